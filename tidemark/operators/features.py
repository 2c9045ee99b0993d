"""Rain, state and antecedent features by day, without looking ahead."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import nulled, rolling, series
from tidemark.operators.series import days_since, densify, ewm_mean, spell_length, wet_before

#: fixed value: months of the north-east monsoon
MONSOON = (11, 12, 1, 2, 3)
#: how far apart, relatively, values may be that are told equal
TIE = 1e-12


def by_point_and_day(hourly: DataFrame, col: str) -> DataFrame:
    """(point, day, total, peak): a day's sum is 0 where all its hours are missing, its peak is then null."""
    return hourly.groupBy("point", F.to_date("time").alias("day")).agg(F.coalesce(F.sum(col), F.lit(0.0)).alias("total"), F.max(col).alias("peak"))


def rain_daily(hourly: DataFrame, col: str = "precip_mm") -> DataFrame:
    """(day, rain_daily, rain_hourly): the wettest point's total and the largest hour of all points."""
    return by_point_and_day(hourly, col).groupBy("day").agg(F.max("total").alias("rain_daily"), F.max("peak").alias("rain_hourly"))


def daily_stats(hourly: DataFrame, col: str, prefix: str) -> DataFrame:
    return by_point_and_day(hourly, col).groupBy("day").agg(F.avg("total").alias(f"{prefix}_total_mean"), F.max("total").alias(f"{prefix}_total_max"), F.max("peak").alias(f"{prefix}_hourly_max"))


def month_columns(month=None) -> dict:
    m = F.month("day") if month is None else month
    return {"month_sin": F.sin(2 * math.pi * m / 12), "month_cos": F.cos(2 * math.pi * m / 12), "ne_monsoon": m.isin(*MONSOON).cast("int")}


def build_features(rain: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """Features by day from hourly rain (time, point, precip_mm) and forecasts (precip_fcst_d1, precip_fcst_d2).

    All but the nowcast columns use earlier days only.  Lead-1 columns are null on days with
    fewer than 22 forecast hours a point.
    """
    f = densify(daily_stats(rain, "precip_mm", "obs"))
    w = series()
    mean = F.col("obs_total_mean")
    out = {f"obs_1d_{c}": F.lag(f"obs_{c}", 1).over(w) for c in ("total_mean", "total_max", "hourly_max")}
    out |= {f"obs_{n}d_mean": rolling(mean, "sum", -n, -1, n) for n in (3, 7, 14, 30)}
    f = f.withColumns(out).withColumn("_wet", wet_before("obs_total_mean"))
    f = f.withColumn("obs_wet_days_7d", rolling(F.col("_wet"), "sum", -6, 0, 7)).withColumns(month_columns())
    f = f.withColumns({"nowcast_total_max": F.col("obs_total_max"), "nowcast_hourly_max": F.col("obs_hourly_max")})
    f = f.drop("_wet", "obs_total_mean", "obs_total_max", "obs_hourly_max")
    if forecast is None:
        return f
    for k in (1, 2):
        f = f.join(daily_stats(forecast.where(F.col(f"precip_fcst_d{k}").isNotNull()), f"precip_fcst_d{k}", f"fc{k}"), "day", "left")
    points = forecast.agg(F.countDistinct("point").alias("_points"))
    hours = forecast.where("precip_fcst_d1 is not null").groupBy(F.to_date("time").alias("day")).agg(F.count("*").alias("_hours"))
    f = f.join(hours, "day", "left").crossJoin(F.broadcast(points))  # points is one row
    return f.withColumns(nulled(f.columns, ("fc1",), F.col("_hours") / F.col("_points") < 22)).drop("_hours", "_points")


def derived(s: DataFrame) -> DataFrame:
    """29 antecedent features of (day, rain, tcwv_00, soil_00, rh850_00), a dense series.

    Rain counts through the day before.  tcwv_hi_days_7d compares with the quantile of the
    whole series, so it describes and does not forecast.
    """
    w = series()
    hi = s.agg(F.percentile("tcwv_00", F.lit(0.75)).alias("_q"))
    f = s.withColumn("r", F.lag("rain", 1).over(w)).crossJoin(F.broadcast(hi))  # hi is one row
    r, t, soil = F.col("r"), F.col("tcwv_00"), F.col("soil_00")
    f = f.withColumns({f"rain_sum_{n}d": rolling(r, "sum", -n + 1, 0, n) for n in (1, 2, 3, 5, 7, 14, 30)})
    for hl in (1, 2, 4, 8, 16):
        f = ewm_mean(f, "r", hl, hl, name=f"rain_ewm_hl{hl}d")
    f = f.withColumn("_wet", (r > 1).cast("double")).withColumn("wet_days_7d", rolling(F.col("_wet"), "sum", -6, 0, 7))
    f = days_since(spell_length(f, r > 1), "r", 20, name="days_since_20mm")
    f = f.withColumns({
        "dry_days_7d": 7 - F.col("wet_days_7d"), **{f"tcwv_mean_{n}d": rolling(t, "avg", -n + 1, 0, n) for n in (3, 7)},
        "tcwv_max_3d": rolling(t, "max", -2, 0, 3), "tcwv_min_7d": rolling(t, "min", -6, 0, 7), "tcwv_slope_3d": (t - F.lag(t, 2).over(w)) / 2,
        "tcwv_chg_1d": t - F.lag(t, 1).over(w), "_hi": (t > F.col("_q")).cast("double"), "tcwv_dev_from_14d": t - rolling(t, "avg", -14, -1, 10),
        "soil_mean_3d": rolling(soil, "avg", -2, 0, 3), "soil_chg_3d": soil - F.lag(soil, 3).over(w), "rh850_mean_3d": rolling(F.col("rh850_00"), "avg", -2, 0, 3),
    })
    return f.withColumn("tcwv_hi_days_7d", rolling(F.col("_hi"), "sum", -6, 0, 7)).drop("_hi", "_q", "_wet", "r")


def previous_day(hourly: DataFrame, aggregates: dict[str, tuple[str, str]], calendar: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """(day, names...): aggregates {name: (column, how)} of the day before, on the days of a calendar."""
    made = hourly.groupBy(F.to_date("time").alias("day")).agg(*((F.coalesce(F.sum(c), F.lit(0.0)) if how == "sum" else getattr(F, how)(c)).alias(n) for n, (c, how) in aggregates.items()))
    dense = calendar.select("day").join(made, "day", "left")
    return dense.select("day", *(F.lag(n, 1).over(series()).alias(n) for n in aggregates))


def hours_above(hourly: DataFrame, col: str, share: float = 0.75) -> DataFrame:
    """(day, hi_hours, missing_share): hours above the quantile of all hours, and the share without a value.

    Values within a TIE of the quantile, relative to it, are equal to it: equal means of points differ in their last digits by the order of sums.
    """
    edge = hourly.agg(F.percentile(col, F.lit(share)).alias("_q"))
    made = hourly.crossJoin(F.broadcast(edge))  # edge is one row
    above = F.col(col) > F.col("_q") + F.abs("_q") * TIE
    return made.groupBy(F.to_date("time").alias("day")).agg(F.count_if(above).alias("hi_hours"), F.avg(F.col(col).isNull().cast("double")).alias("missing_share"))


def rolling_peak(hourly: DataFrame, cols: Sequence[str], span: int = 3, how: str = "max") -> DataFrame:
    """(day, peak): the day's largest sum of `span` hours of the row-wise maximum or mean over points."""
    from tidemark.functions.columns import row_max, row_mean

    x = row_max(*cols) if how == "max" else row_mean(*cols)
    made = hourly.withColumn("_x", x).withColumn("_s", rolling(F.col("_x"), "sum", -span + 1, 0, span, order="time"))
    return made.groupBy(F.to_date("time").alias("day")).agg(F.max("_s").alias("peak"))
