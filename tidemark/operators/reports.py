"""State and moisture features, and the reports that put features, folds and measures together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import physics, text
from tidemark.functions.columns import all_present, nulled, rolling, series
from tidemark.operators import evaluation as ev
from tidemark.operators import events, features, intervals
from tidemark.operators import series as op
from tidemark.session import ship
from tidemark.sources.readers import union_periods

# When the regional model's archive starts, and the columns of its part.
NWP_START = "2021-04-01"
NWP_PREFIXES = ("cape", "li_", "lapse", "t850", "rh850", "u850", "v850", "now_cape", "now_li")
ERA5 = ("temperature_2m", "dew_point_2m", "surface_pressure", "relative_humidity_2m", "cloud_cover", "shortwave_radiation", "boundary_layer_height", "soil_moisture_0_to_7cm", "total_column_integrated_water_vapour")
NWP = ("temperature_850hPa", "temperature_500hPa", "relative_humidity_850hPa", "cape", "lifted_index")


def era5_area(panel: DataFrame) -> DataFrame:
    a = physics.area_mean(panel, list(ERA5), [("wind_speed_10m", "wind_direction_10m", "u10", "v10")])
    return a.withColumn("theta_e", physics.theta_e(F.col("temperature_2m"), F.col("dew_point_2m"), F.col("surface_pressure")))


def nwp_area(panel: DataFrame) -> DataFrame:
    a = physics.area_mean(panel, list(NWP), [("wind_speed_850hPa", "wind_direction_850hPa", "u850", "v850")])
    return a.withColumn("lapse", F.col("temperature_850hPa") - F.col("temperature_500hPa"))


def _joined(calendar: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "day", "left"), parts, calendar)


def _same_day(hourly: DataFrame, aggregates: Mapping[str, tuple[str, str]]) -> DataFrame:
    return hourly.groupBy(F.to_date("time").alias("day")).agg(*(getattr(F, how)(c).alias(n) for n, (c, how) in aggregates.items()))


def state_features(era5: DataFrame, nwp: DataFrame | None = None, cape_forecast: DataFrame | None = None) -> DataFrame:
    """Features of the air by day: summaries of the day before, states at 00:00, and the day itself as now_*.

    era5, nwp: hourly panels (time, point, variables).  cape_forecast: time, cape_previous_day1.
    """
    e = era5_area(era5)
    water, dew, warm, moist = "total_column_integrated_water_vapour", "dew_point_2m", "temperature_2m", "theta_e"
    days = op.calendar(e.select(F.to_date("time").alias("day")))
    before = {
        "tcwv_d1_mean": (water, "avg"), "tcwv_d1_max": (water, "max"), "dewp_d1_mean": (dew, "avg"), "t2m_d1_max": (warm, "max"), "thetae_d1_max": (moist, "max"), "thetae_d1_mean": (moist, "avg"),
        "rh_d1_mean": ("relative_humidity_2m", "avg"), "cloud_d1_mean": ("cloud_cover", "avg"), "sw_d1_sum": ("shortwave_radiation", "sum"), "blh_d1_max": ("boundary_layer_height", "max"), "u10_d1": ("u10", "avg"), "v10_d1": ("v10", "avg"),
    }
    at = [intervals.snapshot(e, c, 0, 0, n) for c, n in ((water, "tcwv_00"), (moist, "thetae_00"), (dew, "dewp_00"), ("soil_moisture_0_to_7cm", "soil_00"))]
    now = _same_day(e, {"now_tcwv_mean": (water, "avg"), "now_thetae_max": (moist, "max"), "now_t2m_max": (warm, "max"), "now_cloud_mean": ("cloud_cover", "avg")})
    f = _joined(days, [features.previous_day(e, before, days), *at, now])
    f = f.withColumn("tcwv_delta24", F.col("tcwv_00") - F.lag("tcwv_00", 1).over(series()))
    if nwp is not None:
        n = nwp_area(nwp)
        before = {
            "cape_d1_max": ("cape", "max"), "cape_d1_mean": ("cape", "avg"), "li_d1_min": ("lifted_index", "min"), "lapse_d1_mean": ("lapse", "avg"), "t850_d1_mean": ("temperature_850hPa", "avg"),
            "rh850_d1_mean": ("relative_humidity_850hPa", "avg"), "u850_d1": ("u850", "avg"), "v850_d1": ("v850", "avg"),
        }
        at = [intervals.snapshot(n, c, 0, 0, k) for c, k in (("cape", "cape_00"), ("relative_humidity_850hPa", "rh850_00"), ("temperature_850hPa", "t850_00"))]
        f = _joined(f, [features.previous_day(n, before, days), *at, _same_day(n, {"now_cape_max": ("cape", "max"), "now_li_min": ("lifted_index", "min")})])
        f = f.withColumns(nulled(f.columns, NWP_PREFIXES, F.col("day") < F.lit(NWP_START).cast("date")))
    if cape_forecast is not None:
        c = cape_forecast.groupBy("time").agg(F.avg("cape_previous_day1").alias("c"))
        f = f.join(_same_day(c, {"cape_fc1_max": ("c", "max")}), "day", "left")
    return f


def moisture_features(era5: DataFrame, nwp: DataFrame, points: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Water vapour, its changes and gaps, flux convergence of the lowest level and flux at 850 hPa, by day.

    mfc_d1_min is, for all its name, the most convergent hour of the day before.
    """
    e = era5_area(era5)
    water, w = "total_column_integrated_water_vapour", series()
    days = op.calendar(e.select(F.to_date("time").alias("day")))
    mean = op.densify(_same_day(e, {"_m": (water, "avg")})).withColumn("_mean60", rolling(F.col("_m"), "avg", -60, -1, 30)).drop("_m")
    f = _joined(days, [intervals.snapshot(e, water, 0, 0, "tcwv_00"), intervals.snapshot(e, water, 18, 1, "_18"), mean, features.hours_above(e, water)])
    f = f.withColumns({
        "tcwv_anom_00": F.col("tcwv_00") - F.col("_mean60"), "tcwv_chg6_00": F.col("tcwv_00") - F.col("_18"), "tcwv_chg24_00": F.col("tcwv_00") - F.lag("tcwv_00", 1).over(w),
        "tcwv_hi_hours_d1": F.lag("hi_hours", 1).over(w), "tcwv_missing": F.coalesce("missing_share", F.lit(0.0)),
    }).drop("_18", "_mean60", "hi_hours", "missing_share")
    u, v = physics.wind_uv(F.col("wind_speed_10m"), F.col("wind_direction_10m"))
    q = physics.specific_humidity_surface(F.col("dew_point_2m"), F.col("surface_pressure"))
    mfc = physics.flux_convergence(era5.withColumns({"qu": q * u, "qv": q * v}), points, "qu", "qv")
    f = _joined(f, [intervals.snapshot(mfc, "mfc", 0, 0, "mfc_00"), features.previous_day(mfc, {"mfc_d1_min": ("mfc", "max"), "mfc_d1_mean": ("mfc", "avg")}, days)])
    n = nwp_area(nwp).withColumn("q850", physics.specific_humidity_850(F.col("temperature_850hPa"), F.col("relative_humidity_850hPa")) * 1000)
    n = n.withColumns({"fluxu850": F.col("q850") * F.col("u850"), "fluxv850": F.col("q850") * F.col("v850"), "spd850": F.hypot("u850", "v850")})
    f = _joined(f, [intervals.snapshot(n, c, 0, 0, f"{c}_00") for c in ("q850", "fluxu850", "fluxv850", "spd850")])
    f = f.withColumn("ivt_proxy_00", F.col("tcwv_00") * F.col("spd850_00")).drop("spd850_00")
    return f.withColumns(nulled(f.columns, ("q850", "flux", "ivt"), F.col("day") < F.lit(NWP_START).cast("date")))


def tide_daily(hourly: DataFrame, col: str = "tide_m") -> DataFrame:
    return hourly.groupBy(F.to_date("time").alias("day")).agg(F.max(col).alias("high"), F.min(col).alias("low"))


def compared(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """(n, mean_a, mean_b, corr_same, corr_next): two daily series, the second also taken a day later."""
    x, y = a.select("day", F.col(col).alias("a")), b.select("day", F.col(col).alias("b"))
    j = op.shifted_by_days(x.join(y, "day"), -1, ["b"], "_next")
    return j.agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.corr("a", "b").alias("corr_same"), F.corr("a", "b_next").alias("corr_next"))


# ---------------------------------------------------------------- model reports


def folded_z_scores(folds: DataFrame, raw: Sequence[str], sets: dict[str, Sequence[str]], c: float = 0.1, y: str = "y", least: int = 3) -> DataFrame:
    """logistic_scores on seasonal z-scores z_{column}, whose climatology each fold fits on its own train rows."""
    ship(folds.sparkSession)
    columns = sorted({*raw, *(x for s in sets.values() for x in s if not x.startswith("z_"))})
    kind = folds.schema["fold"].dataType.simpleString()
    wanted = {n: list(s) for n, s in sets.items()}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        t = 2 * np.pi * pd.to_datetime(pdf["day"]).dt.dayofyear.to_numpy() / 365.25
        design = np.column_stack([np.ones(len(t)), *(f(h * t) for h in (1, 2) for f in (np.sin, np.cos))])
        train, y_all = (pdf["part"] == "train").to_numpy(), pdf["y"].to_numpy(float)
        for name in raw:
            x = pdf[name].to_numpy(float)
            ok = train & ~np.isnan(x)
            if ok.sum() < design.shape[1]:
                pdf[f"z_{name}"] = np.nan
                continue
            mean = design @ np.linalg.lstsq(design[ok], x[ok], rcond=None)[0]
            spread = design @ np.linalg.lstsq(design[ok], np.abs(x - mean)[ok], rcond=None)[0] * np.sqrt(np.pi / 2)
            pdf[f"z_{name}"] = (x - mean) / np.maximum(spread, 1e-6)
        out = []
        for model, cols in wanted.items():
            score = np.full((~train).sum(), np.nan)
            if least <= y_all[train].sum() < train.sum():
                fit = ev.fit_logistic(pdf.loc[train, cols].to_numpy(float), y_all[train], c)
                score = ev.predict_logistic(fit, pdf.loc[~train, cols].to_numpy(float))
            out.append(pd.DataFrame({"model": model, "fold": key[0], "day": pdf.loc[~train, "day"], "y": pdf.loc[~train, "y"], "score": score}))
        made = pd.concat(out)
        return made.astype(object).where(made.notna(), None)

    rows = folds.select("fold", "part", "day", F.col(y).cast("int").alias("y"), *(F.col(x).cast("double").alias(x) for x in columns))
    return rows.groupBy("fold").applyInPandas(run, f"model string, fold {kind}, day date, y int, score double")


def summary(scores: DataFrame, probabilistic: Sequence[str] = (), n_boot: int = 2000, n_perm: int = 2000, seed: int = 0, chunk: int = 250) -> DataFrame:
    """A row for each model of (model, day, y, score, alert): days, floods, base rate, AP with a month-block interval and a
    permutation p, ROC, Brier for the probabilistic ones, contingency and budget captures.

    All resampling is one job: a group is one model's days and one chunk of replicates.
    """
    ship(scores.sparkSession)
    s = scores.where("score is not null")
    by = ["model"]
    base = s.groupBy("model").agg(F.count("*").alias("n_days"), F.sum("y").alias("n_flood"), F.avg("y").alias("base_rate"))
    brier = ev.brier(s.where(F.col("model").isin(*probabilistic)), by) if probabilistic else None
    parts = [ev.average_precision(s, by), ev.roc_auc(s, by), ev.contingency(s, by), ev.budget_capture(s, by=by), *([brier] if brier is not None else [])]
    chunks = s.sparkSession.range(0, max(n_boot, n_perm), chunk).select(F.col("id").alias("first"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day", "score"])
        y, x, months, out = pdf["y"].to_numpy(float), pdf["score"].to_numpy(float), pdf["month"], []
        for r in range(key[1], key[1] + chunk):
            g = np.random.default_rng([seed, r])
            if r < n_boot:
                out.append(("boot", ev.ap_of(y, x, ev._month_weights(months, g))))
            if r < n_perm:
                out.append(("perm", ev.ap_of(g.permutation(y), x)))
        return pd.DataFrame({"model": key[0], "kind": [k for k, _ in out], "value": [v for _, v in out]})

    rows = s.select("model", "day", F.trunc("day", "month").alias("month"), "y", "score").crossJoin(F.broadcast(chunks))  # a row for each chunk of replicates
    drawn = rows.groupBy("model", "first").applyInPandas(run, "model string, kind string, value double").where("not isnan(value)")
    only = lambda k: F.when(F.col("kind") == k, F.col("value"))
    joined = drawn.join(parts[0], "model")
    ci = joined.groupBy("model").agg(F.percentile(only("boot"), F.lit(0.025)).alias("ap_lo"), F.percentile(only("boot"), F.lit(0.975)).alias("ap_hi"), F.avg(F.when(F.col("kind") == "perm", (F.col("value") >= F.col("ap") - 1e-12).cast("double"))).alias("perm_p"))
    return reduce(lambda a, b: a.join(b, "model", "left"), [*parts, ci], base)


def evaluate_sets(data: DataFrame, sets: Mapping[str, Sequence[str] | str], composite: Sequence[str], period: str = "period", purge: int = 7) -> DataFrame:
    """(model, day, y, score) of feature sets: lists go through purged quarters, a single column is ranked with gaps at
    its median, "composite" is the mean rank of the given columns within periods."""
    parts = []
    lists = {n: list(s) for n, s in sets.items() if not isinstance(s, str)}
    if lists:
        parts.append(ev.logistic_scores(ev.purged_quarters(data, purge), lists, least=3).select("model", "day", "y", "score"))
    for name, s in sets.items():
        if s == "composite":
            made = op.composite_rank(data, composite, [period], "score")
        elif isinstance(s, str):
            middle = data.agg(F.percentile(s, F.lit(0.5)).alias("_m"))
            made = data.crossJoin(F.broadcast(middle)).withColumn("_x", F.coalesce(F.col(s).cast("double"), "_m"))  # middle is one row
            made = made.withColumn("score", op.midrank("_x"))
        else:
            continue
        parts.append(made.select(F.lit(name).alias("model"), "day", F.col("y").cast("int").alias("y"), F.col("score").cast("double").alias("score")))
    return reduce(DataFrame.unionByName, parts)


def lag_profile(values: DataFrame, floods: DataFrame, columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """(series, lag, n, mean_pct): mean place among control days of each column on the days before floods."""
    parts = [
        intervals.control_percentile(values, floods, c, lag=k).agg(F.count("pct").alias("n"), F.avg("pct").alias("mean_pct")).select(F.lit(c).alias("series"), F.lit(k).alias("lag"), "n", "mean_pct")
        for c in columns
        for k in lags
    ]
    return reduce(DataFrame.unionByName, parts)


def precursors(values: DataFrame, floods: DataFrame, columns: Sequence[str], least_values: int = 100, least_events: int = 10) -> DataFrame:
    """lag_profile at lag 0 of the columns with more than `least_values` values, where at least `least_events` events count."""
    have = values.agg(*(F.count(c).alias(c) for c in columns)).first()
    used = [c for c in columns if have[c] > least_values]
    return lag_profile(values, floods, used, [0]).where(F.col("n") >= least_events).drop("lag") if used else values.sparkSession.createDataFrame([], "series string, n long, mean_pct double")


def event_rain_ranks(local: DataFrame, area: DataFrame, details: DataFrame, window: int = 45, buffer: int = 3, reach: int = 3) -> DataFrame:
    """(event_id, n_controls, and for each statistic its value on the event's day and its place among control days, *_pct).

    Statistics: area_day, local_day (totals), local_peak3, area_peak3 (largest 3-hour sums of the day), local_window3 and
    area_window3 (within `reach` hours of the onset hour, where there is one).  Areas count their wettest point.  Controls are
    days within `window` of the event with local rain, not within `buffer` of any event.  A missing value has place 0.

    local: event_id, time, mm.  area: point, time, mm.  details: event_id, day, onset_hour.
    """
    three = lambda df, by: df.withColumn("s", rolling(F.col("mm"), "sum", -2, 0, 3, [by], "time")).withColumns({"day": F.to_date("time"), "hour": F.hour("time")})
    near, wide = three(local, "event_id"), three(area, "point")
    own = near.groupBy("event_id", "day").agg(F.coalesce(F.sum("mm"), F.lit(0.0)).alias("local_day"), F.max("s").alias("local_peak3"))
    total = features.by_point_and_day(area.withColumnRenamed("mm", "_mm"), "_mm").groupBy("day").agg(F.max("total").alias("area_day"))
    whole = total.join(wide.groupBy("day").agg(F.max("s").alias("area_peak3")), "day", "left")

    around = details.select("event_id", "onset_hour", F.col("day").alias("d0"), F.explode(F.sequence(F.date_sub("day", window), F.date_add("day", window))).alias("day"))
    flooded = details.select(F.explode(F.sequence(F.date_sub("day", buffer), F.date_add("day", buffer))).alias("day")).distinct()
    controls = around.join(flooded, "day", "left_anti").join(own.select("event_id", "day"), ["event_id", "day"], "left_semi")
    days = controls.select("event_id", "day", "onset_hour", F.lit(False).alias("own")).unionByName(details.select("event_id", "day", "onset_hour", F.lit(True).alias("own")))

    h = F.bround("onset_hour").cast("int")
    hours = days.where("onset_hour is not null").select("event_id", "day", F.explode(F.sequence(F.greatest(h - reach, F.lit(0)), F.least(h + reach, F.lit(23)))).alias("hour"))
    by_hour = wide.groupBy("day", "hour").agg(F.max("s").alias("s"))
    windows = hours.join(near.select("event_id", "day", "hour", F.col("s").alias("a")), ["event_id", "day", "hour"], "left").join(by_hour.withColumnRenamed("s", "b"), ["day", "hour"], "left")
    windows = windows.groupBy("event_id", "day").agg(F.max("a").alias("local_window3"), F.max("b").alias("area_window3"))
    full = days.join(own, ["event_id", "day"], "left").join(whole, "day", "left").join(windows, ["event_id", "day"], "left")

    names = ("area_day", "local_day", "local_peak3", "area_peak3", "local_window3", "area_window3")
    mine = Window.partitionBy("event_id")  # an event's days: 2 * window + 1 at most
    full = full.withColumns({f"_{n}": F.max(F.when(F.col("own"), F.col(n))).over(mine) for n in names})
    place = lambda n: F.avg(F.when(~F.col("own") & F.col(n).isNotNull(), F.when(F.col(n) < F.col(f"_{n}"), 1.0).when(F.col(n) == F.col(f"_{n}"), 0.5).otherwise(0.0)))
    timed = F.max("onset_hour").isNotNull()
    return full.groupBy("event_id").agg(
        F.count_if(~F.col("own")).alias("n_controls"), *(F.max(f"_{n}").alias(n) for n in names),
        *((F.when(timed, place(n)) if n.endswith("window3") else place(n)).alias(f"{n}_pct") for n in names),
    )


# ---------------------------------------------------------------- periods and drivers


def assembled(parts: Mapping[str, tuple[DataFrame, DataFrame, DataFrame]], excluded: Sequence[str], most_missing: float = 0.5) -> DataFrame:
    """Days of all periods with features, news features and labels, and the strict and tolerant flags of exclusion_flags.

    parts: period: (features, news, labels with day and label_type).  Days with a share tcwv_missing of `most_missing` or more go;
    null counts as missing.  The day after is looked up within the period.
    """
    made = {k: f.join(news, "day", "left").join(labels.select("day", "label_type"), "day") for k, (f, news, labels) in parts.items()}
    data = union_periods(made).where(F.col("tcwv_missing") < most_missing)
    return events.exclusion_flags(data, excluded, ["period"])


def flood_days(labels: Mapping[str, DataFrame]) -> DataFrame:
    """(day): the flood days of all periods, once for each period that has them."""
    return union_periods(dict(labels)).where("label_type = 'flood'").select("day")


def daily_series(rains: Sequence[DataFrame], states: DataFrame) -> DataFrame:
    """(day, rain, states...) on every day: the wettest point's total, of the first period that has the day, beside the states.

    rains: hourly panels (time, point, precip_mm) of periods, in order.
    """
    tagged = [features.rain_daily(r).select("day", F.col("rain_daily").alias("rain"), F.lit(k).alias("_k")) for k, r in enumerate(rains)]
    rain = op.first_per_key(reduce(DataFrame.unionByName, tagged), ["day"], ["_k"]).drop("_k")
    return op.densify(rain.join(states, "day", "full"))


def scores_by_period(data: DataFrame, scores: Sequence[str], y: str = "y", period: str = "period") -> DataFrame:
    """(period, score, n_days, n_flood, base, ap, roc, median_flood, median_other) of each score column, pooled and by period,
    over the days on which all of them have a value."""
    ok = data.where(all_present(*scores))
    both = ok.withColumn("period", F.explode(F.array(F.lit("pooled"), F.col(period).cast("string"))))
    long = both.select("period", F.col(y).cast("int").alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("score")) for c in scores))).alias("_s")).select("period", F.col("_s.name").alias("name"), "y", F.col("_s.score").alias("score"))
    by = ["period", "name"]
    middle = lambda v: F.percentile(F.when(F.col("y") == v, F.col("score")), F.lit(0.5))
    base = long.groupBy(*by).agg(F.count("*").alias("n_days"), F.sum("y").alias("n_flood"), F.avg("y").alias("base"), middle(1).alias("median_flood"), middle(0).alias("median_other"))
    return base.join(ev.average_precision(long, by), by, "left").join(ev.roc_auc(long, by), by, "left").withColumnRenamed("name", "score")


def pooled_scores(folds: DataFrame, sets: Mapping[str, Sequence[str]], ranks: Mapping[str, str], c: float = 0.1) -> DataFrame:
    """(model, fold, day, y, score, threshold, alert) of the climatology, the ranked columns and the logistic models over the same folds.

    Folds whose train rows have fewer than two positives give no rows.
    """
    used = ev.usable_folds(folds)
    named = lambda df, n: df.select(F.lit(n).alias("model"), "fold", "day", F.col("y").cast("int").alias("y"), F.col("score").cast("double").alias("score"), F.col("threshold").cast("double").alias("threshold"))
    parts = [named(ev.climatology(used), "climatology"), *(named(ev.rank_baseline(used, col), name) for name, col in ranks.items())]
    fitted = ev.logistic_scores(used, {f"logistic: {n}": s for n, s in sets.items()}, c)
    return reduce(DataFrame.unionByName, [*parts, fitted.select(*parts[0].columns)]).withColumn("alert", F.col("score") >= F.col("threshold"))


def combined_report(parts: Mapping[str, DataFrame], cutoffs: Sequence[str], sets: Mapping[str, Sequence[str]], ranks: Mapping[str, str], n_boot: int = 2000, n_perm: int = 2000) -> DataFrame:
    """The summary row of every model over the pooled days (day, y, columns...) of all periods."""
    scores = pooled_scores(ev.expanding_folds(union_periods(dict(parts)), cutoffs), sets, ranks)
    return summary(scores, ["climatology", *(f"logistic: {n}" for n in sets)], n_boot, n_perm)


def sampling_report(articles: DataFrame, found: DataFrame, pages: DataFrame, n: int = 6) -> DataFrame:
    """(event_id, samples): for each event the picked urls with page titles and their first flood sentences, for JSON."""
    picked = events.pick_urls(articles, found, n).join(pages.select("url", "title", "text"), "url", "left")
    one = F.struct("place", "url", "title", text.flood_sentences(F.coalesce("text", F.lit(""))).alias("flood_sentences"))
    return picked.groupBy("event_id").agg(F.sort_array(F.collect_list(one)).alias("samples"))  # n a group at most


def memoised(spark: SparkSession, path: str, made: DataFrame, key: str) -> DataFrame:
    """Rows by key that are kept in a partitioned table: keys already there are not made again."""
    from tidemark.sources.readers import optional

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    known = optional(spark, path, ddl)
    made.join(known.select(key).distinct(), key, "left_anti").write.mode("append").partitionBy(key).parquet(path)
    return spark.read.schema(ddl).parquet(path)
