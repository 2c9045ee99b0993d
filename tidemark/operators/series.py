"""Dense daily series, robust spikes, clusters, spells and other ordered-row operators.

All take `by`, the keys of a series; without keys the series is one calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import rolling, series, yes

#: fixed values of the strict tier and the spike rule
STRICT_DISTANCE = 300
WINDOW, HALF, LEAST, MAD_SCALE = 61, 30, 15, 1.4826


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The earliest row of each key; all other columns break ties, so the result is determined."""
    rest = [c for c in df.columns if c not in {*keys, *order}]
    w = Window.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def calendar(df: DataFrame, by: Sequence[str] = (), day: str = "day") -> DataFrame:
    """Every day from the first to the last of each series."""
    ends = df.groupBy(*by).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi")).where("_lo is not null")
    return ends.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(day))


def densify(df: DataFrame, by: Sequence[str] = (), day: str = "day", zero: Sequence[str] = ()) -> DataFrame:
    """Rows for all days of the calendar; columns in `zero` are 0 on new days, others null."""
    return calendar(df, by, day).join(df, [*by, day], "left").fillna(0, subset=list(zero)) if zero else calendar(df, by, day).join(df, [*by, day], "left")


def near_flood(distance: Column, most: int = STRICT_DISTANCE) -> Column:
    """Within `most` characters, or no distance known."""
    return (distance <= most) | distance.isNull()


def tier_counts(articles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dense daily counts in one pass over articles.

    articles: day, has_target, strict, my_domain, domain, has_selangor, has_kl.
    """
    s = F.col("strict")
    n = lambda c: F.count_if(c).alias
    out = articles.where("has_target").groupBy(*by, "day").agg(
        F.count("*").alias("n_loose"), n(s)("n_strict"), n(s & F.col("my_domain"))("n_strict_my"),
        F.countDistinct(F.when(s, F.col("domain"))).alias("n_strict_domains"), n(s & F.col("has_selangor"))("n_strict_selangor"), n(s & F.col("has_kl"))("n_strict_kl"),
    )
    return densify(out, by, zero=[c for c in out.columns if c.startswith("n_")])


def detect_spikes(daily: DataFrame, col: str = "n_strict_my", half: int = HALF, z: float = 3.5, least_count: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """baseline, z and spike: distance from a centred rolling median in robust deviations.

    The second window takes each row's distance from its own median.
    """
    x = F.col(col)
    made = daily.withColumn("baseline", rolling(x, "median", -half, half, LEAST, by))
    made = made.withColumn("_apart", F.abs(x - F.col("baseline")))
    made = made.withColumn("_mad", rolling(F.col("_apart"), "median", -half, half, LEAST, by))
    score = (x - F.col("baseline")) / F.greatest(MAD_SCALE * F.col("_mad"), F.lit(1.0))
    return made.withColumn("z", score).withColumn("spike", yes((F.col("z") >= z) & (x >= least_count))).drop("_apart", "_mad")


def cluster_days(days: DataFrame, max_gap: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(by, event_id, start, end, n_spike_days) of runs of days no more than max_gap apart."""
    w = F.session_window("_t", f"{max_gap} days")
    found = days.withColumn("_t", F.col("day").cast("timestamp")).groupBy(*by, w).agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("n_spike_days"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("start")).cast("long")
    return found.select(*by, number.alias("event_id"), "start", "end", "n_spike_days")


def trailing_sums(df: DataFrame, col: str, spans: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """{col}_{n}d: sum of the n rows before each row, all of which must have values."""
    return df.withColumns({f"{col}_{n}d": rolling(F.col(col), "sum", -n, -1, n, by) for n in spans})


def wet_before(col: str, above: float = 1.0, keep_null: bool = False, by: Sequence[str] = ()) -> Column:
    """1 where the row before is above a value, else 0.  keep_null: null where that value is missing."""
    before = F.lag(col, 1).over(series(by)) > above
    return (before if keep_null else yes(before)).cast("double")


def wet_day_counts(df: DataFrame, col: str, n: int = 7, above: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """wet_counted (missing counts as dry) and wet_strict (missing makes the count missing)."""
    made = df.withColumns({"_a": wet_before(col, above, False, by), "_b": wet_before(col, above, True, by)})
    return made.withColumns({"wet_counted": rolling(F.col("_a"), "sum", -n + 1, 0, n, by), "wet_strict": rolling(F.col("_b"), "sum", -n + 1, 0, n, by)}).drop("_a", "_b")


def spell_length(df: DataFrame, wet: Column, by: Sequence[str] = (), name: str = "wet_spell_len") -> DataFrame:
    """Length of the run of wet rows that ends at each row: 0 on dry rows, null on missing ones."""
    w = series(by)
    made = df.withColumn("_wet", wet).withColumn("_island", F.sum(F.when(yes(F.col("_wet")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*by, "_island").orderBy("day")
    run = F.sum(yes(F.col("_wet")).cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return made.withColumn(name, F.when(F.col("_wet").isNotNull(), run)).drop("_wet", "_island")


def days_since(df: DataFrame, col: str, at_least: float, by: Sequence[str] = (), name: str = "days_since") -> DataFrame:
    """Rows since the last value of at_least; null before the first, and from a missing value to the next."""
    w = series(by).rowsBetween(Window.unboundedPreceding, 0)
    made = df.withColumn("_island", F.sum(F.col(col).isNull().cast("int")).over(w))
    within = Window.partitionBy(*by, "_island").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(col) >= at_least, F.col("day")), ignorenulls=True).over(within)
    return made.withColumn(name, F.when(F.col(col).isNotNull(), F.datediff("day", last).cast("long"))).drop("_island")


def ewm_mean(df: DataFrame, col: str, halflife: float, least: int, by: Sequence[str] = (), name: str = "ewm", reach: int = 45) -> DataFrame:
    """Exponentially weighted mean with the given half-life in rows, gaps decaying too.

    The frame of a value holds reach * halflife rows: older weights are below 2**-reach of its own.
    A missing value leaves the mean as it was, however long ago that is: all weights shrink alike.
    """
    span = int(reach * halflife)
    w = series(by)
    ordered = df.withColumn("_i", F.row_number().over(w))
    frame = F.collect_list(F.when(F.col(col).isNotNull(), F.struct("_i", F.col(col).alias("x")))).over(w.rowsBetween(-span, 0))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    made = ordered.withColumn("_f", frame).withColumn("_n", F.count(col).over(past))
    weigh = f"power(0.5D, (_i - p._i) / {float(halflife)}D)"
    mean = F.expr(f"try_divide(aggregate(_f, 0D, (a, p) -> a + {weigh} * p.x), aggregate(_f, 0D, (a, p) -> a + {weigh}))")
    made = made.withColumn("_m", F.when(F.col(col).isNotNull(), mean))
    return made.withColumn(name, F.when(F.col("_n") >= least, F.last("_m", ignorenulls=True).over(past))).drop("_i", "_f", "_n", "_m")


def shifted_by_days(df: DataFrame, days: int, columns: Sequence[str], suffix: str, by: Sequence[str] = ()) -> DataFrame:
    """The columns as of `days` days before each row, by the calendar and not by rows."""
    other = df.select(*by, F.date_add("day", days).alias("day"), *(F.col(c).alias(f"{c}{suffix}") for c in columns))
    return df.join(other, [*by, "day"], "left")


def gaps(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """gap: days since the event before."""
    return df.withColumn("gap", F.datediff("day", F.lag("day").over(series(by))).cast("long"))


def neighbour_within(df: DataFrame, spans: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """within_{w}: whether the nearest other event is no more than w days away."""
    w = series(by)
    near = F.least(F.datediff("day", F.lag("day").over(w)), F.datediff(F.lead("day").over(w), "day"))
    return df.withColumn("_near", near).withColumns({f"within_{n}": yes(F.col("_near") <= n) for n in spans}).drop("_near")


def trailing_ratio(df: DataFrame, col: str, name: str, span: int = 60, least: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """(yesterday + 1) / (mean of the `span` days before yesterday + 1)."""
    before = F.lag(col, 1).over(series(by))
    return df.withColumn(name, (before + 1) / (rolling(F.col(col), "avg", -span - 1, -2, least, by) + 1))


def midrank(col: str, by: Sequence[str] = ()) -> Column:
    """Average rank of ties, as a share of the rows that have a value."""
    have = F.col(col).isNotNull()
    place = Window.partitionBy(*by, have).orderBy(col)
    ties = F.count("*").over(Window.partitionBy(*by, col))
    total = F.count(col).over(Window.partitionBy(*by))
    return F.when(have, (F.rank().over(place) + (ties - 1) / 2) / total)


def composite_rank(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), name: str = "composite") -> DataFrame:
    """Mean of the columns' midranks within each group, of those that have a value."""
    from tidemark.functions.columns import row_mean

    made = df.withColumns({f"_r_{c}": midrank(c, by) for c in columns})
    return made.withColumn(name, row_mean(*(f"_r_{c}" for c in columns))).drop(*(f"_r_{c}" for c in columns))


def event_before(df: DataFrame, flag: str, spans: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """prior_{w}: whether one of the w rows before has the flag."""
    return df.withColumns({f"prior_{n}": yes(F.max(flag).over(series(by).rowsBetween(-n, -1)) > 0) for n in spans})


def past_quantile_rank(df: DataFrame, col: str, share: float, least: int = 90, by: Sequence[str] = ()) -> DataFrame:
    """past_alert: value at or above the quantile of all rows before it, of which there must be `least`."""
    w = series(by).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.when(F.count(col).over(w) >= least, F.percentile(F.col(col), F.lit(share)).over(w))
    return df.withColumn("past_edge", edge).withColumn("past_alert", F.col(col) >= F.col("past_edge"))


def trimmed(df: DataFrame, head: int = 7, tail: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Without the first `head` and last `tail` days of each series."""
    w = Window.partitionBy(*by)
    made = df.withColumns({"_lo": F.min("day").over(w), "_hi": F.max("day").over(w)})
    return made.where(f"day between date_add(_lo, {head}) and date_sub(_hi, {tail})").drop("_lo", "_hi")
