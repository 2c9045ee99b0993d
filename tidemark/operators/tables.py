"""Aggregations and set operations that are not tied to a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantile_bins(df: DataFrame, col: str, n: int = 5, y: str = "y") -> DataFrame:
    """(bin, n, positives, rate_per_100, low, high): bins between exact quantiles, closed on the right."""
    edges = df.agg(F.percentile(col, [k / n for k in range(1, n)]).alias("_e"))
    place = F.size(F.filter("_e", lambda e: e < F.col(col))).cast("int")
    made = df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bin", place)  # edges is one row
    return made.groupBy("bin").agg(F.count("*").alias("n"), F.sum(y).alias("positives"), (100 * F.avg(y)).alias("rate_per_100"), F.min(col).alias("low"), F.max(col).alias("high"))


def filled_counts(df: DataFrame, col: str, n: int) -> DataFrame:
    """(value, count) for every value from 0 to n - 1."""
    seen = df.groupBy(F.col(col).cast("int").alias("value")).agg(F.count("*").alias("count"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("value")).join(seen, "value", "left").fillna(0)


def null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))


def conditional_medians(df: DataFrame, col: str, flag: Column) -> DataFrame:
    return df.agg(F.percentile(F.when(flag, F.col(col)), F.lit(0.5)).alias("median_yes"), F.percentile(F.when(~flag, F.col(col)), F.lit(0.5)).alias("median_no"))


def lagged_correlations(df: DataFrame, x: str, y: str, lags: Sequence[int] = (-1, 0, 1)) -> DataFrame:
    """(corr_m1, corr_0, corr_p1, ...): correlation of x with y of `lag` rows before."""
    from tidemark.functions.columns import series

    names = {k: f"corr_{'m' if k < 0 else 'p' if k > 0 else ''}{abs(k)}" for k in lags}
    made = df.withColumns({f"_{n}": F.lag(y, k).over(series()) for k, n in names.items()})
    return made.agg(*(F.corr(x, f"_{n}").alias(n) for n in names.values()))


def pooled_and_each(df: DataFrame, key: str, *aggregates: Column, pooled: str = "pooled") -> DataFrame:
    """Aggregates over all rows and by key, in one pass."""
    return df.rollup(key).agg(F.grouping(key).alias("_g"), *aggregates).withColumn(key, F.when(F.col("_g") == 1, pooled).otherwise(F.col(key))).drop("_g")


def range_of(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.percentile(col, F.lit(0.5)).alias("mid"), F.avg(col).alias("mean"))


def label_scheme(features: DataFrame, labels: DataFrame, scheme: str, excluded: Sequence[str], negatives: Sequence[str]) -> DataFrame:
    """Features with the labels of a scheme ("all" leaves out the excluded, "labeled" keeps the known) and y."""
    if scheme not in ("all", "labeled"):
        raise ValueError(f"unknown scheme {scheme!r}")
    d = features.join(labels.select("day", "label_type"), "day")
    d = d.where(~F.col("label_type").isin(*excluded)) if scheme == "all" else d.where(F.col("label_type").isin(*negatives, "flood"))
    return d.withColumn("y", (F.col("label_type") == "flood").cast("int"))
