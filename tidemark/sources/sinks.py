"""Writers.  Spark's commit protocol makes each of them whole or absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n, kind in df.dtypes if kind in ("double", "float")})


def report_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """One CSV file with a header, for reports of bounded size."""
    (rounded(df, digits) if digits is not None else df).coalesce(1).write.mode("overwrite").csv(path, header=True)


def report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def daily_tsv(df: DataFrame, path: str, day: str = "day", missing: DataFrame | None = None) -> None:
    """gzip TSV with a header, a folder for each day; only the days written are replaced.

    missing: (day, ts, kind) of files that could not be had, which goes beside it, to path + ".missing".
    """
    if missing is not None:
        daily_tsv(missing, path.rstrip("/") + ".missing", day)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).csv(path, sep="\t", header=True, compression="gzip")


def pivoted(df: DataFrame, rows: str, columns: str, values: Sequence, how: str = "count", of: str | None = None) -> DataFrame:
    """A wide table with a column for each given value; counts of absent pairs are 0."""
    grouped = df.groupBy(rows).pivot(columns, list(values))
    return grouped.count().fillna(0) if how == "count" else grouped.agg(getattr(F, how)(of))
