"""Readers with explicit schemas: lazy scans, and pages through a cache; what asks the network is given by the caller."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the feeds, and which tab fields of a raw line they are.
V2_RAW = ("DATE", "url", "V2Locations", "V2Themes")
V1_RAW = ("GKGRECORDID", "DATE", "SourceCommonName", "DocumentIdentifier", "Themes", "Locations")
FEED_FIELDS = {"GKGRECORDID": 0, "DATE": 1, "SourceCommonName": 3, "DocumentIdentifier": 4, "V2Themes": 8, "V2Locations": 10, "V2Tone": 15}
FEED_LEAST = 16
KINDS = ("en", "trans")
MISSING = -999


def strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def raw_csv(spark: SparkSession, path: str, names: Sequence[str] = V1_RAW) -> DataFrame:
    """A CSV export with all columns as strings and blanks as empty strings."""
    return spark.read.schema(strings(names)).csv(path, header=True, multiLine=True, escape='"').fillna("")


def typed_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).csv(path, header=True)


def pruned_scan(spark: SparkSession, path: str, first: str, last: str, patterns: dict[str, str], columns: dict[str, str], partition: str = "day") -> DataFrame:
    """A date-partitioned table: partitions between two days, rows whose columns all match, columns renamed.

    Only the named columns are read, and partitions outside the range are not listed.
    """
    df = spark.read.parquet(path).where(F.col(partition).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    for c, p in patterns.items():
        df = df.where(F.col(c).rlike(p))
    return df.select(*(F.col(c).alias(n) for c, n in columns.items()))


def feed_lines(lines: DataFrame, pattern: str, kind: str, value: str = "value") -> DataFrame:
    """Feed columns of the tab-separated lines that match the pattern and have enough fields, tagged with their collection.

    Takes a batch or a stream of text.
    """
    f = F.split(value, "\t")
    good = lines.where(F.col(value).rlike(pattern)).where(F.size(f) >= FEED_LEAST)
    return good.select(*(F.get(f, F.lit(k)).alias(n) for n, k in FEED_FIELDS.items()), F.lit(kind).alias("Collection"))


def feed_files(spark: SparkSession, path: str, pattern: str, kind: str) -> DataFrame:
    return feed_lines(spark.read.text(path), pattern, kind)


def quarter_hours(days: DataFrame, day: str = "day") -> DataFrame:
    """(day, ts): the 96 quarter hours of each day."""
    start = F.col(day).cast("timestamp_ntz")
    return days.select(day, F.explode(F.sequence(start, start + F.expr("INTERVAL '23:45' HOUR TO MINUTE"), F.expr("INTERVAL 15 MINUTES"))).alias("ts"))


def missing_files(days: DataFrame, landed: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(day, ts, kind) that have not landed: what a resumed download still has to get."""
    kind = days.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return quarter_hours(days).crossJoin(F.broadcast(kind)).join(landed, ["ts", "kind"], "left_anti").select("day", "ts", "kind")  # a row for each kind


def hourly_panel(responses: DataFrame, variables: Sequence[str], point: str = "point", hourly: str = "hourly") -> DataFrame:
    """(time, point, variables...) of responses that hold equal-length arrays in a struct."""
    zipped = F.arrays_zip(*(F.col(f"{hourly}.{v}").alias(v) for v in ("time", *variables)))
    return responses.select(point, F.explode(zipped).alias("h")).select(F.to_timestamp_ntz("h.time").alias("time"), point, *(F.col(f"h.{v}").cast("double").alias(v) for v in variables))


def year_slices(ranges: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """(…, lo, hi): a range cut at the turn of years."""
    year = F.explode(F.sequence(F.year(first), F.year(last))).alias("_y")
    made = ranges.select("*", year)
    return made.withColumns({"lo": F.greatest(F.col(first), F.make_date("_y", F.lit(1), F.lit(1))), "hi": F.least(F.col(last), F.make_date("_y", F.lit(12), F.lit(31)))}).drop("_y")


def gauge_daily(records: DataFrame) -> DataFrame:
    """(day, station, mm) of records DATE, STATION, PRCP in tenths; unreadable amounts are null."""
    return records.select(F.col("DATE").try_cast("date").alias("day"), F.col("STATION").alias("station"), (F.trim("PRCP").try_cast("double") / 10).alias("mm"))


def sea_level(rows: DataFrame) -> DataFrame:
    """(time, sea_level) in metres of rows time, sea_level in millimetres; the row of units and gaps go."""
    made = rows.select(F.regexp_replace("time", "(Z|[+-]00:?00)$", "").try_cast("timestamp_ntz").alias("time"), (F.trim("sea_level").try_cast("double") / 1000).alias("sea_level"))
    return made.where("time is not null and sea_level is not null and not isnan(sea_level)")


def phase_index(lines: DataFrame, value: str = "value") -> DataFrame:
    """(day, pc1, pc2, amp, sector) of lines `y m d pc1 pc2 amp` with missing values as -999."""
    from tidemark.functions.physics import phase_sector

    p = F.split(F.trim(value), r"\s+")
    number = lambda k: F.nullif(F.get(p, F.lit(k)).try_cast("double"), F.lit(float(MISSING)))
    part = lambda k: F.get(p, F.lit(k)).try_cast("int")
    made = lines.where(F.size(p) >= 6).select(F.make_date(part(0), part(1), part(2)).alias("day"), number(3).alias("pc1"), number(4).alias("pc2"), number(5).alias("amp"))
    return made.withColumn("sector", phase_sector(F.col("pc1"), F.col("pc2")))


PAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "meta_date", "title", "text", "error")])


def page_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached pages, one JSON document a file; failed ones have an error and no text."""
    return spark.read.schema(PAGE).json(path, multiLine=True)


def cached_pages(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """urls with the cache's fields by sha1 of the url; fetched says whether there is text."""
    from tidemark.functions.text import cache_key

    known = cache.withColumn("_k", cache_key(F.col("url"))).drop("url")
    return urls.withColumn("_k", cache_key(F.col("url"))).join(known, "_k", "left").drop("_k").withColumn("fetched", F.col("text").isNotNull())


def fetched(urls: DataFrame, get: Callable[[str], tuple[int, str]], tries: int = 3, wait: float = 5.0) -> DataFrame:
    """(url, body, error) of each url, by get(url) -> (status, body) on the executors.

    Answers of 429 and from 500 on and exceptions are tried again, after wait, 2 * wait, ... seconds; then the
    status or the exception's name is the error, and the body is null.
    """
    from tidemark.session import ship

    ship(urls.sparkSession)

    def one(url: str) -> tuple[str | None, str | None]:
        error = None
        for k in range(tries):
            if k:
                time.sleep(wait * k)
            try:
                status, body = get(url)
            except Exception as e:  # noqa: BLE001  old pages fail in many ways
                error = type(e).__name__
                continue
            if status == 200:
                return body, None
            error = f"HTTP {status}"
            if status != 429 and status < 500:
                break
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(u) for u in b["url"]]
            yield pd.DataFrame({"url": b["url"], "body": [x for x, _ in got], "error": [e for _, e in got]}, dtype=object)

    return urls.select("url").mapInPandas(run, "url string, body string, error string")


def pages_through_cache(urls: DataFrame, path: str, get: Callable[[str], tuple[int, str]], tries: int = 1, wait: float = 5.0) -> DataFrame:
    """cached_pages of urls over the Parquet cache at path, after pages that it lacks were fetched, read and added to it.

    Failures are cached too, so a failed url is not asked again.
    """
    from tidemark.functions.text import html_fields

    spark = urls.sparkSession
    ddl = ", ".join(f"{f.name} string" for f in PAGE)
    new = urls.select("url").where("url is not null").distinct().join(optional(spark, path, ddl).select("url"), "url", "left_anti")
    f = html_fields(F.col("body"))
    made = fetched(new, get, tries, wait).withColumn("_f", F.when(F.col("body").isNotNull(), f))
    made.select("url", "_f.meta_date", "_f.title", "_f.text", "error").write.mode("append").parquet(path)
    return cached_pages(urls, spark.read.schema(ddl).parquet(path))


def json_column(df: DataFrame, col: str, ddl: str) -> DataFrame:
    """The fields of a JSON string column beside the others."""
    return df.withColumn("_j", F.from_json(col, ddl)).select(*df.columns, "_j.*")


def optional(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A Parquet table, or an empty one with the schema if the path does not exist."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(ddl).parquet(path) if there else spark.createDataFrame([], ddl)


def union_periods(parts: dict[str, DataFrame], name: str = "period") -> DataFrame:
    """All parts with the key of each; columns that a part lacks are null."""
    out = None
    for key, df in parts.items():
        tagged = df.withColumn(name, F.lit(key))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out
