"""The quarter-hour feed as a stream: parse, deduplicate, count by day, cluster, land by day."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import ship
from tidemark.sources.readers import feed_lines


def stream_feed(spark: SparkSession, path: str, pattern: str, kind: str, files_per_batch: int = 96) -> DataFrame:
    """Parsed lines of text files as they land, with event time `ts`."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return feed_lines(lines, pattern, kind).withColumn("ts", F.to_timestamp("DATE", "yyyyMMddHHmmss"))


def first_arrivals(stream: DataFrame, key: str = "DocumentIdentifier", late: str = "2 days") -> DataFrame:
    """The first arrival of each key within the watermark; with files in order that is the earliest."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, hours: int = 8, late: str = "1 day") -> DataFrame:
    """Articles and approximate domains by local day."""
    local = stream.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {hours} HOURS")).withWatermark("ts", late)
    return local.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("SourceCommonName").alias("domains")).select(F.to_date("w.start").alias("day"), "n", "domains")


def clusters(days: DataFrame, by: str = "series", gap: str = "2 days", late: str = "3 days") -> DataFrame:
    """Sessions of the event times of each series that are less than the gap apart; a stream needs the key."""
    found = days.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return found.select(by, "n", "start", "end")


def trailing_spikes(days: DataFrame, span: int = 60, least: int = 15, z: float = 3.5, least_count: int = 4) -> DataFrame:
    """(series, day, n, baseline, z, spike) of a stream of daily counts (series, day, n) in order of days.

    The batch rule looks at days on either side, a stream cannot: here a day is held against the median and
    the median deviation of the `span` days before it, of which there must be `least`; they are the state of a series.
    """
    ship(days.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("day")
        out = []
        for day, n in zip(rows["day"], rows["n"], strict=True):
            before, score, middle = np.array(past[-span:]), None, None
            if len(before) >= least:
                middle = float(np.median(before))
                score = (n - middle) / max(1.4826 * float(np.median(np.abs(before - middle))), 1.0)
            out.append((key[0], day, int(n), middle, score, bool(score is not None and score >= z and n >= least_count)))
            past.append(float(n))
        state.update((past[-span:],))
        yield pd.DataFrame(out, columns=["series", "day", "n", "baseline", "z", "spike"])

    schema = "series string, day date, n long, baseline double, z double, spike boolean"
    return days.select("series", "day", "n").groupBy("series").applyInPandasWithState(run, schema, "past array<double>", "append", GroupStateTimeout.NoTimeout)


def land_by_day(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that is there into day partitions and stop; a restart goes on from the checkpoint, and a batch that
    is run again replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        made = batch.withColumns({"day": F.to_date("ts"), "batch": F.lit(batch_id)})
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there into a table in memory; for small results and tests."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return stream.sparkSession.table(name)
