"""Interval joins, exclusions and control-day comparisons, written as equi-joins on exploded days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def days_of(events: DataFrame, before: int = 0, after: int = 0, start: str = "start", end: str = "end", keep: Sequence[str] = ()) -> DataFrame:
    """(keep, day): each day of [start - before, end + after]."""
    return events.select(*keep, F.explode(F.sequence(F.date_sub(start, before), F.date_add(end, after), F.expr("INTERVAL 1 DAY"))).alias("day"))


def interval_join(rows: DataFrame, events: DataFrame, keep: Sequence[str] = ("event_id",), start: str = "start", end: str = "end") -> DataFrame:
    """Rows with the events whose interval holds their day.  Intervals are short, so an event is a few
    exploded days and the join is an equi-join that partitions by day."""
    return rows.join(days_of(events, start=start, end=end, keep=keep), "day")


def covered_flag(days: DataFrame, events: DataFrame, margin: int, name: str = "covered") -> DataFrame:
    """name: whether the day lies within `margin` days of an event's interval."""
    near = days_of(events, margin, margin).distinct().withColumn(name, F.lit(True))
    return days.join(near, "day", "left").fillna(False, subset=[name])


def control_percentile(values: DataFrame, events: DataFrame, col: str, window: int = 45, buffer: int = 3, least: int = 20, lag: int = 0) -> DataFrame:
    """(day, value, n_controls, pct): place of each event day's value among control days.

    Controls are days within `window` of the event that have a value and are not within
    `buffer` days of any event.  pct is the share below plus half the share equal; null with
    fewer than `least` controls or no value.  lag: values of so many days before are meant.
    """
    values = values.select(F.date_add("day", lag).alias("day"), F.col(col).alias("c"))
    days = events.select("day").distinct()
    around = days.select(F.col("day").alias("d0"), F.explode(F.sequence(F.date_sub("day", window), F.date_add("day", window), F.expr("INTERVAL 1 DAY"))).alias("day"))
    buffered = days.select(F.explode(F.sequence(F.date_sub("day", buffer), F.date_add("day", buffer), F.expr("INTERVAL 1 DAY"))).alias("day")).distinct()
    controls = around.join(buffered, "day", "left_anti").join(values.where("c is not null"), "day").select("d0", "c")
    own = days.join(values, "day", "left").select(F.col("day").alias("d0"), F.col("c").alias("value"))
    score = F.avg(F.when(F.col("c") < F.col("value"), 1.0).when(F.col("c") == F.col("value"), 0.5).otherwise(0.0))
    got = own.join(controls, "d0", "left").groupBy("d0", "value").agg(F.count("c").alias("n_controls"), score.alias("pct"))
    return got.select(F.col("d0").alias("day"), "value", "n_controls", F.when((F.col("n_controls") >= least) & F.col("value").isNotNull(), F.col("pct")).alias("pct"))


def snapshot(panel: DataFrame, col: str, hour: int, ahead: int, name: str, time: str = "time") -> DataFrame:
    """(day, name): the value at an hour of each day, on the day `ahead` days later."""
    return panel.where(F.hour(time) == hour).select(F.date_add(F.to_date(time), ahead).alias("day"), F.col(col).alias(name))


def onset_peak(hours: DataFrame, onsets: DataFrame, col: str, reach: int = 3) -> DataFrame:
    """(event_id, peak): the largest value within `reach` hours of each onset, on its day.

    hours: day, hour, col; onsets: event_id, day, onset_hour.  The hour is rounded half to even.
    """
    h = F.bround("onset_hour").cast("int")
    span = onsets.select("event_id", "day", F.explode(F.sequence(F.greatest(h - reach, F.lit(0)), F.least(h + reach, F.lit(23)))).alias("hour"))
    return span.join(hours, ["day", "hour"], "left").groupBy("event_id").agg(F.max(col).alias("peak"))
