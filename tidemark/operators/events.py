"""Candidate events, second pass, verdicts and the ordered daily label rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import rolling, series, yes
from tidemark.operators.intervals import covered_flag, days_of, interval_join
from tidemark.operators.series import cluster_days, detect_spikes, trimmed

#: fixed values of the label rules
REJECTED = ("reject", "reject_auto")
POSITIVE = ("confirmed", "probable")
UNSURE = ("uncertain", "unverified")
FINE_TYPES = ("3", "4", "5")
RAIN_LOW, RAIN_HEAVY_DAILY, RAIN_HEAVY_HOURLY = 0.75, 0.90, 0.95


def listed(df: DataFrame, group: str, item: str, top: int, name: str, counts: bool = True, separator: str = "; ") -> DataFrame:
    """(group, name): the most frequent items of each group, "item (count)", ties by name."""
    n = df.where(F.col(item).isNotNull()).groupBy(group, item).agg(F.count("*").alias("_c"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_c"), item))
    text = F.concat(F.col(item), F.lit(" ("), F.col("_c").cast("string"), F.lit(")")) if counts else F.col(item).cast("string")
    kept = n.withColumn("_p", place).where(F.col("_p") <= top).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_p", text.alias("t")))).alias("_l"))
    return kept.select(group, F.array_join(F.transform("_l", lambda x: x["t"]), separator).alias(name))


def build_events(daily: DataFrame, articles: DataFrame, locations: DataFrame, top_places: int = 5, max_gap: int = 2, count: str = "n_strict_my", types: Sequence[str] = FINE_TYPES) -> DataFrame:
    """Events of clustered spike days with the evidence of their days.

    daily: day, spike, counts.  articles: day, url, domain, strict, my_domain, has_target,
    has_selangor, has_kl, n_my_places.  locations: url, type, name, lat, lon.
    """
    events = cluster_days(daily.where("spike").select("day"), max_gap)
    within = interval_join(daily, events)
    peak = within.groupBy("event_id").agg(F.max_by("day", F.struct(F.col(count), -F.unix_date("day"))).alias("peak_day"), F.max(count).alias("peak_count"))
    evidence = interval_join(articles.where("has_target and strict and my_domain"), events)
    totals = evidence.groupBy("event_id").agg(
        F.count("*").alias("n_articles"), F.countDistinct("domain").alias("n_domains"), F.count_if("has_selangor").alias("n_selangor"), F.count_if("has_kl").alias("n_kl"),
    )
    places = evidence.select("event_id", "url").join(locations.where(F.col("type").isin(*types)), "url").withColumn("place", F.substring_index("name", ",", 1))
    centre = places.groupBy("event_id").agg(F.percentile("lat", F.lit(0.5)).alias("lat"), F.percentile("lon", F.lit(0.5)).alias("lon"))
    order = F.row_number().over(Window.partitionBy("event_id").orderBy("n_my_places", "url"))
    urls = evidence.withColumn("_p", order).where("_p <= 3").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("_p", F.col("url").cast("string").alias("u")))).alias("_l"))
    out = events.join(peak, "event_id", "left").join(totals, "event_id", "left").fillna(0, subset=["n_articles", "n_domains", "n_selangor", "n_kl"])
    for part in (listed(places, "event_id", "place", top_places, "top_places"), centre, listed(evidence, "event_id", "domain", 4, "domains", counts=False), urls.select("event_id", F.array_join(F.transform("_l", lambda x: x["u"]), " | ").alias("sample_urls"))):
        out = out.join(part, "event_id", "left")
    return out.fillna("", subset=["top_places", "domains", "sample_urls"])


def second_pass_days(daily: DataFrame, rain: DataFrame, events: DataFrame, rain_daily: float, rain_hourly: float, margin: int, count: str = "n_strict_my", z: float = 2.5, least: int = 3, news: int = 3) -> DataFrame:
    """relaxed_news, rain_news and extra by day: weaker spikes, or heavy rain with some news, away from known events."""
    relaxed = detect_spikes(daily, count, z=z, least_count=least).select("day", F.col("spike").alias("relaxed_news"), count)
    joined = relaxed.join(rain, "day", "left")
    nearby = F.col(count) + F.lead(count, 1, 0).over(series())
    wet = yes((F.col("rain_daily") >= rain_daily) | (F.col("rain_hourly") >= rain_hourly))
    made = joined.withColumn("rain_news", wet & (nearby >= news))
    made = covered_flag(made, events, margin)
    return made.withColumn("extra", (F.col("relaxed_news") | F.col("rain_news")) & ~F.col("covered"))


def stream_tags(flags: DataFrame, events: DataFrame, names: Sequence[str] = ("relaxed_news", "rain_news")) -> DataFrame:
    """(event_id, streams): which flags any day of the event has, joined by +."""
    got = interval_join(flags, events).groupBy("event_id").agg(*(F.bool_or(n).alias(n) for n in names))
    return got.select("event_id", F.concat_ws("+", *(F.when(F.col(n), n) for n in names)).alias("streams"))


def label_table(events: DataFrame, verdicts: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Annotated events in date order: the annotated date, else the peak day; use marks positives."""
    v = verdicts.where(F.col("verdict").isin(*kept))
    joined = v.join(events, "event_id")
    return joined.withColumns({"date": F.coalesce("event_date", "peak_day"), "use": F.col("verdict").isin(*POSITIVE), "lat": F.round("lat", 4), "lon": F.round("lon", 4)}).orderBy("date", "event_id")


def daily_labels(news: DataFrame, rain: DataFrame, events: DataFrame, verdicts: DataFrame, news_max: int = 1, buffer: int = 3) -> DataFrame:
    """label_type and y by day.

    news: day, n_loose, n_strict, n_strict_my.  rain: day, rain_daily, rain_hourly (dense).
    events: event_id, start, end, peak_day.  verdicts: event_id, verdict, event_date.
    The rules are one CASE, the last rule first.  Positive events outside the calendar add a day.
    """
    before = rain.select("day", rolling(F.col("rain_daily"), "max", -3, -1, 3).alias("rain_daily_3d_prior_max"))
    edges = rain.agg(
        *(F.percentile("rain_daily", F.lit(q)).alias(n) for q, n in ((RAIN_LOW, "low_d"), (RAIN_HEAVY_DAILY, "heavy_d"))),
        *(F.percentile("rain_hourly", F.lit(q)).alias(n) for q, n in ((RAIN_LOW, "low_h"), (RAIN_HEAVY_HOURLY, "heavy_h"))),
    )
    d = trimmed(news.join(rain, "day"))
    d = d.withColumn("news_my_2d", F.col("n_strict_my") + F.lead("n_strict_my", 1, 0).over(series())).join(before, "day", "left").crossJoin(F.broadcast(edges))  # edges is one row
    ev = events.join(verdicts, "event_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unverified")))
    d = covered_flag(d, ev.where(~F.col("verdict").isin(*REJECTED)), buffer, "near")
    d = covered_flag(d, ev.where("verdict = 'reject'"), 0, "refuted")

    def on(verdict: tuple[str, ...], name: str, day: Column) -> DataFrame:
        return ev.where(F.col("verdict").isin(*verdict)).select(day.alias("day")).where("day is not null").distinct().withColumn(name, F.lit(True))

    d = d.join(on(UNSURE, "unsure", F.coalesce("event_date", "peak_day")), "day", "left")
    d = d.join(on(POSITIVE, "positive", F.col("event_date")), "day", "full")
    heavy = yes((F.col("rain_daily") >= F.col("heavy_d")) | (F.col("rain_hourly") >= F.col("heavy_h")))
    quiet = yes(F.col("news_my_2d") <= news_max)
    near = yes(F.col("near"))
    easy = yes((F.col("rain_daily") < F.col("low_d")) & (F.col("rain_hourly") < F.col("low_h")) & (F.col("rain_daily_3d_prior_max") < F.col("low_d"))) & quiet & ~near
    moderate = ~easy & ~heavy & ~near & quiet & yes((F.col("rain_daily") >= F.col("low_d")) | (F.col("rain_hourly") >= F.col("low_h")))
    hard = yes(F.col("refuted")) & ~heavy & ~near & ~easy & ~moderate
    label = (
        F.when(yes(F.col("positive")), "flood").when(yes(F.col("unsure")), "uncertain_event").when(hard, "hard_news_negative").when(easy, "easy_negative")
        .when(moderate, "moderate_rain_negative").when(heavy & ~near, "ambiguous_heavy_rain").when(near, "near_event").otherwise("unlabeled")
    )
    d = d.withColumn("label_type", label)
    y = F.when(F.col("label_type") == "flood", 1).when(F.col("label_type").endswith("_negative"), 0)
    return d.withColumn("y", y.cast("int")).select("day", "n_loose", "n_strict", "n_strict_my", "rain_daily", "rain_hourly", "rain_daily_3d_prior_max", "news_my_2d", "label_type", "y")


def pick_urls(articles: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """(event_id, url, place): per event the first article of each domain, by n_my_places and date, then the first n."""
    w = interval_join(articles.where("has_target and strict and my_domain"), events)
    order = ["n_my_places", "day", "url"]
    first = w.withColumn("_d", F.row_number().over(Window.partitionBy("event_id", "domain").orderBy(*order))).where("_d = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy(*order))).where(F.col("place") <= n).select("event_id", "url", F.col("place").cast("long"))


def exclusion_flags(labels: DataFrame, excluded: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """flood, flood_tol (flood on the day or the next), excl_strict and excl_tol."""
    from tidemark.operators.series import shifted_by_days

    d = labels.withColumn("flood", (F.col("label_type") == "flood").cast("int"))
    d = shifted_by_days(d, -1, ["flood"], "_next", by)
    d = d.withColumn("flood_tol", ((F.col("flood") + F.coalesce("flood_next", F.lit(0))) > 0).cast("int"))
    out = F.col("label_type").isin(*excluded)
    return d.withColumns({"excl_strict": out, "excl_tol": out & (F.col("flood_tol") == 0)}).drop("flood_next")


__all__ = ["build_events", "daily_labels", "days_of", "exclusion_flags", "label_table", "listed", "pick_urls", "second_pass_days", "stream_tags"]
