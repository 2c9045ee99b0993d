"""Queries on daily series: orders stand for articles, line items for rain, order and ship dates for days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import rolling, series
from tidemark.operators import events as ev
from tidemark.operators import features, intervals, tables
from tidemark.operators import series as op

QUERIES, ORACLE = {}, {}
#: thresholds for these tables, whose days have a handful of orders
SPIKE = {"z": 1.5, "least_count": 2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- the tables that stand in


def articles(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_orderdate") + F.expr("INTERVAL 8 HOURS")).cast("date").alias("day"), F.col("o_orderkey").alias("url"), (F.col("o_orderstatus") != "P").alias("has_target"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("strict"), (F.col("o_custkey") % 3 != 0).alias("my_domain"), F.col("o_custkey").alias("domain"),
        (F.col("o_orderstatus") == "O").alias("has_selangor"), (F.col("o_orderstatus") == "F").alias("has_kl"), (F.col("o_custkey") % 7).alias("n_my_places"),
    )


A = """a AS (SELECT CAST(o_orderdate + INTERVAL 8 HOUR AS DATE) AS day, o_orderkey AS url, o_orderstatus <> 'P' AS has_target,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS strict, o_custkey % 3 <> 0 AS my_domain, o_custkey AS domain,
  o_orderstatus = 'O' AS has_selangor, o_orderstatus = 'F' AS has_kl, o_custkey % 7 AS n_my_places FROM orders)"""
DAILY = (
    A
    + """,
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM a WHERE has_target),
cnt AS (SELECT day, count(*) AS n_loose, count(*) FILTER (strict) AS n_strict, count(*) FILTER (strict AND my_domain) AS n_strict_my,
  count(DISTINCT CASE WHEN strict THEN domain END) AS n_strict_domains, count(*) FILTER (strict AND has_selangor) AS n_strict_selangor,
  count(*) FILTER (strict AND has_kl) AS n_strict_kl FROM a WHERE has_target GROUP BY day),
daily AS (SELECT cal.day, coalesce(n_loose, 0) AS n_loose, coalesce(n_strict, 0) AS n_strict, coalesce(n_strict_my, 0) AS n_strict_my,
  coalesce(n_strict_domains, 0) AS n_strict_domains, coalesce(n_strict_selangor, 0) AS n_strict_selangor, coalesce(n_strict_kl, 0) AS n_strict_kl
  FROM cal LEFT JOIN cnt USING (day))"""
)


def spikes_sql(name: str, z: float, least: int) -> str:
    return f"""
{name}0 AS (SELECT *, CASE WHEN count(n_strict_my) OVER w >= 15 THEN median(n_strict_my) OVER w END AS baseline FROM daily
  WINDOW w AS (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)),
{name}1 AS (SELECT *, abs(n_strict_my - baseline) AS apart FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN count(apart) OVER w >= 15 THEN median(apart) OVER w END AS mad FROM {name}1
  WINDOW w AS (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)),
{name} AS (SELECT * EXCLUDE (apart, mad), (n_strict_my - baseline) / greatest(1.4826 * mad, 1.0) AS z,
  coalesce((n_strict_my - baseline) / greatest(1.4826 * mad, 1.0) >= {z} AND n_strict_my >= {least}, false) AS spike FROM {name}2)"""


SPIKES = DAILY + "," + spikes_sql("sp", SPIKE["z"], SPIKE["least_count"])
CLUSTERS = (
    SPIKES
    + """,
sd AS (SELECT day, CASE WHEN day - lag(day) OVER (ORDER BY day) <= 2 THEN 0 ELSE 1 END AS fresh FROM sp WHERE spike),
grp AS (SELECT day, sum(fresh) OVER (ORDER BY day) AS event_id FROM sd),
ev AS (SELECT CAST(event_id AS BIGINT) AS event_id, min(day) AS "start", max(day) AS "end", count(*) AS n_spike_days FROM grp GROUP BY event_id)"""
)


def rain_panel(spark: SparkSession, d: str) -> DataFrame:
    """Hourly rain: a line item is an amount at a point, its line number the hour."""
    li = table(spark, d, "lineitem")
    time = F.date_trunc("day", "l_shipdate") + F.make_interval(hours=F.col("l_linenumber").cast("int"))
    return li.select(F.concat(F.lit("p"), F.col("l_suppkey") % 5).alias("point"), time.cast("timestamp_ntz").alias("time"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("precip_mm"))


R = """r AS (SELECT 'p' || CAST(l_suppkey % 5 AS VARCHAR) AS point, CAST(l_shipdate AS DATE) AS day, l_linenumber AS hour,
  CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS mm FROM lineitem),
pd AS (SELECT point, day, coalesce(sum(mm), 0) AS total, max(mm) AS peak FROM r GROUP BY point, day),
rain0 AS (SELECT day, max(total) AS rain_daily, max(peak) AS rain_hourly, avg(total) AS total_mean FROM pd GROUP BY day),
rcal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM rain0),
rain AS (SELECT day, rain_daily, rain_hourly, total_mean FROM rcal LEFT JOIN rain0 USING (day))"""


def rain_days(spark: SparkSession, d: str) -> DataFrame:
    return op.densify(features.rain_daily(rain_panel(spark, d))).cache()  # a row for each day


def daily(spark: SparkSession, d: str) -> DataFrame:
    return op.tier_counts(articles(spark, d)).cache()  # a row for each day, read by several branches


def spiky(spark: SparkSession, d: str) -> DataFrame:
    return op.detect_spikes(daily(spark, d), **SPIKE).cache()


def r6(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- queries


@query("""SELECT * EXCLUDE (k) FROM (SELECT user_id, ts, event_id, event_type, value, props,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type, value, props) AS k FROM events) WHERE k = 1""")
def dedupe_keep_earliest(spark, d):
    return op.first_per_key(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value", "props"), ["user_id"], ["ts"])


@query(f"WITH {DAILY} SELECT * FROM daily")
def daily_tier_counts_dense(spark, d):
    return daily(spark, d)


@query(f"WITH {SPIKES} SELECT day, n_strict_my, round(baseline, 6) AS baseline, round(z, 6) AS z, spike FROM sp")
def spike_robust_z(spark, d):
    return r6(spiky(spark, d).select("day", "n_strict_my", "baseline", "z", "spike"), "baseline", "z")


@query(f"WITH {CLUSTERS} SELECT * FROM ev")
def cluster_spike_days(spark, d):
    return op.cluster_days(spiky(spark, d).where("spike").select("day"))


@query(f"""WITH {CLUSTERS},
e AS (SELECT ev.event_id, a.* FROM a JOIN ev ON a.day BETWEEN ev.start AND ev.end WHERE has_target AND strict AND my_domain),
pk AS (SELECT event_id, max(n_strict_my) AS peak_count, arg_max(day, n_strict_my * 100000 - date_diff('day', DATE '1970-01-01', day)) AS peak_day FROM sp JOIN ev ON sp.day BETWEEN ev.start AND ev.end GROUP BY event_id),
tot AS (SELECT event_id, count(*) AS n_articles, count(DISTINCT domain) AS n_domains, count(*) FILTER (has_selangor) AS n_selangor, count(*) FILTER (has_kl) AS n_kl FROM e GROUP BY event_id),
loc AS (SELECT e.event_id, split_part(n_name || ', ' || c_mktsegment, ',', 1) AS place, c_acctbal AS lat, o_totalprice AS lon
  FROM e JOIN orders o ON e.url = o.o_orderkey JOIN customer ON c_custkey = o.o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE CAST(c_custkey % 6 AS VARCHAR) IN ('3', '4', '5')),
pl AS (SELECT event_id, string_agg(place || ' (' || c || ')', '; ' ORDER BY p) AS top_places FROM (
  SELECT event_id, place, count(*) AS c, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, place) AS p FROM loc GROUP BY event_id, place) WHERE p <= 5 GROUP BY event_id),
ce AS (SELECT event_id, median(lat) AS lat, median(lon) AS lon FROM loc GROUP BY event_id),
dm AS (SELECT event_id, string_agg(CAST(domain AS VARCHAR), '; ' ORDER BY p) AS domains FROM (
  SELECT event_id, domain, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, domain) AS p FROM e GROUP BY event_id, domain) WHERE p <= 4 GROUP BY event_id),
su AS (SELECT event_id, string_agg(CAST(url AS VARCHAR), ' | ' ORDER BY p) AS sample_urls FROM (
  SELECT event_id, url, row_number() OVER (PARTITION BY event_id ORDER BY n_my_places, url) AS p FROM e) WHERE p <= 3 GROUP BY event_id)
SELECT ev.*, peak_day, peak_count, coalesce(n_articles, 0) AS n_articles, coalesce(n_domains, 0) AS n_domains, coalesce(n_selangor, 0) AS n_selangor, coalesce(n_kl, 0) AS n_kl,
  coalesce(top_places, '') AS top_places, round(lat, 4) AS lat, round(lon, 4) AS lon, coalesce(domains, '') AS domains, coalesce(sample_urls, '') AS sample_urls
FROM ev LEFT JOIN pk USING (event_id) LEFT JOIN tot USING (event_id) LEFT JOIN pl USING (event_id) LEFT JOIN ce USING (event_id) LEFT JOIN dm USING (event_id) LEFT JOIN su USING (event_id)""")
def build_events(spark, d):
    return r6(found_events(spark, d), "lat", "lon", digits=4)


def found_events(spark, d) -> DataFrame:
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    locations = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("url"), (F.col("c_custkey") % 6).cast("string").alias("type"), F.concat_ws(", ", "n_name", "c_mktsegment").alias("name"), F.col("c_acctbal").alias("lat"), F.col("o_totalprice").alias("lon"),
    )
    return ev.build_events(spiky(spark, d), articles(spark, d), locations)


SECOND = f"""{CLUSTERS}, {R}, {spikes_sql("rx", 1.0, 1)},
j AS (SELECT rx.day, rx.spike AS relaxed_news, rx.n_strict_my, rain.rain_daily, rain.rain_hourly,
  rx.n_strict_my + lead(rx.n_strict_my, 1, 0) OVER (ORDER BY rx.day) AS nxt FROM rx LEFT JOIN rain ON rx.day = rain.day),
xs0 AS (SELECT day, relaxed_news, coalesce(rain_daily >= 900 OR rain_hourly >= 50, false) AND nxt >= 4 AS rain_news,
  EXISTS (SELECT 1 FROM ev WHERE j.day BETWEEN ev.start - 3 AND ev.end + 3) AS covered FROM j),
sx AS (SELECT *, (relaxed_news OR rain_news) AND NOT covered AS extra FROM xs0)"""


def second_flags(spark, d) -> DataFrame:
    first = op.cluster_days(spiky(spark, d).where("spike").select("day"))
    return ev.second_pass_days(daily(spark, d), rain_days(spark, d), first, 900, 50, 3, z=1.0, least=1, news=4)


@query(f"WITH {SECOND} SELECT * FROM sx")
def second_pass_days(spark, d):
    return second_flags(spark, d).select("day", "relaxed_news", "rain_news", "covered", "extra")


@query(f"""WITH {SECOND},
xd AS (SELECT *, CASE WHEN day - lag(day) OVER (ORDER BY day) <= 2 THEN 0 ELSE 1 END AS fresh FROM sx WHERE extra),
xg AS (SELECT day, sum(fresh) OVER (ORDER BY day) AS k FROM xd),
xe AS (SELECT CAST(k AS BIGINT) AS k, min(day) AS s, max(day) AS e FROM xg GROUP BY k)
SELECT k + 100 AS event_id, concat_ws('+', CASE WHEN bool_or(relaxed_news) THEN 'relaxed_news' END, CASE WHEN bool_or(rain_news) THEN 'rain_news' END) AS streams
FROM xe JOIN sx ON sx.day BETWEEN s AND e GROUP BY k""")
def second_pass_streams(spark, d):
    flags = second_flags(spark, d)
    extra = op.cluster_days(flags.where("extra").select("day"))
    return ev.stream_tags(flags, extra).withColumn("event_id", F.col("event_id") + 100)


VERDICTS = """peaks AS (SELECT ev.*, (SELECT arg_max(day, n_strict_my * 100000 - date_diff('day', DATE '1970-01-01', day)) FROM sp WHERE sp.day BETWEEN ev.start AND ev.end) AS peak_day FROM ev),
vd AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'probable' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'reject' WHEN 4 THEN 'reject_auto' ELSE 'merge into event 6' END AS verdict,
  CASE WHEN event_id % 7 IN (0, 1) THEN peak_day + CAST(event_id % 3 * 2000 AS INTEGER) WHEN event_id % 14 = 2 THEN peak_day END AS event_date FROM peaks WHERE event_id % 7 <> 6)"""


def events_and_verdicts(spark, d) -> tuple[DataFrame, DataFrame]:
    found = op.cluster_days(spiky(spark, d).where("spike").select("day"))
    peak = intervals.interval_join(spiky(spark, d), found).groupBy("event_id").agg(F.max_by("day", F.struct("n_strict_my", -F.unix_date("day"))).alias("peak_day"))
    e = found.join(peak, "event_id")
    k = F.col("event_id") % 7
    names = F.when(k == 0, "confirmed").when(k == 1, "probable").when(k == 2, "uncertain").when(k == 3, "reject").when(k == 4, "reject_auto").otherwise("merge into event 6")
    date = F.when(k.isin(0, 1), F.date_add("peak_day", (F.col("event_id") % 3 * 2000).cast("int"))).when(F.col("event_id") % 14 == 2, F.col("peak_day"))
    return e, e.where(k != 6).select("event_id", names.alias("verdict"), date.alias("event_date"))


LABELS = f"""{CLUSTERS}, {R}, {VERDICTS},
e2 AS (SELECT peaks.*, coalesce(verdict, 'unverified') AS verdict, event_date FROM peaks LEFT JOIN vd USING (event_id)),
q AS (SELECT quantile_cont(rain_daily, 0.75) AS low_d, quantile_cont(rain_daily, 0.9) AS heavy_d, quantile_cont(rain_hourly, 0.75) AS low_h, quantile_cont(rain_hourly, 0.95) AS heavy_h FROM rain),
pr AS (SELECT day, CASE WHEN count(rain_daily) OVER w = 3 THEN max(rain_daily) OVER w END AS prior FROM rain WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
m0 AS (SELECT day, n_loose, n_strict, n_strict_my, rain_daily, rain_hourly FROM daily JOIN rain USING (day)),
m1 AS (SELECT *, n_strict_my + lead(n_strict_my, 1, 0) OVER (ORDER BY day) AS news_my_2d FROM (
  SELECT * FROM m0 WHERE day BETWEEN (SELECT min(day) + 7 FROM m0) AND (SELECT max(day) - 1 FROM m0))),
m2 AS (SELECT m1.*, prior AS rain_daily_3d_prior_max,
  EXISTS (SELECT 1 FROM e2 WHERE verdict NOT IN ('reject', 'reject_auto') AND m1.day BETWEEN "start" - 3 AND "end" + 3) AS near,
  EXISTS (SELECT 1 FROM e2 WHERE verdict = 'reject' AND m1.day BETWEEN "start" AND "end") AS refuted,
  EXISTS (SELECT 1 FROM e2 WHERE verdict IN ('uncertain', 'unverified') AND coalesce(event_date, peak_day) = m1.day) AS unsure
  FROM m1 LEFT JOIN pr USING (day)),
m3 AS (SELECT *, coalesce(rain_daily >= heavy_d OR rain_hourly >= heavy_h, false) AS heavy,
  coalesce(rain_daily < low_d AND rain_hourly < low_h AND rain_daily_3d_prior_max < low_d, false) AND news_my_2d <= 1 AND NOT near AS easy,
  coalesce(rain_daily >= low_d OR rain_hourly >= low_h, false) AS wettish FROM m2, q),
po AS (SELECT DISTINCT event_date AS day FROM e2 WHERE verdict IN ('confirmed', 'probable')),
m4 AS (SELECT coalesce(m3.day, po.day) AS day, n_loose, n_strict, n_strict_my, rain_daily, rain_hourly, rain_daily_3d_prior_max, news_my_2d,
  CASE WHEN po.day IS NOT NULL THEN 'flood' WHEN unsure THEN 'uncertain_event'
       WHEN easy THEN 'easy_negative'
       WHEN NOT heavy AND NOT near AND news_my_2d <= 1 AND wettish THEN 'moderate_rain_negative'
       WHEN refuted AND NOT heavy AND NOT near THEN 'hard_news_negative'
       WHEN heavy AND NOT near THEN 'ambiguous_heavy_rain' WHEN near THEN 'near_event' ELSE 'unlabeled' END AS label_type
  FROM m3 FULL JOIN po ON m3.day = po.day),
lab AS (SELECT *, CAST(CASE WHEN label_type = 'flood' THEN 1 WHEN label_type LIKE '%\\_negative' ESCAPE '\\' THEN 0 END AS INTEGER) AS y FROM m4)"""


def labelled_days(spark, d) -> DataFrame:
    e, v = events_and_verdicts(spark, d)
    return ev.daily_labels(daily(spark, d).select("day", "n_loose", "n_strict", "n_strict_my"), rain_days(spark, d), e, v)


@query(f"WITH {LABELS} SELECT * FROM lab")
def daily_label_rules(spark, d):
    return labelled_days(spark, d)


@query(f"""WITH {CLUSTERS}, {VERDICTS}
SELECT event_id, verdict, coalesce(event_date, peak_day) AS date, verdict IN ('confirmed', 'probable') AS use, n_spike_days FROM vd JOIN peaks USING (event_id)
WHERE verdict IN ('confirmed', 'probable', 'uncertain')""")
def label_table_assembly(spark, d):
    e, v = events_and_verdicts(spark, d)
    e = e.withColumns({"lat": F.lit(3.14159), "lon": F.lit(101.5)})
    return ev.label_table(e, v, ["confirmed", "probable", "uncertain"]).select("event_id", "verdict", "date", "use", "n_spike_days")


@query(f"""WITH {LABELS}, f AS (SELECT day, label_type, CAST(label_type = 'flood' AS INTEGER) AS flood FROM lab),
g AS (SELECT f.*, CAST(f.flood + coalesce(n.flood, 0) > 0 AS INTEGER) AS flood_tol, f.label_type IN ('near_event', 'uncertain_event', 'ambiguous_heavy_rain') AS excl_strict
  FROM f LEFT JOIN f n ON n.day = f.day + 1)
SELECT *, excl_strict AND flood_tol = 0 AS excl_tol FROM g""")
def exclusion_flags(spark, d):
    return ev.exclusion_flags(labelled_days(spark, d).select("day", "label_type"), ["near_event", "uncertain_event", "ambiguous_heavy_rain"])


@query(f"""WITH {CLUSTERS}, w AS (SELECT ev.event_id, a.* FROM a JOIN ev ON a.day BETWEEN ev.start AND ev.end WHERE has_target AND strict AND my_domain),
f AS (SELECT *, row_number() OVER (PARTITION BY event_id, domain ORDER BY n_my_places, day, url) AS k FROM w),
g AS (SELECT event_id, url, row_number() OVER (PARTITION BY event_id ORDER BY n_my_places, day, url) AS place FROM f WHERE k = 1)
SELECT * FROM g WHERE place <= 6""")
def pick_urls(spark, d):
    return ev.pick_urls(articles(spark, d), op.cluster_days(spiky(spark, d).where("spike").select("day")), 6)


@query(f"WITH {R} SELECT day, rain_daily, rain_hourly FROM rain0")
def rain_daily_two_level(spark, d):
    return features.rain_daily(rain_panel(spark, d))


def _rolling_sql(how: str, lo: int, hi: int, least: int, x: str) -> str:
    at = lambda k: f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}" if k else "CURRENT ROW"
    w = f"OVER (ORDER BY day ROWS BETWEEN {at(lo)} AND {at(hi)})"
    return f"CASE WHEN count({x}) {w} >= {least} THEN {how}({x}) {w} END"


@query(f"WITH {R} SELECT day, {', '.join(f'round({_rolling_sql("sum", -n, -1, n, "rain_daily")}, 4) AS rain_daily_{n}d' for n in (3, 7, 14, 30))} FROM rain")
def antecedent_rolling_sums(spark, d):
    made = op.trailing_sums(rain_days(spark, d), "rain_daily", (3, 7, 14, 30))
    return r6(made.select("day", *(f"rain_daily_{n}d" for n in (3, 7, 14, 30))), *(f"rain_daily_{n}d" for n in (3, 7, 14, 30)), digits=4)


@query(f"""WITH {R}, b AS (SELECT day, lag(rain_hourly) OVER (ORDER BY day) AS p FROM rain),
c AS (SELECT day, CASE WHEN p > 49 THEN 1.0 ELSE 0.0 END AS x, CASE WHEN p > 49 THEN 1.0 WHEN p IS NOT NULL THEN 0.0 END AS z FROM b)
SELECT day, CAST({_rolling_sql('sum', -6, 0, 7, 'x')} AS DOUBLE) AS wet_counted, CAST({_rolling_sql('sum', -6, 0, 7, 'z')} AS DOUBLE) AS wet_strict FROM c""")
def wet_days_count(spark, d):
    return op.wet_day_counts(rain_days(spark, d), "rain_hourly", 7, 49).select("day", "wet_counted", "wet_strict")


@query(f"""WITH {R} SELECT day, round({_rolling_sql('avg', -6, 0, 4, 'rain_daily')}, 6) AS mean7, {_rolling_sql('max', -2, 0, 3, 'rain_daily')} AS max3,
{_rolling_sql('min', -6, 0, 7, 'rain_daily')} AS min7, {_rolling_sql('max', -3, -1, 3, 'rain_daily')} AS prior3 FROM rain""")
def rolling_minmaxmean(spark, d):
    x = F.col("rain_daily")
    return rain_days(spark, d).select("day", F.round(rolling(x, "avg", -6, 0, 4), 6).alias("mean7"), rolling(x, "max", -2, 0, 3).alias("max3"), rolling(x, "min", -6, 0, 7).alias("min7"), rolling(x, "max", -3, -1, 3).alias("prior3"))


@query(f"""WITH {R}, s AS (SELECT day, rain_daily > 400 AS wet, sum(CASE WHEN coalesce(rain_daily > 400, false) THEN 0 ELSE 1 END) OVER (ORDER BY day) AS island FROM rain)
SELECT day, CAST(CASE WHEN wet IS NOT NULL THEN sum(CASE WHEN coalesce(wet, false) THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY day) END AS BIGINT) AS wet_spell_len FROM s""")
def wet_spell_length(spark, d):
    return op.spell_length(rain_days(spark, d), F.col("rain_daily") > 400).select("day", "wet_spell_len")


@query(f"""WITH {R}, s AS (SELECT day, rain_daily, sum(CASE WHEN rain_daily IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY day) AS island FROM rain)
SELECT day, CAST(CASE WHEN rain_daily IS NOT NULL THEN day - max(CASE WHEN rain_daily >= 700 THEN day END) OVER (PARTITION BY island ORDER BY day) END AS BIGINT) AS days_since FROM s""")
def days_since_threshold(spark, d):
    return op.days_since(rain_days(spark, d), "rain_daily", 700).select("day", "days_since")


@query(f"""WITH {R}, i AS (SELECT day, rain_daily AS x, row_number() OVER (ORDER BY day) AS i, count(rain_daily) OVER (ORDER BY day) AS n FROM rain)
SELECT a.day, CASE WHEN any_value(a.n) >= 4 THEN round(sum(power(0.5, (a.i - b.i) / 4.0) * b.x) / sum(power(0.5, (a.i - b.i) / 4.0)), 6) END AS ewm
FROM i a LEFT JOIN i b ON b.i <= a.i AND b.x IS NOT NULL GROUP BY a.day""")
def ewm_halflife(spark, d):
    return r6(op.ewm_mean(rain_days(spark, d), "rain_daily", 4, 4).select("day", "ewm"), "ewm")


@query(f"WITH {DAILY} SELECT day, lag(n_loose, 1) OVER w AS before, lead(n_loose, 1, 0) OVER w AS after, n_loose + lead(n_loose, 1, 0) OVER w AS two FROM daily WINDOW w AS (ORDER BY day)")
def lag_lead_default(spark, d):
    w = series()
    return daily(spark, d).select("day", F.lag("n_loose", 1).over(w).alias("before"), F.lead("n_loose", 1, 0).over(w).alias("after"), (F.col("n_loose") + F.lead("n_loose", 1, 0).over(w)).alias("two"))


@query(f"WITH {DAILY}, s AS (SELECT * FROM daily WHERE n_strict > 0) SELECT s.day, s.n_strict, p.n_strict AS n_strict_prev, x.n_strict AS n_strict_next FROM s LEFT JOIN s p ON p.day = s.day - 1 LEFT JOIN s x ON x.day = s.day + 1")
def calendar_offset_join(spark, d):
    s = daily(spark, d).where("n_strict > 0").select("day", "n_strict")
    both = op.shifted_by_days(s, 1, ["n_strict"], "_prev")
    return both.join(s.select(F.date_sub("day", 1).alias("day"), F.col("n_strict").alias("n_strict_next")), "day", "left")


@query(f"""WITH {SPIKES}, g AS (SELECT day - lag(day) OVER (ORDER BY day) AS gap FROM sp WHERE spike)
SELECT CAST(median(gap) AS DOUBLE) AS median_gap, {', '.join(f'count(*) FILTER (gap <= {n}) AS within_{n}' for n in (3, 7, 14, 30))} FROM g""")
def gap_stats(spark, d):
    g = op.gaps(spiky(spark, d).where("spike").select("day"))
    return g.agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"), *(F.count_if(F.col("gap") <= n).alias(f"within_{n}") for n in (3, 7, 14, 30)))


@query(f"""WITH {SPIKES}, s AS (SELECT year(day) AS period, day FROM sp WHERE spike),
n AS (SELECT *, least(day - lag(day) OVER w, lead(day) OVER w - day) AS near FROM s WINDOW w AS (PARTITION BY period ORDER BY day))
SELECT CAST(period AS INTEGER) AS period, day, {', '.join(f'coalesce(near <= {k}, false) AS within_{k}' for k in (3, 7, 14, 30))} FROM n""")
def neighbour_within_w(spark, d):
    return op.neighbour_within(spiky(spark, d).where("spike").select(F.year("day").alias("period"), "day"), (3, 7, 14, 30), ["period"])


@query(f"WITH {DAILY} SELECT day, round((lag(n_loose) OVER (ORDER BY day) + 1) / ({_rolling_sql('avg', -61, -2, 20, 'n_loose')} + 1), 6) AS ratio FROM daily")
def news_ratio_trailing60(spark, d):
    return r6(op.trailing_ratio(daily(spark, d), "n_loose", "ratio").select("day", "ratio"), "ratio")


@query(f"WITH {SPIKES} SELECT day, {', '.join(f'coalesce(max(CAST(spike AS INTEGER)) OVER (ORDER BY day ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) > 0, false) AS prior_{k}' for k in (3, 14))} FROM sp")
def event_in_previous_days(spark, d):
    s = spiky(spark, d).select("day", F.col("spike").cast("int").alias("spike"))
    return op.event_before(s, "spike", (3, 14)).drop("spike")


@query(f"""WITH {DAILY}, p AS (SELECT day, n_loose, CASE WHEN count(*) OVER w >= 90 THEN quantile_cont(n_loose, 0.9) OVER w END AS past_edge FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT day, round(past_edge, 6) AS past_edge, n_loose >= past_edge AS past_alert FROM p""")
def past_only_quantile(spark, d):
    return r6(op.past_quantile_rank(daily(spark, d), "n_loose", 0.9).select("day", "past_edge", "past_alert"), "past_edge")


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS period, CASE WHEN c_custkey % 9 <> 0 THEN round(c_acctbal, -2) END AS x FROM customer),
r AS (SELECT c_custkey, (rank() OVER (PARTITION BY period, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY period, x) - 1) / 2.0) / count(x) OVER (PARTITION BY period) AS pct, x FROM c)
SELECT c_custkey, CASE WHEN x IS NOT NULL THEN round(pct, 6) END AS pct FROM r""")
def midrank_pct(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("period"), F.when(F.col("c_custkey") % 9 != 0, F.round("c_acctbal", -2)).alias("x"))
    return c.select("c_custkey", F.round(op.midrank("x", ["period"]), 6).alias("pct"))


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price FROM part),
r AS (SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(p_size) OVER (PARTITION BY p_brand) AS a,
  CASE WHEN price IS NOT NULL THEN (rank() OVER (PARTITION BY p_brand, price IS NULL ORDER BY price) + (count(*) OVER (PARTITION BY p_brand, price) - 1) / 2.0) / count(price) OVER (PARTITION BY p_brand) END AS b FROM p)
SELECT p_partkey, round(CASE WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 6) AS composite FROM r""")
def composite_rank(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("price"))
    return r6(op.composite_rank(p, ["p_size", "price"], ["p_brand"]).select("p_partkey", "composite"), "composite")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders),
b AS (SELECT len(list_filter(e, lambda x: x < o_totalprice)) AS bin, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y, o_totalprice AS x FROM orders, q)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(100 * avg(y), 6) AS rate_per_100, min(x) AS low, max(x) AS high FROM b GROUP BY bin""")
def qcut_rate_table(spark, d):
    o = table(spark, d, "orders").select("o_totalprice", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))
    return r6(tables.quantile_bins(o, "o_totalprice"), "rate_per_100")


@query(f"WITH {DAILY} SELECT corr(n_loose, x1) AS corr_m1, corr(n_loose, x0) AS corr_0, corr(n_loose, y1) AS corr_p1 FROM (SELECT n_loose, n_strict AS x0, lead(n_strict) OVER w AS x1, lag(n_strict) OVER w AS y1 FROM daily WINDOW w AS (ORDER BY day))".replace("corr(n_loose, x1)", "round(corr(n_loose, x1), 6)").replace("corr(n_loose, x0)", "round(corr(n_loose, x0), 6)").replace("corr(n_loose, y1)", "round(corr(n_loose, y1), 6)"))
def lagged_corr(spark, d):
    return r6(tables.lagged_correlations(daily(spark, d), "n_loose", "n_strict"), "corr_m1", "corr_0", "corr_p1")


@query(f"""WITH {CLUSTERS}, f AS (SELECT DISTINCT day FROM sp WHERE spike),
ctl AS (SELECT f.day AS d0, daily.n_loose AS c FROM f JOIN daily ON daily.day BETWEEN f.day - 45 AND f.day + 45 WHERE NOT EXISTS (SELECT 1 FROM f g WHERE daily.day BETWEEN g.day - 3 AND g.day + 3))
SELECT f.day, n_loose AS value, count(c) AS n_controls, CASE WHEN count(c) >= 20 THEN round(avg(CASE WHEN c < n_loose THEN 1.0 WHEN c = n_loose THEN 0.5 ELSE 0.0 END), 6) END AS pct
FROM f JOIN daily USING (day) LEFT JOIN ctl ON d0 = f.day GROUP BY f.day, n_loose""")
def percentile_vs_controls(spark, d):
    return r6(intervals.control_percentile(daily(spark, d), spiky(spark, d).where("spike").select("day"), "n_loose"), "pct")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def semi_anti_sets(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    on = F.col("o_custkey") == F.col("c_custkey")
    some = o.join(c.where("c_mktsegment = 'BUILDING'"), on, "left_semi").join(c.where("c_acctbal < 0"), on, "left_anti")
    return some.select("o_orderkey").union(o.where("o_orderstatus = 'P'").select("o_orderkey")).distinct()


@query(f"""WITH {A}, p AS (SELECT 'early' AS period, day, url, NULL AS torrential FROM a WHERE day < DATE '1998-01-01' UNION ALL SELECT 'late', day, url, has_kl FROM a WHERE day >= DATE '1997-12-01'),
k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY period) AS n FROM p)
SELECT period, count(*) AS n, count(*) FILTER (coalesce(torrential, false)) AS torrential FROM k WHERE n = 1 GROUP BY period""")
def union_periods(spark, d):
    from tidemark.sources.readers import union_periods as joined

    a = articles(spark, d)
    both = joined({"early": a.where("day < date '1998-01-01'").select("day", "url"), "late": a.where("day >= date '1997-12-01'").select("day", "url", F.col("has_kl").alias("torrential"))})
    first = op.first_per_key(both.select("url", "period", "day", "torrential"), ["url"], ["period"])
    return first.groupBy("period").agg(F.count("*").alias("n"), F.count_if(F.coalesce("torrential", F.lit(False))).alias("torrential"))


BUILD = f"""{R}, o AS (SELECT rcal.day, total_mean, rain_daily AS total_max, rain_hourly AS hourly_max FROM rcal LEFT JOIN rain0 USING (day)),
w AS (SELECT *, CASE WHEN lag(total_mean) OVER (ORDER BY day) > 1 THEN 1.0 ELSE 0.0 END AS wet FROM o)"""


@query(f"""WITH {BUILD} SELECT day, round(lag(total_mean) OVER (ORDER BY day), 6) AS obs_1d_total_mean, lag(total_max) OVER (ORDER BY day) AS obs_1d_total_max, lag(hourly_max) OVER (ORDER BY day) AS obs_1d_hourly_max,
{', '.join(f'round({_rolling_sql("sum", -n, -1, n, "total_mean")}, 4) AS obs_{n}d_mean' for n in (3, 7, 14, 30))}, CAST({_rolling_sql('sum', -6, 0, 7, 'wet')} AS DOUBLE) AS obs_wet_days_7d,
round(sin(2 * pi() * month(day) / 12), 9) + 0.0 AS month_sin, round(cos(2 * pi() * month(day) / 12), 9) + 0.0 AS month_cos, CAST(month(day) IN (11, 12, 1, 2, 3) AS INTEGER) AS ne_monsoon, total_max AS nowcast_total_max, hourly_max AS nowcast_hourly_max FROM w""")
def build_features(spark, d):
    f = features.build_features(rain_panel(spark, d))
    f = r6(f, "obs_1d_total_mean")
    f = r6(f, "month_sin", "month_cos", digits=9)
    return r6(f, *(f"obs_{n}d_mean" for n in (3, 7, 14, 30)), digits=4)


_EWMS = ", ".join(f"CASE WHEN any_value(a.n) >= {h} THEN sum(power(0.5, (a.i - b.i) / {h}.0) * b.r) / sum(power(0.5, (a.i - b.i) / {h}.0)) END AS rain_ewm_hl{h}d" for h in (1, 2, 4, 8, 16))
_t, _r, _s = "tcwv_00", "r", "soil_00"
DERIVED = (
    {f"rain_sum_{n}d": _rolling_sql("sum", -n + 1, 0, n, "r") for n in (1, 2, 3, 5, 7, 14, 30)}
    | {"wet_days_7d": _rolling_sql("sum", -6, 0, 7, "wet"), "dry_days_7d": f"7 - {_rolling_sql('sum', -6, 0, 7, 'wet')}"}
    | {f"tcwv_mean_{n}d": _rolling_sql("avg", -n + 1, 0, n, "tcwv_00") for n in (3, 7)}
    | {
        "tcwv_max_3d": _rolling_sql("max", -2, 0, 3, "tcwv_00"), "tcwv_min_7d": _rolling_sql("min", -6, 0, 7, "tcwv_00"), "tcwv_slope_3d": "(tcwv_00 - lag(tcwv_00, 2) OVER (ORDER BY day)) / 2",
        "tcwv_chg_1d": "tcwv_00 - lag(tcwv_00, 1) OVER (ORDER BY day)", "tcwv_dev_from_14d": f"tcwv_00 - {_rolling_sql('avg', -14, -1, 10, 'tcwv_00')}", "soil_mean_3d": _rolling_sql("avg", -2, 0, 3, "soil_00"),
        "soil_chg_3d": "soil_00 - lag(soil_00, 3) OVER (ORDER BY day)", "rh850_mean_3d": _rolling_sql("avg", -2, 0, 3, "rh850_00"), "tcwv_hi_days_7d": _rolling_sql("sum", -6, 0, 7, "hi"),
    }
)
_same = ("tcwv_00", "soil_00", "rh850_00")


@query(f"""WITH {R}, {DAILY}, s AS (SELECT rain.day, rain_daily AS rain, CAST(n_loose AS DOUBLE) AS tcwv_00, CAST(n_strict AS DOUBLE) AS soil_00, CAST(n_strict_my AS DOUBLE) AS rh850_00 FROM rain LEFT JOIN daily USING (day)),
q AS (SELECT quantile_cont(tcwv_00, 0.75) AS edge FROM s), b AS (SELECT s.*, lag(rain) OVER (ORDER BY day) AS r, CAST(tcwv_00 > edge AS DOUBLE) AS hi, row_number() OVER (ORDER BY day) AS i FROM s, q),
c AS (SELECT *, CAST(r > 1 AS DOUBLE) AS wet, count(r) OVER (ORDER BY day) AS n, sum(CASE WHEN r > 1 THEN 0 ELSE 1 END) OVER (ORDER BY day) AS dry_island, sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY day) AS gap_island FROM b),
w AS (SELECT a.day, {_EWMS} FROM c a LEFT JOIN c b ON b.i <= a.i AND b.r IS NOT NULL GROUP BY a.day),
f AS (SELECT day, rain, {', '.join(_same)}, {', '.join(f'{x} AS {k}' for k, x in DERIVED.items())}, CAST(CASE WHEN wet IS NOT NULL THEN sum(CASE WHEN wet = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY dry_island ORDER BY day) END AS BIGINT) AS wet_spell_len,
  CAST(CASE WHEN r IS NOT NULL THEN day - max(CASE WHEN r >= 20 THEN day END) OVER (PARTITION BY gap_island ORDER BY day) END AS BIGINT) AS days_since_20mm FROM c)
SELECT day, rain, {', '.join(_same)}, {', '.join(f'round({k}, 5) + 0.0 AS {k}' for k in DERIVED)}, wet_spell_len, days_since_20mm, {', '.join(f'round(rain_ewm_hl{h}d, 5) AS rain_ewm_hl{h}d' for h in (1, 2, 4, 8, 16))} FROM f JOIN w USING (day)""")
def derived_antecedents(spark, d):
    s = rain_days(spark, d).join(daily(spark, d).select("day", F.col("n_loose").cast("double").alias("tcwv_00"), F.col("n_strict").cast("double").alias("soil_00"), F.col("n_strict_my").cast("double").alias("rh850_00")), "day", "left")
    f = features.derived(s.withColumnRenamed("rain_daily", "rain").drop("rain_hourly"))
    plain = {"day", "rain", *_same}
    return f.select(*((F.round(c, 5) + F.lit(0.0)).alias(c) if kind == "double" and c not in plain else F.col(c) for c, kind in f.dtypes))
