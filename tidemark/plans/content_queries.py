"""Queries on nested strings, text, pages, panels, scores and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import nested, physics, text
from tidemark.operators import evaluation as ev
from tidemark.operators import features, harmonics, intervals, reports, tables
from tidemark.operators import series as op
from tidemark.plans.series_queries import CLUSTERS, SPIKES, R, daily, r6, spiky, table
from tidemark.sources import readers, sinks

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- nested strings


def raw_v2(spark: SparkSession, d: str) -> DataFrame:
    """A raw table of delimited strings: orders as articles, their line items as places and themes."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat_ws("#", F.lit("3"), F.concat(F.lit("n"), F.col("l_suppkey") % 9), F.when(F.col("l_suppkey") % 4 == 0, "SG").otherwise("MY"),
                    F.when(F.col("l_partkey") % 5 == 0, "MY12").when(F.col("l_partkey") % 5 == 1, "MY14").when(F.col("l_partkey") % 5 == 2, "MY").otherwise("MY01"), F.lit("x"),
                    F.when(F.col("l_linenumber") == 6, "bad").otherwise((F.col("l_suppkey") % 50).cast("string")), F.lit("101.5"), F.lit("f"), (F.col("l_partkey") % 1000).cast("string")).alias("place"),
        F.concat(F.when(F.col("l_returnflag") == "A", "NATURAL_DISASTER_FLASH_FLOOD").when(F.col("l_returnflag") == "R", "FLOOD").otherwise("NATURAL_DISASTER_MONSOON"), F.lit(","),
                 F.when(F.col("l_linenumber") == 5, "-7").otherwise((F.col("l_suppkey") * 10 % 1500).cast("string"))).alias("theme"),
    )
    made = li.groupBy("l_orderkey").agg(*(F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", c)))[c], ";").alias(n) for c, n in (("place", "V2Locations"), ("theme", "V2Themes"))))
    o = table(spark, d, "orders")
    url = F.concat(F.lit("http://"), F.when(F.col("o_custkey") % 2 == 0, "WWW.").otherwise(""), F.lit("site"), F.col("o_custkey") % 13, F.when(F.col("o_custkey") % 3 == 0, ".com.my").otherwise(":8080"), F.lit("/a/"), F.col("o_orderkey"))
    return o.join(made, o["o_orderkey"] == made["l_orderkey"]).select(F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("DATE"), url.alias("url"), "V2Locations", "V2Themes")


NESTED = """p AS (SELECT l_orderkey AS k, l_linenumber AS n, 'n' || CAST(l_suppkey % 9 AS VARCHAR) AS name, CASE WHEN l_suppkey % 4 = 0 THEN 'SG' ELSE 'MY' END AS country,
  CASE l_partkey % 5 WHEN 0 THEN 'MY12' WHEN 1 THEN 'MY14' WHEN 2 THEN 'MY' ELSE 'MY01' END AS adm1, CAST(l_suppkey % 50 AS DOUBLE) AS lat, l_partkey % 1000 AS off FROM lineitem WHERE l_linenumber <> 6),
t AS (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'A' THEN 'NATURAL_DISASTER_FLASH_FLOOD' WHEN 'R' THEN 'FLOOD' ELSE 'NATURAL_DISASTER_MONSOON' END AS theme, l_suppkey * 10 % 1500 AS off FROM lineitem WHERE l_linenumber <> 5),
art AS (SELECT o_orderkey AS k, o_orderdate AS date, 'site' || CAST(o_custkey % 13 AS VARCHAR) || CASE WHEN o_custkey % 3 = 0 THEN '.com.my' ELSE ':8080' END AS domain, o_custkey % 3 = 0 AS my_domain,
  'http://' || CASE WHEN o_custkey % 2 = 0 THEN 'WWW.' ELSE '' END || 'site' || CAST(o_custkey % 13 AS VARCHAR) || CASE WHEN o_custkey % 3 = 0 THEN '.com.my' ELSE ':8080' END || '/a/' || CAST(o_orderkey AS VARCHAR) AS url
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


@query(f"""WITH {NESTED},
l AS (SELECT k, count(DISTINCT name) AS n_locations, count(DISTINCT CASE WHEN country = 'MY' AND adm1 <> 'MY' THEN name END) AS n_my_places, bool_or(adm1 = 'MY12') AS has_selangor, bool_or(adm1 = 'MY14') AS has_kl FROM p GROUP BY k),
h AS (SELECT k, bool_or(theme LIKE '%FLOOD%') AS flood, bool_or(theme LIKE '%FLASH_FLOOD%') AS flash_flood, bool_or(theme = 'NATURAL_DISASTER_MONSOON') AS monsoon FROM t GROUP BY k),
m AS (SELECT p.k, min(abs(p.off - t.off)) AS dist FROM p JOIN t USING (k) WHERE adm1 IN ('MY12', 'MY14') AND theme LIKE '%FLOOD%' GROUP BY p.k)
SELECT url, domain, my_domain, coalesce(n_locations, 0) AS n_locations, coalesce(n_my_places, 0) AS n_my_places, coalesce(has_selangor, false) AS has_selangor, coalesce(has_kl, false) AS has_kl,
  coalesce(has_selangor, false) OR coalesce(has_kl, false) AS has_target, coalesce(flood, false) AS flood, coalesce(flash_flood, false) AS flash_flood, coalesce(monsoon, false) AS monsoon, CAST(dist AS DOUBLE) AS min_flood_loc_dist
FROM art LEFT JOIN l USING (k) LEFT JOIN h USING (k) LEFT JOIN m USING (k)""")
def parse_nested_locations(spark, d):
    arts, _ = nested.build_tables(raw_v2(spark, d))
    return arts.select("url", "domain", "my_domain", "n_locations", "n_my_places", "has_selangor", "has_kl", "has_target", "flood", "flash_flood", "monsoon", "min_flood_loc_dist")


@query(f"""WITH {NESTED} SELECT url, CASE adm1 WHEN 'MY12' THEN 'Selangor' ELSE 'Kuala Lumpur' END AS region, name, country, adm1, lat, 101.5 AS lon, CAST(off AS BIGINT) AS "offset"
FROM p JOIN art USING (k) WHERE adm1 IN ('MY12', 'MY14')""".replace("101.5 AS lon", "CAST(101.5 AS DOUBLE) AS lon"))
def explode_target_locations(spark, d):
    _, locs = nested.build_tables(raw_v2(spark, d))
    return locs.select("url", "region", "name", "country", "adm1", "lat", "lon", "offset")


@query(f"WITH {NESTED} SELECT url, theme, CAST(off AS BIGINT) AS \"offset\" FROM t JOIN art USING (k)")
def parse_themes(spark, d):
    return raw_v2(spark, d).select("url", F.explode(nested.themes(F.col("V2Themes"))).alias("t")).select("url", "t.theme", "t.offset")


@query(f"""WITH {NESTED} SELECT k AS orderkey, min(abs(p.off - t.off)) AS dist, min(abs(p.off - t.off)) <= 300 AS near FROM p JOIN t USING (k) GROUP BY k""")
def min_offset_distance(spark, d):
    raw = raw_v2(spark, d).withColumns({"p": nested.locations(F.col("V2Locations")), "o": F.transform(nested.themes(F.col("V2Themes")), lambda t: t["offset"])})
    made = raw.select(F.regexp_extract("url", r"/a/(\d+)$", 1).cast("bigint").alias("orderkey"), nested.least_distance(F.col("p"), F.col("o")).alias("dist")).where("dist is not null")
    return made.withColumn("near", op.near_flood(F.col("dist")))


V1 = """SELECT o_orderkey AS k, CASE WHEN o_custkey % 4 = 0 THEN 'MY12' WHEN o_custkey % 4 = 1 THEN 'MY14' ELSE 'MY02' END AS adm1, o_custkey % 11 = 0 AS named, o_custkey % 6 = 0 AS broken, o_orderpriority FROM orders"""


@query(f"""SELECT k AS url, (adm1 = 'MY12' AND NOT broken) OR named AS has_selangor, adm1 = 'MY14' AND NOT broken AS has_kl, o_orderpriority = '1-URGENT' AS torrential_rain, CAST(CASE WHEN broken THEN 0 ELSE 1 END AS BIGINT) AS n_locations FROM ({V1})""")
def parse_v1_profile(spark, d):
    o = table(spark, d, "orders")
    c = F.col("o_custkey")
    place = F.concat_ws("#", F.lit("4"), F.when(c % 11 == 0, "Shah Alam, Selangor, Malaysia").otherwise("Town"), F.lit("MY"), F.when(c % 4 == 0, "MY12").when(c % 4 == 1, "MY14").otherwise("MY02"), F.lit("3.1"), F.when(c % 6 == 0, "east").otherwise("101.7"), F.lit("-240"))
    raw = o.select(F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("DATE"), F.col("o_orderkey").cast("string").alias("DocumentIdentifier"), F.lit("s").alias("SourceCommonName"), F.when(F.col("o_orderpriority") == "1-URGENT", "TORRENTIAL_RAIN;X").otherwise("X;Y").alias("Themes"), place.alias("Locations"))
    arts, _ = nested.build_tables(raw, "v1")
    return arts.select(F.col("url").cast("bigint").alias("url"), "has_selangor", "has_kl", "torrential_rain", "n_locations")


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages""")
def url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", nested.domain_of(F.col("url")).alias("domain"))


@query("""SELECT page_id, CASE WHEN regexp_matches(u, '/(20\\d\\d)/(\\d\\d)/(\\d\\d)/') THEN regexp_extract(u, '/(20\\d\\d)/(\\d\\d)/(\\d\\d)/', 1) || '-' || regexp_extract(u, '/(20\\d\\d)/(\\d\\d)/(\\d\\d)/', 2) || '-' || regexp_extract(u, '/(20\\d\\d)/(\\d\\d)/(\\d\\d)/', 3) ELSE '' END AS url_date
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://x.my/2021/0' || CAST(page_id % 9 + 1 AS VARCHAR) || '/17/a' ELSE url END AS u FROM pages)""")
def url_date(spark, d):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://x.my/2021/0"), F.col("page_id") % 9 + 1, F.lit("/17/a"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", nested.url_date(u).alias("url_date"))


@query("""SELECT s_suppkey, dom LIKE '%.my' OR dom LIKE '%nst.com.my' OR dom LIKE '%malaymail.com' OR dom LIKE '%bernama.com' AS home FROM (
  SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'xnst.com.my' WHEN 1 THEN 'www2.malaymail.com' WHEN 2 THEN 'bernama.com.sg' ELSE 'a.my' END AS dom FROM supplier)""")
def my_domain_suffix(spark, d):
    k = F.col("s_suppkey") % 4
    dom = F.when(k == 0, "xnst.com.my").when(k == 1, "www2.malaymail.com").when(k == 2, "bernama.com.sg").otherwise("a.my")
    return table(spark, d, "supplier").select("s_suppkey", nested.is_home_domain(dom).alias("home"))


# ---------------------------------------------------------------- text

#: patterns for the invented prose of the test tables, written out so that both engines read them alike
PROSE = text.Profile(
    flood="(^|[^a-z])(the|der|que|les)([^a-z]|$)", place="(^|[^a-z])(in|und|el|dans)([^a-z]|$)", verb="ing", time="(^|[^a-z])(was|ist|una|est)([^a-z]|$)", figurative="[|%#]", policy="tion", other="(^|[^a-z])(of|von|de)([^a-z]|$)",
    hypothetical="(^|[^a-z])(if|zu|por|pour)([^a-z]|$)", year="(19[0-9][0-9]|20[0-9][0-9])", dateline="^THE", strip="^[A-Z][A-Z .,'-]{3,30}: *", here="(^|[^a-z])here([^a-z]|$)",
)
SENTENCES = """snt AS (SELECT doc_id, unnest(string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?])[ \\t\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1))) AS s,
  generate_subscripts(string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?])[ \\t\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1)), 1) - 1 AS i, lang FROM documents)"""


@query(f"WITH {SENTENCES} SELECT doc_id, count(*) AS n, sum(length(s)) AS chars, count(*) FILTER (s = '') AS empty FROM snt GROUP BY doc_id".replace("sum(length(s))", "CAST(sum(length(s)) AS BIGINT)"))
def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"), F.count_if(F.col("s") == "").alias("empty"))


SCORE = f"""{SENTENCES}, f AS (SELECT doc_id, i, regexp_replace(s, '{PROSE.strip.replace("'", "''")}', '') AS s FROM snt WHERE regexp_matches(s, '{PROSE.flood}')),
h AS (SELECT doc_id, regexp_matches(substr(text, 1, 400), '^THE') AS here, regexp_matches(substr(text, 1, 300), '{PROSE.other}') AS other_head FROM documents),
g AS (SELECT f.*, regexp_matches(s, '{PROSE.place}') OR (here AND NOT other_head AND regexp_matches(s, '{PROSE.here}')) AS place, regexp_matches(s, '{PROSE.other}') AS other FROM f JOIN h USING (doc_id)),
sc AS (SELECT doc_id, i, s, 1 + CAST(place AS INTEGER) + CAST(regexp_matches(s, '{PROSE.verb}') OR regexp_matches(s, '{PROSE.time}') AS INTEGER) - 2 * CAST(NOT place AND other AS INTEGER) - CAST(place AND other AS INTEGER)
  - 2 * CAST(len(list_filter(regexp_extract_all(s, '{PROSE.year}'), lambda y: y <> '2021')) > 0 AS INTEGER) - 3 * CAST(regexp_matches(s, '{PROSE.figurative}') AS INTEGER) - CAST(regexp_matches(s, '{PROSE.policy}') AS INTEGER) - CAST(regexp_matches(s, '{PROSE.hypothetical}') AS INTEGER) AS score FROM g),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS k FROM sc),
scored AS (SELECT d.doc_id, coalesce(score, -9) AS score, coalesce(score, -9) >= 2 AS passed, coalesce(substr(s, 1, 250), '') AS sentence FROM documents d LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (doc_id))"""


def scored_documents(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit("2021").alias("year"))
    return text.score_articles(docs, "doc_id", year="year", profile=PROSE, pass_at=2)


@query(f"WITH {SCORE} SELECT * FROM scored")
def sentence_score_best(spark, d):
    return scored_documents(spark, d)


DECIDE = f"""{SCORE}, x AS (SELECT doc_id // 9 AS event_id, doc_id % 9 AS place, doc_id % 4 <> 0 AS fetched, score, passed, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '2021-0' || CAST(doc_id % 9 + 1 AS VARCHAR) END AS date, sentence FROM scored),
dec0 AS (SELECT event_id, count(*) AS n_urls, count(*) FILTER (fetched) AS n_fetched, count(*) FILTER (fetched AND passed) AS n_pass, coalesce(min(CASE WHEN fetched AND passed AND date <> '' THEN date END), '') AS first_pass_date FROM x GROUP BY event_id),
bs AS (SELECT event_id, sentence AS best_sentence FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, place) AS k FROM x WHERE fetched) WHERE k = 1),
dec AS (SELECT event_id, n_urls, n_fetched, n_pass, CASE WHEN n_pass >= 2 OR (n_pass = 1 AND n_fetched <= 3) THEN 'accept' WHEN n_fetched >= 2 AND n_pass = 0 THEN 'reject' ELSE 'review' END AS decision, first_pass_date, coalesce(best_sentence, '') AS best_sentence FROM dec0 LEFT JOIN bs USING (event_id))"""


def decided(spark, d) -> DataFrame:
    k = F.col("doc_id")
    date = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("2021-0"), k % 9 + 1))
    x = scored_documents(spark, d).withColumns({"event_id": F.expr("doc_id div 9"), "place": k % 9, "fetched": k % 4 != 0, "date": date})
    return text.event_decisions(x)


@query(f"WITH {DECIDE} SELECT * FROM dec")
def event_decision(spark, d):
    return decided(spark, d)


@query(f"""WITH {DECIDE}, t AS (SELECT CASE event_id % 3 WHEN 0 THEN 'flood' WHEN 1 THEN 'no' ELSE 'unsure' END AS truth, decision FROM dec)
SELECT truth, count(*) FILTER (decision = 'accept') AS accept, count(*) FILTER (decision = 'reject') AS reject, count(*) FILTER (decision = 'review') AS review FROM t GROUP BY truth""")
def crosstab_truth_decision(spark, d):
    k = F.col("event_id") % 3
    verdict = F.when(k == 0, "probable").when(k == 1, "reject").otherwise("uncertain")
    return sinks.pivoted(decided(spark, d).withColumn("truth", text.truth_of(verdict)), "truth", "decision", ["accept", "reject", "review"])


@query(f"""WITH {SENTENCES}, m AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b, regexp_matches(s, '{PROSE.flood}') AS hit FROM snt WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, CASE WHEN a IS NULL THEN '' ELSE a || ' ' END || s || CASE WHEN b IS NULL THEN '' ELSE ' ' || b END AS ctx, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m WHERE hit)
SELECT doc_id, k - 1 AS place, ctx FROM r WHERE k <= 8""".replace("k - 1 AS place", "CAST(k - 1 AS INTEGER) AS place"))
def flood_contexts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.contexts(F.col("text"), PROSE.flood)).alias("place", "ctx"))


GAZ = {"the": ("A", 1.0, 2.0), "la": ("B", 3.0, 4.0), "der": ("C", 5.0, 6.0), "and": ("G", 0.0, 0.0)}


@query("""WITH w AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ') AS t FROM documents),
f AS (SELECT doc_id, list_filter(t, lambda x: x IN ('the', 'la', 'der', 'and')) AS f, list_filter(t, lambda x: x IN ('the', 'la', 'der')) AS s FROM w)
SELECT doc_id, CAST(len(CASE WHEN len(s) > 0 THEN s ELSE f END) AS INTEGER) AS n, md5(array_to_string(CASE WHEN len(s) > 0 THEN s ELSE f END, ' ')) AS names FROM f""")
def gazetteer_scan(spark, d):
    found = text.find_places(F.col("text"), tuple(GAZ), ("and",))
    return table(spark, d, "documents").select("doc_id", found.alias("f")).select("doc_id", F.size("f").alias("n"), F.md5(F.array_join("f", " ").cast("binary")).alias("names"))


#: what stands in for publication dates and character references, which the pages lack
PAGES = """h AS (SELECT page_id, replace(replace(html, '<head>', CASE page_id % 3 WHEN 0 THEN '<head><meta content="2021-0' || CAST(page_id % 9 + 1 AS VARCHAR) || '-07T08:09" property="article:published_time">'
  WHEN 1 THEN '<head><meta name="x" property=''article:published_time'' content=''2022-11-30''>' ELSE '<head><meta property="og:title" content="1999-01-01">' END), '</title>', ' caf&eacute;<b> t&#8217;s</b> </title>') AS html FROM pages)"""


def marked_pages(spark, d) -> DataFrame:
    k = F.col("page_id")
    own = F.concat(F.lit('<head><meta content="2021-0'), (k % 9 + 1).cast("string"), F.lit('-07T08:09" property="article:published_time">'))
    head = F.when(k % 3 == 0, own).when(k % 3 == 1, "<head><meta name=\"x\" property='article:published_time' content='2022-11-30'>").otherwise('<head><meta property="og:title" content="1999-01-01">')
    page = F.replace(F.replace("html", F.lit("<head>"), head), F.lit("</title>"), F.lit(" caf&eacute;<b> t&#8217;s</b> </title>"))
    return table(spark, d, "pages").select("page_id", page.alias("html"))


def _markup_sql(x: str, between: str = " ") -> str:
    """Text between tags, stripped and joined, with the character references that the pages have."""
    plain = "replace(replace(replace(replace(replace(t, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&eacute;', 'é'), '&#8217;', '’')"
    return f"""array_to_string(list_filter(list_transform(string_split_regex({x}, '(?s)<!--.*?-->|</?[a-zA-Z!][^>]*>'), lambda t: regexp_replace(regexp_replace({plain}, '&amp;?', '&', 'g'), '^\\s+|\\s+$', '', 'g')), lambda t: t <> ''), '{between}')"""


@query(f"""WITH {PAGES}, b AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?is)<nav\\b[^>]*>.*?</nav\\s*>', ' ', 'g'), '(?is)<footer\\b[^>]*>.*?</footer\\s*>', ' ', 'g'), '(?is)<header\\b[^>]*>.*?</header\\s*>', ' ', 'g'), '(?is)<aside\\b[^>]*>.*?</aside\\s*>', ' ', 'g') AS bare FROM h),
p AS (SELECT page_id, bare, {_markup_sql("regexp_extract(bare, '(?is)<title[^>]*>(.*?)</title>', 1)", '')} AS title, CASE page_id % 3 WHEN 0 THEN '2021-0' || CAST(page_id % 9 + 1 AS VARCHAR) || '-07' WHEN 1 THEN '2022-11-30' ELSE '' END AS meta_date,
  list_filter(list_transform(regexp_extract_all(bare, '(?is)<p\\b[^>]*>(.*?)</p\\s*>', 1), lambda x: {_markup_sql('x')}), lambda x: length(x) > 40) AS ps FROM b),
t AS (SELECT page_id, title, meta_date, regexp_replace(title || chr(10) || CASE WHEN len(ps) > 0 THEN array_to_string(ps, chr(10)) ELSE {_markup_sql('bare')} END, '[ \\t]+', ' ', 'g') AS text FROM p)
SELECT page_id, title, meta_date, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM t""")
def html_extract(spark, d):
    f = marked_pages(spark, d).select("page_id", text.html_fields(F.col("html")).alias("f"))
    return f.select("page_id", "f.title", "f.meta_date", F.length("f.text").alias("n_chars"), F.md5(F.col("f.text").cast("binary")).alias("digest"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, d):
    j = readers.json_column(table(spark, d, "events").select("event_type", "props"), "props", "k bigint")
    return j.groupBy("event_type", (F.col("k") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT page_id, sha1(url) AS key FROM pages")
def cache_key(spark, d):
    return table(spark, d, "pages").select("page_id", text.cache_key(F.col("url")).alias("key"))


LED = r"(?i)((?:as of|as at|until|till|by|setakat|sehingga|hingga|updated?|published|posted)\s*[:\-]?\s*)?"
CLOCKS = LED + r"\b([0-9]{1,2})(?:[.:]([0-9]{2}))?\s*(a\.?m\.?|p\.?m\.?)(?:[^a-zA-Z]|$)"
SPOKEN = LED + r"\b(?:jam|pukul)\s+([0-9]{1,2})(?:[.:]([0-9]{2}))?\s*(pagi|tengah hari|petang|malam)?"


@query(f"""WITH t AS (SELECT conv_id, turn, 'pukul ' || CAST(turn % 13 AS VARCHAR) || ' petang until 6pm, at 7.30 am ' || text AS t FROM conversations),
m AS (SELECT conv_id, turn, unnest(regexp_extract_all(t, '{CLOCKS}')) AS m, 1 AS k FROM t UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(t, '{SPOKEN}')), 2 FROM t),
x AS (SELECT conv_id, turn, k, regexp_extract(m, CASE k WHEN 1 THEN '{CLOCKS}' ELSE '{SPOKEN}' END, ['led', 'h', 'mi', 'part']) AS g FROM m WHERE k = 1 UNION ALL SELECT conv_id, turn, k, regexp_extract(m, '{SPOKEN}', ['led', 'h', 'mi', 'part']) FROM m WHERE k = 2),
y AS (SELECT conv_id, turn, k, TRY_CAST(g.h AS INTEGER) AS h, coalesce(TRY_CAST(g.mi AS INTEGER), 0) AS mi, lower(g.part) AS part FROM x WHERE g.led = ''),
z AS (SELECT conv_id, turn, mi, CASE WHEN k = 1 THEN CASE WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN part LIKE 'p%' THEN 12 ELSE 0 END END WHEN h <= 23 THEN CASE WHEN h < 12 AND (part IN ('petang', 'malam') OR part = 'tengah hari' AND h <> 11) THEN h + 12 ELSE h END END AS h FROM y)
SELECT conv_id, turn, h + mi / 60.0 AS hour, 'clock' AS kind FROM z WHERE h IS NOT NULL""".replace("regexp_extract(m, CASE k WHEN 1 THEN '" + CLOCKS + "' ELSE '" + SPOKEN + "' END, [", "regexp_extract(m, '" + CLOCKS + "', [").replace("h + mi / 60.0 AS hour", "CAST(h + mi / CAST(60 AS DOUBLE) AS DOUBLE) AS hour"))
def extract_times(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("pukul "), F.col("turn") % 13, F.lit(" petang until 6pm, at 7.30 am "), "text").alias("t"))
    return c.select("conv_id", "turn", F.explode(text.extract_times(F.col("t"))).alias("x")).select("conv_id", "turn", "x.hour", "x.kind")


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 7 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN CASE WHEN make_date(year(d), 10, 15) > d + 3 THEN make_date(year(d) - 1, 10, 15) ELSE make_date(year(d), 10, 15) END
  WHEN 1 THEN CASE WHEN make_date(year(d), 12, 15) > d + 3 THEN make_date(year(d) - 1, 12, 15) ELSE make_date(year(d), 12, 15) END
  WHEN 2 THEN d - CAST((isodow(d) + 5) % 7 AS INTEGER) WHEN 3 THEN d - 1 WHEN 4 THEN d WHEN 5 THEN d - CAST((isodow(d) + 6) % 7 AS INTEGER) END AS date,
  CASE k WHEN 0 THEN 'explicit' WHEN 1 THEN 'explicit' WHEN 2 THEN 'weekday' WHEN 3 THEN 'yesterday' WHEN 4 THEN 'today' WHEN 5 THEN 'weekday' END AS rule FROM o""")
def resolve_date(spark, d):
    words = F.element_at(F.array(*map(F.lit, ("on Oct 15", "15 dis lalu", "on Tuesday", "semalam", "hari ini", "Feb 30 Monday", "nothing"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", text.resolved_date(words, F.col("o_orderdate").cast("date")).alias("r")).select("o_orderkey", "r.date", "r.rule")


@query("""WITH v AS (SELECT o_custkey % 20 AS event_id, CAST(o_orderdate AS DATE) AS date, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 ELSE 1 END AS w FROM orders),
n AS (SELECT event_id, date, sum(w) AS votes, row_number() OVER (PARTITION BY event_id ORDER BY sum(w) DESC, date) AS k FROM v GROUP BY event_id, date)
SELECT event_id, date AS date_auto, CAST(votes AS BIGINT) AS votes FROM n WHERE k = 1""")
def date_vote(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    rule = F.when(p == "1", "explicit").when(p == "2", "weekday").when(p == "3", "yesterday").otherwise("today")
    return text.date_votes(table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("event_id"), F.col("o_orderdate").cast("date").alias("date"), rule.alias("rule")))


@query("""SELECT doc_id % 40 AS event_id, count(*) AS n_articles_used, DATE '2021-10-15' AS date_auto, 3 * count(*) AS votes, 18.0::DOUBLE AS hour_clock, count(*) AS clock_mentions, CAST(NULL AS DOUBLE) AS hour_period,
  'Klang (' || count(*) || '); Petaling (' || count(*) || ')' AS districts, 'klang (' || count(*) || '); shah alam (' || count(*) || ')' AS places, round((3.045 + 3.073) / 2, 3)::DOUBLE AS lat, round((101.445 + 101.518) / 2, 3)::DOUBLE AS lon FROM documents GROUP BY 1""")
def event_details(spark, d):
    docs = table(spark, d, "documents").select((F.col("doc_id") % 40).alias("event_id"), F.col("doc_id").alias("url"), F.concat(F.lit("Banjir kilat in Klang and Shah Alam on Oct 15 at 6pm. "), F.col("text")).alias("text"), F.lit("2021-10-20").cast("date").alias("published"))
    return text.event_details(docs)


# ---------------------------------------------------------------- aggregates over tables


@query("""SELECT s_nationkey AS k, round(sum(s_acctbal * (s_suppkey % 5 + 1)) / sum(s_suppkey % 5 + 1), 3) AS lat, round(sum(s_suppkey * (s_suppkey % 5 + 1)) / CAST(sum(s_suppkey % 5 + 1) AS DOUBLE), 3) AS lon FROM supplier GROUP BY s_nationkey""")
def weighted_centroid(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("a"), F.col("s_suppkey").alias("b"), (F.col("s_suppkey") % 5 + 1).alias("w"))
    return text.weighted_centre(s, "k", "a", "b", "w")


@query("SELECT avg(CAST(doc_quality IS NULL AS INTEGER)) AS quality, avg(CAST(doc_toxic IS NULL AS INTEGER)) AS toxic FROM (SELECT quality AS doc_quality, toxic AS doc_toxic FROM documents LEFT JOIN labels USING (doc_id))")
def null_fraction(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return tables.null_shares(joined, ["quality", "toxic"])


@query("SELECT CAST(v AS INTEGER) AS value, count(l_linenumber) AS count FROM (SELECT unnest(range(9)) AS v) LEFT JOIN lineitem ON l_linenumber = v GROUP BY v")
def bincount_fill(spark, d):
    return tables.filled_counts(table(spark, d, "lineitem"), "l_linenumber", 9)


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'pooled' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, median(o_totalprice) AS mid FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def rollup_pooled_period(spark, d):
    return tables.pooled_and_each(table(spark, d, "orders"), "o_orderstatus", F.count("*").alias("n"), F.percentile("o_totalprice", F.lit(0.5)).alias("mid"))


@query("SELECT median(CASE WHEN quality = 1 THEN n_chars END) AS median_yes, median(CASE WHEN quality = 0 THEN n_chars END) AS median_no FROM documents JOIN labels USING (doc_id)")
def conditional_medians(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return tables.conditional_medians(j, "n_chars", F.col("quality") == 1)


# ---------------------------------------------------------------- panels


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Hourly values at five points: events as gauges, users as points."""
    e = table(spark, d, "events")
    h = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), (F.col("user_id") % 5).cast("int").alias("point"))
    return h.agg(F.avg("value").alias("mm"), F.max("value").alias("peak"), F.count("*").alias("n"))


PANEL = "pan AS (SELECT date_trunc('hour', ts) AS time, CAST(user_id % 5 AS INTEGER) AS point, avg(value) AS mm, max(value) AS peak, count(*) AS n FROM events GROUP BY 1, 2)"
WIDE = f"""{PANEL}, wide AS (SELECT time, {', '.join(f'max(CASE WHEN point = {k} THEN mm END) AS p{k}' for k in range(5))} FROM pan GROUP BY time)"""


def wide(spark, d) -> DataFrame:
    w = panel(spark, d).groupBy("time").pivot("point", list(range(5))).agg(F.first("mm"))
    return w.select("time", *(F.col(str(k)).alias(f"p{k}") for k in range(5)))


@query(f"WITH {WIDE} SELECT time, {', '.join(f'round(p{k}, 6) AS p{k}' for k in range(5))} FROM wide")
def pivot_points_wide(spark, d):
    return r6(wide(spark, d), *(f"p{k}" for k in range(5)))


@query(f"""WITH {WIDE}, s AS (SELECT time, greatest(p0, p1, p2, p3, p4) AS x FROM wide),
r AS (SELECT time, CASE WHEN count(x) OVER w = 3 THEN sum(x) OVER w END AS s3 FROM s WINDOW w AS (ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT CAST(time AS DATE) AS day, round(max(s3), 4) AS peak FROM r GROUP BY 1""")
def rolling3h_daily_peak(spark, d):
    return r6(features.rolling_peak(wide(spark, d), [f"p{k}" for k in range(5)]), "peak", digits=4)


@query(f"""WITH {PANEL}, h AS (SELECT CAST(time AS DATE) AS day, hour(time) AS hour, max(peak) AS v FROM pan GROUP BY 1, 2),
o AS (SELECT CAST(c_custkey AS BIGINT) AS event_id, DATE '2024-01-01' + CAST(c_custkey % 30 AS INTEGER) AS day, CAST(c_custkey * 5 % 47 AS DOUBLE) / 2 AS onset FROM customer),
b AS (SELECT *, CAST(CASE WHEN onset - floor(onset) = 0.5 THEN CASE WHEN floor(onset) % 2 = 0 THEN floor(onset) ELSE floor(onset) + 1 END ELSE round(onset) END AS INTEGER) AS hh FROM o)
SELECT event_id, max(v) AS peak FROM b LEFT JOIN h ON h.day = b.day AND h.hour BETWEEN greatest(hh - 3, 0) AND least(hh + 3, 23) GROUP BY event_id""")
def onset_window_peak(spark, d):
    hours = panel(spark, d).groupBy(F.to_date("time").alias("day"), F.hour("time").alias("hour")).agg(F.max("peak").alias("v"))
    k = F.col("c_custkey")
    onsets = table(spark, d, "customer").select(k.alias("event_id"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("day"), (k * 5 % 47 / 2.0).cast("double").alias("onset_hour"))
    return intervals.onset_peak(hours, onsets, "v")


@query(f"""WITH {PANEL}, m AS (SELECT time, avg(mm) AS v FROM pan GROUP BY time),
a AS (SELECT CAST(time AS DATE) AS day, round(v, 6) AS v00 FROM m WHERE hour(time) = 0), b AS (SELECT CAST(time AS DATE) + 1 AS day, round(v, 6) AS v18 FROM m WHERE hour(time) = 18)
SELECT day, v00, v18 FROM a FULL JOIN b USING (day)""")
def snapshot_00_18(spark, d):
    m = panel(spark, d).groupBy("time").agg(F.avg("mm").alias("v"))
    a, b = intervals.snapshot(m, "v", 0, 0, "v00"), intervals.snapshot(m, "v", 18, 1, "v18")
    return r6(a.join(b, "day", "full"), "v00", "v18")


@query(f"""WITH {PANEL}, u AS (SELECT time, -(mm / 50) * sin(radians(peak)) AS u, -(mm / 50) * cos(radians(peak)) AS v, mm FROM pan)
SELECT time, round(avg(mm), 6) AS mm, round(avg(u), 6) + 0.0 AS u, round(avg(v), 6) + 0.0 AS v FROM u GROUP BY time""")
def uv_area_mean(spark, d):
    p = panel(spark, d).select("time", "mm", (F.col("mm") / 50).alias("speed"), F.col("peak").alias("direction"))
    return r6(physics.area_mean(p, ["mm"], [("speed", "direction", "u", "v")]), "mm", "u", "v")


@query(f"""WITH {PANEL}, x AS (SELECT time, point, 20 + mm / 50 AS t, 15 + mm / 60 AS td, 1000.0 + point AS p FROM pan),
e AS (SELECT *, 6.112 * exp(17.67 * td / (td + 243.5)) AS e FROM x), r AS (SELECT *, 0.622 * e / (p - e) AS r, 1.0 / (1.0 / (td + 273.15 - 56.0) + ln((t + 273.15) / (td + 273.15)) / 800.0) AS tl FROM e)
SELECT time, point, round((t + 273.15) * pow(1000.0 / (p - e), 0.2854 * (1 - 0.28 * r)) * exp((3.376 / tl - 0.00254) * (r * 1000) * (1 + 0.81 * r)), 5) AS theta_e, round(r, 8) AS q FROM r""")
def theta_e(spark, d):
    t, td, p = 20 + F.col("mm") / 50, 15 + F.col("mm") / 60, 1000.0 + F.col("point")
    return panel(spark, d).select("time", "point", F.round(physics.theta_e(t, td, p), 5).alias("theta_e"), F.round(physics.specific_humidity_surface(td, p), 8).alias("q"))


POINTS = {"p0": (3.0, 101.4), "p1": (3.2, 101.5), "p2": (2.9, 101.7), "p3": (3.4, 101.6), "p4": (3.1, 101.9)}
_SLOPES = physics.plane_slopes(POINTS)


@query(f"""WITH {PANEL}, f AS (SELECT time, count(mm) AS n, sum(mm * CASE point {' '.join(f'WHEN {k} THEN {_SLOPES[f"p{k}"][0]!r}' for k in range(5))} END) AS ux,
  sum(peak * CASE point {' '.join(f'WHEN {k} THEN {_SLOPES[f"p{k}"][1]!r}' for k in range(5))} END) AS vy FROM pan GROUP BY time)
SELECT time, round(-(ux + vy) * 1000, 2) + 0.0 AS mfc FROM f WHERE n = 5""")
def flux_convergence(spark, d):
    p = panel(spark, d).withColumn("point", F.concat(F.lit("p"), "point"))
    return r6(physics.flux_convergence(p, POINTS, "mm", "peak"), "mfc", digits=2)


@query("""SELECT vec_id, CAST((floor((atan2(embedding[2], embedding[1]) + pi()) / (pi() / 4)) % 8 + 8) % 8 AS INTEGER) AS sector, sqrt(CAST(embedding[1] AS DOUBLE) * embedding[1] + CAST(embedding[2] AS DOUBLE) * embedding[2]) >= 0.1 AS active FROM embeddings""")
def phase_sector(spark, d):
    a, b = (F.get("embedding", F.lit(k)).cast("double") for k in (0, 1))
    return table(spark, d, "embeddings").select("vec_id", physics.phase_sector(a, b).alias("sector"), (F.sqrt(a * a + b * b) >= 0.1).alias("active"))


@query(f"""WITH {PANEL}, q AS (SELECT quantile_cont(mm, 0.75) AS e FROM pan) SELECT CAST(time AS DATE) AS day, count(*) FILTER (mm > e) AS hi_hours, avg(CAST(mm IS NULL AS INTEGER)) AS missing_share FROM pan, q GROUP BY 1""")
def hours_above(spark, d):
    return features.hours_above(panel(spark, d), "mm")


# ---------------------------------------------------------------- folds, measures and models


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents scored by length, many scores tied."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return j.select("lang", "doc_id", F.col("quality").alias("y"), F.floor(F.col("n_chars") / 200).cast("double").alias("score"))


SCORES = "s AS (SELECT lang, doc_id, quality AS y, CAST(floor(n_chars / 200) AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"
CURVE = f"""{SCORES}, g AS (SELECT lang, score, sum(y) AS p, count(*) AS n FROM s GROUP BY lang, score),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS nn, sum(p) OVER (PARTITION BY lang) AS pos, sum(n) OVER (PARTITION BY lang) AS tot FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC))"""


@query(f"WITH {CURVE} SELECT lang, round(sum(p / pos * (tp / nn)), 6) AS ap FROM (SELECT lang, CAST(p AS DOUBLE) AS p, pos, CAST(tp AS DOUBLE) AS tp, nn FROM c) GROUP BY lang")
def avg_precision(spark, d):
    return r6(ev.average_precision(scores(spark, d), ["lang"]), "ap")


@query(f"WITH {CURVE} SELECT lang, round(sum((n - p) * (tp - p / 2.0)) / max(CAST(pos AS DOUBLE) * (tot - pos)), 6) AS roc FROM c GROUP BY lang")
def roc_auc(spark, d):
    return r6(ev.roc_auc(scores(spark, d), ["lang"]), "roc")


@query(f"WITH {CURVE} SELECT lang, score, CAST(tp AS BIGINT) AS tp, CAST(nn AS BIGINT) AS n, round(CAST(tp AS DOUBLE) / nn, 6) AS precision, round(CAST(tp AS DOUBLE) / pos, 6) AS recall FROM c")
def pr_curve(spark, d):
    return r6(ev.curve(scores(spark, d), ["lang"]).select("lang", "score", "tp", "n", "precision", "recall"), "precision", "recall")


@query(f"WITH {SCORES} SELECT lang, round(avg(pow(1 / (1 + score) - y, 2)), 6) AS brier FROM s GROUP BY lang")
def brier(spark, d):
    return r6(ev.brier(scores(spark, d).withColumn("score", 1 / (1 + F.col("score"))), ["lang"]), "brier")


@query(f"""WITH {SCORES}, k AS (SELECT lang, count(*) FILTER (y = 1 AND score < 15) AS hits, count(*) FILTER (y = 0 AND score < 15) AS false_alarms, count(*) FILTER (y = 1 AND score >= 15) AS misses FROM s GROUP BY lang)
SELECT lang, hits, false_alarms, misses, round(hits / greatest(hits + false_alarms + misses, 1), 6) AS csi, round(hits / greatest(hits + misses, 1), 6) AS pod, round(false_alarms / greatest(hits + false_alarms, 1), 6) AS far FROM k""")
def csi_contingency(spark, d):
    return r6(ev.contingency(scores(spark, d).withColumn("alert", F.col("score") < 15), ["lang"]), "csi", "pod", "far")


@query(f"""WITH {SCORES}, q AS (SELECT lang, unnest(quantile_cont(score, [{', '.join(repr(0.5 + 0.495 * k / 59) for k in range(60))}])) AS t FROM s GROUP BY lang),
u AS (SELECT DISTINCT lang, t FROM q), k AS (SELECT u.lang, t, sum(CASE WHEN score >= t THEN y ELSE 0 END) AS h, sum(CASE WHEN score >= t THEN 1 ELSE 0 END) AS a, sum(y) AS p FROM u JOIN s ON s.lang = u.lang GROUP BY u.lang, t),
r AS (SELECT *, CAST(h AS DOUBLE) / greatest(a + p - h, 1) AS csi FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY csi DESC, t) AS n FROM r)
SELECT lang, round(t, 6) AS threshold, round(csi, 6) AS csi FROM o WHERE n = 1""")
def best_threshold(spark, d):
    return r6(ev.best_threshold(scores(spark, d), ["lang"]), "threshold", "csi")


@query(f"""WITH {SCORES}, e AS (SELECT lang, quantile_cont(score, 0.95) AS a, quantile_cont(score, 0.9) AS b, quantile_cont(score, 0.8) AS c FROM s GROUP BY lang)
SELECT s.lang, round(sum(CASE WHEN score >= a THEN y ELSE 0 END) / sum(y), 6) AS capture_5, round(sum(CASE WHEN score >= b THEN y ELSE 0 END) / sum(y), 6) AS capture_10, round(sum(CASE WHEN score >= c THEN y ELSE 0 END) / sum(y), 6) AS capture_20 FROM s JOIN e ON e.lang = s.lang GROUP BY s.lang""")
def budget_capture(spark, d):
    return r6(ev.budget_capture(scores(spark, d), by=["lang"]), "capture_5", "capture_10", "capture_20")


CUTS = ("1997-01-01", "1999-01-01", "2000-06-01")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Days with features and spike days as events."""
    s = spiky(spark, d).select("day", F.col("spike").cast("int").alias("y"), F.col("n_loose").cast("double").alias("f1"), F.col("n_strict").cast("double").alias("f2"))
    return s.withColumns(features.month_columns()).drop("ne_monsoon")


DATA = f"{SPIKES}, dt AS (SELECT day, CAST(spike AS INTEGER) AS y, n_loose FROM sp)"
FOLDS = f"""{DATA}, fo AS (SELECT CAST(k AS INTEGER) AS fold, CAST(a AS DATE) AS a, CAST(b AS DATE) AS b FROM (VALUES (0, '1997-01-01', '1999-01-01'), (1, '1999-01-01', '2000-06-01'), (2, '2000-06-01', '2999-01-01')) v(k, a, b)),
ff AS (SELECT fold, CASE WHEN day < a THEN 'train' ELSE 'test' END AS part, day, y, n_loose FROM dt JOIN fo ON day < b)"""


@query(f"WITH {FOLDS} SELECT fold, part, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, min(day) AS lo, max(day) AS hi FROM ff GROUP BY fold, part")
def expanding_folds(spark, d):
    f = ev.expanding_folds(labelled(spark, d), CUTS)
    return f.groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.min("day").alias("lo"), F.max("day").alias("hi"))


@query(f"""WITH {DATA}, q AS (SELECT CAST(date_trunc('quarter', day) AS DATE) AS fold, min(day) AS lo, max(day) AS hi FROM dt GROUP BY 1),
f AS (SELECT fold, CASE WHEN date_trunc('quarter', day) = fold THEN 'test' WHEN day < lo - 7 OR day > hi + 7 THEN 'train' END AS part, day, y FROM dt, q)
SELECT fold, part, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM f WHERE part IS NOT NULL GROUP BY fold, part""")
def purged_quarter_folds(spark, d):
    return ev.purged_quarters(labelled(spark, d)).groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query(f"""WITH {FOLDS}, r AS (SELECT fold, month(day) AS m, avg(y) AS rate FROM ff WHERE part = 'train' GROUP BY 1, 2), b AS (SELECT fold, avg(y) AS base FROM ff WHERE part = 'train' GROUP BY fold),
t AS (SELECT fold, quantile_cont(rate, 0.75) AS threshold FROM r GROUP BY fold)
SELECT ff.fold, day, y, round(coalesce(rate, base), 6) AS score, round(threshold, 6) AS threshold FROM ff LEFT JOIN r ON r.fold = ff.fold AND m = month(day) JOIN b ON b.fold = ff.fold JOIN t ON t.fold = ff.fold WHERE part = 'test'""")
def climatology_month_rate(spark, d):
    return r6(ev.climatology(ev.expanding_folds(labelled(spark, d), CUTS)), "score", "threshold")


@query(f"""WITH {FOLDS}, q AS (SELECT fold, unnest(quantile_cont(n_loose, [{', '.join(repr(0.5 + 0.495 * k / 59) for k in range(60))}])) AS t FROM ff WHERE part = 'train' GROUP BY fold), u AS (SELECT DISTINCT fold, t FROM q),
k AS (SELECT u.fold, t, sum(CASE WHEN n_loose >= t THEN y ELSE 0 END) AS h, sum(CASE WHEN n_loose >= t THEN 1 ELSE 0 END) AS a, sum(y) AS p FROM u JOIN ff ON ff.fold = u.fold WHERE part = 'train' GROUP BY u.fold, t),
o AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY CAST(h AS DOUBLE) / greatest(a + p - h, 1) DESC, t) AS n FROM k)
SELECT ff.fold, day, y, CAST(n_loose AS DOUBLE) AS score, round(t, 6) AS threshold FROM ff JOIN o ON o.fold = ff.fold WHERE n = 1 AND part = 'test'""")
def rank_baseline(spark, d):
    return r6(ev.rank_baseline(ev.expanding_folds(labelled(spark, d), CUTS), "f1"), "threshold")


SETS = {"counts": ["f1", "f2"], "season": ["month_sin", "month_cos"], "all": ["f1", "f2", "month_sin", "month_cos"]}


@query()
def logistic_cv_scores(spark, d):
    return ev.logistic_scores(ev.purged_quarters(labelled(spark, d)), SETS, least=3)


@query()
def logistic_expanding_scores(spark, d):
    return ev.logistic_scores(ev.expanding_folds(labelled(spark, d), CUTS), SETS)


@query()
def transfer_scores(spark, d):
    data = labelled(spark, d)
    return ev.transfer_scores(data.where("day < date '1999-01-01'"), data.where("day >= date '1999-01-01'"), SETS)


def _one_model(spark, d) -> DataFrame:
    return labelled(spark, d).select("day", "y", F.col("f1").alias("score"), F.col("f2").alias("other"))


@query()
def block_bootstrap_ap(spark, d):
    return ev.interval(ev.bootstrap_ap(_one_model(spark, d), 1000))


@query()
def paired_bootstrap(spark, d):
    return ev.interval(ev.paired_bootstrap(_one_model(spark, d), "score", "other", 1000))


@query()
def permutation_p(spark, d):
    return ev.permutation_p(_one_model(spark, d), 500)


@query()
def bootstrap_mean_ci(spark, d):
    return ev.interval(ev.bootstrap_mean(intervals.control_percentile(daily(spark, d), spiky(spark, d).where("spike").select("day"), "n_loose"), "pct"))


@query()
def cluster_permutation(spark, d):
    days = spiky(spark, d).select(F.year("day").alias("period"), "day", F.col("spike").cast("int").alias("flood"))
    return ev.clustering_permutation(days, 14, 500, by_month=True)


def _sectors(spark, d) -> DataFrame:
    s = spiky(spark, d)
    return s.select(F.when(F.col("n_loose") >= 3, F.dayofyear("day") % 8).otherwise(8).cast("int").alias("cat"), F.col("spike").cast("int").alias("flood"), F.date_format("day", "yyyy_MM").alias("stratum"))


@query(f"""WITH {SPIKES}, k AS (SELECT CAST(CASE WHEN n_loose >= 3 THEN dayofyear(day) % 8 ELSE 8 END AS INTEGER) AS cat, CAST(spike AS INTEGER) AS flood FROM sp),
c AS (SELECT CAST(v AS INTEGER) AS cat, count(flood) AS days, CAST(coalesce(sum(flood), 0) AS BIGINT) AS floods FROM (SELECT unnest(range(9)) AS v) LEFT JOIN k ON cat = v GROUP BY v)
SELECT cat, days, floods, round(sum(floods) OVER () * days / sum(days) OVER (), 6) AS expected, round(100 * floods / greatest(days, 1), 6) AS floods_per_100d FROM c""")
def sector_counts(spark, d):
    return r6(ev.category_counts(_sectors(spark, d)), "expected", "floods_per_100d")


@query()
def sector_chi2(spark, d):
    return ev.sector_permutation(_sectors(spark, d), n=500)


@query()
def harmonic_zscore(spark, d):
    return harmonics.seasonal_z(daily(spark, d).select("day", F.col("n_loose").cast("double").alias("x")), "x", F.col("day") < F.lit("2000-01-01").cast("date"))


@query()
def tide_harmonic_fit(spark, d):
    p = panel(spark, d).groupBy("time").agg(F.avg("mm").alias("sea_level"))
    tide = harmonics.Tide.fit(p, names=("M2", "S2", "K1", "O1"))
    return harmonics.fit_report(tide.predict(p), "sea_level", "tide_m")


@query(f"""WITH {SPIKES}, x AS (SELECT day, CAST(n_loose AS DOUBLE) AS y, CAST(n_strict AS DOUBLE) AS a, sin(2 * pi() * month(day) / 12) AS b FROM sp),
m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bb FROM x WHERE day < DATE '2000-01-01'),
w AS (SELECT *, (ay * vb - bb * ab) / (va * vb - ab * ab) AS wa, (bb * va - ay * ab) / (va * vb - ab * ab) AS wb FROM m), p AS (SELECT y, y - (my + wa * (a - ma) + wb * (b - mb)) AS e FROM x, w WHERE day >= DATE '2000-01-01')
SELECT round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2, round(stddev_pop(e), 6) AS residual_sd, count(*) AS n FROM p""")
def linear_fit(spark, d):
    return r6(_linear_fit(spark, d), "r2", "residual_sd")


def _linear_fit(spark, d) -> DataFrame:
    return harmonics.linear_fit_report(labelled(spark, d), "f1", ["f2", "month_sin"], F.col("day") < F.lit("2000-01-01").cast("date"))


# ---------------------------------------------------------------- states and reports

#: added before results are rounded, so that no value of few digits lies between two of nine
TIES = 3.3e-11
#: the panel with means in whole sixteenths, which add up alike in any order
EXACT = "ex AS (SELECT date_trunc('hour', ts) AS time, CAST(user_id % 5 AS INTEGER) AS point, CAST(sum(CAST(round(value * 100) AS BIGINT)) * 16 // (100 * count(*)) AS DOUBLE) / 16 AS mm, max(value) AS peak FROM events GROUP BY 1, 2)"


def exact_panel(spark, d) -> DataFrame:
    h = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), (F.col("user_id") % 5).cast("int").alias("point"))
    return h.agg((F.expr("sum(cast(round(value * 100) as bigint)) * 16 div (100 * count(*))").cast("double") / 16).alias("mm"), F.max("value").alias("peak"))


def era5_like(spark, d) -> DataFrame:
    m, k = F.col("mm"), F.col("point")
    return exact_panel(spark, d).select(
        "time", F.concat(F.lit("p"), "point").alias("point"), (20 + m / 50).alias("temperature_2m"), (15 + m / 60).alias("dew_point_2m"), (1000.0 + k).alias("surface_pressure"), (50 + m / 20).alias("relative_humidity_2m"), (m / 5).alias("cloud_cover"),
        (m * 2).alias("shortwave_radiation"), (m + 100).alias("boundary_layer_height"), (m / 1000).alias("soil_moisture_0_to_7cm"), (40 + m / 30).alias("total_column_integrated_water_vapour"), (F.col("peak") / 50).alias("wind_speed_10m"), (F.col("peak") * 0.7).alias("wind_direction_10m"),
    )


def nwp_like(spark, d) -> DataFrame:
    m = F.col("mm")
    return exact_panel(spark, d).select(
        "time", F.concat(F.lit("p"), "point").alias("point"), (10 + m / 50).alias("temperature_850hPa"), (m / 90 - 10).alias("temperature_500hPa"), (50 + m / 20).alias("relative_humidity_850hPa"), (m * 4).alias("cape"), (-m / 100).alias("lifted_index"),
        (F.col("peak") / 40).alias("wind_speed_850hPa"), (F.col("peak") * 0.5).alias("wind_direction_850hPa"),
    )


@query(f"""WITH {EXACT}, e AS (SELECT time, avg(40 + mm / 30) AS w, avg(mm * 2) AS sw, avg(20 + mm / 50) AS t FROM ex GROUP BY time),
c AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(time AS DATE)) FROM e), (SELECT max(CAST(time AS DATE)) FROM e), INTERVAL 1 DAY)) AS DATE) AS day),
g AS (SELECT CAST(time AS DATE) AS day, avg(w) AS wm, max(w) AS wx, sum(sw) AS sw, max(t) AS t FROM e GROUP BY 1), z AS (SELECT CAST(time AS DATE) AS day, w AS w00 FROM e WHERE hour(time) = 0)
SELECT day, round(lag(wm) OVER (ORDER BY day) + {TIES}, 9) AS tcwv_d1_mean, round(lag(wx) OVER (ORDER BY day) + {TIES}, 9) AS tcwv_d1_max, round(lag(sw) OVER (ORDER BY day) + {TIES}, 9) AS sw_d1_sum, round(w00 + {TIES}, 9) AS tcwv_00, round(w00 - lag(w00) OVER (ORDER BY day) + {TIES}, 9) AS tcwv_delta24, round(t + {TIES}, 9) AS now_t2m_max
FROM c LEFT JOIN g USING (day) LEFT JOIN z USING (day)""")
def state_features(spark, d):
    f = reports.state_features(era5_like(spark, d), nwp_like(spark, d))
    f = f.select("day", "tcwv_d1_mean", "tcwv_d1_max", "sw_d1_sum", "tcwv_00", "tcwv_delta24", "now_t2m_max")
    return f.select("day", *(F.round(F.col(c) + TIES, 9).alias(c) for c in f.columns[1:]))


def _vapour(td: str) -> str:
    return f"6.112 * exp(17.67 * ({td}) / (({td}) + 243.5))"


AREAS = f"""{EXACT}, e0 AS (SELECT time, avg(20 + mm / 50) AS t, avg(15 + mm / 60) AS td, avg(1000.0 + point) AS p, avg(50 + mm / 20) AS rh, avg(mm / 5) AS cc, avg(mm * 2) AS sw, avg(mm + 100) AS blh, avg(mm / 1000) AS soil, avg(40 + mm / 30) AS w,
  avg(-(peak / 50) * sin(radians(peak * 0.7))) AS u10, avg(-(peak / 50) * cos(radians(peak * 0.7))) AS v10 FROM ex GROUP BY time),
e1 AS (SELECT *, {_vapour('td')} AS ve FROM e0), e2 AS (SELECT *, 0.622 * ve / (p - ve) AS r, 1.0 / (1.0 / (td + 273.15 - 56.0) + ln((t + 273.15) / (td + 273.15)) / 800.0) AS tl FROM e1),
e AS (SELECT *, CAST(time AS DATE) AS day, (t + 273.15) * pow(1000.0 / (p - ve), 0.2854 * (1 - 0.28 * r)) * exp((3.376 / tl - 0.00254) * (r * 1000) * (1 + 0.81 * r)) AS th FROM e2),
n AS (SELECT time, CAST(time AS DATE) AS day, avg(10 + mm / 50) AS t850, avg(10 + mm / 50) - avg(mm / 90 - 10) AS lapse, avg(50 + mm / 20) AS rh850, avg(mm * 4) AS cape, avg(-mm / 100) AS li,
  avg(-(peak / 40) * sin(radians(peak * 0.5))) AS u850, avg(-(peak / 40) * cos(radians(peak * 0.5))) AS v850 FROM ex GROUP BY time),
cal AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM e), (SELECT max(day) FROM e), INTERVAL 1 DAY)) AS DATE) AS day)"""
STATE = {
    "g": ("e", {"tcwv_d1_mean": "avg(w)", "tcwv_d1_max": "max(w)", "dewp_d1_mean": "avg(td)", "t2m_d1_max": "max(t)", "thetae_d1_max": "max(th)", "thetae_d1_mean": "avg(th)", "rh_d1_mean": "avg(rh)", "cloud_d1_mean": "avg(cc)", "sw_d1_sum": "sum(sw)", "blh_d1_max": "max(blh)", "u10_d1": "avg(u10)", "v10_d1": "avg(v10)"}),
    "h": ("n", {"cape_d1_max": "max(cape)", "cape_d1_mean": "avg(cape)", "li_d1_min": "min(li)", "lapse_d1_mean": "avg(lapse)", "t850_d1_mean": "avg(t850)", "rh850_d1_mean": "avg(rh850)", "u850_d1": "avg(u850)", "v850_d1": "avg(v850)"}),
}
SAME = {
    "se": ("e", {"now_tcwv_mean": "avg(w)", "now_thetae_max": "max(th)", "now_t2m_max": "max(t)", "now_cloud_mean": "avg(cc)", "tcwv_00": "max(w) FILTER (hour(time) = 0)", "thetae_00": "max(th) FILTER (hour(time) = 0)", "dewp_00": "max(td) FILTER (hour(time) = 0)", "soil_00": "max(soil) FILTER (hour(time) = 0)"}),
    "sn": ("n", {"now_cape_max": "max(cape)", "now_li_min": "min(li)", "cape_00": "max(cape) FILTER (hour(time) = 0)", "rh850_00": "max(rh850) FILTER (hour(time) = 0)", "t850_00": "max(t850) FILTER (hour(time) = 0)"}),
}
_parts = {k: f"{k} AS (SELECT day, {', '.join(f'{f} AS {name}' for name, f in v.items())} FROM {t} GROUP BY day)" for k, (t, v) in (STATE | SAME).items()}


@query(f"""WITH {AREAS}, {', '.join(_parts.values())}, c AS (SELECT day, max(c) AS cape_fc1_max FROM (SELECT time, CAST(time AS DATE) AS day, avg(mm) AS c FROM ex GROUP BY time) GROUP BY day)
SELECT day, {', '.join(f'round(lag({name}) OVER (ORDER BY day) + {TIES}, 9) AS {name}' for _, v in STATE.values() for name in v)}, {', '.join(f'round({name} + {TIES}, 9) AS {name}' for _, v in SAME.values() for name in v)},
  round(tcwv_00 - lag(tcwv_00) OVER (ORDER BY day) + {TIES}, 9) AS tcwv_delta24, round(cape_fc1_max + {TIES}, 9) AS cape_fc1_max FROM cal LEFT JOIN g USING (day) LEFT JOIN h USING (day) LEFT JOIN se USING (day) LEFT JOIN sn USING (day) LEFT JOIN c USING (day)""")
def state_features_all(spark, d):
    f = reports.state_features(era5_like(spark, d), nwp_like(spark, d), exact_panel(spark, d).select("time", F.col("mm").alias("cape_previous_day1")))
    return f.select("day", *(F.round(F.col(c) + TIES, 9).alias(c) for c in f.columns if c != "day"))


@query(f"""WITH {AREAS}, q AS (SELECT quantile_cont(w, 0.75) AS edge FROM e), dd AS (SELECT day, avg(w) AS m, count(*) FILTER (w > edge) AS hi, avg(CAST(w IS NULL AS INTEGER)) AS missing, max(w) FILTER (hour(time) = 0) AS tcwv_00, max(w) FILTER (hour(time) = 18) AS w18 FROM e, q GROUP BY day),
f0 AS (SELECT time, count(*) AS n, -(sum(qu * CASE point {' '.join(f'WHEN {k} THEN {_SLOPES[f"p{k}"][0]!r}' for k in range(5))} END) + sum(qv * CASE point {' '.join(f'WHEN {k} THEN {_SLOPES[f"p{k}"][1]!r}' for k in range(5))} END)) * 1000 AS mfc
  FROM (SELECT time, point, q * -(peak / 50) * sin(radians(peak * 0.7)) AS qu, q * -(peak / 50) * cos(radians(peak * 0.7)) AS qv FROM (SELECT *, 0.622 * ({_vapour('15 + mm / 60')}) / (1000.0 + point - ({_vapour('15 + mm / 60')})) AS q FROM ex)) GROUP BY time),
fd AS (SELECT CAST(time AS DATE) AS day, max(mfc) FILTER (hour(time) = 0) AS mfc_00, max(mfc) AS hi_mfc, avg(mfc) AS mean_mfc FROM f0 WHERE n = 5 GROUP BY 1),
n0 AS (SELECT *, rh850 / 100 * ({_vapour('t850')}) AS ve FROM n WHERE hour(time) = 0), nd AS (SELECT day, 0.622 * ve / (850 - 0.378 * ve) * 1000 AS q850, u850, v850 FROM n0),
j AS (SELECT cal.day, dd.*  EXCLUDE (day), mfc_00, hi_mfc, mean_mfc, q850, u850, v850 FROM cal LEFT JOIN dd USING (day) LEFT JOIN fd USING (day) LEFT JOIN nd USING (day)),
k AS (SELECT *, CASE WHEN count(m) OVER (ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) >= 30 THEN avg(m) OVER (ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS m60 FROM j)
SELECT day, round(tcwv_00 + {TIES}, 9) AS tcwv_00, round(tcwv_00 - m60 + {TIES}, 9) AS tcwv_anom_00, round(tcwv_00 - lag(w18) OVER o + {TIES}, 9) AS tcwv_chg6_00, round(tcwv_00 - lag(tcwv_00) OVER o + {TIES}, 9) AS tcwv_chg24_00, lag(hi) OVER o AS tcwv_hi_hours_d1, coalesce(missing, 0.0) AS tcwv_missing,
  round(mfc_00 + {TIES}, 9) AS mfc_00, round(lag(hi_mfc) OVER o + {TIES}, 9) AS mfc_d1_min, round(lag(mean_mfc) OVER o + {TIES}, 9) AS mfc_d1_mean, round(q850 + {TIES}, 9) AS q850_00, round(q850 * u850 + {TIES}, 9) AS fluxu850_00, round(q850 * v850 + {TIES}, 9) AS fluxv850_00, round(tcwv_00 * sqrt(u850 * u850 + v850 * v850) + {TIES}, 9) AS ivt_proxy_00
FROM k WINDOW o AS (ORDER BY day)""")
def moisture_features(spark, d):
    f = reports.moisture_features(era5_like(spark, d), nwp_like(spark, d), POINTS)
    return f.select(*(F.round(F.col(c) + TIES, 9).alias(c) if kind == "double" else F.col(c) for c, kind in f.dtypes))


@query("SELECT CAST(ts AS DATE) AS day, max(value) AS high, min(value) AS low FROM events GROUP BY 1")
def tide_daily(spark, d):
    return reports.tide_daily(table(spark, d, "events").select(F.col("ts").alias("time"), F.col("value").alias("tide_m")))


@query("""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS x FROM lineitem GROUP BY 1),
j AS (SELECT a.day, a.x AS a, b.x AS b FROM a JOIN b USING (day)), k AS (SELECT j.*, n.b AS b_next FROM j LEFT JOIN j n ON n.day = j.day + 1)
SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(corr(a, b), 6) AS corr_same, round(corr(a, b_next), 6) AS corr_next FROM k""")
def compared_series(spark, d):
    n = lambda t, c: table(spark, d, t).groupBy(F.col(c).cast("date").alias("day")).agg(F.count("*").cast("double").alias("x"))
    return r6(reports.compared(n("orders", "o_orderdate"), n("lineitem", "l_shipdate"), "x"), "mean_a", "mean_b", "corr_same", "corr_next")


@query()
def folded_seasonal_scores(spark, d):
    return reports.folded_z_scores(ev.purged_quarters(labelled(spark, d)), ["f1", "f2"], {"z": ["z_f1", "z_f2"], "both": ["z_f1", "f2"]})


@query()
def model_summary(spark, d):
    s = ev.logistic_scores(ev.expanding_folds(labelled(spark, d), CUTS), SETS)
    return reports.summary(s.select("model", "day", "y", "score", (F.col("score") >= F.col("threshold")).alias("alert")), list(SETS), 200, 200)


@query()
def feature_set_scores(spark, d):
    data = labelled(spark, d).withColumn("period", F.year("day"))
    return reports.evaluate_sets(data, {"counts": ["f1", "f2"], "rank of f1": "f1", "mean rank": "composite"}, ["f1", "f2"])


@query(f"""WITH {SPIKES}, f AS (SELECT day FROM sp WHERE spike), v AS (SELECT d.day + k AS day, k, n_loose AS c FROM daily d, (SELECT unnest([0, 1]) AS k)),
ctl AS (SELECT f.day AS d0, v.k, v.c FROM f JOIN v ON v.day BETWEEN f.day - 45 AND f.day + 45 WHERE NOT EXISTS (SELECT 1 FROM f g WHERE v.day BETWEEN g.day - 3 AND g.day + 3)),
p AS (SELECT o.k, f.day, CASE WHEN count(ctl.c) >= 20 THEN avg(CASE WHEN ctl.c < o.c THEN 1.0 WHEN ctl.c = o.c THEN 0.5 ELSE 0.0 END) END AS pct FROM f JOIN v o ON o.day = f.day LEFT JOIN ctl ON d0 = f.day AND ctl.k = o.k GROUP BY o.k, f.day)
SELECT 'n_loose' AS series, CAST(k AS INTEGER) AS lag, count(pct) AS n, round(avg(pct), 6) AS mean_pct FROM p GROUP BY k""")
def lag_profile(spark, d):
    return r6(reports.lag_profile(daily(spark, d), spiky(spark, d).where("spike").select("day"), ["n_loose"], [0, 1]), "mean_pct")


def _details_sql(n: str) -> str:
    return f"avg(CASE WHEN NOT own AND {n} IS NOT NULL THEN CASE WHEN {n} < o_{n} THEN 1.0 WHEN {n} = o_{n} THEN 0.5 ELSE 0.0 END END)"


STATS = ("area_day", "local_day", "local_peak3", "area_peak3", "local_window3", "area_window3")


@query(f"""WITH {CLUSTERS}, {R}, det AS (SELECT event_id, ev.start AS day, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 9 AS DOUBLE) / 2 END AS onset, CAST(CASE event_id % 3 WHEN 1 THEN CASE event_id % 9 WHEN 1 THEN 0 WHEN 4 THEN 2 ELSE 4 END WHEN 2 THEN CASE event_id % 9 WHEN 2 THEN 1 WHEN 5 THEN 2 ELSE 4 END END AS INTEGER) AS h FROM ev),
rh AS (SELECT point, day, hour, coalesce(sum(mm), 0) AS mm FROM r GROUP BY point, day, hour), s3 AS (SELECT *, CASE WHEN count(mm) OVER w = 3 THEN sum(mm) OVER w END AS s FROM rh WINDOW w AS (PARTITION BY point ORDER BY day, hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
loc AS (SELECT day, sum(mm) AS local_day, max(s) AS local_peak3 FROM s3 WHERE point = 'p1' GROUP BY day), ar AS (SELECT day, max(t) AS area_day, max(p) AS area_peak3 FROM (SELECT point, day, sum(mm) AS t, max(s) AS p FROM s3 GROUP BY point, day) GROUP BY day),
buf AS (SELECT DISTINCT CAST(unnest(generate_series(day - 3, day + 3, INTERVAL 1 DAY)) AS DATE) AS day FROM det),
ctl AS (SELECT event_id, h, CAST(unnest(generate_series(day - 45, day + 45, INTERVAL 1 DAY)) AS DATE) AS day FROM det),
dd AS (SELECT event_id, h, day, false AS own FROM ctl WHERE day NOT IN (SELECT day FROM buf) AND day IN (SELECT day FROM loc) UNION ALL SELECT event_id, h, day, true FROM det),
win AS (SELECT event_id, dd.day, max(CASE WHEN point = 'p1' THEN s END) AS local_window3, max(s) AS area_window3 FROM dd JOIN s3 ON s3.day = dd.day AND h IS NOT NULL AND hour BETWEEN greatest(h - 3, 0) AND least(h + 3, 23) GROUP BY event_id, dd.day),
f AS (SELECT dd.event_id, dd.h, dd.day, own, area_day, local_day, local_peak3, area_peak3, local_window3, area_window3 FROM dd LEFT JOIN loc USING (day) LEFT JOIN ar USING (day) LEFT JOIN win ON win.event_id = dd.event_id AND win.day = dd.day),
g AS (SELECT *, {', '.join(f'max(CASE WHEN own THEN {n} END) OVER (PARTITION BY event_id) AS o_{n}' for n in STATS)} FROM f)
SELECT event_id, count(*) FILTER (NOT own) AS n_controls, {', '.join(f'max(o_{n}) AS {n}' for n in STATS)}, {', '.join(f"{'CASE WHEN max(h) IS NOT NULL THEN ' if n.endswith('window3') else ''}round({_details_sql(n)}, 6){' END' if n.endswith('window3') else ''} AS {n}_pct" for n in STATS)} FROM g GROUP BY event_id""")
def event_rain_ranks(spark, d):
    from tidemark.plans.series_queries import rain_panel

    rain = rain_panel(spark, d).groupBy("point", "time").agg(F.coalesce(F.sum("precip_mm"), F.lit(0.0)).alias("mm"))
    k = F.col("event_id")
    details = op.cluster_days(spiky(spark, d).where("spike").select("day")).select("event_id", F.col("start").alias("day"), F.when(k % 3 > 0, (k % 9) / 2.0).cast("double").alias("onset_hour"))
    local = rain.where("point = 'p1'").select("time", "mm").crossJoin(F.broadcast(details.select("event_id")))  # tens of events
    ranks = reports.event_rain_ranks(local, rain, details)
    return r6(ranks, *(f"{n}_pct" for n in STATS))


@query(f"""WITH {NESTED},
l AS (SELECT k, bool_or(adm1 = 'MY12') AS has_selangor, bool_or(adm1 = 'MY14') AS has_kl FROM p GROUP BY k), h AS (SELECT k, bool_or(theme LIKE '%FLOOD%') AS flood FROM t GROUP BY k),
m AS (SELECT p.k, min(abs(p.off - t.off)) AS dist FROM p JOIN t USING (k) WHERE adm1 IN ('MY12', 'MY14') AND theme LIKE '%FLOOD%' GROUP BY p.k),
x AS (SELECT CAST(date + INTERVAL 8 HOUR AS DATE) AS day, domain, my_domain, coalesce(has_selangor, false) AS has_selangor, coalesce(has_kl, false) AS has_kl, coalesce(flood, false) AND coalesce(dist <= 300, true) AS strict
  FROM art LEFT JOIN l USING (k) LEFT JOIN h USING (k) LEFT JOIN m USING (k) WHERE coalesce(has_selangor, false) OR coalesce(has_kl, false)),
c AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM x),
n AS (SELECT day, count(*) AS n_loose, count(*) FILTER (strict) AS n_strict, count(*) FILTER (strict AND my_domain) AS n_strict_my, count(DISTINCT CASE WHEN strict THEN domain END) AS n_strict_domains,
  count(*) FILTER (strict AND has_selangor) AS n_strict_selangor, count(*) FILTER (strict AND has_kl) AS n_strict_kl FROM x GROUP BY day)
SELECT c.day, {', '.join(f'coalesce({n}, 0) AS {n}' for n in ('n_loose', 'n_strict', 'n_strict_my', 'n_strict_domains', 'n_strict_selangor', 'n_strict_kl'))} FROM c LEFT JOIN n USING (day)""")
def strict_tier_of_parsed_articles(spark, d):
    arts, _ = nested.build_tables(raw_v2(spark, d))
    return op.tier_counts(nested.article_days(arts))


@query(f"""WITH {CLUSTERS}, w AS (SELECT ev.event_id, a.* FROM a JOIN ev ON a.day BETWEEN ev.start AND ev.end WHERE has_target AND strict AND my_domain),
f AS (SELECT *, row_number() OVER (PARTITION BY event_id, domain ORDER BY n_my_places, day, url) AS k FROM w),
g AS (SELECT event_id, url, row_number() OVER (PARTITION BY event_id ORDER BY n_my_places, day, url) AS place FROM f WHERE k = 1)
SELECT event_id, '[' || string_agg('{{"place":' || place || ',"url":' || url || CASE WHEN doc_id IS NULL THEN ',"flood_sentences":[]}}' ELSE ',"title":"title","flood_sentences":["Banjir."]}}' END, ',' ORDER BY place) || ']' AS samples
FROM g LEFT JOIN documents ON doc_id = url WHERE place <= 6 GROUP BY event_id""")
def sampling_report(spark, d):
    from tidemark.plans.series_queries import articles

    pages = table(spark, d, "documents").select(F.col("doc_id").alias("url"), F.lit("title").alias("title"), F.concat(F.lit("Banjir. "), F.col("text")).alias("text"))
    return reports.sampling_report(articles(spark, d), op.cluster_days(spiky(spark, d).where("spike").select("day")), pages).select("event_id", F.to_json("samples").alias("samples"))


# ---------------------------------------------------------------- sources and streams


@query("""WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-03', INTERVAL 1 DAY)) AS DATE) AS day), t AS (SELECT day, unnest(generate_series(CAST(day AS TIMESTAMP), CAST(day AS TIMESTAMP) + INTERVAL '23:45' HOUR, INTERVAL 15 MINUTE)) AS ts FROM d)
SELECT day, ts, kind FROM t, (VALUES ('en'), ('trans')) k(kind) WHERE ts NOT IN (SELECT time_bucket(INTERVAL 15 MINUTE, ts) FROM events WHERE user_id % 2 = 0) OR kind = 'trans'""".replace("INTERVAL '23:45' HOUR", "INTERVAL 1425 MINUTE"))
def missing_feed_files(spark, d):
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-03')) AS day")
    e = table(spark, d, "events").where("user_id % 2 = 0")
    slot = (F.floor(F.unix_timestamp("ts") / 900) * 900).cast("timestamp").cast("timestamp_ntz")
    return readers.missing_files(days, e.select(slot.alias("ts"), F.lit("en").alias("kind")).distinct())


@query("""SELECT n_nationkey, n_name, n_regionkey, CAST(make_date(1995 + y, 1, 1) AS DATE) AS lo, CASE WHEN y = n_nationkey % 3 THEN make_date(1995 + y, 6, 1) ELSE make_date(1995 + y, 12, 31) END AS hi
FROM nation, (SELECT unnest(range(3)) AS y) WHERE y <= n_nationkey % 3""")
def year_slices(spark, d):
    n = table(spark, d, "nation").withColumns({"first": F.lit("1995-01-01").cast("date"), "last": F.make_date(1995 + F.col("n_nationkey") % 3, F.lit(6), F.lit(1))})
    return readers.year_slices(n).drop("first", "last")


@query("SELECT DISTINCT 'u' || CAST(page_id % 50 AS VARCHAR) AS DocumentIdentifier, 'FLOOD,5' AS V2Themes, 'en' AS Collection FROM pages")
def stream_feed_dedupe(spark, d):
    """The feed parsed and deduplicated by a stream over text files, run to its end."""
    import uuid

    from tidemark.streaming import feed

    name = f"feed_{uuid.uuid4().hex[:12]}"
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/_streams/{name}"
    root = f"{folder}/lines"
    blank = lambda n: [F.lit("")] * n
    p = table(spark, d, "pages")
    line = F.concat_ws("\t", F.col("page_id").cast("string"), F.lit("20240101000000"), *blank(1), F.lit("src"), F.expr("concat('u', page_id % 50)"), *blank(3), F.lit("FLOOD,5"), *blank(1), F.lit("Malaysia"), *blank(4), F.lit("0"))
    p.select(line.alias("value")).write.text(root)
    stream = feed.first_arrivals(feed.stream_feed(spark, root, "Malaysia", "en"))
    return feed.drain(stream.select("DocumentIdentifier", "V2Themes", "Collection"), name, checkpoint=f"{folder}/checkpoint")

