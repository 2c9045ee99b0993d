"""The registered queries of the text operators, op<N>_<name>, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import contamination, jaccard, lm, quality, substrings, tokens, toxicity
from tidemark.llm.common import ID

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tokens.token_counts(table(spark, sf_dir, "documents"))
    return got.select(F.col(ID).alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tokens.packed_pieces(table(spark, sf_dir, "documents"))
    return got.select(F.col(ID).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tokens.grammar_round_trip(table(spark, sf_dir, "documents"))
    return got.select(F.col(ID).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select(F.col(ID).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard.jaccard_components(table(spark, sf_dir, "documents"))
    return got.select(F.col(ID).alias("doc_id"), "n_shingles", "component_id")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lm.pseudo_likelihood(table(spark, sf_dir, "documents"))
    return got.withColumnRenamed(ID, "doc_id").drop("_tag")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.withColumnRenamed(ID, "doc_id").drop("_tag")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.withColumnRenamed(ID, "doc_id").drop("_tag")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.withColumnRenamed(ID, "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select(F.col(ID).alias("doc_id"), "held_out", "score", "predicted", "hits", "quoted")


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op3_packing": op3_packing,
    "op4_token_files": op4_token_files,
    "op2_substring_dedup": op2_substring_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
}

ORACLE: dict[str, str] = {
    "op5_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, f.y FROM reach r JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) f ON f.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS s
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN iw USING (n, s)),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i + j AS k
        FROM (SELECT doc_id, i FROM win JOIN rep USING (s)), (SELECT unnest(range(35)) AS j)),
tok AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.k) AS line, count(*) AS n
         FROM tok t LEFT JOIN hit h ON t.doc_id = h.doc_id AND t.k = h.k WHERE h.k IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}
