"""Corpus cleaning: quality filter, near-duplicate removal, substring removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import contamination, jaccard, quality, substrings, tokens
from tidemark.llm.common import ID, TAG, Tables, keep, release


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tag(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _same(docs: DataFrame, found: DataFrame):
    return docs["doc_id"].eqNullSafe(found[ID]) & (_tag(docs) == found[TAG])


_last: list[Tables] = []


def _stage(f):
    """Deletes what earlier stages left in the shared folder, unless docs is still to be computed from it: once
    a stage's result is written and read again, its tables are not needed.

    All stages: null texts count as empty ones and stay; null and repeated ids are kept apart by their texts;
    an empty table gives an empty one; further columns are carried along, but for packing.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for made in [t for t in _last if not t.read_by(docs)]:
            _last.remove(made)
            made.drop()
        with Tables() as made:
            out = f(spark, docs, sf_dir)
        _last.append(made)
        return out

    return run_stage


@_stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney filter keeps; repeated rows stay or go together."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the one with the smallest id, then hash.

    Of rows that are equal in id and text one stays, in texts without words too; ids of null come first.
    """
    found = keep(jaccard.jaccard_components(docs, shingle=5, percent=80), "near")
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col(ID), F.col(TAG))).alias("f")).select(F.col(f"f.{ID}").alias("_fi"), F.col(f"f.{TAG}").alias("_ft"))
    first = keep(first, "first")
    # rows are told from the first of their group by their own keys: no task gets a whole group
    grouped = found.where("root is not null").select(ID, TAG)
    copies = keep(grouped.join(first, grouped[ID].eqNullSafe(first["_fi"]) & (grouped[TAG] == first["_ft"]), "left_anti").distinct(), "copies")
    kept = docs.join(copies, _same(docs, copies), "left_anti")
    # rows with the same id and text are copies too
    same = keep(found.groupBy(ID, TAG).count().where("count > 1").select(ID, TAG), "same")
    release(spark, found)
    if same.isEmpty():
        return kept
    return kept.join(same, _same(kept, same), "left_anti").unionByName(kept.join(same, _same(kept, same), "left_semi").dropDuplicates(["doc_id", "text"]))


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; texts that lose nothing stay as they are, nulls included.

    n_chars, where there is such a column, is that of the new text.
    """
    found = substrings.remove_repeats(docs).where("n_removed > 0").select(ID, TAG, F.col("kept").alias("_kept")).dropDuplicates([ID, TAG])
    joined = docs.join(found, _same(docs, found), "left")
    text = F.coalesce(found["_kept"], docs["text"])
    return joined.select(*(text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns))


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark; those without words share none."""
    return contamination.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length of all documents, in buckets of equal length; a null or empty text is its end id alone."""
    got = tokens.packed_pieces(docs)
    return got.select(F.col(ID).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: DuckDB has neither the tokenizer nor the language model
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as a table and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
