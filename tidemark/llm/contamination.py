"""Benchmark decontamination by winnowing.

A window is WINDOW words of a benchmark item, or a whole shorter item.  Of each window the
smallest KMER-gram hash is its fingerprint; equal windows have equal fingerprints, so every
shared window is found.  Neighbouring windows share most fingerprints, so a text has one
for each run of windows that hang on the same KMER-gram.  The fingerprints of texts are
joined with those of the benchmark; a Bloom filter of the latter thins them out before.
Each match is extended to the windows of its run: they are joined with the benchmark's
windows by two independent 64-bit hashes of their words.
Items too short for a fingerprint are looked up by the hash of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import ALNUM, U64, Words, blocks, grams, mix, sliding_min, words
from tidemark.llm.bloom import bits_for, bloom_of, passes
from tidemark.llm.common import ID, TAG, keep, keyed, lean, same_row

WINDOW = 10
KMER = 5


def _short(w: Words, n: int, at: np.ndarray) -> np.ndarray:
    """Fingerprint of whole items of n < WINDOW words: the hash of all words."""
    return mix(grams(w.hash, n, 20)[at], n)


def _full(w: Words, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(grams(w.hash, n, 21)[at], n), mix(grams(w.other(), n, 22)[at], n)


def _prints(w: Words, window: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of full windows, their fingerprints and the places of these."""
    at = np.flatnonzero(w.room(window))
    if not len(at):
        return at, np.zeros(0, dtype=U64), at
    g = grams(w.hash, kmer)
    least = sliding_min(g, window - kmer + 1)[at]
    return at, g[least], least


SUSPECT = "array<struct<print:bigint,n:int,place:int,windows:array<struct<a:bigint,b:bigint>>>>"


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, kmer: int = KMER) -> tuple[DataFrame, DataFrame]:
    """(per text: _id, _tag, n_words), (hits: _id, _tag, item, place, n).

    Null and empty texts have no words and no hits, items without words no window; a null item
    id counts as an item; repeated rows give repeated rows of the first table and repeated hits;
    empty tables give empty ones; further columns are left out.
    """
    spark = docs.sparkSession
    bench = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    item_kind = bench.schema["item"].dataType.simpleString()

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in blocks(b.column(1)):
                w = words(buf, offs, ALNUM, lower=True)
                at, prints, _ = _prints(w, window, kmer)
                parts = [(at, prints, np.full(len(at), window))]
                size = np.diff(w.first)
                for n in range(1, window):
                    own = w.first[:-1][size == n]
                    if len(own):
                        parts.append((own, _short(w, n, own), np.full(len(own), n)))
                for at, prints, n in parts:
                    if not len(at):
                        continue
                    a, c = _full(w, int(n[0]), at)
                    d = np.searchsorted(w.first, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d + i)), pa.array(n.astype(np.int32)), pa.array(prints.view(np.int64)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["item", "n", "print", "a", "b"])

    wanted = keep(bench.mapInArrow(lean(item_windows), f"item {item_kind}, n int, print long, a long, b long"), "items")
    prints = keep(wanted.select("print", "n").distinct(), "prints")
    lengths = sorted(r["n"] for r in prints.select("n").distinct().collect() if r["n"] < window)  # fewer than a window has words
    shared = spark.sparkContext.broadcast((bloom_of(prints.select("print"), bits_for(prints.count())), lengths))

    base = keyed(docs, id_col, text_col)
    kind = base.schema[ID].dataType.simpleString()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, shorter = shared.value
        for batch in batches:
            for i, j, buf, offs in blocks(batch.column(2)):
                w = words(buf, offs, ALNUM, lower=True)
                at, found, least = _prints(w, window, kmer)
                ok = passes(bloom, found)
                parts = [(at[ok], found[ok], least[ok], window)]
                for n in shorter:
                    at = np.flatnonzero(w.room(n))
                    found = _short(w, n, at) if len(at) else np.zeros(0, U64)
                    ok = passes(bloom, found)
                    parts.append((at[ok], found[ok], at[ok], n))
                columns = [(at, found, least, np.full(len(at), n), *_full(w, n, at)) for at, found, least, n in parts if len(at)]
                at, found, least, n, a, c = (np.concatenate(x) for x in zip(*columns, strict=True)) if columns else (np.zeros(0, np.int64), np.zeros(0, U64), *(np.zeros(0, np.int64),) * 2, *(np.zeros(0, U64),) * 2)
                d = np.searchsorted(w.first, at, side="right") - 1
                order = np.argsort(d, kind="stable")
                at, found, least, n, a, c, d = (x[order] for x in (at, found, least, n, a, c, d))
                # a run: neighbouring windows of one length on one KMER-gram
                new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (n[1:] != n[:-1]) | (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
                windows = pa.ListArray.from_arrays(pa.array(np.r_[new, len(at)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=["a", "b"]))
                cuts = pa.array(np.searchsorted(d[new], np.arange(j - i + 1)).astype(np.int32))
                place = (at - w.first[d])[new] if len(at) else at
                lists = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(found[new].view(np.int64)), pa.array(n[new].astype(np.int32)), pa.array(place.astype(np.int32)), windows], names=["print", "n", "place", "windows"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(w.first).astype(np.int64)), lists], names=[ID, TAG, "n_words", "suspects"])

    rows = keep(base.mapInArrow(lean(suspects), f"{ID} {kind}, {TAG} long, n_words long, suspects {SUSPECT}"), "suspects")
    marks = rows.where(F.size("suspects") > 0).select(ID, TAG, F.explode("suspects").alias("s")).select(ID, TAG, "s.*")
    matched = marks.join(prints, ["print", "n"], "left_semi")
    extended = matched.select(ID, TAG, "n", "place", F.posexplode("windows").alias("step", "w")).select(ID, TAG, "n", (F.col("place") + F.col("step")).alias("place"), "w.a", "w.b")
    hits = extended.join(wanted.select("item", "n", "a", "b").distinct(), ["a", "b", "n"]).select(ID, TAG, "item", "place", "n")
    return rows.select(ID, TAG, "n_words"), hits


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of docs.

    A word is hit if an occurrence of an item's window covers it.  Null and empty texts have
    no words; items without words have no window; repeated rows and items count alike; an
    empty table gives an empty one; further columns are left out.
    """
    rows, hits = find_hits(docs, items, id_col, text_col, item_col, item_text, window, kmer)
    kind = rows.schema[ID].dataType.simpleString()
    # all of an id and tag: a document's places and items, no more than its words and the items they match
    of_text = hits.groupBy(ID, TAG).agg(F.collect_set(F.struct("place", "n")).alias("places"), F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    joined = rows.join(of_text, same_row(rows, of_text), "left").select(rows[ID], "n_words", "places", "items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, n, sha = [], [], []
            for total, places, some in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                covered = 0
                if places.is_valid:
                    at, size = (places.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                    step = np.zeros(total + 1, dtype=np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + size, -1)
                    covered = int((np.cumsum(step[:-1]) > 0).sum())
                hit.append(covered)
                n.append(len(some or ()))
                sha.append(hashlib.sha256(",".join(some or ()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=[ID, "n_words", "n_hit", "n_items", "items_sha256"])

    return joined.mapInArrow(lean(count), f"{ID} {kind}, n_words long, n_hit long, n_items long, items_sha256 string").withColumn("contaminated", F.col("n_hit") > 0)


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that share no window with the items.

    Null and empty texts share none and stay; rows that are equal in id and text go or stay together, a
    null id included; without items all rows stay; an empty table gives an empty one; columns of
    any other name are carried along.
    """
    _, hits = find_hits(docs, items, id_col, text_col)
    bad = hits.select(F.col(ID).alias("_bad_id"), F.col(TAG).alias("_bad_tag")).distinct()
    tag = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"]) & (tag == bad["_bad_tag"]), "left_anti")
