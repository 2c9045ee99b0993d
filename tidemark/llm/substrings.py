"""Removal of word spans that repeat, by compaction of a de Bruijn graph of the corpus.

An edge is a window of WINDOW words, its nodes the words less the last or first.
Consecutive windows of a document that hang on one minimiser (the smallest hash of
the KMER-grams in the window) form a path without branches, which is compacted to one
row: minimiser, path hash, source coordinate.  Equal windows have equal minimisers at
equal offsets, so a window can only repeat in the group of its minimiser:

1. minimisers that occur once are dropped (a count with map-side combine, a semi join);
2. paths that occur as a whole more than once need nothing else;
3. where paths of one minimiser differ (a branch), the source coordinates of one
   occurrence of each path are read again and compared edge by edge.

The mask of repeated windows of each path then goes back to all its occurrences.
No step collects the occurrences of a path; the joins are plain ones that Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import SPACED, U64, Words, blocks, grams, mix, powers, sliding_min, words
from tidemark.llm.common import ID, TAG, keep, keyed, lean, packed, release, same_row, unpack

WINDOW = 35
KMER = 8


def _spans(w: Words, lo: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """Hash of n words from lo on, by another hash of the words than the minimisers have."""
    up, down = powers(len(w) + 1, 0xD1342543DE82EF95 + 2 * salt)
    total = np.zeros(len(w) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(w.other(), 11 + salt) * up[: len(w)], out=total[1:])
        return mix((total[lo + n] - total[lo]) * down[lo] + n.astype(U64), salt)


def _paths(w: Words, window: int, kmer: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, minimiser and hash of each path."""
    ok = np.flatnonzero(w.room(window))
    if not len(ok):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    g = grams(w.hash, kmer)
    at = sliding_min(g, window - kmer + 1)[ok]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)])
    lo, n, a = ok[first], np.diff(np.r_[first, len(ok)]), at[first]
    with np.errstate(over="ignore"):
        path = mix(_spans(w, lo, n + window - 1, 1) + (a - lo).astype(U64) * U64(0x9E3779B97F4A7C15))
    return lo, n, g[a].view(np.int64), path.view(np.int64)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """One row per (id, tag): `paths`, an array of (lo, mask); bit i of mask says that the window
    that starts at word lo + i also starts elsewhere in the corpus.

    Empty and null texts, and texts of fewer than `window` words, have no row.
    """
    if not kmer <= window <= kmer + 62:
        raise ValueError("kmer <= window <= kmer + 62 is required")
    base = keyed(docs, id_col, text_col)
    kind = base.schema[ID].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in blocks(b.column(2)):
                w = words(buf, offs, SPACED)
                lo, n, key, path = _paths(w, window, kmer)
                d = np.searchsorted(w.first, lo, side="right") - 1
                at = pa.array(d + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array((lo - w.first[d]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(path)],
                    names=[ID, TAG, "lo", "n", "key", "path"],
                )

    found = keep(base.mapInArrow(lean(find), f"{ID} {kind}, {TAG} long, lo int, n int, key long, path long"), "paths")
    # joins read written counts: with an exchange of its own on either side, Spark can split a hot key
    often = keep(found.groupBy("key").count().where("count > 1").select("key"), "often")
    some = keep(found.join(often, "key", "left_semi"), "repeated")
    release(docs.sparkSession, found)

    distinct = some.groupBy("key", "path").agg(F.count("*").alias("times"), F.first(ID).alias(ID), F.first(TAG).alias(TAG), F.first("lo").alias("lo"), F.first("n").alias("n"))
    distinct = keep(distinct, "distinct")
    branch = keep(distinct.groupBy("key").count().where("count > 1").select("key"), "branches")
    wanted = distinct.join(branch, "key", "left_semi").groupBy(ID, TAG).agg(F.collect_list(F.struct("key", "path", "times", "lo", "n")).alias("want"))
    text = packed(base)
    sources = text.join(wanted, same_row(text, wanted)).select("_z", "_size", wanted["want"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z, size, want in zip(b.column(0), b.column(1), b.column(2), strict=True):
                raw = np.frombuffer(unpack(z.as_py(), size.as_py()), dtype=np.uint8)
                w = words(raw, np.array([0, len(raw)]), SPACED)
                v = want.values
                n = v.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                rep = np.repeat(np.arange(len(n)), n)
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                lo = v.field("lo").to_numpy(zero_copy_only=False).astype(np.int64)[rep] + i
                e = _spans(w, lo, np.full(len(lo), window), 2).view(np.int64)
                at = pa.array(rep)
                yield pa.RecordBatch.from_arrays([v.field("key").take(at), v.field("path").take(at), v.field("times").take(at), pa.array(i.astype(np.int32)), pa.array(e)], names=["key", "path", "times", "i", "edge"])

    edge = keep(sources.mapInArrow(lean(edges), "key long, path long, times long, i int, edge long"), "edges")
    release(docs.sparkSession)
    twice = keep(edge.groupBy("key", "edge").agg(F.sum("times").alias("times")).where("times > 1").select("key", "edge"), "twice")
    partly = edge.join(twice, ["key", "edge"], "left_semi").groupBy("key", "path").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
    whole = distinct.where("times > 1").select("key", "path", F.lit(-1).cast("long").alias("mask"))
    masks = keep(whole.unionByName(partly).groupBy("key", "path").agg(F.bit_or("mask").alias("mask")), "masks")
    release(docs.sparkSession, edge, twice, distinct, branch, often)
    hits = some.join(masks, ["key", "path"])
    bits = F.when(F.col("mask") == -1, F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("mask"))
    return hits.groupBy(ID, TAG).agg(F.collect_list(F.struct("lo", bits.alias("mask"))).alias("paths"))


def _covered(n_words: int, lo: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """For each word whether a repeated window covers it."""
    step = np.zeros(n_words + 1, dtype=np.int32)
    left = mask.view(U64).copy()
    i = 0
    while left.any():
        on = (left & U64(1)).astype(bool)
        np.add.at(step, lo[on] + i, 1)
        np.add.at(step, lo[on] + i + window, -1)
        left >>= U64(1)
        i += 1
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(_id, _tag, kept text, n_words, n_removed, kept_sha256), one row for each row of docs.

    Each word covered by a repeated window goes; kept words are joined by one space.
    Null and empty texts give 0 words and the empty text; repeated rows count as repeats
    of each other; an empty table gives an empty one; further columns are left out.
    """
    base = keyed(docs, id_col, text_col)
    text, spans = packed(base), repeated_spans(docs, id_col, text_col, window, kmer)
    joined = text.join(spans, same_row(text, spans), "left").select(text[ID], text[TAG], "_z", "_size", "paths")
    kind = base.schema[ID].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, gone, sha = [], [], [], []
            for z, size, paths in zip(b.column(2), b.column(3), b.column(4), strict=True):
                parts = unpack(z.as_py(), size.as_py()).split()
                out = parts
                if paths.is_valid and len(parts) >= window:
                    v = paths.values
                    hit = _covered(len(parts), v.field("lo").to_numpy(zero_copy_only=False).astype(np.int64), v.field("mask").to_numpy(zero_copy_only=False), window)
                    out = [p for p, h in zip(parts, hit.tolist(), strict=True) if not h]
                line = b" ".join(out)
                kept.append(line)
                total.append(len(parts))
                gone.append(len(parts) - len(out))
                sha.append(hashlib.sha256(line).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                names=[ID, TAG, "kept", "n_words", "n_removed", "kept_sha256"],
            )

    return joined.mapInArrow(lean(cut), f"{ID} {kind}, {TAG} long, kept string, n_words long, n_removed long, kept_sha256 string")
