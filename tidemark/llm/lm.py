"""Masked pseudo-likelihood of texts under a bidirectional window network.

Each token is predicted from the WINDOW tokens on either side: position-wise embeddings
are summed and squashed, and a two-level softmax (class, then token within the class)
gives the conditional probability.  The sum of the logarithms over a text scores it.

The vocabulary is the most frequent words of all texts, the other words share hash
buckets.  A word in a bucket has the bucket's probability times its share of the bucket's
words in all texts: the shares of the next FREQUENT words are broadcast, those of all others
are joined.  The network is trained in numpy on every token of every partition, each for itself
from the same start, and the networks are averaged in a tree of groups, weighted by their
tokens; what is shuffled grows with the corpus, what a task holds does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import SPACED, U64, Words, blocks, mix, words
from tidemark.llm.common import ID, TAG, keep, keyed, lean

CLASSES, PER_CLASS, DIM, WINDOW = 32, 64, 16, 2
VOCABULARY = CLASSES * PER_CLASS
#: words that have a token of their own; other words share the remaining tokens, but for the last, the text's border
OWN = VOCABULARY // 2
BORDER = VOCABULARY - 1
#: words that are counted at once before they are sent
COUNTED = 1 << 20
#: words whose counts are broadcast, at most; all other counts are joined
FREQUENT = 1 << 18
BATCH, RATE, PASSES = 2048, 0.5, 2
#: rows of one class that are worked on at once
TILE = 64
#: networks that one group averages
FAN_IN = 32


class Network:
    """Parameters: embeddings by position, hidden bias, class weights, token weights by class.

    Class and token weights have their bias as a last column, which hidden rows meet with a 1.
    """

    SHAPES = {"embed": (2 * WINDOW, VOCABULARY, DIM), "bias": (DIM,), "outer": (CLASSES, DIM + 1), "inner": (CLASSES, PER_CLASS, DIM + 1)}

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(7)
            flat = (rng.standard_normal(self.size()) * 0.1).astype(np.float32)
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n
        self.classes, self.class_bias = self.outer[:, :DIM], self.outer[:, DIM]
        self.tokens, self.token_bias = self.inner[:, :, :DIM], self.inner[:, :, DIM]

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """Hidden rows, each with a last 1."""
        h = np.take(self.embed[0], context[:, 0], axis=0)
        for k in range(1, 2 * WINDOW):
            h += np.take(self.embed[k], context[:, k], axis=0)
        h += self.bias
        out = np.ones((len(h), DIM + 1), dtype=np.float32)
        np.tanh(h, out=out[:, :DIM])
        return out

    def _among(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the activations of all classes, (class, row), and their sum for each row."""
        e = _exp(self.outer @ h.T)
        return e, _ONES[:CLASSES] @ e

    def _within(self, h: np.ndarray, tiles: Tiles) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each tile: token weights, hidden rows, exponentials of the activations of its class's tokens and their sums."""
        x = np.zeros((tiles.slots, DIM + 1), dtype=np.float32)
        x[tiles.slot] = h[tiles.order]
        x = x.reshape(-1, TILE, DIM + 1)
        w = self.inner[tiles.own]
        e = _exp(np.matmul(w, x.transpose(0, 2, 1)))
        return w, x, e, np.matmul(_ONES[:PER_CLASS], e).reshape(-1)

    def log_probability(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token given its context."""
        h = self.hidden(context)
        group, inner = token // PER_CLASS, token % PER_CLASS
        e, total = self._among(h)
        out = np.log(e[group, np.arange(len(h))] / total)
        tiles = Tiles(group)
        _, _, e, total = self._within(h, tiles)
        own = e[tiles.slot // TILE, inner[tiles.order], tiles.slot % TILE]
        out[tiles.order] += np.log(own / total[tiles.slot])
        return out

    def train(self, context: np.ndarray, token: np.ndarray, rate: float) -> None:
        """One step of gradient descent on a batch.

        Exponentials stay as they are: what is made from them is divided by their sums, which is less to divide.
        """
        n, h = len(token), self.hidden(context)
        group, inner = token // PER_CLASS, token % PER_CLASS
        e, total = self._among(h)
        e[group, np.arange(n)] -= total
        back = e.T @ self.outer
        back /= total[:, None]
        self.outer -= rate / n * (e @ (h / total[:, None]))
        tiles = Tiles(group)
        w, x, e, total = self._within(h, tiles)
        e[tiles.slot // TILE, inner[tiles.order], tiles.slot % TILE] -= total[tiles.slot]
        by = np.matmul(e.transpose(0, 2, 1), w).reshape(-1, DIM + 1)[tiles.slot]
        by /= total[tiles.slot, None]
        back[tiles.order] += by
        x /= total.reshape(-1, TILE, 1)  # rows of empty slots are 0
        spread = np.zeros((CLASSES, len(tiles.own)), dtype=np.float32)
        spread[tiles.own, np.arange(len(tiles.own))] = rate / np.maximum(32, tiles.count[tiles.own])
        self.inner -= (spread @ np.matmul(e, x).reshape(len(tiles.own), -1)).reshape(self.inner.shape)
        back, h = back[:, :DIM], h[:, :DIM]
        back = back * ((1 - h * h) * np.float32(rate / 32))
        self.bias -= back.sum(axis=0) * (32 / n)
        for k in range(2 * WINDOW):  # entry by entry: one-dimensional updates are the fast ones
            np.subtract.at(self.embed[k].reshape(-1), (context[:, k, None] * DIM + np.arange(DIM)).reshape(-1), back.reshape(-1))


class Tiles:
    """Rows of a batch in order of their class, in tiles of TILE rows of one class, so that classes are worked on at once."""

    def __init__(self, group: np.ndarray):
        self.order = np.argsort(group.astype(np.uint8), kind="stable")
        self.count = np.bincount(group, minlength=CLASSES)
        self.of = -(-self.count // TILE)
        self.own = np.repeat(np.arange(CLASSES), self.of)
        self.slots = TILE * len(self.own)
        place = np.arange(len(group)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.slot = np.repeat((np.cumsum(self.of) - self.of) * TILE, self.count) + place


def _exp(z: np.ndarray) -> np.ndarray:
    """Activations beyond 60 stay there: sums of their exponentials stay finite."""
    return np.exp(np.clip(z, -60, 60, out=z), out=z)


#: sums over classes or tokens as products, which are faster than reductions
_ONES = np.ones(max(CLASSES, PER_CLASS), dtype=np.float32)


def token_ids(w: Words, own: np.ndarray) -> np.ndarray:
    """Token of each word: its place among `own` (sorted hashes), or a shared bucket."""
    return _ids(w.hash, own)


def _ids(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    at, found = _find(h, own)
    return np.where(found, at, OWN + (mix(h, 61) % U64(BORDER - OWN)).astype(np.int64))


def _find(h: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash among sorted ones, and whether it is there."""
    if not len(among):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(among, h), len(among) - 1)
    return at, among[at] == h


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The tokens around each token, BORDER beyond its text."""
    out = np.full((len(ids), 2 * WINDOW), BORDER, dtype=np.int64)
    place = np.arange(len(ids))
    size = np.diff(first)
    start, stop = np.repeat(first[:-1], size), np.repeat(first[1:], size)
    for k, step in enumerate((*range(-WINDOW, 0), *range(1, WINDOW + 1))):
        at = place + step
        ok = (at >= start) & (at < stop)
        out[ok, k] = ids[at[ok]]
    return out


def vocabulary(base: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(word hash, times) over all texts, and the sorted hashes of the OWN most frequent words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "times"])

        waiting: list[np.ndarray] = []
        for b in batches:
            for _, _, buf, offs in blocks(b.column(2)):
                waiting.append(words(buf, offs, SPACED).hash)
                if sum(map(len, waiting)) >= COUNTED:
                    yield close()
        if waiting:
            yield close()

    counts = keep(base.mapInArrow(lean(count), "word long, times long").groupBy("word").agg(F.sum("times").alias("times")), "words")
    top = counts.orderBy(F.desc("times"), "word").limit(OWN).select("word").collect()
    return counts, np.sort(np.array([r["word"] for r in top], dtype=np.int64).view(U64))


def shares(counts: DataFrame, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """Logarithms of the words of each bucket; hashes of frequent words and logarithms of their
    times; (word, log) of all others, without those that occur once, whose logarithm is 0."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY)
        for b in batches:
            total += np.bincount(_ids(b.column(0).to_numpy().view(U64), own), weights=b.column(1).to_numpy(), minlength=VOCABULARY)
        at = np.flatnonzero(total[OWN:])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[OWN:][at].astype(np.int64))], names=["bucket", "times"])

    total = np.ones(BORDER - OWN)
    for r in counts.mapInArrow(lean(add), "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times")).collect():  # a row for each bucket
        total[r["bucket"]] = r["times"]
    level = F.floor(F.log2("times") * 4)
    least, left = None, FREQUENT
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 256 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    common = F.lit(False) if least is None else level >= least
    some = counts.where(common).toPandas().sort_values("word", key=lambda x: x.to_numpy().view(U64))  # at most FREQUENT rows
    rest = counts.where(~common & (F.col("times") > 1)).select("word", F.log("times").alias("log"))
    return np.log(total), some["word"].to_numpy(np.int64).view(U64), np.log(some["times"].to_numpy(float)), rest


def averaged(parts: DataFrame) -> DataFrame:
    """Average the networks (part, flat, n) in groups of FAN_IN until one is left."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:  # at most FAN_IN rows
        total, weight = np.zeros(Network.size()), float(rows["n"].sum())
        for flat, n in zip(rows["flat"], rows["n"], strict=True):
            total += np.frombuffer(flat, np.float16).astype(float) * (n / weight)
        return pd.DataFrame({"part": [key[0]], "flat": [total.astype(np.float16).tobytes()], "n": [weight]})

    left, count = parts, (parts.agg(F.max("part")).first()[0] or 0) + 1
    while count > 1:
        left = left.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("group").applyInPandas(merge, "part long, flat binary, n double")
        count = -(-count // FAN_IN)
    return left


def train(base: DataFrame, own: np.ndarray) -> Network:
    """A network trained on all partitions of the keyed texts."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen, part = Network(), 0, 0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if b.num_rows:
                part = b.column(3)[0].as_py()
            for _, _, buf, offs in blocks(b.column(2)):
                w = words(buf, offs, SPACED)
                ids = token_ids(w, own)
                waiting.append((contexts(ids, w.first), ids))
                if sum(len(t) for _, t in waiting) >= 4 * BATCH:
                    seen += _passes(net, waiting)
                    waiting = []
        if waiting:
            seen += _passes(net, waiting)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([net.flat.astype(np.float16).tobytes()], pa.binary()), pa.array([float(seen)])], names=["part", "flat", "n"])

    parts = keep(base.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(lean(fit), "part long, flat binary, n double"), "networks").where("n > 0")
    found = averaged(parts).select("flat").collect()  # one row of Network.size() numbers
    return Network(np.frombuffer(found[0]["flat"], np.float16).astype(np.float32).copy()) if found else Network()


def _passes(net: Network, waiting: list[tuple[np.ndarray, np.ndarray]]) -> int:
    around, token = (np.concatenate(x) for x in zip(*waiting, strict=True))
    mixed = np.random.default_rng(len(token)).permutation(len(token))
    around, token = around[mixed], token[mixed]
    for _ in range(PASSES):
        for lo in range(0, len(token), BATCH):
            net.train(around[lo : lo + BATCH], token[lo : lo + BATCH], RATE)
    return len(token)


def _pairs(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text and their times, with the cuts between texts."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(h)])
    return np.searchsorted(doc[first], np.arange(docs + 1)).astype(np.int32), h[first].view(np.int64), times.astype(np.int32)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _tag, n_tokens, log_likelihood, mean_log_likelihood, rare_words), one row for each row of docs.

    Null and empty texts have no tokens, a sum of 0 and a null mean; repeated rows score
    alike; an empty table gives an empty one; further columns are left out.
    """
    base = keyed(docs, id_col, text_col)
    kind = base.schema[ID].dataType.simpleString()
    counts, own = vocabulary(base)
    net = train(base, own)
    bucket, frequent, logs, rest = shares(counts, own)
    shared = docs.sparkSession.sparkContext.broadcast((own, net.flat, bucket, frequent, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, flat, bucket, frequent, logs = shared.value
        net, key = Network(flat), TaskContext.get().partitionId() << 33
        for b in batches:
            for i, j, buf, offs in blocks(b.column(2)):
                w = words(buf, offs, SPACED)
                ids = token_ids(w, own)
                around = contexts(ids, w.first)
                lp = np.zeros(len(ids) + 1)
                for lo in range(0, len(ids), 8192):
                    lp[lo + 1 : lo + 8193][: len(ids) - lo] = net.log_probability(around[lo : lo + 8192], ids[lo : lo + 8192])
                out = np.flatnonzero(ids >= OWN)
                at, known = _find(w.hash[out], frequent)
                lp[out + 1] -= bucket[ids[out] - OWN]
                lp[out[known] + 1] += logs[at[known]]
                cuts, other, times = _pairs(w.doc()[out[~known]], w.hash[out[~known]], j - i)
                total = np.cumsum(lp)
                rare = np.r_[0, np.cumsum(ids >= OWN)]
                n = np.diff(w.first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(j - i)), pa.ListArray.from_arrays(cuts, other), pa.ListArray.from_arrays(cuts, times), b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(total[w.first[1:]] - total[w.first[:-1]]), pa.array((rare[w.first[1:]] - rare[w.first[:-1]]).astype(np.int64))],
                    names=["_key", "_word", "_times", ID, TAG, "n_tokens", "log_likelihood", "rare_words"],
                )
                key += j - i

    scores = keep(base.mapInArrow(lean(run), f"_key long, _word array<long>, _times array<int>, {ID} {kind}, {TAG} long, n_tokens long, log_likelihood double, rare_words long"), "scores")
    pairs = scores.select("_key", F.explode(F.arrays_zip("_word", "_times")).alias("p")).select("_key", F.col("p._word").alias("word"), F.col("p._times").alias("times"))
    more = pairs.join(rest, "word").groupBy("_key").agg(F.sum(F.col("times") * F.col("log")).alias("_more"))
    out = scores.drop("_word", "_times").join(more, "_key", "left")
    out = out.select(ID, TAG, "n_tokens", (F.col("log_likelihood") + F.coalesce("_more", F.lit(0.0))).alias("log_likelihood"), "rare_words")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
