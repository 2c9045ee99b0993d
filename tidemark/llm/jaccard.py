"""Exact Jaccard join of word n-gram sets, with a light and a heavy side by size.

Equal sets collapse first.  A set then gets tokens such that every linked pair shares one:

* light sets (few elements): the hashes of all subsets of the sizes that the overlap
  with a partner of each possible size can have; sharing one is already the proof;
* heavy sets: their rarest elements, as many as the threshold allows to be missing plus
  one, whose inverted lists are scanned.  Elements that are frequent over the whole
  corpus come last in the order, so passages that many texts share are not scanned.

The boundary is the largest size at which subsets cost no more than scanning lists.
Lists are never paired with themselves.  Each member is compared with the list's leader;
verified links give components; then only members outside the leader's component are
compared with members of other components, shape by shape: sizes and places in the list
that rule a link out are never paired.  So a group of n near copies costs about n
comparisons per list, and every pair in different components has been compared.
A list member carries its place in its set's order: elements before a pair's first common
one are not shared, so what follows it bounds the overlap.  This, sizes and parity bitmaps
are exact bounds that drop pairs before texts are fetched.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import SPACED, U64, blocks, grams, mix, words
from tidemark.llm.common import ID, TAG, keep, keyed, lean, packed, release, same_row, unpack
from tidemark.llm.components import components

SHINGLE, PERCENT = 4, 85
#: elements in at least so many sets count as frequent; so many of them are kept, the most frequent ones
FREQUENT, MOST = 64, 1 << 17
#: cost of scanning one inverted list, in subsets enumerated
SCAN_COST = 16


def overlap(a: int, b: int, percent: int) -> int:
    """Fewest common elements of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def boundary(percent: int) -> int:
    """Largest size whose subsets cost no more than scanning the lists of its prefix."""
    n = 1
    while sum(comb(n, overlap(n, b, percent)) for b in partners(n, percent) if overlap(n, b, percent) <= min(n, b)) <= SCAN_COST * prefix(n, percent):
        n += 1
    return n - 1


def subset_tokens(s: np.ndarray, percent: int) -> list[int]:
    """A hash for each subset that may be the overlap with a partner; the pair of sizes is part of it."""
    out, n = [], len(s)
    values = mix(s, 31)
    for b in partners(n, percent):
        k = overlap(n, b, percent)
        if k <= min(n, b):
            with np.errstate(over="ignore"):
                salt = U64(min(n, b) << 32 | max(n, b) << 8 | 1)
                out.extend(int(mix(values[list(c)].sum(dtype=U64) + mix(salt[None], 3), 32)[0]) for c in combinations(range(n), k))
    return out


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int, other: bool = False) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the n-word shingles of each text; all words if there are fewer.

    other: by another hash of the words.
    """
    w = words(buf, offs, SPACED, lower=True)
    h = w.other() if other else w.hash
    g = grams(h, n, 9)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            yield mix(grams(h[a:b], b - a, 9), b - a)
        else:
            yield np.zeros(0, dtype=U64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the elements in each of 256 to 8192 cells, at least two cells an element up to there."""
    bits = 1 << min(13, max(8, int(2 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((mix(s, 33) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def may_link(na: int, nb: int, a: bytes, b: bytes, percent: int) -> bool:
    """False only if the sizes or the bitmaps prove that the sets are no link."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    apart = int(np.bitwise_count(x ^ y).sum())
    return (100 + percent) * (na + nb - apart) >= 2 * percent * (na + nb)


def shingle_table(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(_id, _tag, n, d1, d2, tokens, skip, bits) for each row: size and digest of the set, tokens, how many of
    the tokens are subsets, and bitmap."""
    kind = docs.schema[ID].dataType.simpleString()

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times = np.zeros(0, U64), np.zeros(0, np.int64)
        for b in batches:
            for _, _, buf, offs in blocks(b.column(2)):
                parts = list(shingle_sets(buf, offs, n))
                new = np.concatenate([held, *parts]) if parts else held
                held, at = np.unique(new, return_inverse=True)
                times = np.bincount(at, weights=np.r_[times, np.ones(len(new) - len(times))], minlength=len(held)).astype(np.int64)
                if len(held) > 1 << 19:  # what is rare so far goes; the order need not be exact
                    held, times = held[times > 1], times[times > 1]
        held, times = held[times > 2], times[times > 2]
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(times)], names=["token", "times"])

    common = docs.mapInArrow(lean(frequent), "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    top = common.orderBy(F.desc("times"), "token").limit(MOST).toPandas()  # at most MOST rows
    order = np.argsort(top["token"].to_numpy().astype(np.int64).view(U64))
    rank = np.empty(len(order), dtype=np.int64)
    rank[:] = (len(order) - np.arange(len(order)))[order]  # the rarer of them first
    shared = docs.sparkSession.sparkContext.broadcast((top["token"].to_numpy().astype(np.int64).view(U64)[order], rank))
    light = boundary(percent)

    def tokens_of(s: np.ndarray, heavy: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, int]:
        out: list[np.ndarray] = []
        subsets = 0
        if len(s) <= light:
            out.append(np.array(subset_tokens(s, percent), dtype=U64))
            subsets = len(out[0])
        if partners(len(s), percent)[-1] > light:
            late = np.zeros(len(s), dtype=np.int64)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                late = np.where(heavy[at] == s, ranks[at], 0)
            out.append(s[np.lexsort((s, late))[: prefix(len(s), percent)]])
        return np.concatenate(out), subsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, ranks = shared.value
        for b in batches:
            for i, j, buf, offs in blocks(b.column(2)):
                size, d1, d2, tokens, skip, bits = [], [], [], [], [], []
                for s in shingle_sets(buf, offs, n):
                    size.append(len(s))
                    d1.append(mix(s, 34).sum(dtype=U64))
                    d2.append(mix(s, 35).sum(dtype=U64))
                    found, subsets = tokens_of(s, heavy, ranks) if len(s) else (s, 0)
                    tokens.append(found)
                    skip.append(subsets)
                    bits.append(bitmap(s).tobytes() if len(s) else b"")
                cuts = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(tokens).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(size, pa.int64()), pa.array(mix(np.array(d1, dtype=U64)).view(np.int64)), pa.array(np.array(d2, dtype=U64).view(np.int64)), lists, pa.array(skip, pa.int32()), pa.array(bits, pa.binary())],
                    names=[ID, TAG, "n", "d1", "d2", "tokens", "skip", "bits"],
                )

    return docs.mapInArrow(lean(run), f"{ID} {kind}, {TAG} long, n long, d1 long, d2 long, tokens array<bigint>, skip int, bits binary")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(_id, _tag, n_shingles, root, component_id), one row for each row of docs.

    Texts link when 100 * common >= percent * united of their shingle sets.  component_id is
    the smallest id of a component (nulls aside); root is the same for the rows of one
    component, and null for texts without words, which are alone: their component_id is their
    own id.  Sets are told apart by 64 bits.  Equal texts and repeated rows are in one
    component; an empty table gives an empty one; further columns are left out.
    """
    base = keyed(docs, id_col, text_col)
    rows = keep(shingle_table(base, shingle, percent), "sets")
    sets = keep(
        rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.first("tokens").alias("tokens"), F.first("skip").alias("skip"), F.first("bits").alias("bits"), F.first(ID).alias(ID), F.first(TAG).alias(TAG)).withColumnRenamed("d1", "u"),
        "distinct",
    )
    # size and what is left of the set from the token on share one number: most postings are alone and only pass by
    exploded = sets.select("u", "n", "skip", F.posexplode("tokens").alias("at", "token"))
    posted = exploded.select("token", "u", F.expr("shiftleft(n, 32) + n - greatest(at - skip, 0)").alias("p"))
    several = keep(posted.groupBy("token").count().where("count > 1").select("token"), "several")
    found = keep(posted.join(several, "token", "left_semi").select("token", "u", F.expr("shiftright(p, 32)").alias("n"), F.expr("p & 4294967295").alias("left")), "postings")
    # the leader has the fewest elements before the token: rarer ones are most often edits of its own
    early = F.expr("shiftleft(n - left, 40) + (u & 1099511627775)")
    leaders = keep(found.groupBy("token").agg(F.min_by("u", early).alias("lead"), F.min_by("n", early).alias("lead_n"), F.min_by("left", early).alias("lead_left")), "leaders")
    lists = keep(found.join(leaders, "token"), "lists")
    release(docs.sparkSession, several, found, leaders)

    nodes = lists.select("u").distinct()
    source = sets.join(nodes, "u", "left_semi").select(ID, TAG, "u")
    text = packed(base)
    texts = keep(text.join(source, same_row(text, source)).select("u", "_z", "_size"), "texts")
    small = sets.select("u", "n", "bits")
    release(docs.sparkSession)

    star = lists.where(f"u <> lead and {_reach('n', 'left', 'lead_n', 'lead_left', percent)}").select(F.col("u").alias("a"), F.col("lead").alias("b")).distinct()
    links = keep(verified(star, small, texts, shingle, percent), "links")
    roots = keep(components(links), "roots")

    placed = lists.join(roots, lists["u"] == roots["node"], "left").select("token", "u", "n", "left", "lead", F.coalesce("root", "u").alias("comp"))
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    mixed_lists = rest = keep(placed.join(mixed, "token", "left_semi"), "mixed")
    main = rest.where("u = lead").select("token", F.col("comp").alias("main")).distinct()
    rest = rest.join(main, "token")
    cross = crossed(rest, percent)
    more = keep(verified(cross, small, texts, shingle, percent), "more")
    if not more.isEmpty():
        roots = keep(components(links.unionByName(more)), "roots")
    release(docs.sparkSession, sets, lists, texts, mixed_lists)

    least = rows.where("n > 0").groupBy("d1").agg(F.min(ID).alias("first"))
    of_set = least.join(roots, least["d1"] == roots["node"], "left").select("d1", F.coalesce("root", "d1").alias("root"), "first")
    of_root = of_set.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of_set.join(of_root, "root").select(F.col("d1").alias("_d"), "root", "component_id")
    joined = rows.join(named, (rows["d1"] == named["_d"]) & (rows["n"] > 0), "left")
    return joined.select(ID, TAG, F.col("n").alias("n_shingles"), "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(ID)).alias("component_id"))


def crossed(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (token, u, n, left, lead, comp, main) of a list that may be links between components.

    Members are paired by shape: size and what is left of the set from the token on.  A list has
    few shapes however many members; only pairs of shapes that allow a link are joined with the
    members, so members that bounds keep apart are never enumerated against each other.
    """
    minor = rest.where("comp <> main").select("token", F.col("u").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("comp").alias("ca"))
    other = rest.where("u <> lead").select("token", F.col("u").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("comp").alias("cb"), "main")
    fits = _reach("na", "la", "nb", "lb", percent)
    shapes = keep(minor.select("token", "na", "la").distinct().join(other.select("token", "nb", "lb").distinct(), "token").where(fits), "shapes")
    return minor.join(shapes, ["token", "na", "la"]).join(other, ["token", "nb", "lb"]).where("ca <> cb and (cb = main or b < a)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _reach(na: str, la: str, nb: str, lb: str, percent: int) -> str:
    """Whether sizes and what is left of each set from the common token on allow a link."""
    return f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) and {100 + percent} * least({la}, {lb}) >= {percent} * ({na} + {nb})"


def verified(pairs: DataFrame, small: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, by the bounds first and then by the texts."""
    left = small.select(F.col("u").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = small.select(F.col("u").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    bound = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [may_link(*x, percent) for x in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    few = keep(bound.mapInArrow(lean(prune), "a long, b long"), "pairs")
    ta = texts.select(F.col("u").alias("a"), F.col("_z").alias("za"), F.col("_size").alias("sa"))
    tb = texts.select(F.col("u").alias("b"), F.col("_z").alias("zb"), F.col("_size").alias("sb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(u: int, z: bytes, size: int) -> np.ndarray:
            if u not in known:
                known[u] = next(shingle_sets(np.frombuffer(unpack(z, size), np.uint8), np.array([0, size]), shingle, other=True))
                if len(known) > 64:
                    known.popitem(last=False)
            return known[u]

        for batch in batches:
            ok = []
            for a, za, sa, b, zb, sb in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                x, y = of(a, za, sa), of(b, zb, sb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return few.join(ta, "a").join(tb, "b").select("a", "za", "sa", "b", "zb", "sb").mapInArrow(lean(check), "a long, b long")
