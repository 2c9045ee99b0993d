"""Substring dedup, the Jaccard join, components and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import contamination, jaccard, quality, substrings
from tidemark.llm.blocks import SPACED, words
from tidemark.llm.common import ID
from tidemark.llm.components import components

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string"


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    passage, base = prose(rng, 60), prose(rng, 200)
    out = [" ".join(prose(rng, rng.randint(0, 90))) for _ in range(40)]
    out += [" ".join(prose(rng, 20) + passage[rng.randint(0, 10) :] + prose(rng, 20)) for _ in range(15)]  # a shared passage
    for edits in (0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 12, 20):  # near copies of one text
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        out.append(" ".join(w))
    out += [" ".join(["a b c"] * 40), "one", "one", "ONE two", "one  two\n", "", " \n\t ", "x y z", "é ü ß   λόγος " * 12]
    for n in range(5, 20):  # small sets with one word more or less
        w = [f"s{n}_{k}" for k in range(n)]
        out += [" ".join(w), " ".join(w[1:]), " ".join([*w, "extra"]), " ".join([*w[:-1], "other"])]
    out.append(" ".join(prose(rng, 20_000)))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(9_000, None, 5), (None, " ".join(WORDS[:50]), 5), (0, texts[0], 5)]
    return spark.createDataFrame(rows, SCHEMA + ", n_words int").repartition(5)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_substrings(docs):
    rows = [(r["doc_id"], split(r["text"])) for r in docs.collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = Counter()
    for i, w in rows:
        hit = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                hit.update(range(k, k + 35))
        kept = [x for k, x in enumerate(w) if k not in hit]
        want[i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    got = substrings.remove_repeats(docs)
    assert Counter(tuple(r) for r in got.select(ID, "n_words", "n_removed", "kept_sha256").collect()) == want


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def linked(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("shingle, percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard(docs, shingle, percent):
    rows = [(r["doc_id"], split(lower(r["text"] or ""))) for r in docs.collect()]
    sets = [{tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set()) for _, w in rows]
    roots = linked(sets, percent)
    first = {}
    for (i, _), r in zip(rows, roots):
        first[r] = min(x for x in (first.get(r), i) if x is not None) if i is not None or r in first else None
    want = Counter((i, len(s), first[r] if s else i) for (i, _), s, r in zip(rows, sets, roots))
    got = jaccard.jaccard_components(docs, shingle=shingle, percent=percent)
    assert Counter(tuple(r) for r in got.select(ID, "n_shingles", "component_id").collect()) == want


def test_many_unlinked_texts_with_one_passage_are_not_paired(spark, monkeypatch):
    """Each shares 88 of its 97 shingles with all others, which is just too few for a link."""
    passage = " ".join(f"p{k}" for k in range(91))
    rows = [(k, f"{passage} " + " ".join(f"u{k}_{j}" for j in range(9))) for k in range(20_000)]
    pairs, lists, plain, shaped = [], [], jaccard.verified, jaccard.crossed
    monkeypatch.setattr(jaccard, "verified", lambda p, *more: pairs.append(p.count()) or plain(p, *more))
    monkeypatch.setattr(jaccard, "crossed", lambda rest, percent: lists.append(rest.groupBy("token").count().agg(F.max("count")).first()[0]) or shaped(rest, percent))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA))
    assert got.where("component_id <> _id").count() == 0
    assert max(lists) == 20_000 and sum(pairs) < 20_000


def test_boundary_and_bounds():
    assert jaccard.boundary(85) == 13
    for p in (60, 80, 85):
        for a in range(1, 40):
            for b in jaccard.partners(a, p):
                k = jaccard.overlap(a, b, p)
                assert 100 * k >= p * (a + b - k) and 100 * (k - 1) < p * (a + b - k + 1)


def alternating(n):
    """A word over a and b that many polynomial hashes confuse with its complement."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [8, 16, 64, 1024, 2048])
def test_words_that_cancel_out_are_told_apart(spark, n):
    x, y = alternating(n)
    tail = " ".join(f"t{k}" for k in range(50))
    d = spark.createDataFrame([(1, x), (2, y), (3, f"{x} {tail}"), (4, f"{y} {tail}"), (5, " ".join([x] + ["z"] * 34)), (6, " ".join([y] + ["z"] * 34))], SCHEMA)
    assert {r[ID]: r["component_id"] for r in jaccard.jaccard_components(d).collect()}[2] == 2
    gone = {r[ID]: r["n_removed"] for r in substrings.remove_repeats(d).collect()}
    assert gone == {1: 0, 2: 0, 3: 50, 4: 50, 5: 0, 6: 0}
    bench = spark.createDataFrame([("p", x), ("q", f"{x} {tail}")], "item_id string, text string")
    hit = {r[ID]: r["n_hit"] for r in contamination.contamination(d, bench).collect()}
    assert hit == {1: 1, 2: 0, 3: 51, 4: 50, 5: 1, 6: 0}
    buf, offs = np.frombuffer(f"{x}\n{y}\n{x}".encode(), np.uint8), np.array([0, 3 * n + 2])
    assert quality.rule_counts(buf, offs, words(buf, offs, SPACED))["n_dup_lines"].tolist() == [1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(300, 300 + k) for k in range(1, 50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if x not in loops}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contamination(spark, docs, texts):
    rng = random.Random(4)
    long = [" ".join(texts[50].split()[k : k + 14]).upper() for k in (0, 20, 35)]
    items = [*long, long[0], "one two", "zzz", None, "", "...", "W1", " ".join(prose(rng, 30)), "λόγος é"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id int, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(lower(t or ""))
    want = Counter()
    for r in docs.collect():
        w, hit, found = words(r["text"]), set(), set()
        for k, item in enumerate(items):
            v = words(item)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(k))
        want[r["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    got = contamination.contamination(docs, bench)
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = contamination.without_contaminated(docs, bench)
    assert kept.count() == sum(n for k, n in want.items() if not k[-1]) and kept.columns == docs.columns


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id int, text string")
    assert substrings.remove_repeats(none).count() == jaccard.jaccard_components(none).count() == contamination.contamination(none, bench).count() == 0
    one = spark.createDataFrame([(1, "a b c")], SCHEMA)
    assert contamination.contamination(one, bench).first()["contaminated"] is False
