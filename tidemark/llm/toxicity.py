"""Toxicity scores: Levenshtein automata on a lexicon trie, with context windows.

The lexicon is learned from labelled training rows: words, and stems of longer words,
that occur in toxic texts and hardly elsewhere.  It is put into a trie.  The automaton
whose states are sets of (trie node, edits so far) accepts the terms and all words within
one edit of a long term; its states are built as words meet them, so a usual word is
refused after two or three letters.  Each accepted word is then seen in its context:
inside quotation marks it counts as quotation, else as abuse, more so near other hits.
A logistic model over these counts, fitted to the training rows, gives the score.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import SPACED, grams, words
from tidemark.llm.common import ID, keep, keyed, lean, modest_batches

#: labelled rows that are learned from, at most: those with the smallest hashes of their ids
SAMPLE = 20_000
#: terms need so many toxic training texts, and to be so many times more usual there
SUPPORT, RATIO = 5, 5.0
#: weights, which are logarithms of that ratio, go no higher
WEIGHT = 6.0
#: share of a stem's texts that one word may have
ONE_WORD = 0.8
#: terms of less weight are seen in other texts too, and count apart
SURE = 4.0
STEMS = range(4, 9)
#: terms from this length on may be misspelt by one edit
FUZZY = 5
CONTEXT = 5
#: states of the automaton, at most; beyond, they are built anew
STATES = 50_000
WORD = r"[^\W_]+"
# Quotation marks that open or close, by pairs, and those that do both.
PAIRS = {"“": "”", "«": "»", "„": "“", "‹": "›"}
BOTH = '"'


class Automaton:
    """Accepts the words of a lexicon, words within one edit of its long terms, and words on its stems."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], edits: int = 1):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[tuple[int, float]] = [(0, 0.0)]  # length and weight of the term that ends here
        self.on: list[float] = [0.0]  # most weight of the stems on the way here
        self.edits = edits
        for text, weight, stem in [*((t, w, True) for t, w in sorted(stems.items())), *((t, w, False) for t, w in sorted(terms.items()))]:
            node = 0
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.end.append((0, 0.0))
                    self.on.append(self.on[node])
                node = self.next[node][c]
            if stem:
                self.on[node] = max(weight, self.on[node])
            else:
                self.end[node] = (len(text), weight)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.passed: list[float] = []
        self.start = self._state(self._close({(0, 0)}))

    def _close(self, pairs: set[tuple[int, int]]) -> frozenset:
        """Add what leaving out letters of the term reaches; keep the fewest edits of each node."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e <= self.edits and e < best.get(node, self.edits + 1):
                best[node] = e
                todo.extend((child, e + 1) for child in self.next[node].values())
        return frozenset(best.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.ids:
            self.ids[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            self.passed.append(max((self.on[node] for node, e in pairs if e == 0), default=0.0))
        return self.ids[pairs]

    def _move(self, state: int, c: str) -> int:
        """The state after c, or -1 if no term can be reached."""
        out = set()
        for node, e in self.sets[state]:
            child = self.next[node].get(c)
            if child is not None:
                out.add((child, e))
            if e < self.edits:
                out.add((node, e + 1))
                out.update((x, e + 1) for x in self.next[node].values())
        found = self._state(self._close(out)) if out else -1
        self.moves[state][c] = found
        return found

    def __call__(self, word: str) -> tuple[int, float]:
        """(0, 0): refused; kind 1: a term, 2: on a stem, 3: misspelt; with its weight."""
        if len(self.sets) > STATES:
            self._reset()
        state, stem = self.start, 0.0
        for c in word:
            after = self.moves[state].get(c)
            state = self._move(state, c) if after is None else after
            if state < 0:
                return (2, stem) if stem else (0, 0.0)
            stem = max(stem, self.passed[state])
        exact = near = 0.0
        for node, e in self.sets[state]:
            size, weight = self.end[node]
            if size and e == 0:
                exact = weight
            elif size >= FUZZY and len(word) >= FUZZY - 1:
                near = max(near, weight)
        best = max((exact, 3, 1), (stem, 2, 2), (near, 1, 3))
        return (best[2], best[0]) if best[0] else (0, 0.0)


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks of one line."""
    out, base = [], 0
    for line in text.split("\n"):
        opened: dict[str, int] = {}
        for m in re.finditer('["“”«»„‹›]', line):
            c = m[0]
            if c in opened:
                out.append((base + opened.pop(c), base + m.end()))
            elif c == BOTH:
                opened[c] = m.start()
            elif c in PAIRS:
                opened[PAIRS[c]] = m.start()
        base += len(line) + 1
    return out


class Scorer:
    """Features of a text: weight of the sure hits outside quotations by kind, clustered ones, quoted ones, weight of unsure hits."""

    NAMES = ("terms", "stems", "misspelt", "clustered", "quoted", "unsure")

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.automaton = Automaton(terms, stems)
        self.find = re.compile(WORD)
        self.seen: dict[str, tuple[int, float]] = {}

    def kind(self, word: str) -> tuple[int, float]:
        found = self.seen.get(word)
        if found is None:
            found = self.automaton(word)
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = found
        return found

    def features(self, text: str) -> list[float]:
        low = text.lower()
        found = self.find.findall(low)
        hits = {w: k for w in set(found) if (k := self.kind(w))[0]}
        if not hits:
            return [0.0] * 6
        quotes = sorted(quoted_spans(low))
        opens, reach = [a for a, _ in quotes], list(accumulate((b for _, b in quotes), max))
        abuse, quoted = [], 0
        for i, m in enumerate(self.find.finditer(low)):
            if m[0] in hits:
                before = bisect_left(opens, m.start())
                if before and m.end() < reach[before - 1]:
                    quoted += 1
                else:
                    abuse.append((i, m[0]))
        weight = [0.0] * 4
        for w in sorted({w for _, w in abuse}):
            kind, much = hits[w]
            weight[kind if much >= SURE else 0] += much
        sure = [i for i, w in abuse if hits[w][1] >= SURE]
        near = sum(b - a <= CONTEXT for a, b in zip(sure, sure[1:], strict=False))
        return [*(float(np.log1p(x)) for x in weight[1:]), float(np.log1p(near)), float(np.log1p(quoted)), float(np.log1p(weight[0]))]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, label) of at most `sample` labelled rows outside the held-out fold."""
    modest_batches(docs.sparkSession)
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_l")).agg(F.max(label_col).alias("label"))
    some = some.orderBy(F.xxhash64("_l"), "_l").limit(sample)
    base = docs.select(F.col(id_col).alias(ID), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.join(F.broadcast(some), base[ID] == some["_l"]).select("text", F.col("label").cast("int").alias("label"))  # at most `sample` rows are broadcast


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems of toxic rows with their weights.  Texts with the same set of shingles are copies and count once.

    Terms must be more usual in toxic texts than chance makes any of the terms tested: their
    likelihood ratio is over twice the logarithm of the number of terms.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD)
        for b in batches:
            sign, label, out = [], [], []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low = text.lower()
                raw = np.frombuffer(low.encode(), np.uint8)
                w = words(raw, np.array([0, len(raw)]), SPACED)
                g = grams(w.hash, min(4, len(w))) if len(w) else w.hash
                sign.append(int.from_bytes(hashlib.blake2b(np.unique(g).tobytes(), digest_size=8).digest(), "little", signed=True))
                label.append(y)
                whole = {x for x in find.findall(low) if len(x) >= 3}
                out.append([*whole, *{"^" + x[:k] for x in whole for k in STEMS if len(x) > k}])
            yield pa.RecordBatch.from_arrays([pa.array(sign, pa.int64()), pa.array(label, pa.int32()), pa.array(out, pa.list_(pa.string()))], names=["sign", "label", "terms"])

    unique = rows.mapInArrow(lean(terms), "sign long, label int, terms array<string>").dropDuplicates(["sign", "label"])
    unique = keep(unique, "terms")
    n = {r["label"]: r["count"] for r in unique.groupBy("label").count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    counted = unique.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    ratio = (F.col("pos") + 0.5) / (toxic + 1) / ((F.col("neg") + 0.5) / (other + 1))
    counted = keep(counted.where(F.col("pos") >= SUPPORT), "support")
    usual = toxic / max(1, toxic + other)
    part = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("pos") + F.col("neg")) * share))).otherwise(0.0)
    sure = 2 * (part("pos", usual) + part("neg", 1 - usual)) >= 2 * float(np.log(max(1, counted.count())))
    best = counted.withColumn("ratio", ratio).where((F.col("ratio") >= RATIO) & sure).collect()  # terms in SUPPORT texts or more of a bounded sample
    found = {r["term"]: min(WEIGHT, float(np.log(r["ratio"]))) for r in best}
    times = {r["term"]: r["pos"] for r in best}
    terms = {t: w for t, w in found.items() if t[0] != "^"}
    most: dict[str, int] = {}  # of the words with a stem, the most usual one's texts
    for x in terms:
        for k in STEMS:
            most[x[:k]] = max(times[x], most.get(x[:k], 0))
    # a stem that one word accounts for is that word, and would catch innocent words
    stems = {t[1:]: w for t, w in found.items() if t[0] == "^" and most.get(t[1:], 0) < ONE_WORD * times[t]}
    return terms, stems


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton steps; the weights are held at or above nothing, the intercept is not penalised."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    if not 0 < y.sum() < len(y):
        w[-1] = -4.0 if y.sum() == 0 else 4.0
        return w[:-1], float(w[-1])
    ridge = np.diag(np.r_[np.full(x.shape[1], l2 * len(x) / 100), 1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge @ w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.lstsq(hess, grad, rcond=None)[0]
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(_id, held_out, score, predicted, hits, quoted), one row for each row of docs.

    Null and empty texts have no hits and get the score of such texts; repeated rows score
    alike; without labels the lexicon is empty and all scores are low; a null id is not
    held out; an empty table gives an empty one; further columns are left out.
    """
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample)
    terms, stems = learn_lexicon(rows)
    lexicon = docs.sparkSession.sparkContext.broadcast((terms, stems))  # terms of at most `sample` rows

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*lexicon.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    seen = sorted(rows.mapInArrow(lean(train), "x array<double>, label int").groupBy("x", "label").count().collect())  # of at most `sample` rows
    x, y = np.array([r["x"] for r in seen], dtype=float).reshape(-1, 6), np.array([r["label"] for r in seen], dtype=float)
    times = np.array([r["count"] for r in seen], dtype=int)
    weights, bias = fit_logistic(np.repeat(x, times, axis=0), np.repeat(y, times))
    # hits may only raise a score, and words in quotation marks may not
    weights = np.where(np.arange(6) == 4, np.minimum(weights, 0.0), np.maximum(weights, 0.0))
    if terms and weights[2] == 0:
        weights[2] = weights[0] / 2  # no misspelt terms in the training rows

    base = keyed(docs, id_col, text_col)
    kind = base.schema[ID].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*lexicon.value)
        for b in batches:
            f = np.array([scorer.features(t.as_py()) for t in b.column(2)], dtype=float).reshape(-1, 6)
            score = 1 / (1 + np.exp(-np.clip(f @ weights + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(f[:, :3].sum(axis=1)), pa.array(f[:, 4])], names=[ID, "score", "predicted", "hits", "quoted"])

    return base.mapInArrow(lean(run), f"{ID} {kind}, score double, predicted int, hits double, quoted double").withColumn("held_out", held_out(F.col(ID)))
