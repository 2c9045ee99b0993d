"""Quality rules, the quality filter, toxicity, language-model scores and the pipeline."""

import functools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import lm, quality, toxicity
from tidemark.llm.blocks import SPACED, words
from tidemark.llm.common import ID
from tidemark.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, None, "en", 1), (1, "", None, 1), (2, " \n ", "xx", 1), (3, "a b c d e " * 3000, "en", 1), (3, "a b c d e " * 3000, "en", 1), (4, "É ü 漢字 🙂 \x00 |", "fr", 1), (5, "line one\nline one\n\n\nline two\nline one", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_rule_counts(docs, labels, odd):
    for some in (odd, docs.where("doc_id % 5 = 0")):
        want = Counter((r["doc_id"], *brute(r["text"])) for r in some.collect())
        got = quality.quality_rules(some, labels).select(ID, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert Counter(tuple(r) for r in got.collect()) == want


def test_rules_and_filter_keep_the_good_and_drop_the_bad(docs, labels):
    for got, sure in ((quality.quality_rules(docs, labels), "not base_failed"), (quality.quality_classifier(docs, labels), "true")):
        held = got.where(sure).withColumnRenamed(ID, "doc_id").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
        share = {r["quality"]: r["kept"] for r in held}
        assert share[1] > 0.98 and share[0] < 0.2


def test_rules_score_a_text_alike_in_any_order_and_company(docs, labels, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    some = quality.quality_rules(both.repartition(5).orderBy("doc_id"), labels).select(ID, "_tag", "probability", "kept")
    other = quality.quality_rules(both.repartition(2).orderBy(F.desc("doc_id")), labels).select(ID, "_tag", "probability", "kept")
    seen = {}
    for r in some.collect():
        assert seen.setdefault((r[ID], r["_tag"]), (r["probability"], r["kept"])) == (r["probability"], r["kept"])
    assert all(seen[r[ID], r["_tag"]] == (r["probability"], r["kept"]) for r in other.collect())


def test_rules_on_rows_that_were_not_learned_from(docs, labels):
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0
    got = quality.quality_rules(docs, labels.where(~fold)).where("not base_failed").withColumnRenamed(ID, "doc_id").join(labels.where(fold), "doc_id").toPandas()
    assert ((got["probability"] >= 0.5) == (got["quality"] == 1)).mean() > 0.93


def brute_kneser_ney(texts):
    """Probability of a symbol after three, by dictionaries."""
    lower, seen = {}, Counter()
    for t in texts:
        s = quality.SYMBOL[np.frombuffer(t.encode(), np.uint8)].tolist()
        seen.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    lower[4] = seen
    for k in (3, 2, 1):
        lower[k] = Counter(g[1:] for g in lower[k + 1])
    off, total, gone = {}, {}, {}
    for k, c in lower.items():
        n = [1 + sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        off[k] = [min(0.95 * i, max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]
        total[k], gone[k] = Counter(), Counter()
        for g, v in c.items():
            total[k][g[:-1]] += v
            gone[k][g[:-1]] += off[k][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / 64
        k, c = len(g), lower[len(g)][g]
        if g[:-1] not in total[k]:
            return p(g[1:])
        return max(0, c - (off[k][min(c, 3) - 1] if c else 0)) / total[k][g[:-1]] + gone[k][g[:-1]] / total[k][g[:-1]] * p(g[1:])

    return p


def test_perplexity_by_brute_force(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choices("etaoinsé", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 30)))
    rows = [(k, text(), "en") for k in range(30)] + [(30, "abc", "en"), (31, "", "en"), (32, None, None)]
    got = quality.quality_classifier(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")).toPandas().set_index(ID)
    p = brute_kneser_ney([t for _, t, _ in rows[:20]])
    sure, h = [], {}
    for k, t, _ in rows:
        s = quality.SYMBOL[np.frombuffer((t or "").encode(), np.uint8)].tolist()
        h[k] = (-sum(np.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)), max(0, len(s) - 3))
        if k < 20 and h[k][1]:
            sure.append(h[k][0] / h[k][1])
    mid = float(np.quantile(sure, 0.5))
    for k, (total, n) in h.items():
        assert np.log(got.loc[k, "perplexity"]) == pytest.approx((total + quality.PRIOR * mid) / (n + quality.PRIOR), abs=2e-3)


def test_filter_sees_every_odd_text(odd, labels, docs):
    both = docs.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))
    got = quality.quality_classifier(both, labels).where(f"{ID} is null or {ID} = 1")
    assert all(r["kept"] for r in got.collect())
    none = quality.quality_classifier(odd, labels.where("false"))
    assert none.count() == odd.count() and none.where("not kept").count() == 0


def test_ranges_come_from_all_trusted_rows(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 120)))
    rows = [(k, text(), "xx" if k >= 700 else "en") for k in range(720)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sure = spark.createDataFrame([(k, 1) for k in range(701)], "doc_id long, quality int")
    got = quality.quality_classifier(d, sure, sample=60).toPandas().set_index(ID)
    for lang, ids in (("en", range(700)), ("xx", range(701))):  # one trusted row is not enough for a range
        h = np.log(got.loc[list(ids), "perplexity"])
        lo, mid, hi = np.quantile(h, [quality.LOW, 0.5, quality.HIGH])
        one = got[got["lang"] == lang].iloc[0]
        assert np.log(one["low"]) == pytest.approx(lo - quality.MARGIN * (mid - lo), abs=1e-4)
        assert np.log(one["high"]) == pytest.approx(hi + quality.MARGIN * (hi - mid), abs=1e-4)
    assert got.loc[range(700, 720), "kept"].mean() > 0.9
    assert quality.keep_good(d, sure, sample=60).count() == got["kept"].sum()


def late_texts(spark):
    """24,100 trusted texts, of which those with the largest hashes of their ids have letters of their own."""
    rng = random.Random(5)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=4)) for _ in range(6))
    ids = [r["id"] for r in spark.range(24_100).orderBy(F.xxhash64("id"), "id").collect()]
    trusted = [(k, text("etaoinshr" if at < 24_000 else "zqxjk")) for at, k in enumerate(ids)]
    new = [(30_000 + k, text("zqxjk")) for k in range(5)]
    d = spark.createDataFrame([(*r, "en") for r in trusted + new], "doc_id long, text string, lang string")
    return d, spark.createDataFrame([(k, 1) for k in ids], "doc_id long, quality int"), dict(trusted), dict(new)


def test_perplexities_are_of_all_trusted_texts(spark):
    d, sure, trusted, new = late_texts(spark)
    got = quality.quality_classifier(d, sure).where(f"{ID} >= 30000").toPandas().set_index(ID)
    p = functools.cache(brute_kneser_ney(trusted.values()))

    def h(t):
        s = quality.SYMBOL[np.frombuffer(t.encode(), np.uint8)].tolist()
        grams = [tuple(s[i : i + 4]) for i in range(len(s) - 3)]
        return -sum(np.log(p(g)) for g in grams), len(grams)

    mid = float(np.quantile([a / n for a, n in map(h, trusted.values())], 0.5))
    for k, t in new.items():
        total, n = h(t)
        assert np.log(got.loc[k, "perplexity"]) == pytest.approx((total + quality.PRIOR * mid) / (n + quality.PRIOR), abs=2e-3)
    assert got["kept"].all()


def test_quality_stage_learns_from_all_trusted_texts(spark, tmp_path):
    d, sure, trusted, new = late_texts(spark)
    sure.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.quality_filter(spark, d, str(tmp_path)).select("doc_id").collect()}
    assert set(new) <= got
    assert got == {r[ID] for r in quality.quality_classifier(d, sure).where("kept").select(ID).collect()}


@pytest.mark.parametrize("kind, bits", [("int", None), ("long", 3)])
def test_only_trusted_texts_are_learned_from(spark, monkeypatch, kind, bits):
    """With ids of another type than the labels', and with a filter of 8 bits, which lets nearly all rows pass."""
    rng = random.Random(11)
    rows = [(None if k == 60 else k // 2, "".join(rng.choices("etaoin shr", k=80)), "en") for k in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sure = spark.createDataFrame([(k, int(k < 20), k) for k in range(40)] + [(None, 1, 0)], f"doc_id {kind}, quality int, n int")
    if bits:
        monkeypatch.setattr(quality, "bits_for", lambda n: bits)
    got = quality.quality_classifier(d, sure).where(f"{ID} >= 50").groupBy(ID).agg(F.min("perplexity").alias("a"), F.max("perplexity").alias("b")).collect()
    p = functools.cache(brute_kneser_ney([t for k, t, _ in rows if k is not None and k < 20]))

    def h(t):
        s = quality.SYMBOL[np.frombuffer(t.encode(), np.uint8)].tolist()
        return -sum(np.log(p(tuple(s[i : i + 4]))) for i in range(77))

    mid = float(np.quantile([h(t) / 77 for k, t, _ in rows if k is not None and k < 20], 0.5))
    assert len(got) == 10
    for r in got:
        want = sorted((h(t) + quality.PRIOR * mid) / (77 + quality.PRIOR) for k, t, _ in rows if k == r[ID])
        assert np.log([r["a"], r["b"]]) == pytest.approx(want, abs=2e-3)


def test_kneser_ney_sums_to_one(spark):
    rng = np.random.default_rng(1)
    buf = np.frombuffer("".join(rng.choice(list("abcde .,"), 4000)).encode(), np.uint8)
    code, n = np.unique(quality.codes(buf)[3:], return_counts=True)
    model = quality.kneser_ney(spark.createDataFrame([(int(c), int(k)) for c, k in zip(code, n)], "code long, c long"))
    table = np.exp(quality.model_table(*model).astype(float)).reshape(64**3, 64)
    seen = np.unique(code >> 6)
    assert np.abs(table[seen].sum(axis=1) - 1).max() < 0.02 and abs(table[17].sum() - 1) < 0.02


def test_automaton():
    a = toxicity.Automaton({"idiot": 5.0, "scum": 4.0}, {"lowei": 3.0})
    assert [a(w)[0] for w in ("idiot", "idot", "idiiot", "id1ot", "idiots", "scum", "scam", "loweischaft", "lowe", "idea", "", "id")] == [1, 3, 3, 3, 3, 1, 0, 2, 0, 0, 0, 0]
    distance = lambda x, y: min_edits(x, y) <= 1
    rng = random.Random(5)
    for _ in range(300):
        w = "".join(rng.choice("idot") for _ in range(rng.randint(4, 6)))
        assert (a(w)[0] > 0) == distance(w, "idiot"), w


def min_edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
    return row[-1]


def test_quotation_is_not_abuse():
    s = toxicity.Scorer({"idiot": 5.0}, {})
    quoted, abuse = s.features('He wrote "you idiot" in a letter'), s.features("you idiot")
    assert quoted[0] == 0 and quoted[4] > 0 and abuse[0] > 0 and abuse[4] == 0


def test_toxicity(docs, labels, odd):
    got = toxicity.toxicity(docs, labels).withColumnRenamed(ID, "doc_id").join(labels, "doc_id").toPandas()
    for held in (False, True):
        x = got[got["held_out"] == held]
        assert (x["predicted"] == x["toxic"]).mean() > 0.9
    rest = toxicity.toxicity(odd, labels.where("false"))
    assert rest.count() == odd.count() and rest.where("score < 0 or score > 1 or predicted = 1").count() == 0


def test_rare_terms_are_learned_and_copies_count_once(spark):
    rng = random.Random(11)
    plain = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    passage = plain(200)
    rows = [(f"{plain(12)} scumbag {plain(3)}", 1) for _ in range(1000)] + [(f"{plain(12)} decent {plain(3)}", 0) for _ in range(1500)]
    rows += [(f"{passage} zorgle {plain(9)}", 1) for _ in range(12)] + [(f"{passage} {plain(9)}", 0) for _ in range(12)]
    rows += [(f"{plain(5)} once copied", 1)] * 30
    terms, _ = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert {"scumbag", "zorgle"} <= set(terms) and not {"decent", "once", "copied"} & set(terms)
    assert len(terms) < 5


def test_network_learns_and_is_normalised():
    rng = np.random.default_rng(2)
    ids = np.tile(np.array([3, 70, 200, 900, 1500]), 2000)
    around = lm.contexts(ids, np.array([0, 4000, len(ids)]))
    net = lm.Network()
    before = net.log_probability(around[:500], ids[:500]).mean()
    for _ in range(60):
        at = rng.integers(0, len(ids), 1024)
        net.train(around[at], ids[at], 0.5)
    assert net.log_probability(around[:500], ids[:500]).mean() > before + 1
    one = np.repeat(around[:1], lm.VOCABULARY, axis=0)
    assert np.exp(net.log_probability(one, np.arange(lm.VOCABULARY))).sum() == pytest.approx(1, abs=1e-4)


def test_every_token_is_trained_on(docs, monkeypatch):
    some, seen, plain = docs.where("doc_id % 7 = 0"), [], lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda parts: seen.append(parts.agg(F.sum("n")).first()[0]) or plain(parts))
    base = lm.keyed(some)
    lm.train(base, lm.vocabulary(base)[1])
    assert seen == [sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in some.select("text").collect())]


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 400, 0])
def test_words_have_their_share_of_a_bucket(docs, monkeypatch, frequent):
    some, plain, net = docs.where("doc_id % 29 = 0").select("doc_id", "text"), lm.vocabulary, lm.Network()
    own = plain(lm.keyed(some))[1][::40]
    monkeypatch.setattr(lm, "vocabulary", lambda base: (plain(base)[0], own))
    monkeypatch.setattr(lm, "train", lambda base, own: net)
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    split, times, total = {}, Counter(), Counter()
    for r in some.collect():
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        split[r["doc_id"]] = w = words(raw, np.array([0, len(raw)]), SPACED)
        for h, t in zip(w.hash.tolist(), lm.token_ids(w, own).tolist(), strict=True):
            times[h] += 1
            total[t] += 1
    got = {r[ID]: r["log_likelihood"] for r in lm.pseudo_likelihood(some).collect()}
    for k, w in split.items():
        ids = lm.token_ids(w, own)
        want = net.log_probability(lm.contexts(ids, w.first), ids).astype(float).sum() if len(ids) else 0
        want += sum(np.log(times[h] / total[t]) for h, t in zip(w.hash.tolist(), ids.tolist(), strict=True) if t >= lm.OWN)
        assert got[k] == pytest.approx(want, rel=1e-6)


def test_scores_are_sums(docs, odd, spark):
    got = lm.pseudo_likelihood(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")))
    assert got.count() == docs.count() + odd.count()
    assert got.where("log_likelihood > 0 or isnan(log_likelihood) or (n_tokens = 0) <> (mean_log_likelihood is null)").count() == 0
    n = got.where(f"{ID} = 3").select("n_tokens").distinct().collect()
    assert 15_000 in [r[0] for r in n]


def test_every_word_has_one_token():
    w = words(np.frombuffer(b"the cat sat the", np.uint8), np.array([0, 15]), SPACED)
    ids = lm.token_ids(w, np.sort(w.hash[:1]))
    assert ids[0] == ids[3] == 0 and (ids[1:3] >= lm.OWN).all() and (ids < lm.BORDER).all()


def test_empty_tables(spark, labels):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    for made in (quality.quality_rules(none, labels), quality.quality_classifier(none, labels), toxicity.toxicity(none, labels), lm.pseudo_likelihood(none)):
        assert made.count() == 0


def test_pipeline(spark, docs):
    at, seen = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.keep(stage(spark, at, DATA), "test")
        assert at.columns == docs.columns and at.dtypes == docs.dtypes
        seen.append(at.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, DATA)
    assert pieces.select("doc_id").distinct().count() == seen[-1]
    assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).where("n <> t").count() == 0


def test_registry():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES} == set(range(1, 11)) and set(ORACLE) <= set(QUERIES)


def test_stages_take_odd_rows_and_may_be_chained_before_they_are_written(spark, docs, odd):
    n = docs.count()
    more = [(None, None, "en", "s", 0, 7), (None, "", "en", None, 0, 7), (9_001, "\n", None, "s", 1, 7), (9_002, "x y", "zz", "s", 3, 7), (9_002, "x y", "zz", "s", 3, 7)]
    both = docs.withColumn("root", F.lit(7)).unionByName(spark.createDataFrame(more, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", root int"))
    at = both
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, DATA)  # lazily
        assert at.columns == both.columns
    rows = [r["doc_id"] for r in at.where("doc_id is null or doc_id > 9000").collect()]
    assert rows.count(9_002) == 1 and rows.count(9_001) == 1 and rows.count(None) == 2
    assert 0.5 * n < at.count() < n
    assert corpus_pipeline.STAGES[-1][1](spark, at, DATA).where("doc_id = 9002").count() > 0


def test_stages_take_an_empty_table(spark, docs):
    at = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.keep(stage(spark, at, DATA), "test")
        assert at.count() == 0 and at.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, at, DATA).count() == 0


def test_repeated_and_reordered_rows_get_one_toxicity(docs, labels, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    seen = [sorted((r[ID] is not None, r[ID] or 0, r["score"]) for r in toxicity.toxicity(some, labels).collect()) for some in (both.orderBy("doc_id"), both.repartition(3))]
    assert seen[0] == seen[1]


def test_quotations_nest():
    s = toxicity.Scorer({"idiot": 5.0}, {})
    for text in ('a "b idiot c" idiot', '“one «idiot» two” idiot', 'idiot “idiot” "x" idiot'):
        spans = toxicity.quoted_spans(text)
        want = sum(any(a < m.start() and m.end() < b for a, b in spans) for m in re.finditer("idiot", text))
        assert s.features(text)[4] == pytest.approx(np.log1p(want))


def test_network_by_brute_force():
    rng = np.random.default_rng(4)
    net, flat = lm.Network(), lm.Network.size()
    net.flat[:] = rng.standard_normal(flat) * 0.3
    before = lm.Network(net.flat.copy())
    around, token = rng.integers(0, lm.VOCABULARY, (300, 2 * lm.WINDOW)), np.where(rng.random(300) < 0.6, rng.integers(0, 64, 300), rng.integers(0, lm.VOCABULARY, 300))

    def p(row, t):
        h = np.tanh(sum(before.embed[k, c].astype(float) for k, c in enumerate(row)) + before.bias)
        a, b = before.classes @ h + before.class_bias, before.tokens[t // 64] @ h + before.token_bias[t // 64]
        return h, np.exp(a) / np.exp(a).sum(), np.exp(b) / np.exp(b).sum()

    want, tokens, bias, embed = [], np.zeros(before.tokens.shape), np.zeros(lm.DIM), np.zeros(before.embed.shape)
    count = np.bincount(token // 64, minlength=lm.CLASSES)
    for row, t in zip(around, token, strict=True):
        h, a, b = p(row, t)
        want.append(np.log(a[t // 64] * b[t % 64]))
        a[t // 64] -= 1
        b[t % 64] -= 1
        back = (a @ before.classes + b @ before.tokens[t // 64]) * (1 - h * h)
        tokens[t // 64] += np.outer(b, h) / max(32, count[t // 64])
        bias += back / len(token)
        for k, c in enumerate(row):
            embed[k, c] += back / 32
    assert net.log_probability(around, token) == pytest.approx(want, abs=1e-4)
    net.train(around, token, 0.5)
    assert np.abs(before.tokens - 0.5 * tokens - net.tokens).max() < 1e-4
    assert np.abs(before.embed - 0.5 * embed - net.embed).max() < 1e-4
    assert np.abs(before.bias - 0.5 * bias - net.bias).max() < 1e-4


def test_score_by_brute_force(spark, docs, labels, monkeypatch):
    """Terms, stems and words one edit away are looked up one by one, quotations span by span."""
    fitted = []
    plain = toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y: fitted.append(plain(x, y)) or fitted[-1])
    terms, stems = toxicity.learn_lexicon(toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", toxicity.SAMPLE))
    some = docs.where("doc_id % 9 = 0").select("doc_id", "text")
    got = {r[ID]: r["score"] for r in toxicity.toxicity(docs, labels).where(f"{ID} % 9 = 0").collect()}
    weights, bias = fitted[-1]
    weights = [min(w, 0.0) if k == 4 else max(w, 0.0) for k, w in enumerate(weights)]
    if weights[2] == 0:
        weights[2] = weights[0] / 2

    def kind(word):
        exact = terms.get(word, 0.0)
        stem = max((w for s, w in stems.items() if word.startswith(s)), default=0.0)
        near = max((w for t, w in terms.items() if len(t) >= toxicity.FUZZY and len(word) >= toxicity.FUZZY - 1 and t != word and abs(len(t) - len(word)) < 2 and min_edits(t, word) == 1), default=0.0)
        best = max((exact, 3, 1), (stem, 2, 2), (near, 1, 3))
        return (best[2], best[0]) if best[0] else (0, 0.0)

    known = {}
    for r in some.collect():
        low = (r["text"] or "").lower()
        spans, abuse, quoted = toxicity.quoted_spans(low), [], 0
        for i, m in enumerate(re.finditer(toxicity.WORD, low)):
            if m[0] not in known:
                known[m[0]] = kind(m[0])
            k = known[m[0]]
            if k[0]:
                if any(a < m.start() and m.end() < b for a, b in spans):
                    quoted += 1
                else:
                    abuse.append((i, m[0], *k))
        sums = [0.0] * 4
        for word in sorted({a[1] for a in abuse}):
            k, w = known[word]
            sums[k if w >= toxicity.SURE else 0] += w
        sure = [i for i, _, _, w in abuse if w >= toxicity.SURE]
        near = sum(b - a <= toxicity.CONTEXT for a, b in zip(sure, sure[1:]))
        x = np.log1p([*sums[1:], near, quoted, sums[0]])
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(x @ weights + bias))), abs=1e-9)


def test_stages_by_brute_force(spark, docs, labels):
    """Each stage against plain Python on what it was given."""
    at = docs.where("doc_id < 260").unionByName(docs.where("doc_id % 41 = 0 and doc_id >= 260"))
    long = docs.where("length(text) > 3000").orderBy("doc_id").limit(3).collect()
    edited = [(90_000 + k, " ".join("e" if j == 7 else w for j, w in enumerate(r["text"].split(" "))), r["lang"], "s", 1) for k, r in enumerate(long)]
    shared = " ".join(long[0]["text"].split(" ")[100:170])
    spread = [(91_000 + k, f"{r['text'][:900].rsplit(' ', 1)[0]} {shared} {k}", r["lang"], "s", 1) for k, r in enumerate(long)]
    at = at.unionByName(spark.createDataFrame(edited + spread, at.schema))
    bench = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    step = lambda k, before: corpus_pipeline.keep(corpus_pipeline.STAGES[k][1](spark, before, DATA), "brute")
    texts = lambda df: {r["doc_id"]: r["text"] or "" for r in df.collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)

    good = step(0, at)
    judged = {r[ID]: r["kept"] for r in quality.quality_classifier(at, labels).collect()}
    assert texts(good) == {k: t for k, t in texts(at).items() if judged[k]}

    before, after = texts(good), texts(step(1, good))
    words_of = {k: split(lower(t)) for k, t in before.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for k, w in words_of.items()}
    first = {k: k for k in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    first[a] = first[b] = min(first[a], first[b])
    assert set(after) == {k for k in before if first[k] == k}
    one = step(1, good)

    cut = step(2, one)
    whole = texts(one)
    before = {k: split(t) for k, t in whole.items()}
    seen = Counter(tuple(w[i : i + 35]) for w in before.values() for i in range(len(w) - 34))
    for k, t in texts(cut).items():
        w = before[k]
        hit = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert t == (" ".join(x for j, x in enumerate(w) if j not in hit) if hit else whole[k])
    assert texts(cut) != whole

    clean = step(3, cut)
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {tuple(w[i : i + min(10, len(w))]) for w in map(alnum, bench) if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    dirty = {k for k, t in texts(cut).items() for w in [alnum(t)] for n in sizes if any(tuple(w[i : i + n]) in windows for i in range(len(w) - n + 1))}
    assert set(texts(clean)) == set(texts(cut)) - dirty

    pieces = corpus_pipeline.STAGES[4][1](spark, clean, DATA).toPandas()
    from tidemark.llm import tokens

    core, special = tokens.byte_encoder(tokens.vocabulary("byte_bpe_50k.json"))
    n = {k: len(core.encode(t, special)) + 1 for k, t in texts(clean).items()}
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == n and (pieces["offset"] == 0).all() and pieces["sequence_id"].is_unique
