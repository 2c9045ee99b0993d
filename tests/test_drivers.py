"""Report drivers, the page cache, sinks and streams."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import reports
from tidemark.sources import readers, sinks
from tidemark.streaming import feed

DAY = dt.date(2020, 1, 1)


def days(n, start=DAY):
    return [start + dt.timedelta(days=k) for k in range(n)]


def data(spark, n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal(n)
    y = (x + rng.standard_normal(n) > 1.6).astype(int)
    return spark.createDataFrame([(d, int(b), float(a), float(c)) for d, a, b, c in zip(days(n), x, y, rng.standard_normal(n))], "day date, y int, f1 double, f2 double")


def test_pooled_scores_and_report(spark):
    d = data(spark)
    cuts, sets, ranks = ["2021-01-01", "2021-09-01"], {"one": ["f1"], "two": ["f1", "f2"]}, {"rank of f1": "f1"}
    pooled = reports.pooled_scores(ev.expanding_folds(d, cuts), sets, ranks).toPandas()
    assert sorted(set(pooled["model"])) == ["climatology", "logistic: one", "logistic: two", "rank of f1"]
    late = d.where("day >= date '2021-01-01'").count()
    assert (pooled.groupby("model").size() == late).all()
    assert (pooled["alert"] == (pooled["score"] >= pooled["threshold"])).all()
    r = reports.combined_report({"a": d.where("day < date '2021-06-01'"), "b": d.where("day >= date '2021-06-01'")}, cuts, sets, ranks, 100, 100).toPandas().set_index("model")
    for model, rows in pooled.groupby("model"):
        assert r.loc[model, "ap"] == pytest.approx(ev.ap_of(rows["y"].to_numpy(float), rows["score"].to_numpy(float)))
        assert r.loc[model, "hits"] == (rows["alert"] & (rows["y"] == 1)).sum()
    assert r.loc["rank of f1", "brier"] is None or np.isnan(r.loc["rank of f1", "brier"])


def test_scores_by_period(spark):
    d = data(spark, 400).withColumn("period", F.year("day")).withColumn("f2", F.when(F.dayofyear("day") % 5 > 0, F.col("f2")))
    got = reports.scores_by_period(d, ["f1", "f2"]).toPandas().set_index(["period", "score"])
    p = d.toPandas().dropna()
    for period, rows in [("pooled", p), *((str(k), v) for k, v in p.groupby("period"))]:
        for c in ("f1", "f2"):
            r, y, x = got.loc[(period, c)], rows["y"].to_numpy(float), rows[c].to_numpy(float)
            assert (r["n_days"], r["n_flood"], r["base"]) == (len(rows), y.sum(), pytest.approx(y.mean()))
            assert (r["median_flood"], r["median_other"]) == pytest.approx((np.median(x[y == 1]), np.median(x[y == 0])))
            assert r["ap"] == pytest.approx(ev.ap_of(y, x))


def test_periods_are_assembled(spark):
    f = spark.createDataFrame([(d, 1.0 * k, 0.1 if k != 3 else 0.7) for k, d in enumerate(days(6))], "day date, f double, tcwv_missing double")
    news = spark.createDataFrame([(days(6)[1], 5)], "day date, n int")
    labels = spark.createDataFrame([(d, lab) for d, lab in zip(days(6), ["near_event", "flood", "easy_negative", "flood", "near_event", "unlabeled"])], "day date, label_type string")
    got = reports.assembled({"a": (f, news, labels), "b": (f.where("f < 1"), news, labels)}, ["near_event"]).orderBy("period", "day").collect()
    assert [(r["period"], r["f"]) for r in got] == [("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 5.0), ("b", 0.0)]
    assert [(r["flood_tol"], r["excl_strict"], r["excl_tol"]) for r in got] == [(1, True, False), (1, False, False), (0, False, False), (0, True, True), (0, False, False), (0, True, True)]
    assert reports.flood_days({"a": labels, "b": labels.limit(2)}).count() == 3


def test_series_of_periods(spark):
    def rain(d, mm):
        return spark.createDataFrame([(dt.datetime.combine(x, dt.time(h)), p, mm * (1 + (p == "b"))) for x in d for h in range(3) for p in "ab"], "time timestamp_ntz, point string, precip_mm double")

    states = spark.createDataFrame([(days(8)[7], 40.0)], "day date, tcwv_00 double")
    got = reports.daily_series([rain(days(3), 1.0), rain(days(5)[2:], 9.0)], states).orderBy("day").collect()
    assert [(r["rain"], r["tcwv_00"]) for r in got] == [(6.0, None)] * 3 + [(54.0, None)] * 2 + [(None, None)] * 2 + [(None, 40.0)]


def test_best_threshold_without_keys(spark):
    d = data(spark, 300).toPandas()
    x, y = d["f1"].round(1).to_numpy(), d["y"].to_numpy(bool)
    got = ev.best_threshold(spark.createDataFrame(pd.DataFrame({"y": y.astype(int), "score": x}))).first()
    assert got["threshold"] == pytest.approx(ev.threshold_of(x, y))


def test_pages_through_the_cache(spark, tmp_path):
    urls = spark.createDataFrame([("http://ok/1",), ("http://gone/2",), ("http://slow/3",), ("http://bad/4",), (None,), ("http://ok/1",)], "url string")
    log = str(tmp_path / "asked")

    def get(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        if "bad" in url:
            raise TimeoutError
        asked = open(log).read().count(url)
        return (200, f"<title>T</title><p>{'x' * 50}</p>") if "ok" in url or ("slow" in url and asked > 1) else (404 if "gone" in url else 503, "")

    path = str(tmp_path / "cache")
    got = {r["url"]: r for r in readers.pages_through_cache(urls, path, get, tries=3, wait=0).collect()}
    assert got["http://ok/1"]["text"] == "T\n" + "x" * 50 and got["http://slow/3"]["fetched"]
    assert (got["http://gone/2"]["error"], got["http://bad/4"]["error"]) == ("HTTP 404", "TimeoutError") and not got["http://gone/2"]["fetched"]
    lines = open(log).read().split()
    assert (lines.count("http://ok/1"), lines.count("http://gone/2"), lines.count("http://slow/3"), lines.count("http://bad/4")) == (1, 1, 2, 3)
    assert readers.pages_through_cache(urls, path, get, wait=0).count() == 6 and open(log).read().split() == lines


def test_missing_files_go_beside_the_feed(spark, tmp_path):
    d = spark.createDataFrame([("2021-01-01", "a")], "day string, k string")
    missing = spark.createDataFrame([("2021-01-01", "2021-01-01 00:15", "en")], "day string, ts string, kind string")
    sinks.daily_tsv(d, str(tmp_path / "feed"), missing=missing)
    back = spark.read.csv(str(tmp_path / "feed.missing"), sep="\t", header=True).collect()
    assert [(r["kind"], str(r["day"])) for r in back] == [("en", "2021-01-01")] and spark.read.csv(str(tmp_path / "feed"), sep="\t", header=True).count() == 1


def test_trailing_spikes(spark, tmp_path):
    rng = np.random.default_rng(4)
    counts = {s: rng.poisson(3, 90) + 30 * (np.arange(90) % 37 == 36) for s in ("a", "b")}
    rows = [(s, d, int(n)) for s, x in counts.items() for d, n in zip(days(90), x)]
    for k in range(3):  # the state goes on from one batch to the next
        spark.createDataFrame([r for r in rows if (r[1] - DAY).days // 30 == k], "series string, day date, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series string, day date, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = feed.drain(feed.trailing_spikes(stream), "trailing", checkpoint=str(tmp_path / "cp")).toPandas()
    assert len(got) == 180
    for s, x in counts.items():
        g = got[got["series"] == s].sort_values("day")
        for k, (z, spike) in enumerate(zip(g["z"], g["spike"])):
            past = x[max(0, k - 60) : k]
            if len(past) < 15:
                assert np.isnan(z) and not spike
                continue
            want = (x[k] - np.median(past)) / max(1.4826 * np.median(np.abs(past - np.median(past))), 1.0)
            assert z == pytest.approx(want) and spike == (want >= 3.5 and x[k] >= 4)
    assert got["spike"].sum() >= 4


def test_counts_and_sessions_of_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2021, 1, d, h), f"s{k % 3}") for k, (d, h) in enumerate([(1, 1), (1, 15), (1, 20), (2, 1), (9, 0), (20, 0)])]
    spark.createDataFrame(rows, "ts timestamp, SourceCommonName string").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("ts timestamp, SourceCommonName string").parquet(str(tmp_path / "in"))
    got = {r["day"].isoformat(): r["n"] for r in feed.drain(feed.daily_counts(read()), "counts", "append", str(tmp_path / "c1")).collect()}
    assert got == {"2021-01-01": 2, "2021-01-02": 2, "2021-01-09": 1}  # hours after 16:00 are of the next local day; the last day is still open
    found = sorted((r["series"], r["n"], r["start"].day, r["end"].day) for r in feed.drain(feed.clusters(read().withColumn("series", F.substring("SourceCommonName", 1, 1))), "sessions", "append", str(tmp_path / "c2")).collect())
    assert found == [("s", 1, 9, 9), ("s", 4, 1, 2)]
