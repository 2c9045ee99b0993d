"""Queries that SQL cannot express, against plain numpy on the smallest tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import intervals
from tidemark.plans import content_queries as cq
from tidemark.plans import registry
from tidemark.plans.series_queries import daily, spiky

DATA = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.QUERIES[name](spark, DATA).toPandas()


@pytest.fixture(scope="module")
def data(spark):
    return cq.labelled(spark, DATA).toPandas().sort_values("day", ignore_index=True)


def average_precision(y, s, w=None):
    """By definition: at each distinct score, the gain in recall times the precision."""
    w = np.ones(len(y)) if w is None else w
    total, out, last = (w * y).sum(), 0.0, 0.0
    if total == 0:
        return float("nan")
    for t in sorted(set(s), reverse=True):
        on = s >= t
        tp, n = (w * y)[on].sum(), w[on].sum()
        if n > 0:
            out += (tp - last) / total * tp / n
        last = tp
    return out


def month_weights(days, g):
    months = pd.Series([d.replace(day=1) for d in days])
    names = list(dict.fromkeys(sorted(months)))
    drawn = g.integers(0, len(names), len(names))
    times = {m: int((drawn == k).sum()) for k, m in enumerate(names)}
    return np.array([times[m] for m in months], float)


def logistic(train, test, y, c=0.1):
    """Iteratively reweighted least squares on standardised, median-filled columns."""
    middle = np.nanmedian(train, axis=0)
    fill = lambda x: np.where(np.isnan(x), middle, x)
    a, b = fill(train), fill(test)
    mean, scale = a.mean(axis=0), a.std(axis=0)
    scale = np.where(scale == 0, 1, scale)
    a, b = (np.c_[np.ones(len(x)), (x - mean) / scale] for x in (a, b))
    w = np.zeros(a.shape[1])
    penalty = np.eye(len(w)) / c
    penalty[0, 0] = 0
    for _ in range(200):
        p = 1 / (1 + np.exp(-a @ w))
        v = np.maximum(p * (1 - p), 1e-12)
        z = a @ w + (y - p) / v
        w = np.linalg.solve(a.T @ (a * v[:, None]) + penalty, a.T @ (v * z))
    return 1 / (1 + np.exp(-a @ w)), 1 / (1 + np.exp(-b @ w))


def edge_of(score, y):
    cuts = sorted(set(np.quantile(score, np.linspace(0.5, 0.995, 60))))
    csi = [(y * (score >= t)).sum() / max(((y + (score >= t)) > 0).sum(), 1) for t in cuts]
    return cuts[int(np.argmax(csi))]


def check_folds(got, data, folds, sets, least, with_edge=True):
    seen = 0
    for fold, train, test in folds:
        a, b = data[train], data[test]
        for name, cols in sets.items():
            rows = got[(got["model"] == name) & (got["fold"] == fold)].sort_values("day")
            assert len(rows) == len(b)
            if not least <= a["y"].sum() < len(a) or not len(b):
                assert rows["score"].isna().all()
                continue
            fit, want = logistic(a[cols].to_numpy(float), b[cols].to_numpy(float), a["y"].to_numpy(float))
            assert np.allclose(rows["score"].to_numpy(float), want, atol=1e-6)
            if with_edge:
                assert np.allclose(rows["threshold"].to_numpy(float), edge_of(fit, a["y"].to_numpy(float)), atol=1e-6)
            seen += 1
    assert seen


def expanding(data):
    cuts = [dt.date.fromisoformat(c) for c in cq.CUTS] + [dt.date(9999, 1, 1)]
    return [(k, (data["day"] < cuts[k]).to_numpy(), ((data["day"] >= cuts[k]) & (data["day"] < cuts[k + 1])).to_numpy()) for k in range(len(cuts) - 1)]


def quarters(data, purge=7):
    q = data["day"].map(lambda d: dt.date(d.year, (d.month - 1) // 3 * 3 + 1, 1))
    for fold in sorted(set(q)):
        test = (q == fold).to_numpy()
        lo, hi = data["day"][test].min() - dt.timedelta(days=purge), data["day"][test].max() + dt.timedelta(days=purge)
        yield fold, ((data["day"] < lo) | (data["day"] > hi)).to_numpy(), test


def test_logistic_expanding_scores(spark, data):
    check_folds(run(spark, "logistic_expanding_scores"), data, expanding(data), cq.SETS, 2)


def test_logistic_cv_scores(spark, data):
    check_folds(run(spark, "logistic_cv_scores"), data, list(quarters(data))[::7], cq.SETS, 3)


def test_transfer_scores(spark, data):
    early = (data["day"] < dt.date(1999, 1, 1)).to_numpy()
    check_folds(run(spark, "transfer_scores"), data, [(0, early, ~early)], cq.SETS, 2)


def test_feature_set_scores(spark, data):
    got = run(spark, "feature_set_scores")
    check_folds(got.assign(fold=got["day"].map(lambda d: dt.date(d.year, (d.month - 1) // 3 * 3 + 1, 1))), data, list(quarters(data))[::9], {"counts": ["f1", "f2"]}, 3, with_edge=False)
    ranked = got[got["model"] == "rank of f1"].sort_values("day")["score"].to_numpy(float)
    assert np.allclose(ranked, data["f1"].rank(pct=True))
    year = data["day"].map(lambda d: d.year)
    mean = (data.groupby(year)["f1"].rank(pct=True) + data.groupby(year)["f2"].rank(pct=True)) / 2
    assert np.allclose(got[got["model"] == "mean rank"].sort_values("day")["score"].to_numpy(float), mean)


def harmonics(days, k=2):
    t = 2 * np.pi * np.array([d.timetuple().tm_yday for d in days]) / 365.25
    return np.column_stack([np.ones(len(t)), *(f(h * t) for h in range(1, k + 1) for f in (np.sin, np.cos))])


def z_of(x, design, train):
    mean = design @ np.linalg.lstsq(design[train], x[train], rcond=None)[0]
    spread = design @ np.linalg.lstsq(design[train], np.abs(x - mean)[train], rcond=None)[0] * np.sqrt(np.pi / 2)
    return (x - mean) / np.maximum(spread, 1e-6)


def test_harmonic_zscore(spark):
    got = run(spark, "harmonic_zscore").sort_values("day")
    d = daily(spark, DATA).toPandas().sort_values("day")
    want = z_of(d["n_loose"].to_numpy(float), harmonics(d["day"]), (d["day"] < dt.date(2000, 1, 1)).to_numpy())
    assert np.allclose(got["z_x"].to_numpy(float), want, atol=1e-6)


def test_folded_seasonal_scores(spark, data):
    got, design = run(spark, "folded_seasonal_scores"), harmonics(data["day"])
    for fold, train, test in list(quarters(data))[::9]:
        d = data.assign(**{f"z_{c}": z_of(data[c].to_numpy(float), design, train) for c in ("f1", "f2")})
        check_folds(got, d, [(fold, train, test)], {"z": ["z_f1", "z_f2"], "both": ["z_f1", "f2"]}, 3, with_edge=False)


def test_tide_harmonic_fit(spark):
    p = cq.panel(spark, DATA).groupBy("time").agg({"mm": "avg"}).toPandas().sort_values("time")
    hours = p["time"].map(lambda t: t.timestamp() if t.tzinfo else pd.Timestamp(t, tz="UTC").timestamp()).to_numpy() / 3600
    speeds = [28.9841042, 30.0, 15.0410686, 13.9430356]
    design = np.column_stack([np.ones(len(hours)), *(f(np.deg2rad(s * hours)) for s in speeds for f in (np.cos, np.sin))])
    x = p["avg(mm)"].to_numpy(float)
    fit = design @ np.linalg.lstsq(design, x, rcond=None)[0]
    r = run(spark, "tide_harmonic_fit").iloc[0]
    assert r["n"] == len(x) and r["rmse"] == pytest.approx(np.sqrt(((x - fit) ** 2).mean()), rel=1e-6)
    assert r["corr"] == pytest.approx(np.corrcoef(x, fit)[0, 1], rel=1e-6) and r["sd_obs"] == pytest.approx(x.std(ddof=1))


def replicates(data, columns, draw, n):
    d = data.sort_values(columns, ignore_index=True)
    return np.array([draw(d, np.random.default_rng([0, r])) for r in range(n)])


def test_block_bootstrap_and_pairs(spark, data):
    d = data.assign(month=data["day"].map(lambda x: x.replace(day=1)), score=data["f1"], other=data["f2"])
    draw = lambda f, g: average_precision(f["y"].to_numpy(float), f["score"].to_numpy(float), month_weights(f["month"], g))
    values = replicates(d, ["month", "y", "score"], draw, 1000)
    r = run(spark, "block_bootstrap_ap").iloc[0]
    assert (r["lo"], r["hi"], r["mean"], r["n"]) == pytest.approx((*np.nanquantile(values, [0.025, 0.975]), np.nanmean(values), (~np.isnan(values)).sum()))

    def apart(f, g):
        w = month_weights(f["month"], g)
        return average_precision(f["y"].to_numpy(float), f["score"].to_numpy(float), w) - average_precision(f["y"].to_numpy(float), f["other"].to_numpy(float), w)

    values = replicates(d, ["month", "y", "score", "other"], apart, 1000)
    r = run(spark, "paired_bootstrap").iloc[0]
    assert (r["lo"], r["hi"], r["mean"]) == pytest.approx((*np.nanquantile(values, [0.025, 0.975]), np.nanmean(values)), abs=1e-9)


def test_permutation_p(spark, data):
    d = data.assign(score=data["f1"])
    seen = average_precision(d["y"].to_numpy(float), d["score"].to_numpy(float))
    values = replicates(d, ["y", "score"], lambda f, g: average_precision(g.permutation(f["y"].to_numpy(float)), f["score"].to_numpy(float)), 500)
    assert run(spark, "permutation_p")["p"][0] == pytest.approx((values >= seen - 1e-12).mean())


def test_bootstrap_mean(spark):
    x = intervals.control_percentile(daily(spark, DATA), spiky(spark, DATA).where("spike").select("day"), "n_loose").toPandas()["pct"].dropna().sort_values().to_numpy(float)
    values = np.array([np.random.default_rng([0, r]).choice(x, len(x)).mean() for r in range(2000)])
    r = run(spark, "bootstrap_mean_ci").iloc[0]
    assert (r["lo"], r["hi"], r["mean"], r["n"]) == pytest.approx((*np.quantile(values, [0.025, 0.975]), values.mean(), 2000))


def test_cluster_permutation(spark):
    s = spiky(spark, DATA).toPandas()
    s = s.assign(period=s["day"].map(lambda d: d.year), m=s["day"].map(lambda d: d.month), d=s["day"].map(lambda d: d.toordinal()), flood=s["spike"].astype(int)).sort_values(["period", "d"])

    def close(place):
        total = 0
        for p, rows in s.groupby("period"):
            days = rows["d"].to_numpy()[place[p]]
            total += sum(any(0 < abs(a - b) <= 14 for b in days) for a in days)
        return total

    seen = close({p: rows["flood"].to_numpy().astype(bool) for p, rows in s.groupby("period")})
    values = []
    for r in range(500):
        g, place = np.random.default_rng([0, r]), {}
        for p, rows in s.groupby("period"):
            on, flood = np.zeros(len(rows), bool), rows["flood"].to_numpy().astype(bool)
            for m in sorted(set(rows["m"])):
                ix = np.flatnonzero(rows["m"].to_numpy() == m)
                on[g.choice(ix, int(flood[ix].sum()), replace=False)] = True
            place[p] = on
        values.append(close(place))
    r = run(spark, "cluster_permutation").iloc[0]
    assert (r["observed"], r["expected"], r["p"]) == pytest.approx((seen, np.mean(values), np.mean(np.array(values) >= seen)))


def test_sector_chi2(spark):
    d = cq._sectors(spark, DATA).toPandas().sort_values(["cat", "flood", "stratum"], ignore_index=True)

    def chi(flood):
        out = 0.0
        for c in range(9):
            want = flood.sum() * (d["cat"] == c).mean()
            out += (flood[d["cat"] == c].sum() - want) ** 2 / max(want, 1e-9)
        return out

    flood, seen = d["flood"].to_numpy().astype(bool), chi(d["flood"].to_numpy().astype(bool))
    values = []
    for r in range(500):
        g, on = np.random.default_rng([0, r]), np.zeros(len(d), bool)
        for s in sorted(set(d["stratum"])):
            ix = np.flatnonzero(d["stratum"].to_numpy() == s)
            on[g.choice(ix, int(flood[ix].sum()), replace=False)] = True
        values.append(chi(on))
    got = run(spark, "sector_chi2").iloc[0]
    assert (got["chi2"], got["p"]) == pytest.approx((seen, np.mean(np.array(values) >= seen - 1e-12)))


def test_model_summary(spark):
    s = registry.QUERIES["logistic_expanding_scores"](spark, DATA).toPandas().dropna(subset=["score"])
    got = run(spark, "model_summary").set_index("model")
    for model, d in s.groupby("model"):
        y, x, r = d["y"].to_numpy(float), d["score"].to_numpy(float), got.loc[model]
        on = x >= d["threshold"].to_numpy(float)
        pairs = [(a > b) + (a == b) / 2 for a in x[y == 1] for b in x[y == 0]]
        assert (r["n_days"], r["n_flood"], r["hits"], r["misses"]) == (len(d), y.sum(), (y * on).sum(), (y * ~on).sum())
        assert r["ap"] == pytest.approx(average_precision(y, x), abs=1e-9) and r["roc"] == pytest.approx(np.mean(pairs)) and r["brier"] == pytest.approx(((x - y) ** 2).mean())
        assert r["ap_lo"] <= r["ap_hi"] and 0 <= r["perm_p"] <= 1
