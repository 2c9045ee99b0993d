"""Folds, alerts and ranking measures on long score tables (group..., day, y, score)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import ship

# ---------------------------------------------------------------- measures


def curve(scores: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """(by, score, tp, n, precision, recall, positives) at each distinct score, the highest first; ties are one step."""
    step = scores.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(y).alias("_p"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    made = step.select(*by, score, "_p", "_n", F.sum("_p").over(w).alias("tp"), F.sum("_n").over(w).alias("n"), F.sum("_p").over(whole).alias("positives"), F.sum("_n").over(whole).alias("rows"))
    return made.withColumns({"precision": F.col("tp") / F.col("n"), "recall": F.try_divide(F.col("tp"), F.col("positives"))})


def average_precision(scores: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """(by, ap): step-wise area, with ties as one step; null without positives."""
    gain = F.try_divide(F.col("_p"), F.col("positives")) * F.col("precision")
    return curve(scores, by, y, score).groupBy(*by).agg(F.sum(gain).alias("ap"))


def roc_auc(scores: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """(by, roc): share of pairs in order, ties as half; null without both classes.  One pass over the curve."""
    c = curve(scores, by, y, score)
    neg = F.col("_n") - F.col("_p")
    above = F.col("tp") - F.col("_p") / 2
    return c.groupBy(*by).agg(F.try_divide(F.sum(neg * above), F.max("positives") * (F.max("rows") - F.max("positives"))).alias("roc"))


def brier(scores: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    return scores.where(F.col(score).isNotNull()).groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier"))


def contingency(scores: DataFrame, by: Sequence[str] = (), y: str = "y", alert: str = "alert") -> DataFrame:
    """(by, hits, false_alarms, misses, csi, pod, far); empty denominators count as 1."""
    pos, on = F.col(y) == 1, F.col(alert)
    made = scores.groupBy(*by).agg(F.count_if(pos & on).alias("hits"), F.count_if(~pos & on).alias("false_alarms"), F.count_if(pos & ~on).alias("misses"))
    share = lambda a, *b: F.col(a) / F.greatest(sum(map(F.col, b[1:]), F.col(b[0])), F.lit(1))
    return made.withColumns({"csi": share("hits", "hits", "false_alarms", "misses"), "pod": share("hits", "hits", "misses"), "far": share("false_alarms", "hits", "false_alarms")})


def best_threshold(scores: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score", n: int = 60, lo: float = 0.5, hi: float = 0.995) -> DataFrame:
    """(by, threshold, csi): of n quantiles of the scores the lowest with the largest CSI."""
    shares = [lo + (hi - lo) * k / (n - 1) for k in range(n)]
    cuts = scores.groupBy(*by).agg(F.array_distinct(F.percentile(score, shares)).alias("_q"))
    step = curve(scores, by, y, score)
    # rows at or above a threshold are those of the lowest score not below it: each threshold lies above one lower score
    below = F.lead(score).over(Window.partitionBy(*by).orderBy(F.desc(score)))
    step = step.select(*by, score, "tp", "n", "positives", below.alias("_below"))
    joined = step.join(cuts, list(by)) if by else step.crossJoin(F.broadcast(cuts))  # one row of n thresholds
    own = F.filter("_q", lambda t: (t <= F.col(score)) & (F.col("_below").isNull() | (t > F.col("_below"))))
    at = joined.select(*by, "tp", "n", "positives", F.explode(own).alias("threshold"))
    csi = F.col("tp") / F.greatest(F.col("n") + F.col("positives") - F.col("tp"), F.lit(1))
    best = F.max_by(F.struct("threshold", "csi"), F.struct("csi", -F.col("threshold")))
    return at.withColumn("csi", csi).groupBy(*by).agg(best.alias("_b")).select(*by, "_b.threshold", "_b.csi")


def budget_capture(scores: DataFrame, fractions: Sequence[float] = (0.05, 0.10, 0.20), by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """(by, capture_5, ...): share of positives at or above the quantile that leaves the fraction above; ties may exceed it."""
    names = {f: f"capture_{round(100 * f)}" for f in fractions}
    edges = scores.groupBy(*by).agg(*(F.percentile(score, F.lit(1 - f)).alias(f"_{n}") for f, n in names.items()))
    joined = scores.join(F.broadcast(edges), list(by)) if by else scores.crossJoin(F.broadcast(edges))  # a row for each group
    return joined.groupBy(*by).agg(*(F.try_divide(F.sum(F.when(F.col(score) >= F.col(f"_{n}"), F.col(y)).otherwise(0)), F.sum(y)).alias(n) for n in names.values()))


# ---------------------------------------------------------------- folds


def expanding_folds(data: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """(fold, part, row...): train rows lie before the fold's cutoff, test rows from it to the next; the last fold ends the data."""
    edges = [*cutoffs, None]
    parts = []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        upper = F.lit(True) if b is None else F.col("day") < F.lit(b).cast("date")
        parts.append(F.when(F.col("day") < F.lit(a).cast("date"), F.struct(F.lit(k).alias("fold"), F.lit("train").alias("part"))).when(upper, F.struct(F.lit(k).alias("fold"), F.lit("test").alias("part"))))
    return data.select("*", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("_f")).select(F.col("_f.fold").alias("fold"), F.col("_f.part").alias("part"), *data.columns)


def purged_quarters(data: DataFrame, purge: int = 7) -> DataFrame:
    """(fold, part, row...): each quarter is a test set; its train rows lie more than `purge` days from its first and last row."""
    q = F.trunc("day", "quarter")
    ends = data.groupBy(q.alias("fold")).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    crossed = data.crossJoin(F.broadcast(ends))  # a row for each quarter of a calendar
    part = F.when(q == F.col("fold"), "test").when((F.col("day") < F.date_sub("_lo", purge)) | (F.col("day") > F.date_add("_hi", purge)), "train")
    return crossed.withColumn("part", part).where("part is not null").select("fold", "part", *data.columns)


def usable_folds(folds: DataFrame, y: str = "y", least: int = 2) -> DataFrame:
    """Only folds whose train rows have `least` positives."""
    enough = folds.where("part = 'train'").groupBy("fold").agg(F.sum(y).alias("_p")).where(F.col("_p") >= least).select("fold")
    return folds.join(enough, "fold", "left_semi")


def climatology(folds: DataFrame, y: str = "y") -> DataFrame:
    """(fold, day, y, score, threshold): each test day has its month's train rate, else the train rate; the threshold
    is the upper quartile of the months' rates."""
    train = folds.where("part = 'train'")
    rate = train.groupBy("fold", F.month("day").alias("month")).agg(F.avg(y).alias("rate"))
    whole = train.groupBy("fold").agg(F.avg(y).alias("base"))
    edge = rate.groupBy("fold").agg(F.percentile("rate", F.lit(0.75)).alias("threshold"))
    test = folds.where("part = 'test'").withColumn("month", F.month("day"))
    return test.join(rate, ["fold", "month"], "left").join(whole, "fold").join(edge, "fold").select("fold", "day", F.col(y).alias("y"), F.coalesce("rate", "base").alias("score"), "threshold")


def rank_baseline(folds: DataFrame, col: str, y: str = "y") -> DataFrame:
    """(fold, day, y, score, threshold): the column itself, gaps filled by the train median, with the train set's best threshold."""
    middle = folds.where("part = 'train'").groupBy("fold").agg(F.percentile(col, F.lit(0.5)).alias("_m"))
    filled = folds.join(middle, "fold").withColumn("score", F.coalesce(F.col(col).cast("double"), "_m"))
    edge = best_threshold(filled.where("part = 'train'"), ["fold"], y).select("fold", "threshold")
    return filled.where("part = 'test'").join(edge, "fold").select("fold", "day", F.col(y).alias("y"), "score", "threshold")


# ---------------------------------------------------------------- logistic models


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 0.1) -> dict:
    """Median-filled, standardised, L2-penalised logistic regression with a free intercept, by Newton steps.

    Columns without any value in the train rows are left out; constant ones have scale 1.
    """
    used = ~np.isnan(x).all(axis=0)
    x = x[:, used]
    middle = np.nanmedian(x, axis=0) if x.shape[1] else np.zeros(0)
    z = np.where(np.isnan(x), middle, x)
    mean, scale = z.mean(axis=0), z.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.c_[(z - mean) / scale, np.ones(len(z))]
    w = np.zeros(z.shape[1])
    ridge = np.diag(np.r_[np.full(z.shape[1] - 1, 1 / c), 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-12 * np.eye(len(w)), z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return {"used": used, "middle": middle, "mean": mean, "scale": scale, "w": w}


def predict_logistic(model: dict, x: np.ndarray) -> np.ndarray:
    x = x[:, model["used"]]
    z = (np.where(np.isnan(x), model["middle"], x) - model["mean"]) / model["scale"]
    return 1 / (1 + np.exp(-(z @ model["w"][:-1] + model["w"][-1])))


def logistic_scores(folds: DataFrame, sets: dict[str, Sequence[str]], c: float = 0.1, y: str = "y", least: int = 2) -> DataFrame:
    """(model, fold, day, y, score, threshold) of every feature set and fold, in one job.

    A fold is a calendar's train and test days, so a group has a bounded number of rows.
    Folds with fewer than `least` train positives keep their rows with null scores.
    """
    ship(folds.sparkSession)
    names = folds.sparkSession.createDataFrame([(n,) for n in sets], "model string")
    columns = sorted({x for s in sets.values() for x in s})
    wanted = {n: list(s) for n, s in sets.items()}
    kind = folds.schema["fold"].dataType.simpleString()
    rows = folds.select("fold", "part", "day", F.col(y).cast("int").alias("y"), *(F.col(x).cast("double").alias(x) for x in columns)).crossJoin(F.broadcast(names))  # a row for each feature set

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        cols, train, test = wanted[key[0]], pdf[pdf["part"] == "train"], pdf[pdf["part"] == "test"]
        score, edge = np.full(len(test), np.nan), np.nan
        if train["y"].sum() >= least and train["y"].sum() < len(train) and len(test):
            model = fit_logistic(train[cols].to_numpy(float), train["y"].to_numpy(float), c)
            score = predict_logistic(model, test[cols].to_numpy(float))
            edge = threshold_of(predict_logistic(model, train[cols].to_numpy(float)), train["y"].to_numpy(bool))
        out = pd.DataFrame({"model": key[0], "fold": key[1], "day": test["day"], "y": test["y"], "score": score, "threshold": edge})
        return out.astype(object).where(out.notna(), None)

    return rows.groupBy("model", "fold").applyInPandas(fit, f"model string, fold {kind}, day date, y int, score double, threshold double")


def threshold_of(score: np.ndarray, y: np.ndarray) -> float:
    """The lowest candidate quantile with the largest CSI."""
    best, found = -1.0, np.inf
    for t in np.unique(np.quantile(score, np.linspace(0.5, 0.995, 60))):
        on = score >= t
        csi = (y & on).sum() / max((y | on).sum(), 1)
        if csi > best:
            best, found = csi, float(t)
    return found


def transfer_scores(train: DataFrame, test: DataFrame, sets: dict[str, Sequence[str]], c: float = 0.1, y: str = "y") -> DataFrame:
    """logistic_scores of one fold: all of `train` against all of `test`; sets that need forecasts are left out."""
    own = {n: s for n, s in sets.items() if not any(x.startswith("fc") for x in s)}
    one = lambda d, part: d.select("*", F.lit(0).alias("fold"), F.lit(part).alias("part"))
    return logistic_scores(one(train, "train").unionByName(one(test, "test"), allowMissingColumns=True), own, c, y)


# ---------------------------------------------------------------- resampling


def ap_of(y: np.ndarray, s: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Average precision in numpy, rows weighted by how often they were drawn."""
    w = np.ones(len(y)) if weight is None else weight
    order = np.argsort(-s, kind="stable")
    y, s, w = y[order], s[order], w[order]
    last = np.r_[s[1:] != s[:-1], True]
    tp, n = np.cumsum(w * y)[last], np.cumsum(w)[last]
    if not len(tp) or tp[-1] == 0:
        return float("nan")
    return float((np.diff(np.r_[0, tp]) * tp / np.maximum(n, 1e-300)).sum() / tp[-1])


def _seeds(spark: SparkSession, n: int, chunk: int = 100) -> DataFrame:
    return spark.range(0, n, chunk, numPartitions=max(1, min(64, n // chunk))).select(F.col("id").alias("first"), F.least(F.lit(chunk), F.lit(n) - F.col("id")).cast("int").alias("count"))


def resampled(rows: DataFrame, columns: Sequence[str], draw, n: int, seed: int = 0) -> DataFrame:
    """(rep, value) of n resamples; draw(frame, rng) gives one value.

    rows is one model's days, a bounded calendar; each chunk of replicates is a group that holds
    them once, so they pass from executor to executor.  Each replicate has its own generator, so
    results do not depend on the partitioning.  No rows give no replicates.
    """
    ship(rows.sparkSession)
    columns = list(columns)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf[columns].sort_values(columns, ignore_index=True)
        reps = range(key[0], key[0] + key[1])
        return pd.DataFrame({"rep": reps, "value": [draw(data, np.random.default_rng([seed, r])) for r in reps]})

    chunks = _seeds(rows.sparkSession, n)  # a row for each chunk of replicates
    return rows.select(*columns).crossJoin(F.broadcast(chunks)).groupBy("first", "count").applyInPandas(run, "rep long, value double").where("not isnan(value)")


def interval(values: DataFrame) -> DataFrame:
    """(lo, hi, mean, n): the 2.5 and 97.5 percentiles of the replicates."""
    return values.agg(F.percentile("value", F.lit(0.025)).alias("lo"), F.percentile("value", F.lit(0.975)).alias("hi"), F.avg("value").alias("mean"), F.count("*").alias("n"))


def _month_weights(months: pd.Series, rng: np.random.Generator) -> np.ndarray:
    codes, names = pd.factorize(months)
    return np.bincount(rng.integers(0, len(names), len(names)), minlength=len(names))[codes].astype(float)


def bootstrap_ap(scores: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """Replicates of AP when whole months (day, y, score) are drawn with replacement."""
    rows = scores.where("score is not null").select(F.trunc("day", "month").alias("month"), "y", "score")
    return resampled(rows, ["month", "y", "score"], lambda d, g: ap_of(d["y"].to_numpy(float), d["score"].to_numpy(float), _month_weights(d["month"], g)), n, seed)


def paired_bootstrap(scores: DataFrame, a: str, b: str, n: int = 2000, seed: int = 0) -> DataFrame:
    """Replicates of AP(a) - AP(b) over the same drawn months (day, y, a, b)."""
    rows = scores.select(F.trunc("day", "month").alias("month"), "y", a, b).dropna()

    def draw(d: pd.DataFrame, g: np.random.Generator) -> float:
        w = _month_weights(d["month"], g)
        return ap_of(d["y"].to_numpy(float), d[a].to_numpy(float), w) - ap_of(d["y"].to_numpy(float), d[b].to_numpy(float), w)

    return resampled(rows, ["month", "y", a, b], draw, n, seed)


def permutation_p(scores: DataFrame, n: int = 2000, seed: int = 0) -> DataFrame:
    """(p): share of shuffles of y whose AP is at least the observed one."""
    rows = scores.where("score is not null").select("y", "score")
    observed = average_precision(rows).select("ap")
    values = resampled(rows, ["y", "score"], lambda d, g: ap_of(g.permutation(d["y"].to_numpy(float)), d["score"].to_numpy(float)), n, seed)
    return values.crossJoin(F.broadcast(observed)).agg(F.avg((F.col("value") >= F.col("ap") - 1e-12).cast("double")).alias("p"))  # one row


def bootstrap_mean(values: DataFrame, col: str, n: int = 2000, seed: int = 0) -> DataFrame:
    """Replicates of the mean of the rows with a value."""
    return resampled(values.where(F.col(col).isNotNull()), [col], lambda d, g: float(g.choice(d[col].to_numpy(float), len(d)).mean()), n, seed)


def _near_share(days: np.ndarray, w: int) -> float:
    days = np.sort(days)
    if len(days) < 2:
        return 0.0
    gap = np.diff(days)
    return float((np.minimum(np.r_[np.inf, gap], np.r_[gap, np.inf]) <= w).sum())


def clustering_permutation(days: DataFrame, w: int, n: int = 5000, by_month: bool = False, seed: int = 0) -> DataFrame:
    """(observed, expected, p): events with a neighbour within w days, against events placed at random in their period,
    or in their calendar month of it.  days: period, day, flood over whole calendars."""
    rows = days.select("period", F.unix_date("day").alias("d"), F.month("day").alias("m"), "flood")

    def count(d: pd.DataFrame, g: np.random.Generator | None) -> float:
        total = 0.0
        for _, p in d.groupby("period"):
            flood = p["flood"].to_numpy().astype(bool)
            if g is not None:
                place = np.zeros(len(p), dtype=bool)
                groups = [np.arange(len(p))] if not by_month else [np.flatnonzero(p["m"].to_numpy() == k) for k in sorted(set(p["m"]))]
                for ix in groups:
                    place[g.choice(ix, int(flood[ix].sum()), replace=False)] = True
                flood = place
            total += _near_share(p["d"].to_numpy()[flood], w)
        return total

    columns = ["period", "d", "m", "flood"]
    observed = resampled(rows, columns, lambda d, g: count(d, None), 1).select(F.col("value").alias("observed"))
    values = resampled(rows, columns, count, n, seed).crossJoin(F.broadcast(observed))  # one row
    return values.groupBy("observed").agg(F.avg("value").alias("expected"), F.avg((F.col("value") >= F.col("observed")).cast("double")).alias("p"))


def category_counts(days: DataFrame, categories: int = 9) -> DataFrame:
    """(cat, days, floods, expected, floods_per_100d): every category from 0 on, zero if unseen."""
    spark = days.sparkSession
    seen = days.groupBy("cat").agg(F.count("*").alias("days"), F.sum("flood").alias("floods"))
    full = spark.range(categories).select(F.col("id").cast("int").alias("cat")).join(seen, "cat", "left").fillna(0)
    w = Window.partitionBy()
    return full.withColumns({"expected": F.sum("floods").over(w) * F.col("days") / F.sum("days").over(w), "floods_per_100d": 100 * F.col("floods") / F.greatest("days", F.lit(1))})


def chi_square(counts: DataFrame) -> Column:
    return F.sum(F.pow(F.col("floods") - F.col("expected"), 2) / F.greatest("expected", F.lit(1e-9)))


def sector_permutation(days: DataFrame, categories: int = 9, n: int = 5000, seed: int = 0) -> DataFrame:
    """(chi2, p): floods shuffled within strata (days: cat, flood, stratum)."""
    rows = days.select("cat", "flood", "stratum")

    def chi(d: pd.DataFrame, flood: np.ndarray) -> float:
        cat = d["cat"].to_numpy()
        share = np.bincount(cat, minlength=categories) / len(d)
        expected = flood.sum() * share
        return float(((np.bincount(cat[flood], minlength=categories) - expected) ** 2 / np.maximum(expected, 1e-9)).sum())

    def draw(d: pd.DataFrame, g: np.random.Generator) -> float:
        flood, out = d["flood"].to_numpy().astype(bool), np.zeros(len(d), dtype=bool)
        strata = d["stratum"].to_numpy()
        for s in sorted(set(strata)):
            ix = np.flatnonzero(strata == s)
            out[g.choice(ix, int(flood[ix].sum()), replace=False)] = True
        return chi(d, out)

    columns = ["cat", "flood", "stratum"]
    observed = resampled(rows, columns, lambda d, g: chi(d, d["flood"].to_numpy().astype(bool)), 1).select(F.col("value").alias("chi2"))
    return resampled(rows, columns, draw, n, seed).crossJoin(F.broadcast(observed)).groupBy("chi2").agg(F.avg((F.col("value") >= F.col("chi2") - 1e-12).cast("double")).alias("p"))  # one row
