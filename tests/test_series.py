import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.columns import rolling, row_mean
from tidemark.operators import evaluation as ev
from tidemark.operators import events, features, intervals
from tidemark.operators import series as op

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def days(spark, values, name="x"):
    return spark.createDataFrame([(day(k), v) for k, v in enumerate(values)], f"day date, {name} double")


def column(df, name, order="day"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_clusters_merge_gaps_of_two_days(spark):
    d = spark.createDataFrame([(day(0),), (day(2),), (day(5),)], "day date")
    got = [(r["start"], r["end"], r["n_spike_days"]) for r in op.cluster_days(d).orderBy("start").collect()]
    assert got == [(day(0), day(2), 2), (day(5), day(5), 1)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 60), min_size=1, max_size=15))
def test_cluster_count_does_not_depend_on_order(spark, picked):
    want = 1 + sum(b - a > 2 for a, b in zip(sorted(picked), sorted(picked)[1:]))
    d = spark.createDataFrame([(day(k),) for k in sorted(picked, key=lambda k: k * 7 % 61)], "day date")
    assert op.cluster_days(d).count() == want


def test_rolling_needs_enough_values(spark):
    got = column(days(spark, [1.0, None, 3.0, 4.0, 5.0]).withColumn("s", rolling(F.col("x"), "sum", -2, 0, 3)), "s")
    assert got == [None, None, None, None, 12.0]


def test_sum_of_missing_hours_is_zero_and_peak_missing(spark):
    h = spark.createDataFrame([(dt.datetime(2020, 1, 1, 3), "a", None), (dt.datetime(2020, 1, 2, 3), "a", 4.0)], "time timestamp_ntz, point string, precip_mm double")
    got = [(r["rain_daily"], r["rain_hourly"]) for r in features.rain_daily(h).orderBy("day").collect()]
    assert got == [(0.0, None), (4.0, 4.0)]


def test_distance_rule(spark):
    d = spark.createDataFrame([(None,), (300.0,), (301.0,)], "d double")
    assert [r["n"] for r in d.select(op.near_flood(F.col("d")).alias("n")).collect()] == [True, True, False]


def test_ewm_matches_pandas_with_gaps(spark):
    values = [1.0, 2.0, None, 3.0, None, None, 7.0, 1.0]
    for hl in (1, 2, 4):
        want = pd.Series(values, dtype=float).ewm(halflife=hl, min_periods=hl).mean()
        got = column(op.ewm_mean(days(spark, values), "x", hl, hl), "ewm")
        assert [None if v is None else round(v, 9) for v in got] == [None if math.isnan(v) else round(v, 9) for v in want]
    assert column(op.ewm_mean(days(spark, [1.0, 2.0, 3.0]), "x", 1, 1), "ewm")[-1] == pytest.approx(2.428571, abs=1e-6)


def test_ewm_carries_over_long_gaps(spark):
    values = [1.0, None, 5.0, *[None] * 60, 2.0, None]
    want = pd.Series(values, dtype=float).ewm(halflife=1, min_periods=1).mean()
    got = column(op.ewm_mean(days(spark, values), "x", 1, 1), "ewm")
    assert got == pytest.approx(want.tolist(), abs=1e-9)


def test_wet_spell_and_days_since(spark):
    d = days(spark, [2.0, 3.0, 0.0, None, 5.0, 25.0, 1.0, None, 1.0])
    assert column(op.spell_length(d, F.col("x") > 1), "wet_spell_len") == [1, 2, 0, None, 1, 2, 0, None, 0]
    assert column(op.days_since(d, "x", 20), "days_since") == [None, None, None, None, None, 0, 1, None, None]


def test_two_kinds_of_wet_days(spark):
    d = op.wet_day_counts(days(spark, [2.0, None, 2.0, 2.0]), "x", 2, 1.0)
    assert column(d, "wet_counted") == [None, 1.0, 1.0, 1.0]
    assert column(d, "wet_strict") == [None, None, None, None]


def test_midrank(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (None,)], "x double")
    got = [r["r"] for r in d.withColumn("r", op.midrank("x")).orderBy(F.col("x").asc_nulls_last()).collect()]
    assert got == [0.25, 0.625, 0.625, 1.0, None]


def test_peak_day_is_the_first_of_equals(spark):
    d = spark.createDataFrame([(day(1), 4), (day(2), 4)], "day date, n int")
    assert d.agg(F.max_by("day", F.struct("n", -F.unix_date("day"))).alias("p")).first()["p"] == day(1)


def test_densify_has_every_day(spark):
    d = op.densify(spark.createDataFrame([(day(0), 1), (day(9), 2)], "day date, n int"), zero=["n"])
    assert d.count() == 10 and d.agg(F.sum("n")).first()[0] == 3


def test_dedupe_keeps_the_earliest_and_is_idempotent(spark):
    d = spark.createDataFrame([("u", "20150102000000", 1), ("u", "20150101000000", 2), ("v", "20150101000000", 3)], "url string, DATE string, k int")
    once = op.first_per_key(d, ["url"], ["DATE"])
    assert sorted(r["k"] for r in once.collect()) == [2, 3]
    assert once.exceptAll(op.first_per_key(once, ["url"], ["DATE"])).count() == 0


def test_percentile_against_controls_halves_ties(spark):
    d = days(spark, [1.0] * 30 + [1.0] + [0.0] * 30)
    got = intervals.control_percentile(d, spark.createDataFrame([(day(30),)], "day date"), "x").first()
    assert got["n_controls"] == 54 and got["pct"] == pytest.approx((27 + 13.5) / 54)


def test_few_controls_give_no_percentile(spark):
    d = days(spark, [1.0] * 10)
    assert intervals.control_percentile(d, spark.createDataFrame([(day(5),)], "day date"), "x").first()["pct"] is None


def label_inputs(spark, verdict, event_date=None):
    n = 60
    news = spark.createDataFrame([(day(k), 0, 0, 0) for k in range(n)], "day date, n_loose long, n_strict long, n_strict_my long")
    rain = spark.createDataFrame([(day(k), float(k % 10), float(k % 10)) for k in range(n)], "day date, rain_daily double, rain_hourly double")
    e = spark.createDataFrame([(1, day(30), day(31), day(30))], "event_id long, start date, end date, peak_day date")
    v = spark.createDataFrame([(1, verdict, event_date)], "event_id long, verdict string, event_date date")
    return {r["day"]: (r["label_type"], r["y"]) for r in events.daily_labels(news, rain, e, v).collect()}


def test_event_outside_the_calendar_adds_a_day(spark):
    got = label_inputs(spark, "confirmed", day(500))
    assert got[day(500)] == ("flood", 1) and day(2) not in got and day(59) not in got


def test_near_days_are_not_negatives(spark):
    got = label_inputs(spark, "confirmed", day(30))
    assert got[day(30)] == ("flood", 1) and got[day(33)] == ("near_event", None)


def test_rejected_events(spark):
    assert label_inputs(spark, "reject_auto")[day(31)][0] not in ("near_event", "hard_news_negative")
    assert all(t != "near_event" for t, _ in label_inputs(spark, "reject").values())


def test_missing_verdict_is_unverified(spark):
    assert label_inputs(spark, "uncertain")[day(30)] == ("uncertain_event", None)


def test_average_precision_groups_ties(spark):
    s = spark.createDataFrame(list(zip([1, 0, 1, 0, 1, 0], [0.9, 0.8, 0.8, 0.6, 0.5, 0.4])), "y int, score double")
    assert ev.average_precision(s).first()["ap"] == pytest.approx(0.755556, abs=1e-6)
    assert ev.ap_of(np.array([1, 0, 1, 0, 1, 0.0]), np.array([0.9, 0.8, 0.8, 0.6, 0.5, 0.4])) == pytest.approx(0.755556, abs=1e-6)


def test_measures_do_not_change_under_monotone_maps(spark):
    rng = np.random.default_rng(3)
    data = [(int(y), float(x)) for y, x in zip(rng.integers(0, 2, 200), rng.integers(0, 30, 200))]
    s = spark.createDataFrame(data, "y int, score double")
    t = s.withColumn("score", F.exp(F.col("score") / 10))
    assert ev.average_precision(s).first()["ap"] == pytest.approx(ev.average_precision(t).first()["ap"])
    up, down = ev.roc_auc(s).first()["roc"], ev.roc_auc(s.withColumn("score", -F.col("score"))).first()["roc"]
    assert up == pytest.approx(1 - down)


def test_quantiles_interpolate(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8)], "x double")
    assert d.agg(F.percentile("x", [0.25, 0.5, 0.9]).alias("q")).first()["q"] == pytest.approx([1.75, 3.0, 6.8])


def test_folds_without_positives_have_no_scores(spark):
    rows = [(day(k), int(k in (50, 60)), float(k % 7)) for k in range(100)]
    f = ev.expanding_folds(spark.createDataFrame(rows, "day date, y int, f1 double"), [str(day(40)), str(day(70))])
    got = ev.logistic_scores(f, {"one": ["f1"]}).toPandas()
    assert got[got["fold"] == 0]["score"].isna().all() and got[got["fold"] == 1]["score"].notna().all()


def test_logistic_fit_is_at_its_optimum():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    x[::7, 1] = np.nan
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    m = ev.fit_logistic(x, y, 0.1)
    z = (np.where(np.isnan(x), m["middle"], x) - m["mean"]) / m["scale"]
    grad = z.T @ (ev.predict_logistic(m, x) - y) + m["w"][:-1] / 0.1
    assert np.abs(grad).max() < 1e-6
    none = ev.fit_logistic(np.c_[x, np.full(300, np.nan)], y, 0.1)
    assert ev.predict_logistic(none, np.c_[x, np.ones(300)]) == pytest.approx(ev.predict_logistic(m, x))


def test_resampling_does_not_depend_on_partitions(spark):
    s = spark.createDataFrame([(day(k), int(k % 9 == 0), float(k % 5)) for k in range(300)], "day date, y int, score double")
    a, b = ev.bootstrap_ap(s, 50), ev.bootstrap_ap(s.repartition(7), 50)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_row_mean_skips_missing(spark):
    d = spark.createDataFrame([(1.0, None), (None, None), (2.0, 4.0)], "a double, b double")
    assert [r["m"] for r in d.select(row_mean("a", "b").alias("m")).collect()] == [1.0, None, 3.0]


def test_forecast_columns_need_full_days(spark):
    rain = [(dt.datetime(2020, 1, 1 + k, h), "a", 1.0) for k in range(3) for h in range(24)]
    fc = [(dt.datetime(2020, 1, 1 + k, h), "a", 1.0, 2.0) for k in range(3) for h in range(24 if k else 5)]
    f = features.build_features(spark.createDataFrame(rain, "time timestamp_ntz, point string, precip_mm double"), spark.createDataFrame(fc, "time timestamp_ntz, point string, precip_fcst_d1 double, precip_fcst_d2 double"))
    assert column(f, "fc1_total_mean") == [None, 24.0, 24.0] and column(f, "fc2_total_mean") == [10.0, 48.0, 48.0]
