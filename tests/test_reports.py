import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import features, reports, tables
from tidemark.operators import series as op

POINTS = {"a": (3.0, 101.5), "b": (3.5, 101.5), "c": (3.0, 102.0), "d": (3.5, 102.0), "e": (3.2, 101.7)}


def panels(spark, start=dt.datetime(2021, 3, 30), days=4):
    rng = np.random.default_rng(0)
    times = [start + dt.timedelta(hours=h) for h in range(24 * days)]
    era = pd.DataFrame([(t, p, *rng.uniform(1, 30, 9), *rng.uniform(1, 300, 2)) for t in times for p in POINTS], columns=["time", "point", *reports.ERA5, "wind_speed_10m", "wind_direction_10m"])
    era["surface_pressure"] += 990
    nwp = pd.DataFrame([(t, p, *rng.uniform(1, 30, 5), *rng.uniform(1, 300, 2)) for t in times for p in POINTS], columns=["time", "point", *reports.NWP, "wind_speed_850hPa", "wind_direction_850hPa"])
    as_ntz = lambda d: spark.createDataFrame(d).withColumn("time", F.col("time").cast("timestamp_ntz"))
    return era, nwp, as_ntz(era), as_ntz(nwp)


def test_state_features_match_pandas(spark):
    era, nwp, e, n = panels(spark)
    got = reports.state_features(e, n).toPandas().sort_values("day").reset_index(drop=True)
    a = era.groupby("time").mean(numeric_only=True)
    day = a.index.normalize()
    water = a["total_column_integrated_water_vapour"]
    assert np.allclose(got["tcwv_d1_max"][1:], water.groupby(day).max()[:-1]) and np.isnan(got["tcwv_d1_max"][0])
    assert np.allclose(got["sw_d1_sum"][1:], a["shortwave_radiation"].groupby(day).sum()[:-1])
    assert np.allclose(got["tcwv_00"], water[a.index.hour == 0])
    u = -era["wind_speed_10m"] * np.sin(np.deg2rad(era["wind_direction_10m"]))
    assert np.allclose(got["u10_d1"][1:], u.groupby(era["time"]).mean().groupby(day).mean()[:-1])
    early = got["day"] < dt.date(2021, 4, 1)
    assert got.loc[early, "cape_d1_max"].isna().all() and got.loc[~early, "cape_d1_max"].notna().all()


def test_moisture_features(spark):
    era, _, e, n = panels(spark)
    got = reports.moisture_features(e, n, POINTS).toPandas().sort_values("day").reset_index(drop=True)
    water = era.groupby("time")["total_column_integrated_water_vapour"].mean()
    want = water[water.index.hour == 0].to_numpy()[1:] - water[water.index.hour == 18].to_numpy()[:-1]
    assert np.allclose(got["tcwv_chg6_00"][1:].astype(float), want)
    hi = (water > water.quantile(0.75)).groupby(water.index.normalize()).sum()
    assert got["tcwv_hi_hours_d1"][1:].astype(int).tolist() == hi[:-1].tolist()
    assert got["mfc_d1_min"][1:].notna().all() and (got["mfc_d1_min"][1:] >= got["mfc_d1_mean"][1:]).all()


def test_hours_level_with_the_edge_are_not_above_it(spark):
    level = [0.3, 0.1 + 0.2, 0.3, 0.1 + 0.2]  # equal but for the order of sums
    assert level[0] < level[1]
    values = [0.05] * 6 + level * 3 + [0.1 + 0.2] * 2 + [0.4] * 4
    rows = [(dt.datetime(2021, 1, 1, k), v) for k, v in enumerate(values)]
    d = spark.createDataFrame(rows, "time timestamp_ntz, v double")
    assert [tuple(r)[1:] for r in features.hours_above(d, "v").collect()] == [(4, 0.0)]
    below = spark.createDataFrame([(t, -v) for t, v in rows], "time timestamp_ntz, v double")
    assert [tuple(r)[1:] for r in features.hours_above(below, "v", 0.5).collect()] == [(6, 0.0)]


def scores(spark):
    rows = [("m", dt.date(2020, 1, 1) + dt.timedelta(days=k), int(k % 11 == 0), float((k * 7) % 13), k % 3 == 0) for k in range(400)]
    return spark.createDataFrame(rows, "model string, day date, y int, score double, alert boolean")


def test_summary_agrees_with_its_parts(spark):
    s = scores(spark)
    r = reports.summary(s, ["m"], 300, 300).first()
    d = s.toPandas()
    assert r["ap"] == pytest.approx(ev.ap_of(d["y"].to_numpy(float), d["score"].to_numpy(float)))
    assert r["ap_lo"] <= r["ap"] * 1.3 and r["ap_hi"] >= r["ap"] * 0.7 and 0 <= r["perm_p"] <= 1
    assert (r["n_days"], r["n_flood"]) == (400, 37) and r["hits"] + r["misses"] == 37
    assert reports.summary(s, [], 10, 10).first()["perm_p"] is not None


def test_folded_z_scores_use_train_rows_only(spark):
    rows = [(dt.date(2018, 1, 1) + dt.timedelta(days=k), int(k % 17 == 0), float(np.sin(k / 58.1) + (k % 17 == 0))) for k in range(900)]
    folds = ev.purged_quarters(spark.createDataFrame(rows, "day date, y int, x double"))
    got = reports.folded_z_scores(folds, ["x"], {"z": ["z_x"]}).toPandas()
    assert len(got) == 900 and got["score"].notna().all()
    assert got[got["y"] == 1]["score"].mean() > got[got["y"] == 0]["score"].mean() + 0.2


def test_feature_sets(spark):
    rows = [(dt.date(2018, 1, 1) + dt.timedelta(days=k), int(k % 9 == 0), float(k % 9), None if k % 5 == 0 else float(k % 4), "p") for k in range(400)]
    d = spark.createDataFrame(rows, "day date, y int, a double, b double, period string")
    got = reports.evaluate_sets(d, {"both": ["a", "b"], "one": "b", "mean": "composite"}, ["a", "b"])
    assert {r["model"]: r["count"] for r in got.groupBy("model").count().collect()} == {"both": 400, "one": 400, "mean": 400}
    assert got.where("score is null").count() == 0


def test_label_schemes(spark):
    f = spark.createDataFrame([(dt.date(2020, 1, k),) for k in range(1, 5)], "day date")
    labels = spark.createDataFrame([(dt.date(2020, 1, k), t) for k, t in zip(range(1, 5), ("flood", "near_event", "easy_negative", "unlabeled"))], "day date, label_type string")
    n = lambda s: sorted(r["y"] for r in tables.label_scheme(f, labels, s, ["near_event"], ["easy_negative"]).collect())
    assert n("all") == [0, 0, 1] and n("labeled") == [0, 1]
    with pytest.raises(ValueError):
        tables.label_scheme(f, labels, "other", [], [])


def test_memo_makes_each_key_once(spark, tmp_path):
    path = str(tmp_path / "memo")
    a = reports.memoised(spark, path, spark.createDataFrame([(1.0, 1), (2.0, 2)], "mm double, event_id int"), "event_id")
    b = reports.memoised(spark, path, spark.createDataFrame([(9.0, 2), (3.0, 3)], "mm double, event_id int"), "event_id")
    assert a.count() == 3 or b.count() == 3
    assert sorted(r["mm"] for r in spark.read.parquet(path).collect()) == [1.0, 2.0, 3.0]


def test_precursors_skip_sparse_columns(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=k), float(k % 7), None) for k in range(300)]
    v = spark.createDataFrame(rows, "day date, a double, b double")
    floods = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=20 * k),) for k in range(1, 14)], "day date")
    got = reports.precursors(v, floods, ["a", "b"], least_events=5).collect()
    assert [r["series"] for r in got] == ["a"]


def test_past_only_alerts(spark):
    d = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=k), float(k)) for k in range(95)], "day date, x double")
    got = op.past_quantile_rank(d, "x", 0.9, least=90).orderBy("day").collect()
    assert got[89]["past_alert"] is None and got[90]["past_alert"] is True
