import datetime as dt
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hazecast.operators import normal_equations
from hazecast.plans import forecasting, training
from helpers import same, to_spark


@pytest.fixture(scope="module")
def frame():
    """Two stations; the label depends on a, b and their product."""
    rng = np.random.default_rng(3)
    n = 300
    parts = []
    for station in (0, 1):
        df = pd.DataFrame({"station_id": station,
                           "timestamp": pd.date_range("2024-01-01", periods=n, freq="h")})
        df["aqi"], df["a"], df["b"] = rng.normal(80, 20, n), rng.normal(0, 1000, n), rng.normal(5, 1, n)
        df["ab"], df["still"] = df.a * df.b, 3.0
        df["aqi_target_24h"] = 0.5 * df.aqi + 0.01 * df.a + 2 * df.b + rng.normal(0, 1, n)
        df.loc[n - 24:, "aqi_target_24h"] = np.nan
        parts.append(df)
    df = pd.concat(parts, ignore_index=True)
    df.loc[5:9, "a"] = np.nan
    df["aqi_target_48h"] = np.nan
    df["aqi_target_72h"] = df.aqi_target_24h * 2
    return df


@pytest.fixture(scope="module")
def table(spark, frame):
    return to_spark(spark, frame).cache()


def few(make, **settings):
    return lambda train: make(train, **settings)


CANDIDATES = {"boosted_trees": few(training.boosted_trees, rounds=2, depth=2),
              "random_forest": few(training.random_forest, trees=3, depth=3),
              "ridge_regression": training.ridge}


@pytest.fixture(scope="module")
def run(table):
    def failing(train):
        raise RuntimeError("no such estimator")
    return training.train(table, candidates={**CANDIDATES, "broken": failing})


def test_split_is_chronological(table):
    rows = training.training_rows(table, "aqi_target_24h")
    split = training.with_split(rows).groupBy("station_id").agg(
        F.count_if("is_train").alias("n"), F.max(F.when(F.col("is_train"), F.col("timestamp"))).alias("a"),
        F.min(F.when(~F.col("is_train"), F.col("timestamp"))).alias("b")).collect()
    assert len(split) == 2
    for r in split:
        assert r.n == int(276 * 0.8) and r.a < r.b


def test_too_few_rows(table):
    with pytest.raises(ValueError):
        training.prepare(table, "aqi_target_48h", ["aqi"])
    with pytest.raises(RuntimeError, match="are needed"):
        training.train(table, ["aqi_target_48h"])


def test_ridge_meets_the_normal_equations(table, frame):
    model, scored = training.fit_one(table, "aqi_target_24h", training.ridge)
    names = ["aqi", "a", "b", "ab", "still"]
    known = frame.dropna(subset=["aqi_target_24h"]).fillna({"a": 0.0, "ab": 0.0})
    learn = known.groupby("station_id").head(int(276 * 0.8))
    check = known.drop(learn.index)
    x, y = learn[names].values, learn.aqi_target_24h.values
    centred = x - x.mean(0)
    w = np.linalg.solve(centred.T @ centred + np.eye(5), centred.T @ (y - y.mean()))
    weights = dict(training.importances(model))
    assert same([weights[n] for n in names], np.abs(w), 1e-9)
    want = (check[names].values - x.mean(0)) @ w + y.mean()
    got = scored.orderBy("station_id", "timestamp").toPandas().prediction
    assert same(got, want, 1e-9)


def test_splits_of_all_targets_equal_each_alone(table):
    targets = ["aqi_target_24h", "aqi_target_72h"]
    odd = table.withColumn("aqi_target_72h", F.when(F.hour("timestamp") % 3 != 0, F.col("aqi_target_72h")))
    together = training.with_splits(odd, targets)
    assert set(together.columns) == set(odd.columns) | {f"is_train_{t}" for t in targets}
    for t in targets:
        key = ["station_id", "timestamp"]
        alone = training.with_split(training.training_rows(odd, t)).select(*key, "is_train")
        mine = together.filter(F.col(f"is_train_{t}").isNotNull()).select(*key, f"is_train_{t}")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, alone.collect()))


def test_ridge_of_all_targets_is_one_pass_and_equals_each_alone(spark, table, frame):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(1e6, 1, 500), rng.normal(0, 50, 500), np.full(500, 7.0)])
    y = x[:, :2] @ [3.0, -2.0] + rng.normal(0, 1, 500)
    rows = [(Vectors.dense(a), float(b), float(-2 * b), float(i), bool(i % 3), bool(i % 2) if i % 7 else None, False)
            for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["features", "a", "b", "c", "fa", "fb", "fc"])
    labels = [("a", "fa"), ("b", "fb"), ("c", "fc")]
    for parts in (1, 5):
        first, second, none = normal_equations.ridges(df.repartition(parts), labels)
        assert isinstance(none, ValueError)
        for model, z, flag in ((first, y, [r[4] for r in rows]), (second, -2 * y, [bool(r[5]) for r in rows])):
            u, v = x[flag], z[flag]
            centred = (u - u.mean(0))[:, :2]
            w = np.linalg.solve(centred.T @ centred + np.eye(2), centred.T @ (v - v.mean()))
            assert same(model.values(), [*w, 0.0], 1e-8)
            # the gradient of the penalised squares vanishes
            rest = (v - v.mean()) - centred @ model.values()[:2]
            assert np.abs(centred.T @ rest - model.values()[:2]).max() < 1e-5 * np.abs(centred.T @ (v - v.mean())).max()
    empty = normal_equations.ridges(df.limit(0), labels)
    assert all(isinstance(m, ValueError) for m in empty)


def test_metrics(spark, run):
    rows = [(1.0, 2.0), (3.0, 3.0), (6.0, 4.0), (None, 1.0)]
    m = training.regression_metrics(spark.createDataFrame(rows, "label double, prediction double")).first()
    assert same([m.rmse, m.mae, m.r2, m.n], [np.sqrt(5 / 3), 1.0, 1 - 5 / (38 / 3), 3])
    still = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "label double, prediction double")
    assert training.regression_metrics(still).first().r2 is None


def test_selection(spark, run):
    best = {r.target: r.model for r in training.select_models(run.metrics).collect()}
    assert best == {"aqi_target_24h": "ridge_regression", "aqi_target_72h": "ridge_regression"}
    assert ("aqi_target_24h", "broken") in run.failures and ("aqi_target_48h", "data") in run.failures
    tie = spark.createDataFrame([("t", 1, "b", 2.0), ("t", 0, "a", 2.0), ("t", 2, "c", 3.0)],
                                "target string, candidate int, model string, rmse double")
    assert training.select_models(tie).first().model == "a"
    top = training.top_features(run.importance, 2).filter("target = 'aqi_target_24h'").orderBy("place")
    assert [r.feature for r in top.collect()] == ["b", "aqi"]


def test_save_load_and_forecast(spark, run, table, frame, tmp_path):
    path = str(tmp_path / "models")
    training.save(run, path)
    training.save(run, path)
    models, names, metrics = training.load(spark, path)
    assert metrics.count() == 2 and spark.read.parquet(f"{path}/model_metrics").count() == 4
    assert {r.horizon for r in training.report(metrics).collect()} == {"24H", "72H"}
    # a later run without the 72-hour target leaves that target's earlier model in place
    less = training.Trained({"aqi_target_24h": run.models["aqi_target_24h"]}, run.feature_names,
                            run.metrics.filter("target = 'aqi_target_24h'"),
                            run.importance.filter("target = 'aqi_target_24h'"), {})
    third = training.save(less, path)
    models, names, metrics = training.load(spark, path)
    runs = {r.target: r.run for r in metrics.collect()}
    assert set(models) == {"aqi_target_24h", "aqi_target_72h"} and runs["aqi_target_24h"] == third != runs["aqi_target_72h"]
    assert training.newest_importance(spark, path).count() == run.importance.count()
    got = forecasting.forecast(table.drop("b"), models, names).collect()
    assert [r.timestamp for r in got] == [frame.timestamp.max()] * 2
    same_run = {r.station_id: r for r in forecasting.forecast(
        table.drop("b"), run.models, {t: run.feature_names for t in run.models}).collect()}
    for r in got:
        assert r.aqi_target_24h == same_run[r.station_id].aqi_target_24h >= 0


def test_models_fall_back_to_the_next_folder(spark, run, tmp_path):
    missing, hollow, unlisted, good = (str(tmp_path / n) for n in ("missing", "hollow", "unlisted", "good"))
    broken = training.save(run, hollow)
    shutil.rmtree(f"{hollow}/runs/{broken}/aqi_target_72h")
    run.metrics.limit(0).withColumn("run", F.lit("")).write.parquet(f"{unlisted}/model_metrics")
    training.save(run, good)
    path, models, names, metrics = training.load_first(spark, [missing, hollow, unlisted, good])
    assert path == good and set(models) == {"aqi_target_24h", "aqi_target_72h"}
    assert metrics.count() == 2 and names["aqi_target_24h"] == run.feature_names
    assert training.load_first(spark, [good, missing])[0] == good
    with pytest.raises(RuntimeError, match="missing.*unlisted"):
        training.load_first(spark, [missing, hollow, unlisted])


def test_forecast_points_and_alerts(spark):
    t = dt.datetime(2024, 1, 5)
    forecasts = spark.createDataFrame(
        [(0, t, 100.4, None, 250.9), (1, t, 150.0, 150.5, -1.0)],
        "station_id int, timestamp timestamp, aqi_target_24h double, aqi_target_48h double, "
        "aqi_target_72h double")
    past = spark.createDataFrame(
        [(0, t, None), (0, t - dt.timedelta(hours=1), 90.0), (1, t, None)],
        "station_id int, timestamp timestamp, aqi double")
    points = {(r.station_id, r.horizon): (r["at"], r.value)
              for r in forecasting.forecast_series(forecasts, past).collect()}
    assert len(points) == 7 and points[0, 0] == (t, 90.0) and points[1, 0] == (t, 0.0)
    assert points[0, 72] == (t + dt.timedelta(hours=72), 250.9)
    warned = sorted(tuple(r) for r in forecasting.alerts(forecasts).collect())
    assert warned == [(0, "Day 3", 250, "Very Unhealthy"),
                      (1, "Day 2", 150, "Unhealthy for Sensitive Groups")]
    strict = forecasting.alerts(forecasts, strict=True).filter("station_id = 1").first()
    assert strict.category == "Hazardous"
    cards = {(r.station_id, r.horizon): (r.value, r.category)
             for r in forecasting.forecast_cards(forecasts).collect()}
    assert cards[0, 48] == (None, "No Model Loaded") and cards[0, 24] == (100, "Moderate")
    assert spark.range(1).select(forecasting.clamp(F.lit(-3.0))).first()[0] == 0.0


def test_split_by_time_deals_out_no_rows(spark, frame):
    """The splits are those of dealt rows; of the wide rows none is shuffled."""
    targets = ["aqi_target_24h", "aqi_target_72h"]
    df = frame.assign(aqi_target_72h=frame.aqi_target_72h.where(np.arange(len(frame)) % 7 > 0))
    df.loc[3, "timestamp"] = pd.NaT
    rows = to_spark(spark, df)
    got, want = training.split_by_time(rows, targets), training.with_splits(rows, targets)
    flags = ["station_id", "timestamp", *[f"is_train_{t}" for t in targets]]
    assert got.count() == want.count() == len(df) - 1
    assert got.select(flags).exceptAll(want.select(flags)).isEmpty()
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_targets_and_candidates_share_bins(table, monkeypatch):
    """Cut points and binned rows are made once a run, not once per target and candidate."""
    made, own = [], training.LabelBins

    def counted(*given):
        made.append(own(*given))
        return made[-1]

    monkeypatch.setattr(training, "LabelBins", counted)
    trees = {name: CANDIDATES[name] for name in ("boosted_trees", "random_forest")}
    got = training.train(table, ["aqi_target_24h", "aqi_target_72h"], trees)
    assert len(made) == 1 and not got.failures and len(got.metrics.collect()) == 4
    assert not made[0].table.is_cached
