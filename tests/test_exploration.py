import numpy as np
import pandas as pd
import pytest

from hazecast.functions.aqi import with_aqi
from hazecast.operators import comoments
from hazecast.operators.quantiles import exact_quantiles
from hazecast.plans import exploration as ex
from helpers import same, series, to_spark


@pytest.fixture(scope="module")
def frame():
    """Two stations; one has no reading for days 40 to 70."""
    a, b = series(24 * 90, seed=7, gaps=0.1), series(24 * 90, seed=8, station=1)
    days = (b.timestamp - b.timestamp.min()).dt.days
    return pd.concat([a, b[(days < 40) | (days > 70)]], ignore_index=True)


@pytest.fixture(scope="module")
def table(spark, frame):
    return with_aqi(to_spark(spark, frame)).cache()


@pytest.fixture(scope="module")
def local(table):
    return table.toPandas()


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    df = pd.DataFrame({"wide": rng.lognormal(0, 4, 5000), "ties": rng.integers(0, 4, 5000) * 1.0,
                       "same": 7.0, "few": np.where(np.arange(5000) < 2, np.arange(5000) * 3.0, np.nan),
                       "huge": rng.choice([-1.7e308, -1e-300, 0.0, 2e-308, 1.7e308], 5000),
                       "steps": 2.0 ** rng.integers(-300, 300, 5000), "none": np.nan})
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(to_spark(spark, df).repartition(7), list(df), probabilities
                          ).toPandas().set_index("variable")
    assert list(got.index) == list(df) and got.loc["none", "n"] == 0 and got.loc["none"].isna().sum() == 11
    for c in list(df)[:-1]:
        assert got.loc[c, "n"] == df[c].count()
        if c != "huge":
            assert same(got.loc[c, [f"q{i}" for i in range(7)]], df[c].quantile(probabilities), 1e-12)
    assert got.loc["huge", "q3"] in (-1e-300, 0.0, 2e-308)


def test_quantiles_of_many_rows(spark):
    rows = 10_000_000
    df = spark.range(rows).selectExpr("CAST(id * 7919 % 10000000 AS DOUBLE) / 7 AS x")
    got = exact_quantiles(df, ["x"], [0.25, 0.5, 0.9]).first()
    assert same([got.q0, got.q1, got.q2], [(rows - 1) * p / 7 for p in (0.25, 0.5, 0.9)], 1e-12)


def test_describe_and_missing(table, local):
    got = ex.describe(table).toPandas().set_index("variable")
    ref = local[ex.CORE].describe().T
    for mine, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert (got.loc[ex.CORE, mine] - ref[theirs]).abs().max() <= 0.0051
    gone = ex.missing(table).toPandas().set_index("variable")
    assert same(gone.loc[ex.CORE, "missing_pct"], (local[ex.CORE].isna().mean() * 100).round(2))


def test_correlations(spark, table, local):
    got = ex.correlations(table).toPandas().pivot(index="variable", columns="other", values="r")
    assert same(got.loc[ex.CORE, ex.CORE], local[ex.CORE].corr().round(3), 1.1e-3)
    assert (np.diag(got) == 1).all() and same(got, got.T)
    odd = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (3.0, 5.0, None)],
                                "x double, still double, empty double")
    cells = {(r.variable, r.other): r.r for r in
             ex.correlations(odd, ["x", "still", "empty"]).collect()}
    assert len(cells) == 9 and cells["x", "x"] == 1.0
    assert [v for k, v in cells.items() if k != ("x", "x")] == [None] * 8


def test_correlations_take_one_pass(spark, table):
    """No row per pair before the aggregate, and few rows after it."""
    plan = ex.correlations(table)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Generate" not in below and "Expand" not in below


@pytest.mark.parametrize("parts", [1, 7, 300])
def test_co_moments_keep_digits(spark, parts):
    """An offset of 1e9, a constant, nulls in other rows of each column, an empty column."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=3000)
    df = pd.DataFrame({"a": 1e9 + x, "b": 1e9 - x + rng.normal(size=3000) * 0.1, "same": 0.1, "few": x ** 3, "none": np.nan})
    df.loc[rng.random(3000) < 0.3, "few"] = np.nan
    df.loc[rng.random(3000) < 0.2, "b"] = np.nan
    got = {(r.i, r.j): r for r in comoments.co_moments(to_spark(spark, df).repartition(parts), list(df)).collect()}
    assert len(got) == 15
    for (i, j), r in got.items():
        both = df.iloc[:, [i, j]].dropna().to_numpy() if i != j else df.iloc[:, [i, i]].dropna().to_numpy()
        assert r.n == len(both)
        if r.n:
            centred = both - both.mean(axis=0)
            assert same([r.mean_x, r.mean_y], both.mean(axis=0), 1e-12)
            assert same([r.m2_x, r.m2_y, r.c], [(centred[:, 0] ** 2).sum(), (centred[:, 1] ** 2).sum(),
                                                (centred[:, 0] * centred[:, 1]).sum()], 1e-6)
    assert got[2, 2].m2_x == 0 and got[0, 2].m2_y == 0
    cells = {(r.variable, r.other): r.r for r in ex.correlations(to_spark(spark, df).repartition(parts), list(df)).collect()}
    assert cells["a", "b"] == round(df.a.corr(df.b), 3) and cells["a", "same"] is None and cells["a", "none"] is None
    empty = spark.createDataFrame([], "x double, y double")
    assert comoments.co_moments(empty, ["x", "y"]).count() == 0


def test_histogram_counts_everything(spark, table, local):
    got = ex.histogram(table).toPandas()
    assert len(got) == 50 * len(ex.CORE)
    for c in ex.CORE:
        mine = got[got.variable == c].sort_values("bin").bin_count
        assert mine.sum() == local[c].count()
        assert np.abs(mine.values - np.histogram(local[c].dropna(), 50)[0]).sum() <= 4  # edges
    still = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert ex.histogram(still, ["x"]).filter("bin_count > 0").collect()[0]["bin"] == 1


@pytest.mark.parametrize("period, rule", [("day", "D"), ("week", "W"), ("month", "ME")])
def test_resample_keeps_empty_periods(table, local, period, rule):
    got = ex.resample_mean(table, ["aqi", "pm10"], period).toPandas()
    for station, g in got.groupby("station_id"):
        ref = local[local.station_id == station].set_index("timestamp")[["aqi", "pm10"]]
        ref = ref.resample(rule).mean()
        g = g.sort_values("period")
        assert list(pd.to_datetime(g.period)) == list(ref.index)
        assert same(g[["aqi", "pm10"]], ref)
    if period == "day":
        assert got.aqi.isna().any()


def test_categories_and_seasons(table, local):
    shares = ex.category_distribution(table).toPandas()
    assert abs(shares.share.sum() - 1) < 1e-12 and shares.hours.sum() == local.aqi.count()
    assert list(shares.hours) == sorted(shares.hours, reverse=True)
    hours = ex.seasonal_hour(table).toPandas().sort_values("hour")
    ref = local.groupby(local.timestamp.dt.hour).aqi.agg(["mean", "median", "std"])
    assert same(hours[["mean", "median", "std"]], ref)


def test_outliers(table, local):
    got = ex.outlier_summary(table).toPandas().set_index("variable")
    for c in ex.CORE:
        v = local[c].dropna()
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        out = (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))
        assert got.loc[c, "outliers"] == out.sum() and got.loc[c, "n"] == len(v)
    rows = ex.outlier_rows(table, "co")
    assert rows.count() == local.co.count()
    assert rows.filter("is_outlier").count() == got.loc["co", "outliers"]
