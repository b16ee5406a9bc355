import numpy as np
import pandas as pd
import pytest

from hazecast.fixed_values import EWMA_SPANS, HORIZONS, LAG_STEPS, ROLLING_WINDOWS, WINDOWED
from hazecast.functions.aqi import with_aqi
from hazecast.operators import layout, windows
from hazecast.plans.features import ALL_GROUPS, build_features, column_order, feature_columns
from helpers import same, series, to_spark


@pytest.fixture(scope="module")
def long_series():
    """Over four blocks, with gaps, null runs longer than a block, late starts."""
    df = pd.concat([series(2600, seed=3, gaps=0.05), series(900, seed=4, station=1, gaps=0.3),
                    series(5, seed=5, station=2)], ignore_index=True)
    df.loc[600:1900, "pm2_5"] = np.nan      # nothing known for more than two blocks
    df.loc[700, "pm2_5"] = 33.0             # but for a single value
    df.loc[:400, "pm10"] = np.nan           # a late start
    df.loc[df.station_id == 2, "pm10"] = np.nan
    return df


def expected(g: pd.DataFrame) -> dict:
    out = {}
    for c in WINDOWED:
        for n in ROLLING_WINDOWS:
            roll = g[c].rolling(n, min_periods=1)
            out[f"{c}_rolling_mean_{n}h"] = roll.mean()
            out[f"{c}_rolling_std_{n}h"] = roll.std().fillna(0)
            out[f"{c}_rolling_min_{n}h"] = roll.min()
            out[f"{c}_rolling_max_{n}h"] = roll.max()
            out[f"{c}_range_{n}h"] = roll.max() - roll.min()
        for s in EWMA_SPANS:
            out[f"{c}_ewma_{s}h"] = g[c].ewm(span=s, min_periods=1).mean()
        for n in LAG_STEPS:
            out[f"{c}_lag_{n}h"] = g[c].shift(n)
    for n in (3, 6, 12):
        out[f"aqi_change_rate_{n}h"] = (g.aqi - g.aqi.shift(n)) / n
    for n in HORIZONS:
        out[f"aqi_target_{n}h"] = g.aqi.shift(-n)
    return out


def test_blocks_equal_one_series_in_pandas(spark, long_series):
    features = build_features(to_spark(spark, long_series), block_rows=512)
    assert features.columns == column_order() and len(feature_columns(features)) == 104
    got = features.toPandas().sort_values(["station_id", "timestamp"])
    assert len(got) == len(long_series)
    for _, g in got.groupby("station_id"):
        g = g.reset_index(drop=True)
        for name, values in expected(g).items():
            assert same(g[name], values, 1e-7), name


def test_hours_on_the_clock(spark, long_series):
    df = long_series[long_series.station_id < 2]
    made = windows.with_window_features(
        with_aqi(to_spark(spark, df)), ALL_GROUPS, frame="time", block_rows=512)
    got = made.toPandas().sort_values(["station_id", "timestamp"])
    for _, g in got.groupby("station_id"):
        # on a full grid of hours, frames of rows are frames of hours
        grid = g.set_index("timestamp").reindex(
            pd.date_range(g.timestamp.min(), g.timestamp.max(), freq="h"))
        for name, values in expected(grid).items():
            assert same(g[name], values.reindex(g.timestamp), 1e-7), name


def test_properties(spark, long_series):
    made = windows.with_window_features(
        with_aqi(to_spark(spark, long_series)), ["rolling_mean", "rolling_minmax"], block_rows=512)
    for c in WINDOWED:
        for n in ROLLING_WINDOWS:
            mean, low, high = (f"{c}_rolling_{x}_{n}h" for x in ("mean", "min", "max"))
            wrong = made.filter(f"{mean} < {low} - 1e-9 OR {mean} > {high} + 1e-9 "
                                f"OR {c}_range_{n}h < 0")
            assert wrong.isEmpty()


def test_positions_count_rows(spark, long_series):
    got = layout.positions(to_spark(spark, long_series), cut_hours=64).toPandas()
    for _, g in got.groupby("station_id"):
        g = g.sort_values("timestamp")
        assert g.pos.tolist() == list(range(len(g)))
        assert set(g.series_rows) == {len(g)}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_of_the_windows(spark, long_series):
    base = with_aqi(to_spark(spark, long_series))
    groups = [g for g in ALL_GROUPS if g != "ewma"]
    plan = plan_of(windows.with_window_features(base, groups))
    # row numbers, offsets, and all features of all groups in one more node
    assert plan.count("+- Window ") + plan.count(":- Window ") == 3
    whole = plan_of(build_features(to_spark(spark, long_series)))
    for text in ("SinglePartition", "Python", "Cartesian", "NestedLoop"):
        assert text not in whole.replace("from: Python", "")


def test_shuffles_of_the_whole_build(spark, long_series):
    """The wide rows are shuffled twice; everything else shuffled is narrow."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(build_features(to_spark(spark, long_series)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange " in line]
    # rows by cut and by block; cut sizes by cut, station, cut (twice); pruned
    # rows by cut; block states by block, station, block
    assert len(exchanges) <= 12
    join = next(i for i, line in enumerate(plan.splitlines()) if "Join" in line)
    left = plan.splitlines()[join + 1:join + 5]
    assert any("Window" in line for line in left) and not any("Exchange" in line for line in left)


def test_limits(spark, long_series):
    base = with_aqi(to_spark(spark, long_series))
    with pytest.raises(ValueError):
        windows.with_window_features(base, ["lags"], frame="weeks")
    with pytest.raises(ValueError):
        windows.with_window_features(base, ["ewma"], block_rows=100)


def test_no_copies_go_outside_the_series(spark, long_series):
    """A short series is one block: frames that reach beyond its ends cost no rows."""
    short = to_spark(spark, long_series[long_series.station_id > 0])
    placed = layout.positions(short)
    copies = layout.blocks_with_halo(placed, 1024, windows.HALO_BACK, windows.HALO_AHEAD, from_zero=True)
    assert copies.count() == placed.count() and not copies.filter("NOT own").count()


def test_no_window_function_is_written_twice(spark, long_series):
    plan = plan_of(windows.with_window_features(with_aqi(to_spark(spark, long_series)), ["rolling_minmax"]))
    node = next(line for line in plan.splitlines() if "Window [" in line and "min(pm2_5" in line)
    assert node.count("max(pm2_5") == len(ROLLING_WINDOWS)


def test_known_positions_are_not_counted_again(spark, long_series):
    base = with_aqi(to_spark(spark, long_series))
    known = layout.positions(base).drop("series_rows")
    made = [windows.with_window_features(df, ["lags", "ewma"], block_rows=512, numbered=again)
            for df, again in ((base, False), (known, True))]
    assert made[0].columns == made[1].columns
    assert made[0].exceptAll(made[1]).isEmpty() and made[1].exceptAll(made[0]).isEmpty()
    # the one numbering is that of the rows brought
    assert plan_of(made[1]).count("row_number()") == plan_of(made[0]).count("row_number()")
