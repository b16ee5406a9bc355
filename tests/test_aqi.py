import math

import pytest
from pyspark.sql import functions as F

from hazecast.fixed_values import BREAKPOINTS, POLLUTANT_NAMES, POLLUTANTS
from hazecast.functions import aqi
from hazecast.functions.cleaning import normalize_nan


def by_hand(pollutant, value):
    """The index rule in plain Python: truncate, interpolate, round half-even."""
    if value is None or math.isnan(value) or math.isinf(value) or value < 0:
        return None
    c = int(value * 10) / 10.0 if pollutant == "pm2_5" else int(value)
    for c_low, c_high, i_low, i_high in BREAKPOINTS[pollutant]:
        if c_low <= c <= c_high:
            return float(round((i_high - i_low) / (c_high - c_low) * (c - c_low) + i_low))
    return 500.0


@pytest.mark.parametrize("pollutant", POLLUTANTS)
def test_band_edges(spark, pollutant):
    values = [None, float("nan"), float("inf"), -float("inf"), -0.01, -5.0, 0.0, 0.05, 1e6]
    for c_low, c_high, _, _ in BREAKPOINTS[pollutant]:
        values += [float(c_low), float(c_high), c_high + 0.05, c_high + 0.5, (c_low + c_high) / 2]
    # every tenth (or whole) step of two bands, which holds the exact .5 ties
    step = 0.1 if pollutant == "pm2_5" else 1.0
    values += [round(i * step, 1) for i in range(600)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {pollutant} double")
    got = dict(normalize_nan(df).select("i", aqi.sub_index(pollutant)).collect())
    assert [got[i] for i in range(len(values))] == [by_hand(pollutant, v) for v in values]


def test_half_even_ties_occur(spark):
    exact = [v for v in range(600) for p in ["no2"] for lo, hi, a, b in BREAKPOINTS[p]
             if lo <= v <= hi and ((b - a) / (hi - lo) * (v - lo) + a) % 1 == 0.5]
    assert exact
    df = spark.createDataFrame([(float(v),) for v in exact], "no2 double")
    assert [r[0] for r in df.select(aqi.sub_index("no2")).collect()] == [
        by_hand("no2", v) for v in exact]


def test_overall_dominant_and_long(spark):
    rows = [(0, 10.0, None, 150.0, None, None, 100.0), (1, None, None, None, None, None, None),
            (2, 12.0, 54.0, None, None, None, None), (3, -1.0, -1.0, None, None, 5.0, None)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{p} double" for p in POLLUTANTS))
    both = aqi.with_sub_indices(aqi.with_aqi(df))
    got = {r.i: (r.aqi, r.d) for r in both.select("i", "aqi", aqi.dominant().alias("d")).collect()}
    for r in rows:
        subs = {p: by_hand(p, v) for p, v in zip(POLLUTANTS, r[1:])}
        valid = {p: s for p, s in subs.items() if s is not None}
        top = max(valid, key=valid.get) if valid else None
        assert got[r[0]] == (valid[top], POLLUTANT_NAMES[top]) if top else (None, None)
    long = aqi.sub_indices_long(df, ["i"])
    assert long.count() == 24
    assert long.filter("i = 1 AND sub_index IS NULL").count() == 6


def test_category_gaps(spark):
    values = [0.0, 50.0, 50.5, 51.0, 100.4, 150.9, 300.5, 500.0, 501.0, -1.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(
        aqi.category(F.col("v")), aqi.category(F.col("v"), strict=True)).collect()]
    bad = "Hazardous"
    assert got == [
        ("Good", "Good"), ("Good", "Good"), ("Good", bad), ("Moderate", "Moderate"),
        ("Moderate", bad), ("Unhealthy for Sensitive Groups", bad), ("Very Unhealthy", bad),
        (bad, bad), (bad, bad), (None, bad), (None, None)]


def test_missing_columns_are_left_out(spark):
    df = spark.createDataFrame([(40.0,)], "pm10 double")
    assert aqi.with_aqi(df).first().aqi == by_hand("pm10", 40.0)
    assert aqi.with_aqi(df.drop("pm10").withColumn("x", F.lit(1))).first().aqi is None
