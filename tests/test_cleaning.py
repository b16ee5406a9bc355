import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from hazecast.functions import calendar, cleaning
from helpers import same, series, to_spark


def test_nan_and_infinity_become_null_and_zero(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), None), (float("-inf"), 3), (None, 4)],
                               "x double, n int")
    assert [r.x for r in cleaning.normalize_nan(df).collect()] == [1.0, None, None, None]
    filled = cleaning.impute_zero(df, ["x", "n"]).collect()
    assert [tuple(r) for r in filled] == [(1.0, 1), (0.0, 0), (0.0, 3), (0.0, 4)]


def test_timestamps_are_read_row_by_row_or_as_a_column(spark):
    texts = ["1704067200000", "2024-01-01 01:00:00", "2024-01-01T02:00", "1704078000000.0",
             "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "timestamp string")
    hour = 3_600_000
    rows = [r[0] for r in cleaning.normalize_timestamp(df).collect()]
    assert rows == [1704067200000 + i * hour for i in range(4)]
    strict = [r[0] for r in cleaning.normalize_timestamp(df, strict=True).collect()]
    assert strict == [1704067200000, 1704078000000]  # one odd text: all dates are lost
    dates = df.filter(F.col("timestamp").like("2024%"))
    assert cleaning.normalize_timestamp(dates, strict=True).count() == 2


def test_typed_timestamps(spark):
    moment = dt.datetime(2024, 1, 1, 5)
    df = spark.createDataFrame([(moment,)], "timestamp timestamp")
    assert cleaning.normalize_timestamp(df).first()[0] == 1704085200000
    whole = spark.createDataFrame([(1704085200000,)], "timestamp bigint")
    assert cleaning.normalize_timestamp(whole).first()[0] == 1704085200000


def test_headers_and_empty_rows(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "`PM2_5` double, `Wind Speed` double")
    named = cleaning.normalize_headers(df)
    assert named.columns == ["pm2_5", "wind_speed"]
    assert cleaning.drop_all_null_pollutants(named).count() == 1
    assert cleaning.drop_all_null_pollutants(named.drop("pm2_5")).count() == 2


def test_calendar_against_pandas(spark):
    import numpy as np
    frame = series(24 * 500, missing=0).iloc[::7].reset_index(drop=True)
    ts = frame.timestamp
    got = calendar.with_calendar_features(calendar.with_time_features(
        to_spark(spark, frame))).toPandas().sort_values("timestamp").reset_index(drop=True)
    assert (got.hour == ts.dt.hour).all() and (got.day_of_week == ts.dt.dayofweek).all()
    assert (got.month == ts.dt.month).all()
    assert (got.is_weekend == (ts.dt.dayofweek >= 5)).all()
    assert (got.day_segment == ts.dt.hour // 6).all()
    week = ts.dt.isocalendar().week.astype(int)
    assert same(got.week_of_year_sin, np.sin(2 * np.pi * week / 52))
    assert same(got.day_of_year_cos, np.cos(2 * np.pi * ts.dt.dayofyear / 365.25))
    assert same(got.hour_sin, np.sin(2 * np.pi * ts.dt.hour / 24))
    assert same(got.month_cos, np.cos(2 * np.pi * ts.dt.month / 12))


def test_city_local_hours(spark):
    df = to_spark(spark, pd.DataFrame({"timestamp": pd.to_datetime(["2024-01-01 20:00"])}))
    row = calendar.with_time_features(df, zone="Asia/Tashkent").first()
    assert (row.hour, row.day_of_week) == (1, 1)


def test_interactions_need_both_columns(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "pm10 double, humidity double")
    made = calendar.with_interactions(df)
    assert made.columns == ["pm10", "humidity", "pm10_x_humidity"]
    assert made.first().pm10_x_humidity == 6.0
