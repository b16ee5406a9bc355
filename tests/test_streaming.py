import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazecast.fixed_values import POLLUTANTS, WEATHER
from hazecast.plans.exploration import resample_mean
from hazecast.plans.features import build_features
from hazecast.sources.feature_store import FeatureStore
from hazecast.streaming import joins, resample, series_index, upserts
from helpers import series, to_spark


def drop(df, path, sequence):
    """One file arriving; files are read in order of their names and times."""
    df.withColumn("ingest_seq", F.lit(sequence).cast("bigint")).coalesce(1) \
        .write.mode("append").parquet(path)


def test_join_of_two_streams(spark, tmp_path):
    table = to_spark(spark, series(24 * 10, seed=21, gaps=0.1))
    air = table.select("station_id", "timestamp", *POLLUTANTS)
    weather = table.select("station_id", "timestamp", *WEATHER)
    air.filter("hour(timestamp) <> 3").write.parquet(f"{tmp_path}/a")
    weather.filter("hour(timestamp) <> 5").write.parquet(f"{tmp_path}/w")
    got = joins.run_join(spark, f"{tmp_path}/a", f"{tmp_path}/w", f"{tmp_path}/out", f"{tmp_path}/ck")
    want = table.filter("hour(timestamp) NOT IN (3, 5)")
    assert got.count() == want.count()
    assert got.select(want.columns).exceptAll(want).isEmpty()


@pytest.mark.parametrize("period", ["day", "week"])
def test_closed_periods_equal_the_batch(spark, tmp_path, period):
    table = to_spark(spark, series(24 * 40, seed=22))
    table.write.parquet(f"{tmp_path}/in")
    got = resample.run_means(spark, f"{tmp_path}/in", ["pm10", "co"], period,
                             f"{tmp_path}/out", f"{tmp_path}/ck")
    closed = table.agg(F.max("timestamp")).first()[0] - dt.timedelta(days=5)
    want = resample_mean(table, ["pm10", "co"], period).filter(F.col("period") < closed.date())
    a, b = (d.orderBy("period").toPandas() for d in (got, want))
    assert len(a) == len(b) > 3
    assert list(a.period) == list(b.period)
    pd.testing.assert_frame_equal(a[["pm10", "co"]], b[["pm10", "co"]])


def test_means_follow_corrections(spark, tmp_path):
    """Copies in one file, in a later one, and an older copy that arrives last."""
    table = to_spark(spark, series(24 * 30, seed=27)).select("station_id", "timestamp", "pm10", "co")
    fixed = table.filter("hour(timestamp) % 5 = 0").withColumn("pm10", F.col("pm10") + 100)
    old = table.filter("hour(timestamp) % 10 = 0").withColumn("co", F.lit(-1.0))
    first, second, third = (d.filter("dayofmonth(timestamp) <= 12") for d in (table, fixed, old))
    drop(first.unionByName(first), f"{tmp_path}/in", 2)
    drop(second, f"{tmp_path}/in", 3)
    drop(third, f"{tmp_path}/in", 1)
    rest = [d.filter("dayofmonth(timestamp) > 12") for d in (table, fixed)]
    drop(rest[1], f"{tmp_path}/in", 3)
    drop(rest[0], f"{tmp_path}/in", 2)
    got = resample.run_means(spark, f"{tmp_path}/in", ["pm10", "co"], "day", f"{tmp_path}/out",
                             f"{tmp_path}/ck", order="ingest_seq", files_per_batch=1)
    newest = table.join(fixed.select("station_id", "timestamp", F.col("pm10").alias("new"), F.lit(1).alias("there")),
                        ["station_id", "timestamp"], "left").withColumn(
        "pm10", F.when(F.col("there") == 1, F.col("new")).otherwise(F.col("pm10")))
    closed = table.agg(F.max("timestamp")).first()[0] - dt.timedelta(days=5)
    want = resample_mean(newest, ["pm10", "co"], "day").filter(F.col("period") < closed.date())
    a, b = (d.select("period", "pm10", "co").orderBy("period").toPandas() for d in (got, want))
    assert len(a) == len(b) > 20
    pd.testing.assert_frame_equal(a, b)


def test_corrections_replace_and_replays_change_nothing(spark, tmp_path):
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    table = to_spark(spark, series(48, seed=23, missing=0)).select("station_id", "timestamp", "pm10")
    early = table.filter("hour(timestamp) = 4")
    drop(table, source, 1)
    upserts.run_upserts(spark, source, store, f"{tmp_path}/ck")
    drop(early.withColumn("pm10", F.lit(-1.0)), source, 3)      # a correction
    drop(early.withColumn("pm10", F.lit(-9.0)), source, 2)      # an older copy, late
    got = upserts.run_upserts(spark, source, store, f"{tmp_path}/ck", files_per_batch=1)
    assert got.filter("pm10 = -1").count() == 2 and got.filter("pm10 = -9").count() == 0
    assert got.count() == 48
    before = sorted(got.collect())
    again = upserts.run_upserts(spark, source, store, f"{tmp_path}/other")  # everything once more
    assert sorted(again.collect()) == before


def test_features_of_drops_equal_one_build(spark, tmp_path):
    """Late rows, a correction and a long silence: as built from all rows at once."""
    frame = pd.concat([series(1500, seed=24, gaps=0.05), series(1300, seed=25, station=1)])
    frame.loc[(frame.station_id == 0) & frame.index.isin(range(300, 1000)), "pm10"] = float("nan")
    table = to_spark(spark, frame).cache()
    late = "dayofyear(timestamp) = 30 AND hour(timestamp) = 7"
    source = f"{tmp_path}/in"
    args = (f"{tmp_path}/raw", f"{tmp_path}/store", f"{tmp_path}/ck")
    first = table.filter(f"dayofyear(timestamp) <= 40 AND NOT ({late})")
    drop(first.withColumn("co", F.when(F.col("timestamp") == "2024-02-05", 1.0).otherwise(F.col("co"))),
         source, 1)
    upserts.run_features(spark, source, *args, block_rows=512)
    drop(table.filter(f"dayofyear(timestamp) > 40 OR ({late})")
         .unionByName(first.filter("timestamp = '2024-02-05'")), source, 2)
    upserts.run_features(spark, source, *args, block_rows=512)
    want = build_features(table, block_rows=512).toPandas()
    got = FeatureStore(spark, args[1]).read().select(*want.columns).toPandas()
    key = ["station_id", "timestamp"]
    a, b = (d.sort_values(key).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_old_corrections_leave_other_days_alone(spark, tmp_path, monkeypatch):
    """A value changed and an hour filled a year back, and a new hour: what is read and written."""
    frame = series(24 * 400, seed=31, gaps=0.02)
    frame.loc[(frame.timestamp >= "2024-02-20") & (frame.timestamp < "2024-03-20"), "pm2_5"] = float("nan")
    frame.loc[frame.timestamp == "2024-02-10 05:00", "pm2_5"] = 55.0
    table = to_spark(spark, frame).cache()
    hole = table.filter("timestamp > '2024-02-11'").orderBy("timestamp").first().timestamp
    last = table.agg(F.max("timestamp")).first()[0]
    raw, store = f"{tmp_path}/raw", f"{tmp_path}/store"
    first = table.filter(F.col("timestamp").isin(hole, last) == False).withColumn(  # noqa: E712
        "pm2_5", F.when(F.col("timestamp") == "2024-02-10 05:00", 1.0).otherwise(F.col("pm2_5")))
    upserts.update_features(first.withColumn("ingest_seq", F.lit(1)), raw, store, 512)

    def files():
        return {f.split("date=")[1][:10]: f for f in FeatureStore(spark, store).read().inputFiles()}

    before, opened = files(), set()
    plain = FeatureStore.read_days

    def noted(self, days):
        got = plain(self, days)
        if self.path == raw:
            opened.update(f.split("date=")[1][:10] for f in got.inputFiles())
        return got

    monkeypatch.setattr(FeatureStore, "read_days", noted)
    changed = table.filter(F.col("timestamp").isin(hole, last) | (F.col("timestamp") == "2024-02-10 05:00"))
    upserts.update_features(changed.withColumn("ingest_seq", F.lit(2)), raw, store, 512)
    after = files()
    rewritten = {d for d in after if after[d] != before.get(d)}
    # from 72 rows before the change to the first value after the silence, and the end
    assert {"2024-02-08", "2024-02-10", "2024-02-25", "2024-03-19", str(last.date())} <= rewritten
    assert all("2024-02-06" < d < "2024-03-22" or d >= str(last.date() - dt.timedelta(days=5)) for d in rewritten)
    assert rewritten <= opened and len(opened) < 130
    assert not any("2024-06-01" <= d <= "2024-11-30" for d in opened)
    want = build_features(table, block_rows=512).toPandas().sort_values("timestamp").reset_index(drop=True)
    got = FeatureStore(spark, store).read().select(*want.columns).toPandas().sort_values("timestamp").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)
    # the index is as made from the whole raw store
    kept = series_index.store(spark, raw).read().toPandas().sort_values("timestamp").reset_index(drop=True)
    series_index.rebuild(spark, raw, 512)
    again = series_index.store(spark, raw).read().select(*kept.columns).toPandas().sort_values("timestamp").reset_index(drop=True)
    pd.testing.assert_frame_equal(kept, again, check_dtype=False, rtol=1e-9, atol=1e-9)
