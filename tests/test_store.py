import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazecast.sources import feature_store as fs

HOUR = 3_600_000
T0 = 1704067200000


def batch(spark, rows, extra=""):
    return spark.createDataFrame(
        rows, "station_id int, timestamp bigint, pm2_5 double, co double" + extra)


def contents(store):
    return sorted(map(tuple, store.read().select("station_id", "timestamp", "pm2_5", "co").collect()),
                  key=lambda r: r[:2])


@pytest.fixture
def store(spark, tmp_path):
    return fs.FeatureStore(spark, f"{tmp_path}/store")


def test_upsert_replaces_extends_and_repeats(spark, store):
    first = batch(spark, [(0, T0 + h * HOUR, float(h), 1.0) for h in range(60)])
    store.upsert(first)
    second = batch(spark, [(0, T0 + 40 * HOUR, None, 2.0), (1, T0 + 40 * HOUR, 7.0, 7.0),
                           (0, T0 + 90 * HOUR, 8.0, 8.0)])
    assert tuple(fs.report(store.read(), second).first()) == (3, 2, 1)
    store.upsert(second)
    once = contents(store)
    want = {(0, T0 + h * HOUR): (float(h), 1.0) for h in range(60)}
    want |= {(0, T0 + 40 * HOUR): (None, 2.0), (1, T0 + 40 * HOUR): (7.0, 7.0),
             (0, T0 + 90 * HOUR): (8.0, 8.0)}
    assert once == sorted(k + v for k, v in want.items())
    store.upsert(second)
    assert contents(store) == once
    assert tuple(fs.key_uniqueness(store.read()).first()) == (62, 62, True)


def test_known_values_can_be_kept(spark, store):
    store.upsert(batch(spark, [(0, T0, 1.0, 2.0)]))
    store.upsert(batch(spark, [(0, T0, None, 3.0)]), keep_known=True)
    assert contents(store) == [(0, T0, 1.0, 3.0)]


def test_older_copies_do_not_win(spark, store):
    schema = ", ingest_seq int"
    store.upsert(batch(spark, [(0, T0, 1.0, 1.0, 5)], schema), order="ingest_seq")
    store.upsert(batch(spark, [(0, T0, 9.0, 9.0, 3)], schema), order="ingest_seq")
    assert contents(store) == [(0, T0, 1.0, 1.0)]
    store.upsert(batch(spark, [(0, T0, 9.0, 9.0, 6)], schema), order="ingest_seq")
    assert contents(store) == [(0, T0, 9.0, 9.0)]


def test_columns_may_differ(spark):
    old = spark.createDataFrame([(0, T0, 1.0)], "station_id int, timestamp bigint, a double")
    new = spark.createDataFrame([(0, T0, 2.0), (1, T0, 3.0)],
                                "station_id int, timestamp bigint, b double")
    got = {r.station_id: (r.a, r.b) for r in fs.merged(old, new).collect()}
    assert got == {0: (1.0, 2.0), 1: (None, 3.0)}


def test_replacing_rows_are_not_joined(spark):
    """A batch with all stored columns replaces whole rows: only its keys meet the stored ones."""
    old = batch(spark, [(0, T0, 1.0, 1.0), (1, T0, 2.0, 2.0)])
    new = batch(spark, [(0, T0, None, 5.0), (2, T0, 3.0, 3.0)])
    got = fs.merged(old, new)
    assert sorted(map(tuple, got.collect())) == [(0, T0, None, 5.0), (1, T0, 2.0, 2.0), (2, T0, 3.0, 3.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "FullOuter" not in plan


def test_a_column_may_come_later(spark, tmp_path):
    store = fs.FeatureStore(spark, f"{tmp_path}/store", merge_schema=True)
    store.upsert(batch(spark, [(0, T0, 1.0, 1.0), (0, T0 + 48 * HOUR, 2.0, 2.0)]))
    store.upsert(batch(spark, [(0, T0 + 48 * HOUR, 3.0, 3.0, 7.0)], ", no2 double"))
    assert {r.timestamp: (r.pm2_5, r.no2) for r in store.read().collect()} == {
        T0: (1.0, None), T0 + 48 * HOUR: (3.0, 7.0)}


def test_copies_collapse_before_the_shuffle(spark):
    """One key holds most rows: partial aggregates, no window over the copies."""
    from hazecast.operators.matching import keep_last
    df = spark.range(0, 20_000, 1, 8).selectExpr(
        "0 AS station_id", "if(id % 3 < 2, 0, id) AS timestamp", "id AS ingest_seq", "id * 2 AS x")
    got = keep_last(df)
    assert got.filter("timestamp = 0").first().ingest_seq == 19_999 - (19_999 % 3 == 2)
    assert got.count() == df.select("timestamp").distinct().count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan
    assert plan.index("Exchange") < plan.index("partial_max")


def test_an_empty_store_cannot_train(spark, store):
    store.upsert(batch(spark, [(0, T0, 1.0, 2.0)]).filter("station_id > 5"))
    with pytest.raises(Exception):
        store.training_scan().count()


def test_sanitize(spark):
    rows = [("2024-01-01 00:00:00", 1.0, 5.0, 1), ("1704067200000", 2.0, 6.0, 2),
            ("nonsense", 3.0, 7.0, 3), ("1704070800000", None, 8.0, 4),
            ("1704074400000", float("nan"), 9.0, 5)]
    df = spark.createDataFrame(rows, "TIMESTAMP string, `PM2_5` double, `Wind Speed` double, "
                                     "ingest_seq int").withColumn("station_id", F.lit(0))
    got = fs.sanitize(df).collect()
    assert len(got) == 1 and (got[0].timestamp, got[0].pm2_5, got[0].wind_speed) == (T0, 2.0, 6.0)
    with pytest.raises(ValueError):
        fs.sanitize(df.drop("TIMESTAMP"))
    with pytest.raises(ValueError):
        fs.sanitize(df.drop("ingest_seq"))


def day_files(store):
    """Files of each day, as a reader of the store opens them."""
    import pathlib
    found = {}
    for name in store.read().inputFiles():
        found.setdefault(pathlib.Path(name).parent.name, set()).add(name)
    return found


def test_only_touched_days_are_rewritten(spark, store, tmp_path):
    store.upsert(batch(spark, [(0, T0 + d * 24 * HOUR, 1.0, 1.0) for d in range(4)]))
    before = day_files(store)
    store.upsert(batch(spark, [(0, T0 + 2 * 24 * HOUR, 2.0, 2.0)]))
    after = day_files(store)
    changed = {d for d in before if before[d] != after[d]}
    assert changed == {f"date={dt.date(2024, 1, 3)}"}


def test_readers_see_an_upsert_whole_or_not(spark, store, monkeypatch):
    """A writer that stops after its days are written, and a reader that began before."""
    store.upsert(batch(spark, [(0, T0 + d * 24 * HOUR, 1.0, 1.0) for d in range(4)]))
    before, early = contents(store), store.read()
    change = batch(spark, [(0, T0 + d * 24 * HOUR, 2.0, 2.0) for d in range(6)])

    def killed(self, version):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(fs.FeatureStore, "_list", killed)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(change)
    assert contents(store) == before
    assert store.upsert(change) == {"prepared": 6, "inserted": 2, "updated": 4}
    assert [r[2] for r in contents(store)] == [2.0] * 6
    assert [r.pm2_5 for r in early.collect()] == [1.0] * 4
    assert store.vacuum() == 4 and [r[2] for r in contents(store)] == [2.0] * 6


def test_a_write_that_dies_between_days_changes_nothing(spark, store):
    """One day's task fails after another day was written."""
    store.upsert(batch(spark, [(0, T0 + d * 24 * HOUR, 1.0, 1.0) for d in range(2)]))
    before = contents(store)
    bad = batch(spark, [(0, T0 + d * 24 * HOUR, 2.0, 2.0) for d in range(2)]).withColumn(
        "pm2_5", F.when(F.col("timestamp") > T0, F.raise_error(F.lit("lost"))).otherwise(F.col("pm2_5")))
    with pytest.raises(Exception):
        store._list(store._stage(bad))
    assert contents(store) == before


def test_the_listing_answers_without_a_scan(spark, store):
    store.upsert(batch(spark, [(s, T0 + h * HOUR, 1.0, 1.0) for h in range(24 * 9) for s in (0, 1)]))
    store.upsert(batch(spark, [(0, T0 + (24 * 9 + 5) * HOUR, 2.0, 2.0), (0, T0, 3.0, 3.0)]))
    one = store.overview().first()
    assert (one.row_count, one.day_count, one["first"], one["last"]) == (433, 10, T0, T0 + (24 * 9 + 5) * HOUR)
    assert "data/" not in "".join(store.overview().inputFiles())
    got = store.recent(2)
    assert {f.split("date=")[1][:10] for f in got.inputFiles()} == {"2024-01-08", "2024-01-09", "2024-01-10"}
    assert got.count() == store.read().filter(F.col("timestamp") >= T0 + (24 * 7 + 5) * HOUR).count() == 2 * 43 + 1
