import datetime as dt
import gzip
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazecast.fixed_values import AIR_QUALITY_FIELDS, POLLUTANTS, WEATHER_FIELDS
from hazecast.operators import matching
from hazecast.sources import feature_csv, history, payloads
from helpers import series, to_spark

AIR = {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "pm2_5": [1.5, None],
       "pm10": [2.0, 3.0], "nitrogen_dioxide": [4.0, 5.0], "sulphur_dioxide": [6.0, 7.0],
       "ozone": [8.0, 9.0], "carbon_monoxide": [10.0, 11.0]}


def test_whole_file_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"station_id": 4, "hourly": AIR}, indent=2))
    rows = payloads.read_air_quality(spark, str(tmp_path), multi_line=True).orderBy("timestamp")
    assert rows.columns == ["station_id", "timestamp", *POLLUTANTS]
    assert [tuple(r) for r in rows.collect()] == [
        (4, dt.datetime(2024, 1, 1, 0), 1.5, 2.0, 4.0, 6.0, 8.0, 10.0),
        (4, dt.datetime(2024, 1, 1, 1), None, 3.0, 5.0, 7.0, 9.0, 11.0)]


def test_broken_documents_are_marked_and_left_out(spark, tmp_path):
    good = json.dumps({"station_id": 1, "hourly": AIR})
    (tmp_path / "a.json").write_text(good + "\n{broken\n" + '{"station_id": 2}\n')
    docs = payloads.read_payloads(spark, str(tmp_path), AIR_QUALITY_FIELDS)
    assert docs.cache().filter("_broken IS NOT NULL").count() == 1
    assert payloads.unfold(docs, AIR_QUALITY_FIELDS).count() == 2


def test_no_hourly_data_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"station_id": 2}\n')
    with pytest.raises(ValueError):
        payloads.read_weather(spark, str(tmp_path))


@pytest.fixture(scope="module")
def tables(spark):
    frame = series(24 * 12, seed=11)
    table = to_spark(spark, frame)
    return (table.select("station_id", "timestamp", *POLLUTANTS),
            table.select("station_id", "timestamp", *WEATHER_FIELDS.values()))


def test_backfill_skips_missing_chunks_and_keeps_the_first(spark, tables, tmp_path):
    air, weather = tables
    folders = []
    for n in range(3):
        paths = (f"{tmp_path}/a{n}", f"{tmp_path}/w{n}")
        folders.append(paths)
        if n != 1:
            part = F.dayofmonth("timestamp").between(n * 4, n * 4 + 8)
            payloads.write_payloads(air.filter(part).withColumn("co", F.lit(float(n))),
                                    AIR_QUALITY_FIELDS, paths[0])
            payloads.write_payloads(weather.filter(part), WEATHER_FIELDS, paths[1])
    table, skipped = history.backfill(
        spark, folders, payloads.read_air_quality, payloads.read_weather)
    assert [s[0] for s in skipped] == [folders[1][0]]
    days = {r[0]: (r[1], r[2]) for r in table.groupBy(F.dayofmonth("timestamp")).agg(
        F.count("*"), F.max("co")).collect()}
    assert days == {d: (24, 0.0 if d <= 8 else 2.0) for d in range(1, 13)}
    with pytest.raises(RuntimeError):
        history.backfill(spark, [folders[1]], payloads.read_air_quality, payloads.read_weather)


def test_range_read_prunes_days(spark, tables, tmp_path):
    path = f"{tmp_path}/raw"
    history.write_raw(tables[0], path)
    part = history.read_range(spark, path, "2024-01-03", "2024-01-05")
    assert part.count() == 72
    assert "PartitionFilters: [isnotnull(date" in part._jdf.queryExecution().toString()


def test_recent(tables):
    air = tables[0]
    assert history.recent(air, 2).count() == 49
    assert history.recent(air, 1, now="2024-01-05 00:00:00").count() == 25
    assert history.recent(air, 1, forecast_days=2, now="2024-01-05 00:00:00").count() == 73
    assert history.recent(history.with_date(air), 2).count() == 49


def by_loop(start, end, days, strict):
    """The chunk rule in plain Python."""
    out, at = [], start
    while at < end or (not strict and at == end):
        stop = min(at + dt.timedelta(days - 1), end)
        out.append((at, stop))
        at = stop + dt.timedelta(1)
    return out


@pytest.mark.parametrize("length", [0, 1, 29, 30, 31, 60, 61, 95])
@pytest.mark.parametrize("strict", [False, True])
def test_chunk_ranges(spark, length, strict):
    start = dt.date(2024, 1, 1)
    end = start + dt.timedelta(length)
    spans = spark.createDataFrame([(start, end)], "start_date date, end_date date")
    got = history.chunk_ranges(spans, 30, strict).orderBy("chunk").collect()
    assert [(r.chunk_start, r.chunk_end) for r in got] == by_loop(start, end, 30, strict)


def test_first_available(spark, tables, tmp_path):
    missing = lambda: spark.read.parquet(f"{tmp_path}/none")
    empty = lambda: tables[0].limit(0)
    assert history.first_available([missing, empty, lambda: tables[0]]).count() == 288
    with pytest.raises(RuntimeError):
        history.first_available([missing, empty])


def test_csv_round_trip_and_bad_times(spark, tables, tmp_path):
    path = f"{tmp_path}/csv"
    feature_csv.write_csv(tables[0], path)
    schema = feature_csv.csv_schema(tables[0])
    back = feature_csv.read_csv(spark, path, schema)
    assert back.exceptAll(tables[0]).isEmpty() and tables[0].exceptAll(back).isEmpty()
    (tmp_path / "odd.csv").write_text("timestamp,x\nsoon,1.0\n1704067200000.0,2.0\n,3.0\n")
    odd = spark.createDataFrame([], "timestamp timestamp, x double")
    got = feature_csv.read_csv(spark, f"{tmp_path}/odd.csv", feature_csv.csv_schema(odd)).collect()
    assert [r.timestamp for r in got] == [None, dt.datetime(2024, 1, 1), None]


def test_matching_counts_copies(spark):
    left = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "station_id int, timestamp int")
    right = spark.createDataFrame([(1, 1), (1, 1), (1, 3)], "station_id int, timestamp int")
    assert tuple(matching.match_report(left, right).first()) == (3, 3, 4)
    assert matching.join_observations(left, right).count() == 4


def test_one_row_per_key(spark):
    rows = [(0, 1, 5, "b", None), (0, 1, 3, "a", 1.0), (0, 2, 1, "c", 2.0)]
    df = spark.createDataFrame(
        rows, "station_id int, timestamp int, ingest_seq int, s string, x double")
    assert sorted(matching.keep_first(df).collect()) == [rows[1], rows[2]]
    assert sorted(map(str, matching.keep_last(df).collect())) == sorted(
        map(str, (df.filter("ingest_seq <> 3")).collect()))
    assert [tuple(r) for r in matching.latest_per_station(df).collect()] == [rows[2]]


def test_copies_without_an_order_and_with_equal_ones(spark):
    schema = "station_id int, timestamp timestamp, pm2_5 double, ingest_seq bigint"
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(1, t[0], 5.0, None), (1, t[1], 1.0, None), (1, t[1], 2.0, 7), (1, t[2], 8.0, 3),
            (1, t[2], None, 3), (1, t[2], 9.0, 3)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    first = {r.timestamp: r.pm2_5 for r in matching.keep_first(df).collect()}
    last = {r.timestamp: r.pm2_5 for r in matching.keep_last(df).collect()}
    assert first == {t[0]: 5.0, t[1]: 2.0, t[2]: None} and last == {t[0]: 5.0, t[1]: 2.0, t[2]: 9.0}


def test_documents_of_one_series_and_bad_values(spark, tmp_path):
    """No station, a bad number, a field that is missing, a cut document, a cut archive."""
    odd = {**AIR, "pm10": ["oops", 3.0]}
    del odd["ozone"]
    whole = json.dumps({"hourly": odd})
    (tmp_path / "a.json").write_text(whole + "\n" + whole[:60] + "\n{}\n")
    archive = gzip.compress(b"".join(json.dumps({"n": i}).encode() + b"\n" for i in range(20000)))
    (tmp_path / "b.json.gz").write_bytes(archive[:40])
    docs = payloads.read_payloads(spark, str(tmp_path), AIR_QUALITY_FIELDS)
    rows = payloads.unfold(docs, AIR_QUALITY_FIELDS).orderBy("timestamp").collect()
    assert [(r.station_id, r.pm2_5, r.pm10, r.o3, r.co) for r in rows] == [
        (0, 1.5, None, None, 10.0), (0, None, 3.0, None, 11.0)]
    assert payloads.unfold(docs, AIR_QUALITY_FIELDS, default_station=7).first().station_id == 7
    counts = {r.reason: r.documents for r in payloads.rejected(docs).collect()}
    assert counts["accepted"] == 1 and counts["malformed"] >= 1 and counts["no hourly data"] >= 1
    assert [f.rsplit("/", 1)[1] for f in payloads.unread_files(docs)] == ["b.json.gz"]


def test_backfill_reports_broken_folders(spark, tables, tmp_path):
    air, weather = tables
    folders = [(f"{tmp_path}/a{n}", f"{tmp_path}/w{n}") for n in range(4)]
    for n in (0, 1, 2):
        part = F.dayofmonth("timestamp").between(n * 4 + 1, n * 4 + 4)
        payloads.write_payloads(air.filter(part), AIR_QUALITY_FIELDS, folders[n][0])
        if n != 1:
            payloads.write_payloads(weather.filter(part), WEATHER_FIELDS, folders[n][1])
    (tmp_path / "w1").mkdir()
    (tmp_path / "w1" / "a.json.gz").write_bytes(gzip.compress(b"{}\n" * 9999)[:30])
    table, skipped = history.backfill(spark, folders, payloads.read_air_quality, payloads.read_weather)
    assert skipped == [(folders[1][0], "no hourly data"), (folders[3][0], "no such folder")]
    assert table.count() == 24 * 8


def test_backfill_names_archives_cut_part_way(spark, tmp_path):
    """A cut archive beside a good one: its hours up to the break count, and it is listed."""
    import gzip

    from hazecast.sources import history, payloads

    def document(day, fields):
        return json.dumps({"hourly": {"time": [f"2024-01-{day:02d}T{h:02d}:00" for h in range(24)],
                                      **{f: [float(day * 100 + h) for h in range(24)] for f in fields}}})

    for side, fields in (("air", payloads.AIR_QUALITY_FIELDS), ("weather", payloads.WEATHER_FIELDS)):
        folder = tmp_path / side
        folder.mkdir()
        (folder / "a.json.gz").write_bytes(gzip.compress((document(1, fields) + "\n").encode()))
        lines = "".join(document(d, fields) + "\n" for d in range(2, 29)).encode()
        whole = gzip.compress(lines[:9000], 1) + gzip.compress(lines[9000:], 1)  # two members
        (folder / "b.json.gz").write_bytes(whole if side == "weather" else whole[:-60])
    rows, skipped = history.backfill(spark, [(f"{tmp_path}/air", f"{tmp_path}/weather")],
                                     payloads.read_air_quality, payloads.read_weather)
    assert rows.filter("dayofmonth(timestamp) = 1").count() == 24
    assert [(f.rsplit("/", 2)[1:], r) for f, r in skipped] == [(["air", "b.json.gz"], "cut short")]
    (tmp_path / "air" / "b.json.gz").write_bytes(whole)
    rows, skipped = history.backfill(spark, [(f"{tmp_path}/air", f"{tmp_path}/weather")],
                                     payloads.read_air_quality, payloads.read_weather)
    assert skipped == []
