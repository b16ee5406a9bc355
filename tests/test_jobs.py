import pandas as pd
from pyspark.sql import functions as F

from hazecast.fixed_values import AIR_QUALITY_FIELDS, POLLUTANTS, WEATHER, WEATHER_FIELDS
from hazecast.plans import jobs, training
from hazecast.plans.features import build_features
from hazecast.sources import feature_csv, payloads
from hazecast.sources.feature_store import FeatureStore
from helpers import series, to_spark


def test_backfill_hourly_training_and_serving(spark, tmp_path):
    table = to_spark(spark, series(24 * 30, seed=31, gaps=0.02)).cache()
    air = table.select("station_id", "timestamp", *POLLUTANTS)
    weather = table.select("station_id", "timestamp", *WEATHER)
    folders = []
    for n, (low, high) in enumerate(((1, 12), (13, 25))):
        part = F.dayofmonth("timestamp").between(low, high)
        folders.append((f"{tmp_path}/a{n}", f"{tmp_path}/w{n}"))
        payloads.write_payloads(air.filter(part), AIR_QUALITY_FIELDS, folders[n][0])
        payloads.write_payloads(weather.filter(part), WEATHER_FIELDS, folders[n][1])
    raw, store, csv, models = (f"{tmp_path}/{n}" for n in ("raw", "store", "csv", "models"))
    skipped, counts = jobs.backfill(spark, [*folders, ("/none/a", "/none/w")], raw, store, csv,
                            block_rows=512)
    assert len(skipped) == 1 and counts["inserted"] == counts["prepared"] > 0 == counts["updated"]
    known = table.filter(F.dayofmonth("timestamp") <= 25)
    assert FeatureStore(spark, store).read().count() == known.count()

    # hours 21..30 arrive hourly: the store is as if built from all readings
    counts = jobs.hourly(air, weather, raw, store, sequence=1, past_days=10, block_rows=512)
    assert counts["inserted"] > 0 and counts["updated"] > 0
    want = build_features(table, block_rows=512).toPandas().sort_values("timestamp")
    got = FeatureStore(spark, store).read().select(*want.columns).toPandas().sort_values("timestamp")
    pd.testing.assert_frame_equal(got.reset_index(drop=True), want.reset_index(drop=True),
                                  check_dtype=False, rtol=1e-9, atol=1e-9)

    schema = feature_csv.csv_schema(FeatureStore(spark, store).read())
    readers = [lambda: spark.read.parquet(f"{tmp_path}/none"),
               lambda: FeatureStore(spark, f"{tmp_path}/empty").training_scan(),
               lambda: feature_csv.read_csv(spark, csv, schema),
               lambda: FeatureStore(spark, store).training_scan()]
    run = jobs.train(readers, models, {"ridge_regression": training.ridge})
    assert len(run.models) == 3 and len(run.feature_names) == 104

    views = jobs.serve(air, weather, models, block_rows=512)
    newest = table.agg(F.max("timestamp")).first()[0]
    forecast = views["forecasts"].collect()
    assert [r.timestamp for r in forecast] == [newest]
    assert min(forecast[0][t] for t in run.models) >= 0
    assert views["series"].count() == 4 and views["cards"].count() == 3
    assert views["current"].count() == 1 and views["pollutants"].count() == 6
    views["alerts"].collect()
    assert views["report"].count() == 3 and views["importance"].count() == 30


def test_hourly_without_context_starts_empty(spark, tmp_path):
    table = to_spark(spark, series(24 * 12, seed=32, missing=0))
    air = table.select("station_id", "timestamp", *POLLUTANTS)
    weather = table.select("station_id", "timestamp", *WEATHER)
    store = f"{tmp_path}/store"
    jobs.hourly(air, weather, f"{tmp_path}/raw", store, 1, with_context=False, block_rows=512)
    rows = FeatureStore(spark, store).read()
    assert rows.count() == 121 and rows.filter("aqi_lag_24h IS NULL").count() == 24
