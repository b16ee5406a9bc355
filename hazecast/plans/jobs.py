"""The four jobs a forecasting service runs: backfill, hourly, training, serving."""

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.fixed_values import LIVE_DAYS, RECENT_DAYS
from hazecast.functions.cleaning import drop_all_null_pollutants
from hazecast.operators import layout, matching
from hazecast.plans import forecasting, training
from hazecast.plans.features import build_features
from hazecast.session import configure
from hazecast.sources import feature_csv, feature_store, history, payloads
from hazecast.streaming import series_index
from hazecast.streaming.upserts import update_features


def _with_sequence(df: DataFrame, sequence: int) -> DataFrame:
    return df.withColumn("ingest_seq", F.lit(sequence).cast("bigint"))


def backfill(spark: SparkSession, folders: list[tuple[str, str]], raw_path: str,
             store_path: str, csv_path: str | None = None,
             block_rows: int = layout.BLOCK_ROWS) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """Payload folders (air, weather) per chunk -> raw store -> feature store.

    The joined readings are written before features are built: the build reads
    its input three times, each time only the columns it needs. Returns the
    chunks that could not be read, with the reason, and the store's row counts.
    """
    configure(spark)
    combined, skipped = history.backfill(
        spark, folders, payloads.read_air_quality, payloads.read_weather)
    raw = feature_store.FeatureStore(spark, raw_path)
    raw.upsert(_with_sequence(combined, 0).withColumn("timestamp", F.unix_millis("timestamp")),
               order="ingest_seq")
    stored = raw.read().drop("ingest_seq").withColumn(
        "timestamp", F.timestamp_millis("timestamp"))
    made = drop_all_null_pollutants(build_features(stored, block_rows=block_rows))
    store = feature_store.FeatureStore(spark, store_path)
    counts = store.upsert(made)
    series_index.rebuild(spark, raw_path, block_rows)
    if csv_path:
        feature_csv.write_csv(store.read(), csv_path)
    return skipped, counts


def recent_observations(air: DataFrame, weather: DataFrame, past_days: int) -> DataFrame:
    return matching.join_observations(
        history.recent(air, past_days), history.recent(weather, past_days))


def hourly(air: DataFrame, weather: DataFrame, raw_path: str, store_path: str, sequence: int,
           past_days: int = RECENT_DAYS, with_context: bool = True,
           block_rows: int = layout.BLOCK_ROWS) -> dict[str, int]:
    """The last days' readings into the stores; ``sequence`` orders the runs.

    Features are built with the stored readings before and after them. Without
    context they are built from the last days alone, so that frames and lags
    start empty there, and replace what the store holds for those hours. Returns
    how many rows the feature store was given, inserted and updated.
    """
    configure(air.sparkSession)
    batch = _with_sequence(recent_observations(air, weather, past_days), sequence).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        if batch.isEmpty():
            return {"prepared": 0, "inserted": 0, "updated": 0}
        if with_context:
            return update_features(batch, raw_path, store_path, block_rows)
        made = build_features(batch.drop("ingest_seq"), block_rows=block_rows)
        return feature_store.FeatureStore(batch.sparkSession, store_path).upsert(
            drop_all_null_pollutants(made))
    finally:
        batch.unpersist()


def train(readers: list[Callable[[], DataFrame]], model_path: str,
          candidates: dict[str, Callable] | None = None) -> training.Trained:
    """Train on the first source that has rows and save the run.

    Readers give the feature table, ``timestamp`` as a timestamp or in epoch
    milliseconds.
    """
    table = history.first_available(readers)
    configure(table.sparkSession)
    if table.schema["timestamp"].dataType.typeName() == "long":
        table = table.withColumn("timestamp", F.timestamp_millis("timestamp"))
    trained = training.train(table, candidates=candidates)
    training.save(trained, model_path)
    return trained


def serve(air: DataFrame, weather: DataFrame, model_path: str | list[str],
          past_days: int = LIVE_DAYS, block_rows: int = layout.BLOCK_ROWS) -> dict[str, DataFrame]:
    """Everything the live view shows, one table each.

    Of several model folders the first that can be read serves all tables.
    """
    spark = configure(air.sparkSession)
    live = recent_observations(air, weather, past_days)
    features = build_features(live, epoch=False, block_rows=block_rows)
    folders = [model_path] if isinstance(model_path, str) else model_path
    model_path, models, names, metrics = training.load_first(spark, folders)
    forecasts = forecasting.forecast(features, models, names)
    missing = [t for t in forecasting.TARGETS if t not in models]
    forecasts = forecasts.withColumns({t: F.lit(None).cast("double") for t in missing}) \
        if missing else forecasts
    return {
        "forecasts": forecasts,
        "series": forecasting.forecast_series(forecasts, features),
        "alerts": forecasting.alerts(forecasts),
        "cards": forecasting.forecast_cards(forecasts),
        "current": forecasting.current_conditions(live),
        "pollutants": forecasting.pollutant_breakdown(live),
        "report": training.report(metrics),
        "importance": training.top_features(training.newest_importance(spark, model_path)),
    }
