"""Streams into the stores: corrections replace, replays change nothing."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.operators import layout
from hazecast.operators.matching import keep_last
from hazecast.plans.features import build_features
from hazecast.sources.feature_store import FeatureStore
from hazecast.streaming import series_index
from hazecast.streaming.joins import file_stream


def stored_form(batch: DataFrame) -> DataFrame:
    """Newest copy per key, ``timestamp`` in epoch milliseconds."""
    return keep_last(batch).withColumn("timestamp", F.unix_millis("timestamp"))


def upsert_raw(batch: DataFrame, store: FeatureStore) -> None:
    store.upsert(stored_form(batch), order="ingest_seq")


def _each_batch(stream: DataFrame, action, progress: str) -> None:
    def handle(batch: DataFrame, _: int) -> None:
        kept = batch.persist()
        try:
            if not kept.isEmpty():
                action(kept)
        finally:
            kept.unpersist()

    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", progress)
     .trigger(availableNow=True).start().awaitTermination())


def run_upserts(spark: SparkSession, path: str, store_path: str, progress: str,
                files_per_batch: int | None = None) -> DataFrame:
    """Every file of the folder into a raw store; the newest copy of a key stays."""
    store = FeatureStore(spark, store_path)
    _each_batch(file_stream(spark, path, files_per_batch),
                lambda batch: upsert_raw(batch, FeatureStore(batch.sparkSession, store_path)),
                progress)
    return store.read()


def update_features(batch: DataFrame, raw_path: str, store_path: str,
                    block_rows: int = layout.BLOCK_ROWS) -> dict[str, int]:
    """One batch of observations into the raw store and the feature store.

    What is read and written depends on the batch, not on the length of the series: the
    index of each changed series (one row per 256 hours) tells which rows a change reaches,
    and the state of its means before them; only days that hold those rows are opened, and
    only days with rows made again are written. Returns the feature store's row counts.

    The batch may be run again after a crash at any point: nothing counts twice.
    """
    spark = batch.sparkSession
    raw_store, index = FeatureStore(spark, raw_path), series_index.store(spark, raw_path)
    if raw_store.exists() and not index.exists():
        series_index.rebuild(spark, raw_path, block_rows)
    upsert_raw(batch, raw_store)
    now = series_index.touched(batch, raw_store, index).persist(StorageLevel.MEMORY_AND_DISK)
    plan = series_index.slices(now).persist(StorageLevel.MEMORY_AND_DISK)
    part = series_index.rows_of(plan, raw_store).persist(StorageLevel.MEMORY_AND_DISK)
    made = None
    try:
        made = build_features(part, block_rows=block_rows, seed=series_index.seeds(plan), weights=True, numbered=True).filter(
            "remake").withColumn("station_id", F.col("station_id.station_id")).persist(StorageLevel.MEMORY_AND_DISK)
        weights = [c for c in made.columns if "_weight_" in c]
        counts = FeatureStore(spark, store_path).upsert(
            made.drop("remake", "cut", "cut_end", *weights), cached=True)
        index.upsert(series_index.renewed(now, made))
        return counts
    finally:
        for table in (now, plan, part, made):
            if table is not None:
                table.unpersist()


def run_features(spark: SparkSession, path: str, raw_path: str, store_path: str,
                 progress: str, files_per_batch: int | None = None,
                 block_rows: int = layout.BLOCK_ROWS) -> DataFrame:
    _each_batch(
        file_stream(spark, path, files_per_batch),
        lambda batch: update_features(batch, raw_path, store_path, block_rows),
        progress)
    return FeatureStore(spark, store_path).read()
