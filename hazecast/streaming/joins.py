"""The two sources as file streams, joined as they arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.fixed_values import RECENT_DAYS
from hazecast.operators.matching import KEY

LATENESS = f"{RECENT_DAYS} days"


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, with the folder's present schema."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_lateness(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    if stream.schema["timestamp"].dataType.typeName() == "timestamp_ntz":
        stream = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return stream.withWatermark("timestamp", lateness)


def join_streams(air: DataFrame, weather: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Inner join on station and hour; state older than the lateness is dropped."""
    return with_lateness(air, lateness).join(with_lateness(weather, lateness), KEY, "inner")


def drain(stream: DataFrame, out: str, progress: str) -> DataFrame:
    """Run to the end of what has arrived, append to a table and read it."""
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", out).option("checkpointLocation", progress)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_join(spark: SparkSession, air_path: str, weather_path: str, out: str,
             progress: str, lateness: str = LATENESS) -> DataFrame:
    joined = join_streams(file_stream(spark, air_path), file_stream(spark, weather_path), lateness)
    return drain(joined, out, progress)
