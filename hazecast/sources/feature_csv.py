"""The feature table as CSV: epoch milliseconds out, timestamps back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(features: DataFrame, path: str) -> None:
    """One header per file, no row index; ``timestamp`` in epoch milliseconds."""
    if features.schema["timestamp"].dataType.typeName() == "timestamp":
        features = features.withColumn("timestamp", F.unix_millis("timestamp"))
    features.write.mode("overwrite").option("header", True).csv(path)


def csv_schema(features: DataFrame) -> T.StructType:
    """Schema to read a written table with: the time stays text until parsed."""
    return T.StructType([
        T.StructField(f.name, T.StringType() if f.name == "timestamp" else f.dataType)
        for f in features.schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read with a fixed schema; a time that is no number becomes null."""
    text = spark.read.schema(schema).option("header", True).csv(path)
    millis = F.floor(F.col("timestamp").try_cast("double")).try_cast("bigint")
    return text.withColumn("timestamp", F.timestamp_millis(
        F.coalesce(F.col("timestamp").try_cast("bigint"), millis)))
