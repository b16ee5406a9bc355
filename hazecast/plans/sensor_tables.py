"""Hourly sensor tables read out of an event log.

Every event is read by both sources. Each group of users is a station, so stations grow
with the users; a group is large enough for a series of some hundred hours. Event types
stand for pollutants, and the weather's clock runs an hour late, so that some hours of
either source have no partner. ``max``/``min`` keep the values exact, so every engine sees
the same inputs.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.session import configure

USERS_PER_STATION = 10


def events(spark: SparkSession, folder: str) -> DataFrame:
    table = configure(spark).read.parquet(f"{folder}/events.parquet")
    return table.withColumn("ts", F.col("ts").cast("timestamp"))


def _hourly(log: DataFrame, users: int, late: str = "0"):
    return log.groupBy(
        F.floor(F.col("user_id") / users).cast("int").alias("station_id"),
        (F.date_trunc("hour", F.col("ts")) + F.expr(f"INTERVAL {late} HOURS")).alias("timestamp"))


def air_quality(spark: SparkSession, folder: str, users: int = USERS_PER_STATION) -> DataFrame:
    value = F.col("value")

    def peak(kind: str, scale: float):
        return F.max(F.when(F.col("event_type") == kind, value)) * F.lit(scale)

    return _hourly(events(spark, folder), users).agg(
        peak("view", 0.6).alias("pm2_5"),
        peak("click", 1.2).alias("pm10"),
        peak("purchase", 3.0).alias("no2"),
        peak("signup", 2.0).alias("so2"),
        peak("error", 1.0).alias("o3"),
        (F.max(value) * F.lit(20.0)).alias("co"))


def weather(spark: SparkSession, folder: str, users: int = USERS_PER_STATION) -> DataFrame:
    log = events(spark, folder).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return _hourly(log, users, late="1").agg(
        (F.max("k") * F.lit(0.4)).alias("temperature"),
        (F.min("k") * F.lit(1.0)).alias("humidity"),
        (F.max("value") * F.lit(0.1)).alias("wind_speed"),
        (F.max(F.when(F.col("event_type") == "click", F.col("k"))) * F.lit(3.6))
        .alias("wind_direction"),
        (F.lit(1000.0) + F.min("value")).alias("pressure"))


def observations(spark: SparkSession, folder: str, users: int = USERS_PER_STATION) -> DataFrame:
    from hazecast.operators.matching import join_observations
    return join_observations(air_quality(spark, folder, users), weather(spark, folder, users))
