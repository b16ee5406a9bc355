"""Joining the two sources and choosing one row per key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["station_id", "timestamp"]


def join_observations(air: DataFrame, weather: DataFrame,
                      key: list[str] = KEY) -> DataFrame:
    """Rows both sources have. Skewed keys are left to AQE's skew join."""
    return air.join(weather, key, "inner")


def match_report(air: DataFrame, weather: DataFrame,
                 key: list[str] = KEY) -> DataFrame:
    """Rows on each side and rows their inner join would have.

    Only counts per key are shuffled, never the rows, so a key that holds
    many copies on both sides costs one row per side here.
    """
    left = air.groupBy(*key).agg(F.count("*").alias("l"))
    right = weather.groupBy(*key).agg(F.count("*").alias("r"))
    return left.join(right, key, "full_outer").agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("air_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("weather_rows"),
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("matched_rows"))


def _one_per_key(df: DataFrame, key: list[str], order: str, last: bool) -> DataFrame:
    """The row of least or greatest order per key; a null order loses against any other.

    Equal orders are decided by the other columns, the least row for the first and the
    greatest for the last, so every run keeps the same copy. An aggregate, not a ranking
    window: copies of a key collapse before the shuffle, so one key with a third of the rows
    is no hot partition. Rows are wide, so Spark sorts each task's rows by key for it.
    """
    rest = [c for c in df.columns if c not in key]
    missing = F.col(order).isNull()
    ranked = F.struct((~missing if last else missing).alias("_known"), F.col(order).alias("_order"), *rest)
    chosen = df.groupBy(*key).agg((F.max if last else F.min)(ranked).alias("_row"))
    return chosen.select(*key, *[F.col(f"_row.`{c}`") for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, order: str = "ingest_seq",
               key: list[str] = KEY) -> DataFrame:
    return _one_per_key(df, key, order, last=False)


def keep_last(df: DataFrame, order: str = "ingest_seq",
              key: list[str] = KEY) -> DataFrame:
    return _one_per_key(df, key, order, last=True)


def latest_per_station(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Last row by time of every station."""
    return _one_per_key(df, ["station_id"], time, last=True)
