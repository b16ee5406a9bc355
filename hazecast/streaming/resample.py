"""Daily and weekly means of a stream, each emitted once its period is over."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.streaming.joins import LATENESS, drain, file_stream, with_lateness


def newest_copies(stream: DataFrame, columns: list[str], order: str,
                  lateness: str = LATENESS) -> DataFrame:
    """Of the copies of a (station, time) the one ``order`` puts last, once none can come any more.

    State holds one copy per key until the watermark passes its time; a correction that
    comes later than that is dropped, as any late row is. Nulls in ``order`` lose; of equal
    orders the greatest values win.
    """
    known = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("order"), *columns)
    kept = with_lateness(stream, lateness).groupBy("station_id", "timestamp").agg(F.max(known).alias("kept"))
    return kept.select("station_id", "timestamp", *[f"kept.{c}" for c in columns])


def period_means(stream: DataFrame, columns: list[str], period: str,
                 lateness: str = LATENESS, order: str | None = None) -> DataFrame:
    """Mean per station and period, labelled like ``exploration.resample_mean``.

    With ``order`` a corrected reading counts once, with its newest values: two stateful
    steps, the newest copies and then their means. The epoch is a Thursday, so weeks start four days later, on Monday.
    """
    if period == "day":
        frame = F.window("timestamp", "1 day")
        label = F.to_date("window.start")
    elif period == "week":
        frame = F.window("timestamp", "7 days", "7 days", "4 days")
        label = F.date_sub(F.to_date("window.end"), 1)
    else:
        raise ValueError("period is 'day' or 'week'")
    rows = newest_copies(stream, columns, order, lateness) if order else with_lateness(stream, lateness)
    means = (rows.groupBy("station_id", frame)
             .agg(*[F.avg(c).alias(c) for c in columns]))
    return means.select("station_id", label.alias("period"), *columns)


def run_means(spark: SparkSession, path: str, columns: list[str], period: str, out: str,
              progress: str, lateness: str = LATENESS, order: str | None = None,
              files_per_batch: int | None = None) -> DataFrame:
    stream = file_stream(spark, path, files_per_batch)
    return drain(period_means(stream, columns, period, lateness, order), out, progress)
