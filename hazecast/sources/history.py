"""Range reads, recent reads and backfill by chunks."""

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.fixed_values import BACKFILL_CHUNK_DAYS, RECENT_DAYS
from hazecast.operators.matching import KEY, join_observations, keep_first
from hazecast.sources.payloads import cut_archives, plain_path


def with_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date("timestamp"))


def write_raw(df: DataFrame, path: str) -> None:
    """Raw observations by day; skewed days are split by the rebalance."""
    (with_date(df).hint("rebalance", "date")
     .write.mode("overwrite").partitionBy("date").parquet(path))


def read_range(spark: SparkSession, path: str, first_day: str, last_day: str) -> DataFrame:
    """Rows of the days first..last, both included; other days are pruned."""
    return in_range(spark.read.parquet(path), first_day, last_day).drop("date")


def in_range(df: DataFrame, first_day: str, last_day: str) -> DataFrame:
    day = F.col("date") if "date" in df.columns else F.to_date("timestamp")
    return df.filter(day.between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))


def recent(df: DataFrame, past_days: int = RECENT_DAYS,
           forecast_days: int = 0, now: str | None = None) -> DataFrame:
    """Rows from ``past_days`` before ``now`` to ``forecast_days`` after it.

    ``now`` is the newest row's time when not given: one aggregated row, read
    as a scalar subquery.
    """
    if now is None:
        moment = df.agg(F.max("timestamp").alias("newest")).scalar()
    else:
        moment = F.lit(now).cast("timestamp")
    first = moment - F.expr(f"INTERVAL {past_days} DAYS")
    last = moment + F.expr(f"INTERVAL {forecast_days} DAYS")
    wanted = F.col("timestamp").between(first, last)
    if "date" in df.columns:  # lets a table stored by day skip the other days
        wanted &= F.col("date").between(F.to_date(first), F.to_date(last))
    return df.filter(wanted)


def chunk_ranges(spans: DataFrame, chunk_days: int = BACKFILL_CHUNK_DAYS,
                 strict: bool = False) -> DataFrame:
    """Consecutive ranges of ``chunk_days`` days covering start_date..end_date.

    With ``strict`` a last chunk of one day, the end date, is left out.
    """
    rest = [c for c in spans.columns if c not in ("start_date", "end_date")]
    starts = F.sequence("start_date", "end_date", F.expr(f"INTERVAL {chunk_days} DAYS"))
    chunks = spans.select(*rest, "end_date", F.posexplode(starts).alias("chunk", "chunk_start"))
    if strict:
        chunks = chunks.filter(F.col("chunk_start") < F.col("end_date"))
    return chunks.select(
        *rest, "chunk", "chunk_start",
        F.least(F.date_add("chunk_start", chunk_days - 1), F.col("end_date"))
        .alias("chunk_end"))


def join_chunks(air: DataFrame, weather: DataFrame) -> DataFrame:
    """Chunks (``ingest_seq``) joined each on its own; of a repeated hour the earliest stays."""
    return keep_first(join_observations(air, weather, [*KEY, "ingest_seq"])).drop("ingest_seq")


def _existing(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Of ``paths`` those that exist, with the name Spark gives their files' folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = {}
    for path in paths:
        name = jvm.org.apache.hadoop.fs.Path(path)
        files = name.getFileSystem(conf)
        if files.exists(name):
            found[path] = plain_path(files.makeQualified(name).toString())
    return found


def _chunked(spark: SparkSession, folders: dict[str, int], read: Callable) -> DataFrame:
    """All folders read at once, each row with the number of its folder's chunk."""
    chunks = spark.createDataFrame(list(folders.items()), "_folder string, ingest_seq bigint")
    rows = read(spark, list(folders), check=False, keep=["_file"])
    folder = F.regexp_replace("_file", "/[^/]*$", "")
    return rows.withColumn("_folder", folder).join(chunks, "_folder").drop("_folder", "_file")


def backfill(spark: SparkSession, folders: list[tuple[str, str]],
             read_air: Callable, read_weather: Callable) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Read and join (air, weather) folder pairs; skip chunks that fail.

    One read per source for all chunks. Returns the combined table and what was skipped, with
    reasons: folders that are missing, or without an hour in them, be they empty or broken
    throughout; and files of the other folders that were read only up to a break. Chunk
    numbers that have rows and names of damaged files are all the driver sees.
    """
    known = _existing(spark, [p for pair in folders for p in pair])
    here = {n: pair for n, pair in enumerate(folders) if pair[0] in known and pair[1] in known}
    skipped = {n: "no such folder" for n in range(len(folders)) if n not in here}
    if not here:
        raise RuntimeError("no chunk could be read")
    air = _chunked(spark, {known[a]: n for n, (a, _) in here.items()}, read_air)
    weather = _chunked(spark, {known[w]: n for n, (_, w) in here.items()}, read_weather)
    filled = [{r[0] for r in side.select("ingest_seq").distinct().collect()} for side in (air, weather)]
    skipped |= {n: "no hourly data" for n in here if n not in filled[0] & filled[1]}
    if len(skipped) == len(folders):
        raise RuntimeError("no chunk could be read")
    used = [known[p] for n, pair in here.items() if n not in skipped for p in pair]
    return join_chunks(air, weather), [(folders[n][0], skipped[n]) for n in sorted(skipped)] + cut_archives(spark, used)


def first_available(readers: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that can be read and has rows, in order of preference."""
    reasons = []
    for read in readers:
        try:
            table = read()
            if not table.isEmpty():
                return table
            reasons.append("empty")
        except (PySparkException, Py4JJavaError, ValueError) as reason:
            reasons.append(str(reason).splitlines()[0])
    raise RuntimeError("no source available: " + "; ".join(reasons))
