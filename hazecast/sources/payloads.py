"""Hourly JSON payloads: a struct of parallel arrays per document."""

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazecast.fixed_values import AIR_QUALITY_FIELDS, WEATHER_FIELDS
from hazecast.functions.cleaning import normalize_nan


def payload_schema(fields: dict[str, str]) -> T.StructType:
    """Values are read as text: one bad number must not cost its whole document."""
    hourly = T.StructType([T.StructField(name, T.ArrayType(T.StringType()))
                           for name in ("time", *fields)])
    return T.StructType([T.StructField("station_id", T.StringType()),
                         T.StructField("hourly", hourly),
                         T.StructField("_broken", T.StringType())])


def _when(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm")),
                      F.try_to_timestamp(text))


def unfold(payloads: DataFrame, fields: dict[str, str], default_station: int = 0,
           keep: list[str] = ()) -> DataFrame:
    """One row per hour of each payload, under the engine's column names.

    A document without a station belongs to ``default_station``. What is no number becomes
    null, and so do the values of a field that a document lacks.
    """
    def cell(name: str) -> Column:
        return F.coalesce(F.col(f"hourly.`{name}`"), F.array().cast("array<string>")).alias(name)

    station = F.coalesce(F.col("station_id").try_cast("int"), F.lit(default_station))
    rows = payloads.filter(F.col("hourly.time").isNotNull()).select(
        station.alias("station_id"), *keep,
        F.inline(F.arrays_zip(F.col("hourly.time").alias("time"), *[cell(name) for name in fields])))
    return normalize_nan(rows.filter(F.col("time").isNotNull()).select(
        "station_id", _when(F.col("time")).alias("timestamp"),
        *[F.col(name).try_cast("double").alias(column) for name, column in fields.items()], *keep))


def rejected(payloads: DataFrame) -> DataFrame:
    """(reason, documents): documents that give no hour, counted; and those that do."""
    reason = (F.when(F.col("hourly.time").isNotNull(), "accepted")
              .when(F.col("_broken").isNotNull(), "malformed").otherwise("no hourly data"))
    return payloads.groupBy(reason.alias("reason")).agg(F.count("*").alias("documents"))


def unread_files(payloads: DataFrame) -> list[str]:
    """Files that gave no document: empty, or so broken that they were passed over."""
    seen = {r[0] for r in payloads.select("_file").distinct().collect()}  # names of files only
    return sorted(f for f in payloads.inputFiles() if plain_path(f) not in seen)


def cut_archives(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(file, reason) of gzip files that do not decompress to their end.

    A read passes over the rest of such a file, so the documents before the break look like
    all of it. Each file is decompressed once more, a piece at a time, and only names of
    damaged ones reach the driver. A plain file that was cut shows as a malformed document.
    """
    def check(batches):
        for batch in batches:
            found = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reason = _gzip_damage(content)
                if reason:
                    found.append((path, reason))
            yield pa.RecordBatch.from_pydict({"file": [f for f, _ in found], "reason": [r for _, r in found]},
                                             pa.schema([("file", pa.string()), ("reason", pa.string())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(paths).select("path", "content")
    return sorted((plain_path(r.file), r.reason) for r in files.mapInArrow(check, "file string, reason string").collect())


def _gzip_damage(content: bytes) -> str | None:
    """What is wrong with a gzip file of one or more members."""
    if not content:
        return "empty"
    rest = content
    while rest:
        member = zlib.decompressobj(wbits=31)
        try:
            while rest and not member.eof:
                member.decompress(rest, 1 << 20)  # the output is not kept
                rest = member.unused_data if member.eof else member.unconsumed_tail
        except zlib.error as reason:
            return f"damaged: {reason}"
        if not member.eof:
            return "cut short"
    return None


def plain_path(path: str) -> str:
    return re.sub(r"^file:/+", "file:/", path)


def read_payloads(spark: SparkSession, paths, fields: dict[str, str],
                  multi_line: bool = False) -> DataFrame:
    """Payload documents, broken ones marked in ``_broken``, with their ``_file``.

    A file that breaks while it is read (a cut archive) gives the documents before the break.

    One document per line by default, so that large files split; whole-file
    documents with ``multi_line``.
    """
    return (spark.read.schema(payload_schema(fields))
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_broken")
            .option("allowNonNumericNumbers", True)
            .option("ignoreCorruptFiles", True)
            .json(paths, multiLine=multi_line)
            .withColumn("_file", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")))


def require_hourly(payloads: DataFrame) -> None:
    """Stop if no payload holds hourly data."""
    if payloads.filter(F.col("hourly.time").isNotNull()).isEmpty():
        raise ValueError("no payload with hourly data")


def _read(spark, paths, fields, multi_line, check, default_station, keep):
    payloads = read_payloads(spark, paths, fields, multi_line)
    if check:
        require_hourly(payloads)
    return unfold(payloads, fields, default_station, keep)


def read_air_quality(spark: SparkSession, paths, multi_line: bool = False, check: bool = True,
                     default_station: int = 0, keep: list[str] = ()) -> DataFrame:
    return _read(spark, paths, AIR_QUALITY_FIELDS, multi_line, check, default_station, keep)


def read_weather(spark: SparkSession, paths, multi_line: bool = False, check: bool = True,
                 default_station: int = 0, keep: list[str] = ()) -> DataFrame:
    return _read(spark, paths, WEATHER_FIELDS, multi_line, check, default_station, keep)


def to_payloads(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Fold hourly rows to one payload per station and day.

    A group holds the hours of one day, so the lists are at most 24 long.
    """
    cells = F.sort_array(F.collect_list(F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm").alias("time"),
        *[F.col(column).alias(name) for name, column in fields.items()])))
    days = rows.groupBy("station_id", F.to_date("timestamp").alias("day")).agg(
        cells.alias("c"))
    return days.select("station_id", F.struct(
        F.col("c.time").alias("time"),
        *[F.col(f"c.{name}").alias(name) for name in fields]).alias("hourly"))


def write_payloads(rows: DataFrame, fields: dict[str, str], path: str) -> None:
    (to_payloads(rows, fields).write.mode("overwrite")
     .option("ignoreNullFields", False).json(path))
