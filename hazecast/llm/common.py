"""Small helpers shared by the operators of this package."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.session import configure, work_folder

#: ASCII white space as a pattern and its complement, as the contracts spell words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


_SCOPES: list[list[str]] = []


#: Spark's setting that deletes a query's shuffle files as it ends, not when the driver happens to collect garbage.
SHUFFLES_DELETED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: lineage ends here, and shuffle files with it."""
    spark = configure(df.sparkSession)
    path, before = work_folder(spark, name), spark.conf.get(SHUFFLES_DELETED, "false")
    spark.conf.set(SHUFFLES_DELETED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_DELETED, before)
    for scope in _SCOPES:
        scope.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


@contextmanager
def noted_tables():
    """The folders that ``stored`` writes while the block runs."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads: all that was made of them is stored too."""
    for table in tables:
        delete_folder(table.sparkSession, table.stored_at)


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know ASCII alone, which is what is asked for.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bucket_of(column: str, modulus: int):
    """crc32 of an id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def small_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20
                  ) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds few bytes (a single row may hold more)."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, int(rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``function`` over the small batches of each partition."""
    return df.mapInArrow(lambda batches: function(small_batches(batches)), schema)
