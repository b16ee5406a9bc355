"""Row positions and blocks: windows over a series without one task per series.

Frames count rows, so a row needs its position in its station's series. The
series is cut by time first (``positions``): rows are numbered inside a cut and
the cuts' row counts, one row per station and cut, are summed along the series.
With positions known, ``blocks_with_halo`` cuts the series into equal blocks
and copies to each the few neighbours its frames reach. Every window then runs
per (station, block), however long a station's series is.

The tables summed along a series have one row per ``CUT_HOURS`` hours, which
is under 900 rows per station and century, whatever the number of readings.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

CUT_HOURS = 1024
BLOCK_ROWS = 1024

# Weights of a block's first rows grow as (span + 1) / (span - 1) per row; with
# span 6 they stay in a double's range for 2000 rows.
MAX_BLOCK_ROWS = 2000


def epoch_hours(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(3600.0)).cast("bigint")


def positions(df: DataFrame, cut_hours: int = CUT_HOURS) -> DataFrame:
    """Add ``pos`` (0-based row position by time) and ``series_rows``.

    (station_id, timestamp) is unique: see ``matching.keep_first``.
    """
    cut = F.floor(epoch_hours(F.col("timestamp")) / F.lit(cut_hours)).cast("bigint")
    rows = df.withColumn("_cut", cut)
    sizes = rows.groupBy("station_id", "_cut").agg(F.count("*").alias("_n"))
    series = Window.partitionBy("station_id")
    before = series.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "station_id", "_cut",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(series).alias("series_rows"))
    in_cut = Window.partitionBy("station_id", "_cut").orderBy("timestamp")
    numbered = rows.withColumn("_rank", F.row_number().over(in_cut))
    return (numbered.join(offsets, ["station_id", "_cut"])
            .withColumn("pos", F.col("_offset") + F.col("_rank") - 1)
            .drop("_cut", "_offset", "_rank"))


def known_positions(df: DataFrame, columns: list[str], cut_hours: int = CUT_HOURS) -> DataFrame:
    """Add ``pos_{c}`` and ``rows_{c}`` per column: rows of the series before this one, and in all, that have c.

    All columns share one exchange; (station_id, timestamp) is unique.
    """
    cut = F.floor(epoch_hours(F.col("timestamp")) / F.lit(cut_hours)).cast("bigint")
    rows = df.withColumn("_cut", cut)
    sizes = rows.groupBy("station_id", "_cut").agg(*[F.count(c).alias(f"_n_{c}") for c in columns])
    series = Window.partitionBy("station_id")
    before = series.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("station_id", "_cut", *[p for c in columns for p in (
        F.coalesce(F.sum(f"_n_{c}").over(before), F.lit(0)).alias(f"_offset_{c}"),
        F.sum(f"_n_{c}").over(series).alias(f"rows_{c}"))])
    in_cut = Window.partitionBy("station_id", "_cut").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.select("*", *[F.count(c).over(in_cut).alias(f"_rank_{c}") for c in columns])
    return (numbered.join(offsets, ["station_id", "_cut"])
            .withColumns({f"pos_{c}": F.col(f"_offset_{c}") + F.col(f"_rank_{c}") for c in columns})
            .drop("_cut", *[f"_{kind}_{c}" for c in columns for kind in ("offset", "rank")]))


def hour_positions(df: DataFrame) -> DataFrame:
    """Add ``pos`` as hours since the epoch, for frames that count hours."""
    return df.withColumn("pos", epoch_hours(F.col("timestamp")))


def check_block(block_rows: int) -> None:
    if not 512 <= block_rows <= MAX_BLOCK_ROWS:
        raise ValueError(f"block_rows must lie in 512..{MAX_BLOCK_ROWS}")


def with_block(df: DataFrame, block_rows: int) -> DataFrame:
    check_block(block_rows)
    block = F.floor(F.col("pos") / F.lit(block_rows)).cast("bigint")
    return df.withColumn("block", block)


def blocks_with_halo(df: DataFrame, block_rows: int,
                     back: int, ahead: int, from_zero: bool = False) -> DataFrame:
    """Copy each row to every block whose frames reach it.

    ``block`` is the block a copy goes to, ``own`` tells the row's own block
    from the others; a block's frames see ``back`` rows before and ``ahead``
    rows after it. Where positions count ``from_zero``, no copy goes to a block
    before the first.
    """
    def block(pos: Column) -> Column:
        return F.floor(pos / F.lit(block_rows)).cast("bigint")

    check_block(block_rows)
    pos = F.col("pos")
    first = F.greatest(pos - ahead, F.lit(0)) if from_zero else pos - ahead
    return (df.withColumn("block", F.explode(F.sequence(block(first), block(pos + back))))
            .withColumn("own", F.col("block") == block(pos)))
