"""An index of series: what a changed row reaches, without reading the series.

One row per station and cut of 256 hours: how many rows it has, where in it each windowed
column is known first and last, and the state of the exponentially weighted means after its
last row. A batch renews the rows of the cuts it touches and of those whose means it moves.

Row counts give positions. From them follows which rows a change at positions p1..p2 reaches:

* the 72 rows before p1, whose targets look ahead;
* rows up to the first known value at p2 + 512 or later: there an earlier value weighs less
  than a double keeps. A mean stands still over nulls, so the row of that value ends it, per
  column.

Features of those rows are made from whole cuts around them (24 rows back, 72 ahead). Each
run of cuts is a series of its own, a slice, that starts with the state of the cut before it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from hazecast.fixed_values import EWMA_SPANS, WINDOWED
from hazecast.functions import aqi
from hazecast.operators import layout
from hazecast.operators.windows import HALO_AHEAD, HALO_BACK, state_columns, with_window_features
from hazecast.sources.feature_store import FeatureStore

CUT_HOURS = 256
CUT_MS = CUT_HOURS * 3_600_000
# Positions after which a value's weight vanishes from a mean (see ``operators.windows``).
EWMA_REACH = 512

KNOWN = [f"{c}_{end}" for c in WINDOWED for end in ("first", "last")]


def store(spark: SparkSession, raw_path: str) -> FeatureStore:
    """The index of a raw store; ``timestamp`` is the start of a cut."""
    return FeatureStore(spark, f"{raw_path}/series")


def with_time(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.timestamp_millis("timestamp"))


def _cut():
    return F.floor(layout.epoch_hours(F.col("timestamp")) / F.lit(CUT_HOURS)).cast("bigint")


def _ranked(rows: DataFrame) -> DataFrame:
    """Add ``cut`` and ``rank``, the place in it; rows carry ``timestamp`` as a time."""
    order = Window.partitionBy("station_id", "cut").orderBy("timestamp")
    return rows.withColumn("cut", _cut()).withColumn("rank", F.row_number().over(order) - 1)


def _summary():
    """Aggregates of ranked rows of one cut."""
    known = []
    for c in WINDOWED:
        place = F.when(F.col(c).isNotNull(), F.col("rank")).cast("bigint")
        known += [F.min(place).alias(f"{c}_first"), F.max(place).alias(f"{c}_last")]
    return [F.count("*").alias("rows"), *known]


def _days(cuts: DataFrame) -> list:
    """Calendar days that cuts overlap. One number per cut of the calendar, whatever the stations."""
    span = F.sequence(F.to_date(F.timestamp_millis(F.col("cut") * CUT_MS)),
                      F.to_date(F.timestamp_millis((F.col("cut") + 1) * CUT_MS - 1)))
    return [r.day for r in cuts.select("cut").distinct().select(F.explode(span).alias("day")).distinct().collect()]


def _stored_form(df: DataFrame) -> DataFrame:
    return df.select("station_id", (F.col("cut") * CUT_MS).alias("timestamp"), "rows", *KNOWN, *state_columns())


def rebuild(spark: SparkSession, raw_path: str, block_rows: int = layout.BLOCK_ROWS) -> None:
    """The whole index from the raw store: reads three columns of every row."""
    raw = with_time(FeatureStore(spark, raw_path).read())
    rows = aqi.with_aqi(raw).select("station_id", "timestamp", *WINDOWED)
    means = with_window_features(rows, ["ewma"], block_rows=block_rows, weights=True)
    made = means.select("*", *[F.col(f"{c}_ewma_{n}h").alias(f"{c}_mean_{n}") for c in WINDOWED for n in EWMA_SPANS])
    ends = made.withColumn("cut", _cut()).groupBy("station_id", "cut").agg(
        *[F.max_by(c, "timestamp").alias(c) for c in state_columns()])
    counted = _ranked(rows).groupBy("station_id", "cut").agg(*_summary())
    store(spark, raw_path).upsert(_stored_form(counted.join(ends, ["station_id", "cut"])))


def touched(batch: DataFrame, raw: FeatureStore, index: FeatureStore) -> DataFrame:
    """The index of the batch's stations as it is after the batch, without new states.

    Touched cuts are counted again from the raw store, and have ``r1`` and ``r2``, the first
    and last changed row in them. Days of other cuts are not opened.
    """
    changes = batch.filter("timestamp IS NOT NULL").groupBy("station_id", _cut().alias("cut")).agg(
        F.min("timestamp").alias("since"), F.max("timestamp").alias("until"))
    rows = aqi.with_aqi(with_time(raw.read_days(_days(changes))))
    here = _ranked(rows.select("station_id", "timestamp", *WINDOWED)).join(changes, ["station_id", "cut"])
    counted = here.groupBy("station_id", "cut").agg(
        *_summary(), F.min(F.when(F.col("timestamp") >= F.col("since"), F.col("rank"))).alias("r1"),
        F.max(F.when(F.col("timestamp") <= F.col("until"), F.col("rank"))).alias("r2"))
    fresh = counted.select("station_id", "cut", F.struct("rows", *KNOWN, "r1", "r2").alias("n"))
    if not index.exists():
        return fresh.select("station_id", "cut", "n.*",
                            *[F.lit(None).cast("double").alias(c) for c in state_columns()])
    stations = changes.select("station_id").distinct()
    old = index.read().join(stations, "station_id", "left_semi").select(
        "station_id", F.expr(f"timestamp div {CUT_MS}").alias("cut"), F.struct("rows", *KNOWN).alias("o"), *state_columns())
    both = old.join(fresh, ["station_id", "cut"], "full_outer")
    return both.select(
        "station_id", "cut", *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
                               for c in ("rows", *KNOWN)], "n.r1", "n.r2", *state_columns())


def slices(now: DataFrame) -> DataFrame:
    """Cuts to read: their ``slice`` (its first cut) and where that begins, first position, and the rows to make again.

    ``low`` and ``high`` bound the positions made again in a cut; a cut with context alone has
    none. A station's index is one window group: one row per 256 hours.
    """
    station = Window.partitionBy("station_id")
    ahead = station.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    before = station.orderBy("cut")
    placed = now.withColumns({
        "p": F.coalesce(F.sum("rows").over(ahead), F.lit(0)), "total": F.sum("rows").over(station),
        "number": F.row_number().over(before),
        **{f"before_{c}": F.lag(c).over(before) for c in state_columns()}})
    # a probe per touched cut looks for the known value that ends its reach
    marks = placed.select("station_id", F.col("p").alias("at"), F.lit(1).alias("kind"),
                          *[(F.col("p") + F.col(f"{c}_first")).alias(c) for c in WINDOWED],
                          F.lit(None).cast("bigint").alias("low"), "total")
    probes = placed.filter("r1 IS NOT NULL").select(
        "station_id", (F.col("p") + F.col("r2") + EWMA_REACH).alias("at"), F.lit(0).alias("kind"),
        *[F.lit(None).cast("bigint").alias(c) for c in WINDOWED],
        F.greatest(F.col("p") + F.col("r1") - HALO_AHEAD, F.lit(0)).alias("low"), "total")
    onward = station.orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    met = marks.unionByName(probes).withColumn("high", F.greatest(
        *[F.coalesce(F.first(c, ignorenulls=True).over(onward), F.col("total")) for c in WINDOWED]) - 1)
    reach = met.filter("kind = 0").select("station_id", "low", "high")
    # ranges that meet are one
    so_far = station.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    apart = reach.withColumn("new", F.coalesce(F.col("low") > F.max("high").over(so_far) + 1, F.lit(True)).cast("int"))
    joined = apart.withColumn("run", F.sum("new").over(station.orderBy("low", "high").rowsBetween(
        Window.unboundedPreceding, 0))).groupBy("station_id", "run").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).drop("run")
    near = (F.col("c.station_id") == F.col("r.station_id")) & (F.col("c.p") <= F.col("r.high") + HALO_AHEAD) & (
        F.col("c.p") + F.col("c.rows") > F.col("r.low") - HALO_BACK)
    cuts = placed.alias("c").join(joined.alias("r"), near).groupBy("c.station_id", "c.cut").agg(
        F.first("p").alias("p"), F.first("number").alias("number"), F.first("rows").alias("rows"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.first(f"before_{c}").alias(c) for c in state_columns()])
    run = F.col("number") - F.row_number().over(before)
    part = Window.partitionBy("station_id", "run")
    return cuts.withColumn("run", run).withColumns({
        "slice": F.min("cut").over(part), "slice_p": F.min("p").over(part)}).drop("run", "number")


def _series():
    return F.struct("station_id", "slice").alias("station_id")


def seeds(plan: DataFrame) -> DataFrame:
    """The state each slice starts with: that of the cut before it."""
    return plan.filter(F.col("cut") == F.col("slice")).select(_series(), *state_columns())


def rows_of(plan: DataFrame, raw: FeatureStore) -> DataFrame:
    """Raw rows of the slices, each a series of its own with known positions; ``remake`` tells rows to make again."""
    rows = with_time(raw.read_days(_days(plan))).drop("ingest_seq")
    wanted = plan.select("station_id", "cut", "slice", "p", F.col("rows").alias("cut_rows"), "low", "high", "slice_p")
    placed = _ranked(rows).join(wanted, ["station_id", "cut"])
    pos = F.col("p") + F.col("rank")
    return placed.select(
        _series(), *[c for c in rows.columns if c != "station_id"], pos.between(F.col("low"), F.col("high")).alias("remake"),
        "cut", (F.col("rank") == F.col("cut_rows") - 1).alias("cut_end"),
        (pos - F.col("slice_p")).alias("pos"))


def renewed(now: DataFrame, made: DataFrame) -> DataFrame:
    """Index rows to write: cuts counted again, and cuts whose last row was made again."""
    ends = made.filter("cut_end").select("station_id", "cut", F.struct(
        *[F.col(f"{c}_ewma_{n}h").alias(f"{c}_mean_{n}") for c in WINDOWED for n in EWMA_SPANS],
        *[c for c in made.columns if "_weight_" in c]).alias("e"))
    both = now.join(ends, ["station_id", "cut"], "left").filter("r1 IS NOT NULL OR e IS NOT NULL")
    return _stored_form(both.select("station_id", "cut", "rows", *KNOWN, *[
        F.when(F.col("e").isNotNull(), F.col(f"e.{c}")).otherwise(F.col(c)).alias(c) for c in state_columns()]))
