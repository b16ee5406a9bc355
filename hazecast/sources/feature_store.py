"""Feature store: Parquet by day, one row per (station, hour), keyed upsert.

An upsert writes the days it touches into a folder of its own, a version, and then lists
them: one small file with a row per day, its version, its rows and its first and last time.
That file is the switch. A reader takes each day from the newest version listed, so it sees
all days of an upsert or none, whenever a writer stops; files it has begun to read stay until
``vacuum``. One writer at a time: of two that touch a day together, the later would win.

The listing also answers what would else be a scan: rows, days, the newest hour.
"""

import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.functions import cleaning
from hazecast.operators.matching import KEY, keep_last


def sanitize(df: DataFrame, order: str = "ingest_seq", strict: bool = False) -> DataFrame:
    """Headers, keys, all-null rows and repeated keys set right (last stays)."""
    named = cleaning.normalize_headers(df)
    if "timestamp" not in named.columns:
        raise ValueError("a feature table needs a timestamp column")
    keyed = cleaning.normalize_timestamp(named, strict=strict)
    useful = cleaning.drop_all_null_pollutants(cleaning.normalize_nan(keyed))
    key = [c for c in KEY if c in useful.columns]
    if order not in useful.columns:
        raise ValueError(f"'{order}' must tell which copy of a key came last")
    return keep_last(useful, order, key)


def merged(existing: DataFrame, batch: DataFrame, keep_known: bool = False) -> DataFrame:
    """Existing rows replaced by, and extended with, the batch's rows.

    A batch row replaces every field, nulls included. With ``keep_known`` a
    null leaves the stored value alone.
    """
    values = [c for c in batch.columns if c not in KEY]
    stored = [c for c in existing.columns if c not in KEY]
    if not keep_known and set(stored) <= set(values):
        # the batch's rows replace whole rows: they stay where they are, and only their keys meet the stored ones
        untouched = existing.join(batch.select(*KEY), KEY, "left_anti")
        return batch.select(*KEY, *values).unionByName(untouched, allowMissingColumns=True)
    # a struct per side tells "no row" from "a row of nulls" after the join
    old = existing.select(*KEY, F.struct(*stored).alias("o"))
    new = batch.select(*KEY, F.struct(*values).alias("n"))

    def field(c: str) -> str:
        if c not in values:
            return f"o.`{c}` AS `{c}`"
        if c not in stored:
            return f"n.`{c}` AS `{c}`"
        if keep_known:
            return f"coalesce(n.`{c}`, o.`{c}`) AS `{c}`"
        return f"CASE WHEN n IS NOT NULL THEN n.`{c}` ELSE o.`{c}` END AS `{c}`"

    columns = values + [c for c in stored if c not in values]
    return old.join(new, KEY, "full_outer").selectExpr(*KEY, *[field(c) for c in columns])


def newest(existing: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Of stored and new copies of a key, the one ``order`` puts last."""
    return keep_last(existing.unionByName(batch, allowMissingColumns=True), order, KEY)


def report(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows prepared, inserted and updated: one row."""
    old = existing.select(*KEY, F.lit(True).alias("stored"))
    return batch.select(*KEY).join(old, KEY, "left").agg(
        F.count("*").alias("prepared"),
        F.count_if(F.col("stored").isNull()).alias("inserted"),
        F.count_if(F.col("stored").isNotNull()).alias("updated"))


def key_uniqueness(df: DataFrame) -> DataFrame:
    """Rows, distinct keys and whether they agree: one row.

    Counted per key first, so a repeated key collapses before the shuffle.
    """
    per_key = df.groupBy(*KEY).agg(F.count("*").alias("copies"))
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.count("*").alias("key_count"),
        F.coalesce(F.max("copies") == 1, F.lit(True)).alias("is_unique"))


# what Spark says of a folder that is not there or holds no file yet
ABSENT = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}
LISTING = "version string, date date, rows bigint, first bigint, last bigint"


def day_of():
    return F.to_date(F.timestamp_millis("timestamp"))


class FeatureStore:
    """A feature table in one folder.

    With ``merge_schema`` days written before a column existed and days that
    have it are read as one table; it costs a look into every file's footer.
    """

    def __init__(self, spark: SparkSession, path: str, merge_schema: bool = False):
        self.spark = spark
        self.path = path
        self.merge_schema = merge_schema

    # --- what is listed -------------------------------------------------------

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(LISTING).parquet(f"{self.path}/listing")
        except AnalysisException as reason:
            if reason.getCondition() in ABSENT:
                return None
            raise

    def days(self) -> DataFrame:
        """One row per day: its version, rows, first and last ``timestamp``. Reads no data."""
        commits = self._commits()
        if commits is None:
            return self.spark.createDataFrame([], LISTING)
        rest = F.struct("version", "rows", "first", "last")
        return commits.groupBy("date").agg(F.max(rest).alias("d")).select(
            "d.version", "date", "d.rows", "d.first", "d.last").filter("rows > 0")

    def exists(self) -> bool:
        return not self.days().isEmpty()

    def overview(self) -> DataFrame:
        """Rows, days, first and last ``timestamp`` of the store, from its listing: one row."""
        return self.days().agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"), F.count("*").alias("day_count"),
            F.min("first").alias("first"), F.max("last").alias("last"))

    # --- reading --------------------------------------------------------------

    def _table(self, days: list | None = None, between: tuple | None = None) -> DataFrame:
        """Rows of all days, of those named, or of those between two; ``date`` is kept.

        The listing comes to the driver: one row per day of the store. Only folders of
        wanted days are opened.
        """
        wanted = self.days()
        if days is not None:
            wanted = wanted.filter(F.col("date").isin(days))
        if between is not None:
            wanted = wanted.filter(F.col("date").between(*between))
        listed = [(r.version, str(r.date)) for r in wanted.select("version", "date").collect()]
        if not listed:
            raise ValueError(f"the feature store {self.path} is empty")
        root = f"{self.path}/data"
        table = self.spark.read.option("mergeSchema", self.merge_schema).option("basePath", root).parquet(
            *[f"{root}/version={v}/date={d}" for v, d in listed])
        return table.drop("version")

    def read(self) -> DataFrame:
        """Every row, ``timestamp`` in epoch milliseconds, in no set order."""
        return self._table().drop("date")

    def read_days(self, days: list) -> DataFrame:
        """Rows of the named days; files of other days are not opened. No row if none is stored."""
        try:
            return self._table(days=days).drop("date")
        except ValueError:
            return self.read().limit(0)

    def recent(self, past_days: int) -> DataFrame:
        """Rows of the ``past_days`` days before the newest hour, which the listing knows."""
        last = self.overview().first()["last"]
        if last is None:
            raise ValueError(f"the feature store {self.path} is empty")
        first = last - past_days * 86_400_000
        edges = self.spark.range(1).select(*[F.to_date(F.timestamp_millis(F.lit(t))) for t in (first, last)]).first()
        return self._table(between=tuple(edges)).drop("date").filter(F.col("timestamp") >= first)

    def training_scan(self) -> DataFrame:
        """Every row, for training; stops when there is none."""
        return self.read()

    # --- writing --------------------------------------------------------------

    def _stage(self, rows: DataFrame) -> str:
        """Write rows as a new version that no reader sees yet; returns its name."""
        commits = self._commits()
        newest = commits.agg(F.max("version")).first()[0] if commits is not None else None
        number = int(newest.split("-")[0]) + 1 if newest else 0
        version = f"{number:010d}-{uuid.uuid4().hex[:8]}"
        # the rebalance gathers a day's rows, and splits a day that is too big
        (rows.withColumn("date", day_of()).hint("rebalance", "date")
         .write.partitionBy("date").parquet(f"{self.path}/data/version={version}"))
        return version

    def _list(self, version: str) -> None:
        """Put a version's days in the listing: one file, so all of them at once."""
        written = self.spark.read.schema("timestamp bigint, date date").parquet(
            f"{self.path}/data/version={version}")
        (written.groupBy("date").agg(
            F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
         .select(F.lit(version).alias("version"), "date", "rows", "first", "last")
         .coalesce(1).write.mode("append").parquet(f"{self.path}/listing"))

    def _rows(self) -> int:
        return self.overview().first()["row_count"]

    def upsert(self, batch: DataFrame, keep_known: bool = False,
               order: str | None = None, cached: bool = False) -> dict[str, int]:
        """Write sanitised rows (epoch-millisecond ``timestamp``, unique keys).

        A row without a time has no key and is left out. With ``order`` a stored copy stays where it is the newer one. Returns how many rows
        were prepared, inserted and updated; the listing tells how many the store gained.
        ``cached`` says that the batch is read from rows already kept, so no second copy is made of it.
        """
        batch = batch.filter(F.col("timestamp").isNotNull())
        if not cached:
            batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # a batch touches at most one day per calendar day it covers
            touched = {r.day: r.n for r in batch.groupBy(day_of().alias("day")).agg(F.count("*").alias("n")).collect()}
            before = self._rows()
            rows = batch
            if before:
                try:
                    existing = self._table(days=list(touched)).drop("date")
                    rows = newest(existing, batch, order) if order else merged(existing, batch, keep_known)
                except ValueError:
                    pass  # none of these days is stored
            prepared = sum(touched.values())
            if prepared:
                self._list(self._stage(rows))
            inserted = self._rows() - before
            return {"prepared": prepared, "inserted": inserted, "updated": prepared - inserted}
        finally:
            if not cached:
                batch.unpersist()

    def vacuum(self) -> int:
        """Delete files of days that newer versions replaced; returns how many folders went.

        For quiet times: a reader that began before an upsert may still want them.
        """
        kept = {(r.version, str(r.date)) for r in self.days().select("version", "date").collect()}
        listed = self._commits()
        known = {(r.version, str(r.date)) for r in listed.select("version", "date").collect()} if listed else set()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        gone = 0
        for version, day in sorted(known - kept):
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/version={version}/date={day}")
            gone += bool(folder.getFileSystem(conf).delete(folder, True))
        return gone
