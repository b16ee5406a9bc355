"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

The budget is dealt out by weight. A source whose share exceeds ``most_epochs`` times its
size is clamped there, and what it leaves is dealt among the others by weight, round after
round until no share is above its cap. Each round is one aggregate over the table of
sources (one row each); the driver sees two numbers a round.

Within a source every document is taken ``floor(target / size)`` times; the rest comes from
a prefix of the documents in the order of a seeded digest. The prefix is found in two steps,
so no task holds a source: sizes summed per 3-digit digest prefix, then a running sum
inside each (source, prefix) cell.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazecast.llm.common import WORD, stored

CELL_DIGITS = 3


def sized(docs: DataFrame, text_column: str = "text"):
    """Words in a text; null counts as none."""
    return F.coalesce(F.expr(f"regexp_count(`{text_column}`, r'{WORD}')"), F.lit(0)).cast("long")


def with_ranks(sources: DataFrame) -> DataFrame:
    """Sources numbered from 0 in code point order, null last (Spark sorts strings by byte)."""
    ordered = sources.sort(F.col("source").asc_nulls_last())
    spark = sources.sparkSession
    numbered = ordered.rdd.zipWithIndex().map(lambda pair: (*pair[0], pair[1]))
    return spark.createDataFrame(numbered, "source string, source_size long, docs long, rank long")


def filled(sources: DataFrame, share_halves: int = 3, most_epochs: int = 2) -> DataFrame:
    """``target`` per source of (source, source_size, weight).

    The budget is ``share_halves / 2`` times all sizes. Sizes and weights are whole numbers,
    so sums are exact and a target takes one division: reruns agree in every bit.
    A total weight of zero among unclamped sources ends the rounds.
    """
    if share_halves > 2 * most_epochs:
        raise ValueError("the budget is larger than all caps together")
    cap = F.col("source_size") * most_epochs
    sources = sources.withColumn("clamped", F.lit(False))
    twice_budget = share_halves * (sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        held, weight = sources.agg(
            F.coalesce(F.sum(F.when(F.col("clamped"), cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~F.col("clamped"), F.col("weight"))), F.lit(0))).first()
        rest = twice_budget - 2 * held
        over = ~F.col("clamped") & (F.col("weight") * rest > cap * (2 * weight))
        if not weight or not sources.filter(over).limit(1).count():
            break
        sources = stored(sources.withColumn("clamped", F.col("clamped") | over), "water")
    share = (F.col("weight") * rest).cast("double") / F.lit(float(2 * weight or 1))
    return sources.withColumn("target", F.when(F.col("clamped"), cap.cast("double")).otherwise(share))


def _digest(seed: str, id_column: str):
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary"))


def cuts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share_halves: int = 3,
         most_epochs: int = 2, seed: str = "mix-1", id_column: str = "doc_id",
         text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per source: source, source_size, target, whole, cut_cell, last.

    A document is taken ``whole`` times, and once more if its digest cell is below
    ``cut_cell``, or is that cell and (digest, id, size) is not above ``last``.
    """
    rows = stored(docs.select(
        F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"),
        sized(docs, text_column).alias("size"), _digest(seed, id_column).alias("digest")), "mix")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"),
                                        F.count("*").alias("docs"))
    ranked = with_ranks(totals).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                               (F.col("rank") % len(weights) + 1).cast("int")))
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    sources = stored(filled(ranked, share_halves, most_epochs).withColumn(
        "whole", F.least(whole, F.lit(most_epochs))).withColumn(
        "extra", F.when(F.col("whole") >= most_epochs, 0.0).otherwise(
            F.col("target") - F.col("whole") * F.col("source_size"))), "targets").alias("s")

    cell = F.substring("digest", 1, CELL_DIGITS)
    cells = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    # the one cell of each source in which its share ends
    ends = stored(cells.alias("c").join(sources, F.expr("c.source <=> s.source")).filter(
        (F.col("before") < F.col("extra")) & (F.col("before") + F.col("cell_size") >= F.col("extra"))).select(
        F.col("c.source").alias("source"), "cell", "before", "extra"), "ends").alias("e")
    inside = (Window.partitionBy("source").orderBy("digest", "id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    in_cell = rows.withColumn("cell", cell).alias("r").join(
        ends, F.expr("r.source <=> e.source AND r.cell = e.cell")).select("r.*", "before", "extra")
    # a document joins when that brings the sum nearer to what is wanted
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = in_cell.withColumn("joins", start + F.col("size") / 2.0 < F.col("extra")).filter("joins").groupBy(
        "source").agg(F.max(F.struct("digest", "id", "size")).alias("last")).alias("l")
    # one row per source: stored, so that Spark sees its size when all documents join it
    return stored(sources.join(ends, F.expr("s.source <=> e.source"), "left").join(
        last, F.expr("s.source <=> l.source"), "left").select(
        "s.source", "s.source_size", "s.target", "s.whole", F.col("e.cell").alias("cut_cell"), "l.last"), "cuts")


def with_times(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               source_column: str = "source", seed: str = "mix-1", **settings) -> DataFrame:
    """``docs`` with size, source_size, target and times, each under a name with ``__mix_``."""
    found = cuts(docs, seed=seed, id_column=id_column, text_column=text_column,
                 source_column=source_column, **settings)
    plan = found.select(*[F.col(c).alias(f"__mix_{c}") for c in found.columns])
    own = docs.withColumn("__mix_size", sized(docs, text_column)).withColumn("__mix_digest", _digest(seed, id_column))
    joined = own.join(plan, own[source_column].cast("string").eqNullSafe(plan["__mix_source"]))
    cell = F.substring("__mix_digest", 1, CELL_DIGITS)
    mine = F.struct(F.col("__mix_digest").alias("digest"), F.col(id_column).alias("id"),
                    F.col("__mix_size").alias("size"))
    more = (cell < F.col("__mix_cut_cell")) | ((cell == F.col("__mix_cut_cell")) & (mine <= F.col("__mix_last")))
    return joined.withColumn("__mix_times", F.col("__mix_whole") + F.coalesce(more, F.lit(False)).cast("long"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          source_column: str = "source", **settings) -> DataFrame:
    """Every row of ``docs`` with its id, source, size, source_size, target, times and taken.

    ``times`` is how often the mix holds the document (0 to ``most_epochs``) and ``taken``
    is times x size. A null text has size 0; a null source is a source of its own, last. A
    null id is ordered like the empty text; rows equal in id, source and size are taken
    alike. An empty table gives none. Other columns are left out.
    """
    return with_times(docs.select(id_column, text_column, source_column), id_column, text_column,
                      source_column, **settings).select(
        id_column, source_column, F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"), F.col("__mix_times").alias("times"),
        (F.col("__mix_times") * F.col("__mix_size")).alias("taken"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as it is taken."""
    rows = with_times(docs, **settings).filter(F.col("__mix_times") > 0)
    return rows.withColumn("__mix_n", F.explode(F.sequence(F.lit(1), F.col("__mix_times").cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
