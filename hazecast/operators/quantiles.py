"""Exact quantiles of wide tables without sorting, sketching or collecting a column.

The values of a column are narrowed to the wanted ranks: an interval of values is cut into
equal buckets, counts and extremes per bucket are plain hash aggregates, and the bucket that
holds a rank becomes its next interval, from its least to its greatest value. A rank is found
when both are one value. Every round leaves at most a few hundred candidate buckets per rank
for the driver to look at, whatever the size of the table, and splits what is left at least
in two; columns whose values lie within few orders of magnitude take two to five rounds.
"""

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 512
MOMENTS = ["n", "mean", "std", "low", "high"]


def melt(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, value) rows, nulls left out."""
    cells = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {cells}) AS (variable, value)").filter(
        "value IS NOT NULL")


def moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """n, mean, std, low and high of every column, from one aggregate over the rows."""
    made = []
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`").cast("double")
        made += [F.count(value).alias(f"n{i}"), F.avg(value).alias(f"mean{i}"),
                 F.stddev_samp(value).alias(f"std{i}"), F.min(value).alias(f"low{i}"),
                 F.max(value).alias(f"high{i}")]
    row = df.agg(*made).first()
    return {c: {m: row[f"{m}{i}"] for m in MOMENTS} for i, c in enumerate(columns)}


def _bucket(low: Column, high: Column) -> Column:
    # halves first: the difference of two doubles may not be one
    place = (F.col("value") / 2 - low / 2) / (high / 2 - low / 2) * BUCKETS
    return F.least(F.floor(place), F.lit(BUCKETS - 1)).cast("int")


def order_statistics(df: DataFrame, ranks: dict[str, set[int]], extremes: dict[str, dict]
                     ) -> dict[tuple[str, int], float]:
    """The value of each (column, rank from 0). The driver holds one interval per rank."""
    found: dict = {}
    # (column, rank) -> interval (low, high) and how many values lie below it
    open_ = {(c, r): (extremes[c]["low"], extremes[c]["high"], 0) for c, rs in ranks.items() for r in rs}
    columns = list(ranks)
    while True:
        for key, (low, high, _) in list(open_.items()):
            if low == high:
                found[key] = low
                del open_[key]
        if not open_:
            return found
        spans = sorted({(c, low, high) for (c, _), (low, high, _) in open_.items()})
        # one row per column and rank: bounded, so it may be broadcast
        table = df.sparkSession.createDataFrame(spans, "variable string, lo double, hi double")
        wanted = [c for c in columns if any(s[0] == c for s in spans)]
        inside = melt(df, wanted).join(F.broadcast(table), "variable").filter("value BETWEEN lo AND hi")
        counted = inside.groupBy("variable", "lo", "hi", _bucket(F.col("lo"), F.col("hi")).alias("bucket")).agg(
            F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        cells: dict = {}
        for row in counted.collect():
            cells.setdefault((row["variable"], row["lo"], row["hi"]), []).append((row["bucket"], row["n"], row["low"], row["high"]))
        for (c, rank), (low, high, below) in list(open_.items()):
            for _, n, least, most in sorted(cells[c, low, high]):
                if rank < below + n:
                    open_[c, rank] = (least, most, below)
                    break
                below += n


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """(variable, n, mean, std, low, high, q0, q1, ...): one row per column.

    Interpolated linearly between neighbours. A column without a value has n = 0 and nulls.
    Values are finite: the readers make NaN and infinities null. Runs jobs when called, over
    the named columns kept in memory or on disk meanwhile; its result is a few rows.
    """
    df = df.select(*[F.col(f"`{c}`") for c in columns]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _quantiles(df, columns, probabilities)
    finally:
        df.unpersist()


def _quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    stats = moments(df, columns)
    places = {c: [(s["n"] - 1) * float(p) for p in probabilities] for c, s in stats.items() if s["n"]}
    ranks = {c: {r for p in ps for r in (math.floor(p), math.ceil(p))} for c, ps in places.items()}
    values = order_statistics(df, ranks, stats)

    def between(c: str, place: float) -> float:
        lower, upper = values[c, math.floor(place)], values[c, math.ceil(place)]
        part = place - math.floor(place)
        # from the nearer neighbour, which is the more accurate side
        return lower + (upper - lower) * part if part < 0.5 else upper - (upper - lower) * (1.0 - part)

    rows = [(c, *[s[m] for m in MOMENTS],
             *([between(c, p) for p in places[c]] if c in places else [None] * len(probabilities)))
            for c, s in stats.items()]
    schema = "variable string, n bigint, mean double, std double, low double, high double" + "".join(
        f", q{i} double" for i in range(len(probabilities)))
    return df.sparkSession.createDataFrame(rows, schema)
