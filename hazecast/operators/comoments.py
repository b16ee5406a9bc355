"""Means, spreads and co-moments of every pair of columns in one pass over the rows.

Each task keeps one matrix per moment, over the rows where both columns of a pair are
present, and merges batch after batch into it. Tasks send a row per pair; these merge in two
rounds, the first over groups of tasks. Rows are never multiplied by the number of pairs.

Values are centred before they are squared, and matrices merge by the difference of their
means: a large offset costs no digits, and a constant column has a spread of exactly 0.
"""

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASKS_A_GROUP = 256
#: Of a pair (i, j): rows with both, their means, spreads (sums of squares) and co-moment.
MOMENTS = ["n", "mean_x", "mean_y", "m2_x", "m2_y", "c"]


def _of_batch(x: np.ndarray, present: np.ndarray) -> tuple:
    """(n, mean, spread, co-moment) matrices; mean[i, j] is that of i where j is present too."""
    mask = present.astype(np.float64)
    first = np.array([x[np.argmax(p), i] if p.any() else 0.0 for i, p in enumerate(present.T)])
    y = np.where(present, x - first, 0.0)
    centre = y.sum(axis=0) / np.maximum(mask.sum(axis=0), 1.0)
    y = np.where(present, y - centre, 0.0)
    n = mask.T @ mask
    some = np.maximum(n, 1.0)
    sums = y.T @ mask
    spread = (y * y).T @ mask - sums * sums / some
    return n, first[:, None] + centre[:, None] + sums / some, np.maximum(spread, 0.0), y.T @ y - sums * sums.T / some


def _merged(a: tuple, b: tuple) -> tuple:
    (n1, mean1, spread1, c1), (n2, mean2, spread2, c2) = a, b
    n = n1 + n2
    some = np.maximum(n, 1.0)
    gap = np.where((n1 > 0) & (n2 > 0), mean2 - mean1, 0.0)
    mean = np.where(n1 > 0, mean1, mean2) + gap * n2 / some
    weight = n1 * n2 / some
    return n, mean, spread1 + spread2 + gap * gap * weight, c1 + c2 + gap * gap.T * weight


def co_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, n, mean_x, mean_y, m2_x, m2_y, c) of each pair i <= j of columns by number.

    Pairs that no row has are there with n = 0. NaN counts as a value. A table without rows
    gives no pair.
    """
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    i, j = (np.array(side, dtype=np.int32) for side in zip(*pairs))

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                present = np.column_stack([np.asarray(c.is_valid()) for c in batch.columns])
                x = np.column_stack([np.asarray(c.fill_null(0.0)) for c in batch.columns])
                part = _of_batch(x, present)
                total = part if total is None else _merged(total, part)
        if total is not None:
            n, mean, spread, c = total
            yield pa.RecordBatch.from_pydict({
                "i": i, "j": j, "task": np.full(len(i), TaskContext.get().partitionId(), dtype=np.int32),
                "n": n[i, j], "mean_x": mean[i, j], "mean_y": mean[j, i], "m2_x": spread[i, j],
                "m2_y": spread[j, i], "c": c[i, j]})

    fields = ", ".join(f"{m} double" for m in MOMENTS)
    tasks = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(
        run, f"i int, j int, task int, {fields}")
    groups = _summed(tasks.withColumn("part", F.expr(f"task div {TASKS_A_GROUP}")), ["i", "j", "part"], "task")
    return _summed(groups, ["i", "j"], "part")


def _summed(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Moments of each key merged in order: at most ``TASKS_A_GROUP`` of a group, or one per group."""
    listed = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, *MOMENTS))).alias("parts"))
    weight, both = "a.n * b.n / greatest(a.n + b.n, 1D)", "a.n > 0 AND b.n > 0"
    gap = {s: f"CASE WHEN {both} THEN b.mean_{s} - a.mean_{s} ELSE 0D END" for s in "xy"}
    mean = {s: f"CASE WHEN a.n > 0 THEN a.mean_{s} ELSE b.mean_{s} END + ({gap[s]}) * b.n / greatest(a.n + b.n, 1D)"
            for s in "xy"}
    step = ["'n', a.n + b.n", *[f"'mean_{s}', {mean[s]}" for s in "xy"],
            *[f"'m2_{s}', a.m2_{s} + b.m2_{s} + ({gap[s]}) * ({gap[s]}) * ({weight})" for s in "xy"],
            f"'c', a.c + b.c + ({gap['x']}) * ({gap['y']}) * ({weight})"]
    zero = ", ".join(f"'{m}', 0D" for m in MOMENTS)
    merged = F.expr(f"aggregate(parts, named_struct({zero}), (a, b) -> named_struct({', '.join(step)}))")
    return listed.select(*key, merged.alias("m")).select(*key, "m.*")
