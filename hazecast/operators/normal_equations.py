"""Ridge regressions of several labels from one pass over the rows.

A row has one vector of features and, per label, a value and a flag that tells whether the
label learns from it. Each task keeps, per label, the row count, the means and the matrix of
co-moments of features and label; these merge in two rounds, so neither a task nor the driver
sees more than a fixed number of them. The driver solves one system per label, as large as
the number of features.

Values are centred before they are squared, and matrices merge by the difference of their
means, so a large offset costs no digits.
"""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASKS_A_GROUP = 256
MOMENTS = "label int, part int, n double, mean array<double>, spread array<double>"


def _merged(a: tuple, b: tuple) -> tuple:
    """(n, means, co-moments) of two sets of rows together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _of_rows(x: np.ndarray) -> tuple:
    mean = x[0] + (x - x[0]).mean(axis=0)
    y = x - mean
    rest = y.mean(axis=0)  # what rounding left
    return float(len(x)), mean + rest, y.T @ y - np.outer(rest, rest) * len(x)


def label_moments(table: DataFrame, labels: list[tuple[str, str]], vector: str = "features") -> DataFrame:
    """(label, n, mean, spread) per (value, flag) pair of columns, by number.

    ``mean`` and ``spread`` (a square matrix, row by row) are those of the features and then
    the label, over rows whose flag is true; a null flag counts as false. A label without such
    rows has none here.
    """
    chosen = [c for i, (value, flag) in enumerate(labels) for c in (
        F.col(f"`{value}`").cast("double").alias(f"y{i}"), F.coalesce(F.col(f"`{flag}`"), F.lit(False)).alias(f"f{i}"))]
    rows = table.select(vector_to_array(vector).alias("x"), *chosen)
    count = len(labels)

    def run(batches):
        totals = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            column = dict(zip(batch.schema.names, batch.columns))
            x = np.asarray(column["x"].flatten()).reshape(batch.num_rows, -1)
            for i in range(count):
                mine = np.asarray(column[f"f{i}"].cast(pa.int8())).astype(bool)
                if mine.any():
                    y = np.asarray(column[f"y{i}"].filter(column[f"f{i}"]))
                    part = _of_rows(np.column_stack([x[mine], y]))
                    totals[i] = _merged(totals[i], part) if i in totals else part
        part = TaskContext.get().partitionId()
        for i, (n, mean, spread) in totals.items():
            yield pa.RecordBatch.from_pylist([{"label": i, "part": part, "n": n, "mean": mean.tolist(),
                                               "spread": spread.ravel().tolist()}], schema=arrow)

    arrow = pa.schema([("label", pa.int32()), ("part", pa.int32()), ("n", pa.float64()),
                       ("mean", pa.list_(pa.float64())), ("spread", pa.list_(pa.float64()))])
    tasks = rows.mapInArrow(run, MOMENTS)
    return _together(_together(tasks, F.expr(f"part div {TASKS_A_GROUP}").cast("int")), F.lit(0)).drop("part")


def _together(parts: DataFrame, group) -> DataFrame:
    """Moments of a label's parts merged in order, per group of parts."""
    def run(key, table):
        total = None
        for r in table.sort_values("part").itertuples():
            one = r.n, np.array(r.mean), np.array(r.spread).reshape(len(r.mean), -1)
            total = one if total is None else _merged(total, one)
        return pd.DataFrame({"label": [key[0]], "part": [key[1]], "n": [total[0]], "mean": [total[1]],
                             "spread": [total[2].ravel()]})

    return parts.groupBy("label", group.alias("group")).applyInPandas(run, MOMENTS)


def solved(n: float, mean: np.ndarray, spread: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """(weights, intercept) of least squares with penalty ``alpha`` on the squared weights.

    A constant feature has weight 0. A label that does not vary cannot be fitted.
    """
    inner, right = spread[:-1, :-1], spread[:-1, -1]
    if not n or spread[-1, -1] <= 0.0:
        raise ValueError("ridge needs labels that vary")
    varying = np.diag(inner) > 0.0
    weights = np.zeros(len(right))
    weights[varying] = np.linalg.solve(inner[np.ix_(varying, varying)] + alpha * np.eye(varying.sum()), right[varying])
    return weights, float(mean[-1] - mean[:-1] @ weights)


class LinearModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Weights times ``features`` plus an intercept, by built-in functions."""

    @keyword_only
    def __init__(self, weights: str = "[]", intercept: float = 0.0):
        super().__init__()
        self.weights = Param(self, "weights", "one per feature, as JSON", TypeConverters.toString)
        self.intercept = Param(self, "intercept", "what is added", TypeConverters.toFloat)
        self._set(**self._input_kwargs)

    def values(self) -> list[float]:
        return json.loads(self.getOrDefault("weights"))

    @property
    def featureImportances(self):
        """The size of each weight."""
        return Vectors.dense([abs(w) for w in self.values()])

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = F.lit(self.values()).cast("array<double>")
        products = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
        return df.withColumn("prediction", F.aggregate(
            products, F.lit(float(self.getOrDefault("intercept"))), lambda total, p: total + p))


def ridges(table: DataFrame, labels: list[tuple[str, str]], alpha: float = 1.0) -> list[LinearModel | ValueError]:
    """A model per (value, flag) pair of columns, or the reason why there is none."""
    found = {r.label: r for r in label_moments(table, labels).collect()}  # one row per label
    made = []
    for i in range(len(labels)):
        try:
            if i not in found:
                raise ValueError("ridge needs rows to learn from")
            mean = np.array(found[i].mean)
            weights, intercept = solved(found[i].n, mean, np.array(found[i].spread).reshape(len(mean), -1), alpha)
            made.append(LinearModel(weights=json.dumps(weights.tolist()), intercept=intercept))
        except (ValueError, np.linalg.LinAlgError) as reason:
            made.append(ValueError(str(reason)))
    return made
