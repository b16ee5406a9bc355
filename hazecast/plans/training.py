"""Training sets, candidate models, selection and the model folder.

Fits run as distributed ``pyspark.ml`` jobs; the driver holds fitted models,
one metrics row per fit and one importance per feature.
"""

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from hazecast.fixed_values import MIN_TRAINING_ROWS, TARGETS, TRAIN_FRACTION
from hazecast.functions.cleaning import impute_zero
from hazecast.operators.layout import known_positions, positions
from hazecast.operators.normal_equations import LinearModel, ridges
from hazecast.operators.tree_growth import BoostedTrees, Growth, LabelBins, RandomForest
from hazecast.plans.features import feature_columns
from hazecast.session import work_folder


# --- Training sets -----------------------------------------------------------

def training_rows(features: DataFrame, target: str) -> DataFrame:
    return features.filter(F.col(target).isNotNull())


def with_split(rows: DataFrame, fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Add ``is_train``: the first share of each station's rows by time."""
    return (positions(rows)
            .withColumn("is_train", F.col("pos") < F.floor(F.col("series_rows") * F.lit(fraction)))
            .drop("pos", "series_rows"))


def with_splits(rows: DataFrame, targets: list[str], fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Add ``is_train_{target}`` per target: what ``with_split`` gives for its training rows, null elsewhere.

    The rows are dealt and sorted once for all targets.
    """
    placed = known_positions(rows, targets)
    return placed.withColumns({f"is_train_{t}": F.when(
        F.col(t).isNotNull(), F.col(f"pos_{t}") < F.floor(F.col(f"rows_{t}") * F.lit(fraction)))
        for t in targets}).drop(*[f"{kind}_{t}" for t in targets for kind in ("pos", "rows")])


def split_by_time(rows: DataFrame, targets: list[str], fraction: float = TRAIN_FRACTION) -> DataFrame:
    """What ``with_splits`` adds, without dealing out the rows.

    The time that ends a station's training rows, one row per station, comes from keys and targets
    alone. It is written first, so that Spark knows its size when it chooses the join.
    """
    placed = known_positions(rows.select("station_id", "timestamp", *targets), targets)
    path = work_folder(rows.sparkSession, "split")
    placed.groupBy("station_id").agg(*[F.min(F.when(
        F.col(t).isNotNull() & (F.col(f"pos_{t}") >= F.floor(F.col(f"rows_{t}") * F.lit(fraction))), F.col("timestamp")))
        .alias(f"_end_{t}") for t in targets]).write.parquet(path)
    ends = rows.sparkSession.read.parquet(path)
    return rows.filter("timestamp IS NOT NULL").join(ends, "station_id").withColumns({f"is_train_{t}": F.when(
        F.col(t).isNotNull(), F.coalesce(F.col("timestamp") < F.col(f"_end_{t}"), F.lit(True)))
        for t in targets}).drop(*[f"_end_{t}" for t in targets])


def prepare(features: DataFrame, target: str, names: list[str],
            minimum: int = MIN_TRAINING_ROWS) -> DataFrame:
    """Labelled rows with zero-filled features and their split."""
    rows = training_rows(features, target)
    if minimum and (found := rows.count()) < minimum:
        raise ValueError(f"{found} rows have '{target}', {minimum} are needed")
    split = split_by_time(rows, [target]).withColumnRenamed(f"is_train_{target}", "is_train")
    return impute_zero(split, names).withColumn("label", F.col(target).cast("double"))


# --- Candidates ----------------------------------------------------------------

def boosted_trees(train: DataFrame, rounds: int = 500, depth: int = 8):
    """Shrunken trees on four rows and four features in five, with L1 and L2 penalties."""
    return BoostedTrees(rounds, 0.03, Growth(depth, alpha=0.1, lam=1.0, child_weight=3.0))


def random_forest(train: DataFrame, trees: int = 200, depth: int = 15):
    """Deep trees on rows drawn with replacement; nodes of fewer than 5 rows stay whole."""
    return RandomForest(trees, Growth(depth, split_rows=5, leaf_rows=2))


class Ridge:
    """Ridge with penalty ``alpha`` on the coefficients, as summed squares; constant features weigh 0.

    All targets of a run are solved from one pass over its rows (``fit_all``).
    """

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def __call__(self, train: DataFrame) -> "Ridge":
        return self

    def fit(self, train: DataFrame) -> LinearModel:
        model, = self.fit_all(train.withColumn("is_train", F.lit(True)), [("label", "is_train")])
        if isinstance(model, ValueError):
            raise model
        return model

    def fit_all(self, table: DataFrame, labels: list[tuple[str, str]]) -> list[LinearModel | ValueError]:
        """A model, or why there is none, per (label, flag) pair of columns."""
        return ridges(table, labels, self.alpha)


ridge = Ridge()


CANDIDATES: dict[str, Callable] = {
    "boosted_trees": boosted_trees,
    "random_forest": random_forest,
    "ridge_regression": ridge,
}


# --- Metrics and selection -----------------------------------------------------

def regression_metrics(scored: DataFrame, label: str = "label",
                       prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """rmse, mae and r2 over rows with both values: one row per group."""
    error = F.col(label) - F.col(prediction)
    return (scored.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
            .groupBy(*by).agg(
                F.sqrt(F.avg(error * error)).alias("rmse"),
                F.avg(F.abs(error)).alias("mae"),
                (F.lit(1.0) - F.try_divide(F.sum(error * error),
                                           F.var_pop(label) * F.count("*"))).alias("r2"),
                F.count("*").alias("n")))


def select_models(metrics: DataFrame) -> DataFrame:
    """Lowest rmse per target; the earlier candidate wins a tie."""
    order = Window.partitionBy("target").orderBy("rmse", "candidate")
    return (metrics.withColumn("_place", F.row_number().over(order))
            .filter(F.col("_place") == 1).drop("_place"))


FITS_AT_ONCE = 9
METRICS_SCHEMA = ("target string, candidate int, model string, rmse double, mae double, "
                  "r2 double, n_features int, training_rows bigint")
IMPORTANCE_SCHEMA = "target string, feature string, importance double"


@dataclass
class Trained:
    """Everything one training run found out."""

    models: dict[str, PipelineModel]
    feature_names: list[str]
    metrics: DataFrame
    importance: DataFrame
    failures: dict[tuple[str, str], str]


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """(feature, importance), largest first: of the trees or |coefficient|.

    A candidate that knows neither, such as a fixed rule, has none.
    """
    names, fitted = model.stages[0].getInputCols(), model.stages[-1]
    if not hasattr(fitted, "featureImportances"):
        return []
    weights = dict(zip(names, map(float, fitted.featureImportances.toArray())))
    return sorted(weights.items(), key=lambda p: -p[1])


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("target").orderBy(F.desc("importance"), "feature")
    return (importance.withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= n))


def train(features: DataFrame, targets: list[str] = TARGETS,
          candidates: dict[str, Callable] | None = None,
          minimum: int = MIN_TRAINING_ROWS) -> Trained:
    """Fit every candidate per target and keep the one with the lowest rmse.

    ``features`` has ``timestamp`` as a timestamp. A candidate that fails is
    left out and its reason kept; a target with too few rows likewise.
    """
    spark = features.sparkSession
    candidates = CANDIDATES if candidates is None else candidates
    names = feature_columns(features)
    counts = features.agg(F.count("*").alias("total"), *[F.count(t).alias(t) for t in targets]).first()
    models, best, rows, weights, failures = {}, {}, [], [], {}
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    enough = [t for t in targets if counts[t] >= minimum]
    for target in targets:
        if target not in enough:
            failures[target, "data"] = f"{counts[target]} rows have '{target}', {minimum} are needed"
    if not enough:
        raise RuntimeError(f"no candidate could be trained: {failures}")
    # one table for all targets, read once per pass of every fit; lost blocks are recomputed
    table = assembler.transform(impute_zero(split_by_time(features, enough), names)).select(
        "features", *[c for t in enough for c in (F.col(t).cast("double").alias(t), f"is_train_{t}")]).persist(
        StorageLevel.MEMORY_AND_DISK)

    def rows_of(target: str, part: str) -> DataFrame:
        return table.filter(part).select("features", F.col(target).alias("label"))

    shared, sharing = {}, Lock()

    def binned_of(target: str, bins: int):
        """A target's rows in bins; those of all targets are made when a first fit asks for them."""
        with sharing:
            if bins not in shared:
                shared[bins] = LabelBins(table, [(t, f"is_train_{t}") for t in enough], bins)
        return shared[bins].of(enough.index(target))

    def fitted_alone(target: str, name: str):
        learn = rows_of(target, f"is_train_{target}")
        estimator = candidates[name](learn)
        if hasattr(estimator, "fit_binned"):
            return estimator.fit_binned(binned_of(target, estimator.bins))
        return estimator.fit(learn)

    def judged(target: str, fit: Callable):
        try:
            fitted = fit()
            m = regression_metrics(fitted.transform(rows_of(target, f"NOT is_train_{target}"))).first()
        except Exception as reason:  # noqa: BLE001 - any failed fit is skipped
            return None, None, str(reason).splitlines()[0]
        return fitted, m, None if m else "no rows to validate on"

    def attempt(name: str, mine: list[str]):
        """Fits and metrics of one candidate: of one target, or of all it can fit in one pass."""
        if not hasattr(candidates[name], "fit_all"):
            return [judged(t, lambda t=t: fitted_alone(t, name)) for t in mine]
        try:
            models = candidates[name].fit_all(table, [(t, f"is_train_{t}") for t in mine])
        except Exception as reason:  # noqa: BLE001
            models = [reason] * len(mine)

        def given(model):
            if isinstance(model, Exception):
                raise model
            return model
        return [judged(t, lambda m=m: given(m)) for t, m in zip(mine, models)]

    # fits are many small jobs, and none needs another: their stages share the executors
    pieces = [(name, mine) for name, make in candidates.items()
              for mine in ([enough] if hasattr(make, "fit_all") else [[t] for t in enough])]
    try:
        with ThreadPoolExecutor(max_workers=FITS_AT_ONCE) as pool:
            done = list(pool.map(lambda piece: attempt(*piece), pieces))
    finally:
        for kept in (*shared.values(), table):
            kept.unpersist()
    found = {(t, name): r for (name, mine), results in zip(pieces, done) for t, r in zip(mine, results)}
    tries = [(t, name) for t in enough for name in candidates]
    results = [found[pair] for pair in tries]
    for (target, name), (fitted, m, reason) in zip(tries, results):
        if reason:
            failures[target, name] = reason
            continue
        rows.append((target, list(candidates).index(name), name, m.rmse, m.mae, m.r2, len(names), counts["total"]))
        if target not in best or m.rmse < best[target]:
            best[target] = m.rmse
            models[target] = PipelineModel([assembler, fitted])
    for target in models:
        weights += [(target, f, w) for f, w in importances(models[target])]
    if not models:
        raise RuntimeError(f"no candidate could be trained: {failures}")
    return Trained(models, names, spark.createDataFrame(rows, METRICS_SCHEMA),
                   spark.createDataFrame(weights, IMPORTANCE_SCHEMA), failures)


def fit_one(features: DataFrame, target: str, estimator: Callable,
            minimum: int = MIN_TRAINING_ROWS) -> tuple[PipelineModel, DataFrame]:
    """One candidate on one target: the model and the scored validation rows."""
    names = feature_columns(features)
    prepared = prepare(features, target, names, minimum)
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    learn = assembler.transform(prepared).filter("is_train").select("features", "label").persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        model = PipelineModel([assembler, estimator(learn).fit(learn)])
    finally:
        learn.unpersist()
    return model, model.transform(prepared.filter("NOT is_train"))


# --- The model folder ------------------------------------------------------------

def report(metrics: DataFrame) -> DataFrame:
    """Per target: horizon label, chosen model, its metrics and the run's sizes."""
    return select_models(metrics).select(
        F.upper(F.regexp_replace("target", "^aqi_target_", "")).alias("horizon"),
        F.col("model"), "rmse", "mae", "r2", "n_features", "training_rows")


def save(trained: Trained, path: str) -> str:
    """Write the run under its own name, then list it: readers see whole runs."""
    run = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    for target, model in trained.models.items():
        model.write().save(f"{path}/runs/{run}/{target}")
    stamp = F.lit(run).alias("run")
    trained.importance.select(stamp, "*").write.mode("append").parquet(f"{path}/feature_importance")
    chosen = select_models(trained.metrics)
    chosen.select(stamp, "*").coalesce(1).write.mode("append").parquet(f"{path}/model_metrics")
    return run


def newest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics row of each target's newest listed run: a target whose fit failed later
    keeps its earlier model."""
    metrics = spark.read.parquet(f"{path}/model_metrics")
    order = Window.partitionBy("target").orderBy(F.desc("run"))  # run names sort by time
    return metrics.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def newest_importance(spark: SparkSession, path: str) -> DataFrame:
    """Importances of the models that ``load`` gives; those of unlisted runs are passed over."""
    chosen = newest_metrics(spark, path).select("run", "target")
    return spark.read.parquet(f"{path}/feature_importance").join(chosen, ["run", "target"], "left_semi").drop("run")


def load(spark: SparkSession, path: str) -> tuple[dict[str, PipelineModel], dict[str, list[str]], DataFrame]:
    """Models, their feature names and the metrics row of each target's newest run."""
    current = newest_metrics(spark, path)
    models = {r.target: PipelineModel.load(f"{path}/runs/{r.run}/{r.target}")
              for r in current.select("run", "target").collect()}  # one row per target
    names = {t: m.stages[0].getInputCols() for t, m in models.items()}
    return models, names, current


def load_first(spark: SparkSession, paths: list[str]) -> tuple[
        str, dict[str, PipelineModel], dict[str, list[str]], DataFrame]:
    """The first folder, in order of preference, whose models can all be read, and what ``load`` gives for it.

    A folder that is missing, lists no model or lists one whose files are gone is passed over.
    """
    reasons = []
    for path in paths:
        try:
            models, names, metrics = load(spark, path)
        except (PySparkException, Py4JJavaError, ValueError) as reason:
            reasons.append(f"{path}: {str(reason).splitlines()[0]}")
            continue
        if models:
            return path, models, names, metrics
        reasons.append(f"{path}: no model")
    raise RuntimeError("no models available: " + "; ".join(reasons))
