"""The registered fits are those of the library, with all their rounds and trees."""

import pytest

from hazecast.operators.tree_growth import BoostedTrees, RandomForest
from hazecast.plans import training
from workload import spark_queries


def whole(estimator) -> bool:
    """Whether an estimator has the library's full size."""
    if isinstance(estimator, BoostedTrees):
        return (estimator.rounds, estimator.growth.depth, estimator.rows, estimator.features, estimator.bins) == (500, 8, 0.8, 0.8, 64)
    return isinstance(estimator, RandomForest) and (estimator.trees, estimator.growth.depth, estimator.bins) == (200, 15, 64)


@pytest.mark.parametrize("name", ["forest_fit", "gbt_fit"])
def test_fits_are_whole(monkeypatch, name):
    seen = []

    def fit_one(table, target, estimator):
        seen.append(estimator(None))
        raise StopIteration
    monkeypatch.setattr(spark_queries, "feature_table", lambda spark, folder: None)
    monkeypatch.setattr(training, "fit_one", fit_one)
    with pytest.raises(StopIteration):
        spark_queries.QUERIES[name](None, "")
    assert len(seen) == 1 and whole(seen[0])


@pytest.mark.parametrize("name", ["feature_importance", "model_report", "model_selection"])
def test_candidates_are_whole(monkeypatch, name):
    seen = []

    def train(table, targets=None, candidates=None, minimum=None):
        seen.append(training.CANDIDATES if candidates is None else candidates)
        raise StopIteration
    monkeypatch.setattr(spark_queries, "feature_table", lambda spark, folder: None)
    monkeypatch.setattr(spark_queries, "work_folder", lambda spark, name: "")
    monkeypatch.setattr(training, "train", train)
    with pytest.raises(StopIteration):
        spark_queries.QUERIES[name](None, "")
    made, = seen
    assert list(made) == ["boosted_trees", "random_forest", "ridge_regression"]
    assert whole(made["boosted_trees"](None)) and whole(made["random_forest"](None)) and made["ridge_regression"] is training.ridge
