import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler

from hazecast.operators import tree_growth as tg
from helpers import same, to_spark


def vectors(spark, df, parts=3):
    names = [c for c in df if c != "label"]
    made = VectorAssembler(inputCols=names, outputCol="features").transform(to_spark(spark, df).repartition(parts))
    return made.select("features", "label")


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    df = pd.DataFrame({"a": rng.integers(0, 20, 400) * 1.0, "b": rng.normal(size=400).round(1), "c": 7.0,
                       "d": rng.integers(0, 2, 400) * 1.0})
    df["label"] = np.where(df.a > 9, 10.0, 2.0) + 3 * df.d * (df.b > 0) + rng.normal(size=400) * 0.1
    return df


def soft(g, alpha):
    return np.sign(g) * max(abs(g) - alpha, 0)


def brute_tree(x, g, h, n, depth, growth):
    """Exhaustive search over every cut of every feature; a nested tuple or a value."""
    def worth(rows):
        return soft(g[rows].sum(), growth.alpha) ** 2 / (h[rows].sum() + growth.lam)

    whole = np.ones(len(g), dtype=bool)
    leaf = -soft(g.sum(), growth.alpha) / (h.sum() + growth.lam)
    if depth == 0 or n.sum() < growth.split_rows:
        return leaf
    best = (1e-9, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            if min(h[low].sum(), h[~low].sum()) < growth.child_weight or min(n[low].sum(), n[~low].sum()) < max(1, growth.leaf_rows):
                continue
            gain = 0.5 * (worth(low) + worth(~low) - worth(whole))
            if gain > best[0] + 1e-9:
                best = (gain, (f, cut))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    low = x[:, f] <= cut
    return (f, cut, *[brute_tree(x[s], g[s], h[s], n[s], depth - 1, growth) for s in (low, ~low)])


def brute_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("growth", [tg.Growth(1, 0.1, 1.0, 3.0), tg.Growth(3, 5.0, 2.0, 30.0),
                                    tg.Growth(6, 0.0, 0.0, 0.0, split_rows=60, leaf_rows=9)])
def test_boosting_equals_exhaustive_search(spark, frame, growth):
    model = tg.BoostedTrees(rounds=3, rate=0.3, growth=growth, rows=1.0, features=1.0, bins=256).fit(vectors(spark, frame))
    x, y = frame[["a", "b", "c", "d"]].to_numpy(), frame.label.to_numpy()
    margin, ones = np.full(len(y), y.round(12).mean()), np.ones(len(y))
    for _ in range(3):
        tree = brute_tree(x, margin - y, ones, ones, growth.depth, growth)
        margin = margin + 0.3 * np.array([brute_value(tree, r) for r in x])
    got = model.transform(vectors(spark, frame, 1)).toPandas()
    # rows travel: compare by their values
    want = pd.DataFrame({"k": [tuple(r) + (l,) for r, l in zip(x, y)], "v": margin}).groupby("k").v.mean()
    mine = pd.Series(got.prediction.to_numpy(), index=[tuple(f.toArray()) + (l,) for f, l in zip(got.features, got.label)])
    assert all(abs(mine[k] - want[k]).max() < 1e-9 for k in want.index)


def test_forest_equals_exhaustive_search(spark, frame):
    growth = tg.Growth(4, split_rows=5, leaf_rows=2)
    data = vectors(spark, frame)
    model = tg.RandomForest(trees=5, growth=growth, bins=256).fit(data)
    rows, cuts, facts, _ = tg.RandomForest(bins=256)._prepared(data)
    binned = tg.binned(rows, cuts, facts.mean).toPandas()
    local = data.toPandas()
    keyed = rows.selectExpr("xxhash64(x, label) AS key", "x", "label").toPandas()
    assert sorted(keyed.key) == sorted(binned.key)
    x, y, keys = np.stack(keyed.x), keyed.label.to_numpy(), keyed.key.to_numpy()
    total = np.zeros(len(y))
    for t in range(5):
        w = tg.bootstrap(42)(keys, t)
        assert 0.8 < w.mean() < 1.2 and w.max() > 2
        tree = brute_tree(x[w > 0], (w * (y.mean() - y))[w > 0], w[w > 0], np.ones((w > 0).sum()), 4, growth)
        total += np.array([brute_value(tree, r) for r in x]) / 5
    got = model.transform(data.select("features", "label")).toPandas()
    mine = dict(zip([tuple(f.toArray()) for f in got.features], got.prediction))
    assert same([mine[tuple(r)] for r in x], y.mean() + total, 1e-9) and len(local) == 400


def test_partitioning_changes_nothing(spark, frame):
    few = dict(growth=tg.Growth(5, 0.1, 1.0, 3.0), rounds=4)
    one, two = (tg.BoostedTrees(**few).fit(vectors(spark, frame, p)) for p in (1, 7))
    assert one.value("trees") == two.value("trees") and one.value("importance") == two.value("importance")
    one, two = (tg.RandomForest(trees=6).fit(vectors(spark, frame, p)) for p in (1, 7))
    assert one.value("trees") == two.value("trees")
    shares = one.value("importance")
    assert abs(sum(shares) - 1) < 1e-12 and shares[2] == 0 and shares[0] == max(shares)


def test_passes_and_written_margins(spark, frame, monkeypatch, tmp_path):
    """Few nodes a pass and few rounds a step give the same trees."""
    data = vectors(spark, frame)
    whole = [tg.RandomForest(trees=3).fit(data).value("trees"), tg.BoostedTrees(rounds=5).fit(data).value("trees")]
    monkeypatch.setattr(tg, "PASS_BYTES", 24 * 4 * 64 * 3)
    monkeypatch.setattr(tg, "ROUNDS_A_STEP", 2)
    assert tg.RandomForest(trees=3).fit(data).value("trees") == whole[0]
    model = tg.BoostedTrees(rounds=5).fit(data)
    for a, b in zip(model.value("trees"), whole[1]):
        assert a[:3] == b[:3] and same(a[3], b[3], 1e-9)
    path = str(tmp_path / "model")
    PipelineModel([model]).write().save(path)
    back = PipelineModel.load(path)
    assert back.transform(data).exceptAll(PipelineModel([model]).transform(data)).isEmpty()


def test_labels_that_do_not_vary(spark, frame):
    model = tg.BoostedTrees(rounds=2).fit(vectors(spark, frame.assign(label=4.0)))
    assert {r.prediction for r in model.transform(vectors(spark, frame)).collect()} == {4.0}


def test_cuts_of_many_values_meet_their_ranks(spark, monkeypatch):
    """More values than a summary holds, over many blocks and tasks; few values are all found, however rare."""
    monkeypatch.setattr(tg, "SUMMARY", 512)
    monkeypatch.setattr(tg, "BLOCK_ROWS", 700)
    rng = np.random.default_rng(5)
    many, few = rng.gamma(2.0, 30.0, 20000), np.where(np.arange(20000) % 9999 == 7, rng.integers(1, 3, 20000), 0)
    rows = spark.createDataFrame(pd.DataFrame({"x": list(map(list, zip(many.tolist(), few.astype(float).tolist())))}), "x array<double>")
    cuts = tg.cut_points(rows.repartition(5), 2, 64)
    ranks = np.searchsorted(np.sort(many), cuts[0]) / len(many)
    assert len(cuts[0]) == 63 and abs(ranks - np.arange(1, 64) / 64).max() < 0.01
    assert cuts[1] == sorted({*few.tolist()})[:-1]


def test_large_tables_send_histograms_of_one_task_per_core(spark, frame, monkeypatch):
    """What the search for cuts gathers grows with the cores, not with the rows."""
    monkeypatch.setattr(tg, "TASK_CELLS", 40)
    data = vectors(spark, frame, 30)
    rows, cuts, facts, _ = tg.RandomForest()._prepared(data)
    state, tasks = tg.RandomForest._state(rows, cuts, facts)
    assert tasks <= spark.sparkContext.defaultParallelism and state.rdd.getNumPartitions() <= tasks
    state.unpersist()


def test_labels_share_one_pass(spark, frame):
    """Cut points and bins of several labels at once are those each label has alone."""
    table = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(to_spark(spark, frame).repartition(3)).selectExpr(
        "features", "label", "label * 2 AS two", "a < 15 AS learns", "CASE WHEN d > 0 THEN true END AS other")
    shared = tg.LabelBins(table, [("label", "learns"), ("two", "other")], 16)
    for i, (label, flag) in enumerate((("label", "learns"), ("two", "other"))):
        own = table.filter(flag).selectExpr("features", f"{label} AS label")
        rows, cuts, facts, grid = tg.RandomForest(bins=16)._prepared(own)
        got = shared.of(i)
        assert (got.cuts, got.facts, got.grid) == (cuts, facts, grid)
        alone = tg.binned(rows, cuts, facts.mean)
        assert got.state.exceptAll(alone).isEmpty() and alone.exceptAll(got.state).isEmpty()
    shared.unpersist()


def test_histograms_equal_plain_sums(frame):
    """Weights above 1, rows without a slot and more than one block."""
    rng = np.random.default_rng(2)
    x, label = rng.integers(0, 8, (500, 3)).astype(np.uint8), rng.integers(-9, 9, 500) * 1.0
    batches = [pa.RecordBatch.from_pydict({"key": np.arange(i, i + 100), "label": label[i:i + 100], "margin": np.zeros(100),
                                           "bins": [r.tobytes() for r in x[i:i + 100]]}) for i in range(0, 500, 100)]
    tree = tg.Tree()
    tree.split(0, 1, 3, 1.0)
    draw = tg.bootstrap(1)
    sums = tg._histograms(range(4, 5), draw, {0: tree.arrays()}, {0: np.array([-1, -1, 0])}, 1, 3, 8, [np.arange(3)], 1.0, [], 1.0)
    row, = list(sums(iter(batches)))
    got = np.zeros((3, 3 * 8))
    got[:, np.frombuffer(row["cells"][0].as_py(), "<i4")] = np.frombuffer(row["sums"][0].as_py()).reshape(3, -1)
    want = np.zeros((3, 3, 8))
    for r, y, w in zip(x, label, draw(np.arange(500), 4)):
        if r[1] > 3 and w:
            for f in range(3):
                want[:, f, r[f]] += (-y * w, w, 1)
    assert (got == want.reshape(3, -1)).all() and want[1].max() > want[2].max()


def test_one_task_gives_the_trees_of_the_passes(spark, frame, monkeypatch):
    """Boosting as a whole in one task; nodes of a forest sent to tasks at the root, further down, in several jobs, or never."""
    data = vectors(spark, frame)
    boosted = dict(rounds=6, growth=tg.Growth(5, 0.1, 1.0, 3.0))
    forest = dict(trees=4, growth=tg.Growth(9, split_rows=5, leaf_rows=2))
    alone = [tg.BoostedTrees(**boosted).fit(data), tg.RandomForest(**forest).fit(data)]
    monkeypatch.setattr(tg, "SENT_BYTES", 1000)
    monkeypatch.setattr(tg, "SENT_ROWS", 7)
    for cells in (0, 4 * 120):
        monkeypatch.setattr(tg, "ALONE_CELLS", cells)
        passes = [tg.BoostedTrees(**boosted).fit(data), tg.RandomForest(**forest).fit(data)]
        assert passes[0].value("trees") == alone[0].value("trees")
        if not cells:
            assert passes[1].value("trees") == alone[1].value("trees")
        for a, b in zip(alone, passes):
            assert same(a.value("importance"), b.value("importance"), 1e-12)
            assert a.transform(data).exceptAll(b.transform(data)).isEmpty()


@pytest.mark.parametrize("weighted", [False, True])
def test_cuts_of_few_rows_equal_those_of_sums(weighted):
    """Nodes of one row and more; ties go to the first feature and the lowest bin."""
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 40, 60)
    n = int(sizes.sum())
    columns = rng.integers(0, 6, (9, n)).astype(np.uint8)
    columns[4] = columns[2]
    g, w = rng.integers(-50, 50, n) / 8, rng.integers(1, 4, n).astype(float) if weighted else None
    for growth in (tg.Growth(3, 0.1, 1.0, 3.0), tg.Growth(3, split_rows=5, leaf_rows=2)):
        few, many = (search(columns, g, w, sizes, growth, 8) for search in (tg._sparse_cuts, tg._dense_cuts))
        assert (few["gain"] == many["gain"]).all() and (many["gain"] > 0).sum() > 30
        there = many["gain"] > 0
        for c in tg.FOUND[1:]:
            assert (few[c][there] == many[c][there]).all(), c


def test_models_saved_as_lists_are_read(spark, frame):
    model = tg.BoostedTrees(rounds=2).fit(vectors(spark, frame))
    import json
    old = tg.TreeModel(**{n: model.getOrDefault(n) for n in ("cuts", "base", "rate", "importance")}, trees=json.dumps(model.value("trees")))
    data = vectors(spark, frame)
    assert old.transform(data).exceptAll(model.transform(data)).isEmpty()
