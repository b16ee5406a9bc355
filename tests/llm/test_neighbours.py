import heapq
import os

import numpy as np
import pytest

from hazecast.llm import neighbours


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "'x' AS id", "'y' AS vec", "1 AS rank", "2 AS cell")


def brute(rows, every, k):
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    asked = {}
    for i, v in sorted(good, reverse=True):
        if i % every == 0:
            asked[i] = v
    out = {}
    for q, u in asked.items():
        best: dict = {}
        for i, v in good:
            if i != q:
                c = np.dot(u, v) / np.sqrt(np.dot(u, u) * np.dot(v, v))
                best[i] = max(best.get(i, -2), c)
        out[q] = sorted(best.items(), key=lambda p: (-round(p[1], 12), p[0]))[:k]
    return out


def test_small_tables_are_exact(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=8)], 0) for i in range(120)]
    same = [1.0, 2.0, 0.0, 0.0, 0.5, 0.0, 0.0, 1.0]
    rows += [(1000 + i, same, 0) for i in range(60)]  # a third of all rows: ties go to small ids
    rows += [(50, rows[3][1], 0), rows[7], rows[7], (None, same, 0), (2001, None, 0), (2002, [0.0] * 8, 0),
             (2003, [float("nan")] + [1.0] * 7, 0), (2004, [float("inf")] + [1.0] * 7, 0), (2005, [None] + [1.0] * 7, 0),
             (2050, [], 0)]
    got: dict = {}
    for r in neighbours.nearest(table(spark, rows)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    wanted = brute(rows, 50, 5)
    assert got.keys() == wanted.keys() and len(got) > 2
    for q, best in wanted.items():
        assert [got[q][n + 1][0] for n in range(len(best))] == [i for i, _ in best]
        assert np.allclose([got[q][n + 1][1] for n in range(len(best))], [s for _, s in best], atol=1e-12)


def test_recall_of_the_forest(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in draw.normal(size=32).astype(np.float32)], 0) for i in range(4000)]
    found = neighbours.nearest(table(spark, rows), leaf_rows=32).collect()
    wanted = brute(rows, 50, 5)
    hits = sum((r.query_id, r.vec_id) in {(q, i) for q, best in wanted.items() for i, _ in best} for r in found)
    assert len(found) == 5 * len(wanted) and hits >= 0.9 * len(found)


@pytest.mark.parametrize("rows", [200, 500, 2000, 6000])
def test_recall_of_the_defaults(spark, rows):
    """Vectors without structure, where no tree prunes well."""
    draw = np.random.default_rng(rows)
    made = [(i, [float(x) for x in draw.normal(size=64).astype(np.float32)], 0) for i in range(rows)]
    found = neighbours.nearest(table(spark, made)).collect()
    wanted = brute(made, 50, 5)
    hits = sum((r.query_id, r.vec_id) in {(q, i) for q, best in wanted.items() for i, _ in best} for r in found)
    assert len(found) == 5 * len(wanted) and hits >= 0.9 * len(found), hits / len(found)


def test_dealt_leaves_and_query_blocks_change_nothing(spark):
    draw = np.random.default_rng(9)
    rows = [(i, [float(x) for x in draw.normal(size=16).astype(np.float32)], 0) for i in range(3000)]
    plain = neighbours.nearest(table(spark, rows)).collect()
    dealt = neighbours.nearest(table(spark, rows), cell_rows=50, cell_queries=7).collect()
    assert sorted(plain) == sorted(dealt) and len(plain) == 300


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, folder):
    given = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = given.collect()
    vectors = np.array([r.embedding for r in rows], dtype=np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    found = neighbours.nearest(given).collect()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = vectors @ vectors[q]
        score[q] = -2
        best = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        hits, total = hits + len(best & {r.vec_id for r in found if r.query_id == ids[q]}), total + 5
    assert hits >= 0.9 * total, hits / total


def test_few_rows(spark):
    assert neighbours.nearest(table(spark, [])).count() == 0
    assert neighbours.nearest(table(spark, [(50, [1.0, 2.0], 0)])).count() == 0
    got = neighbours.nearest(table(spark, [(50, [1.0, 2.0], 0), (51, [2.0, 4.0], 0), (52, [1.0], 0)])).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(50, 1, 51)]


def walk(forest, unit, wanted):
    """Leaves that a walk through one priority queue opens."""
    margins = forest.normals @ unit - forest.offsets
    inner, seen, found = (1 << forest.depth) - 1, np.zeros(forest.size, dtype=bool), np.zeros((forest.trees, 1 << forest.depth), dtype=bool)
    queue = [(0.0, tree, 0) for tree in range(forest.trees)]
    while queue and seen.sum() < wanted:
        far, tree, node = heapq.heappop(queue)
        if node >= inner:
            found[tree, node - inner] = True
            seen |= forest.where[:, tree] == node - inner
            continue
        margin = float(margins[tree, node])
        heapq.heappush(queue, (far + max(-margin, 0.0) ** 2, tree, 2 * node + 2))
        heapq.heappush(queue, (far + max(margin, 0.0) ** 2, tree, 2 * node + 1))
    return found


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_opened_leaves_are_those_of_a_walk(depth):
    draw = np.random.default_rng(depth)
    sample = neighbours.unit_rows(draw.normal(size=(300, 12)).round(1)).astype(np.float32)
    forest = neighbours.Forest(sample, 4, depth, 3)
    for unit in [*sample[:20], *neighbours.unit_rows(draw.normal(size=(20, 12))).astype(np.float32)]:
        for wanted in (0.0, 0.5, 20, 180.5, 300):
            assert (forest.opened(unit, wanted) == walk(forest, unit, wanted)).all()


def test_memory_does_not_grow_with_opened_leaves(spark, monkeypatch):
    """A query travels once, whatever the number of leaves it opens, and a task looks at few pairs at once."""
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(size=16).astype(np.float32)], 0) for i in range(2000)]
    written = {}
    kept = neighbours.stored

    def stored(df, name):
        written[name] = kept(df, name)
        return written[name]
    monkeypatch.setattr(neighbours, "stored", stored)
    plain = neighbours.nearest(table(spark, rows), leaf_rows=16).collect()
    assert written["asked"].count() == 40 and len(plain) == 200
    bits = {len(r.opened) * 8 for r in written["asked"].collect()}
    assert bits == {8 * 64}  # a bit for each leaf of the trees
    wanted = brute(rows, 50, 5)
    hits = sum((r.query_id, r.vec_id) in {(q, i) for q, best in wanted.items() for i, _ in best} for r in plain)
    assert hits >= 0.9 * len(plain)


def test_an_id_with_many_vectors_takes_one_place(spark):
    """Its own vectors, and many of another id, are not all that a query finds."""
    near = [[1.0, 0.01 * n, 0.0, 0.0] for n in range(12)]
    rows = [(50, v, 0) for v in near] + [(7, [1.0, 0.01 * n, 0.001, 0.0], 0) for n in range(12)]
    rows += [(100 + i, [0.0, 1.0, 0.1 * i, 0.5], 0) for i in range(1, 8)]
    got = {r["rank"]: r.vec_id for r in neighbours.nearest(table(spark, rows)).collect() if r.query_id == 50}
    assert got == {n + 1: i for n, (i, _) in enumerate(brute(rows, 50, 5)[50])} and got[1] == 7 and len(got) == 5
