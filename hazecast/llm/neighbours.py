"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Each tree halves a bounded sample by the difference of two of its points, drawn at random,
down to leaves. Every vector of the table is then indexed in one leaf of each tree. A query
walks all trees, nearest branches first (by the squared margins of the planes it had to cross),
until the leaves it has opened hold ``share`` of the sample, and as much of it as stands for
``least`` vectors of the table. The indexed vectors in those leaves are its candidates, and the
best of them are compared in full.

A query travels once, with a bit per leaf that it opened, in blocks of a bounded number of
queries; the vectors stay where they are. A task takes its vectors in tiles, multiplies a tile of
queries with a tile of vectors, and looks at pairs alone that reach the query's k-th best so far.
So neither memory nor shuffles grow with the leaves that a query opens.

Equal vectors are collapsed first, with their k + 1 least ids: only those can be among the k
nearest. So a vector that a third of all rows share costs one row in a leaf.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazecast.llm.common import stored


class Forest:
    """Planes of ``trees`` complete binary trees of one depth, and where the sample fell."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        draw = np.random.default_rng(seed)
        inner = (1 << depth) - 1
        self.depth, self.trees, self.size = depth, trees, len(sample)
        self.normals = np.zeros((trees, inner, sample.shape[1]), dtype=np.float32)
        self.offsets = np.zeros((trees, inner), dtype=np.float32)
        for tree in range(trees):
            at = np.zeros(len(sample), dtype=np.int64)
            for node in range(inner):
                here = np.flatnonzero(at == node)
                if len(here) > 1:
                    a, b = draw.choice(here, 2, replace=False)
                    normal = sample[a] - sample[b]
                else:
                    normal = draw.normal(size=sample.shape[1])
                normal = normal / (np.linalg.norm(normal) or 1.0)
                side = sample[here] @ normal
                self.normals[tree, node] = normal
                self.offsets[tree, node] = np.median(side) if len(here) else 0.0
                at[here] = 2 * node + 1 + (side > self.offsets[tree, node])
        #: Leaf of each row of the sample in each tree, counted from the tree's first leaf.
        self.where = (self.leaves(sample) - inner).astype(np.int32)

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.zeros((len(unit), self.trees), dtype=np.int64)
        for tree in range(self.trees):
            at = out[:, tree]
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", unit, self.normals[tree, at]) > self.offsets[tree, at]
                at[:] = 2 * at + 1 + side
        return out

    def opened(self, unit: np.ndarray, wanted: float) -> np.ndarray:
        """Whether each leaf of each tree is opened, the nearest first, until they hold ``wanted`` rows of the sample.

        What lies nearer is never behind what lies farther, so a walk through one priority queue of
        (distance, tree, node) opens leaves in the order of their own distances.
        """
        margins = (self.normals @ unit - self.offsets).astype(np.float64)
        far = np.zeros((self.trees, 1))
        for level in range(self.depth):
            margin = margins[:, (1 << level) - 1:(2 << level) - 1]
            far = np.stack([far + np.maximum(margin, 0.0) ** 2, far + np.maximum(-margin, 0.0) ** 2], axis=2).reshape(self.trees, -1)
        place = np.empty(far.size, dtype=np.int64)
        place[np.argsort(far, axis=None, kind="stable")] = np.arange(far.size)
        place = place.reshape(far.shape)
        need = math.ceil(wanted)
        if need > self.size:
            return np.ones(far.shape, dtype=bool)
        if need <= 0:
            return np.zeros(far.shape, dtype=bool)
        # a row of the sample is met with the first of its leaves
        met = place[np.arange(self.trees), self.where].min(axis=1)
        return place <= np.partition(met, need - 1)[need - 1]


def unit_rows(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over their greatest part, and the lengths of those."""
    rows = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return rows, np.sqrt((rows * rows).sum(axis=1))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec) of rows with an id and a finite vector that is not zero, of the usual dimension."""
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vec")).filter(
        F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vec") == (usual["n"] if usual else 0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, trees: int = 8, leaf_rows: int = 128,
            share: float = 0.6, least: int = 1500, most_sample: int = 20000, cell_rows: int = 4096,
            cell_queries: int = 8192, seed: int = 1, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each row whose id is divisible by ``every``.

    Rows without an id, null vectors, zero vectors, those with null or non-finite parts and
    those of another than the commonest dimension take no part. Candidates are all others
    but those with the query's own id; repeated rows count once. Should one id have several
    vectors, its least one asks. The forest is fitted on at most about ``most_sample``
    distinct vectors, chosen by hash; all are indexed. Other columns are left out. A table without
    rows, or without two vectors, gives none.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    by_vector = Window.partitionBy("vec").orderBy("id")
    distinct = stored(rows.dropDuplicates(["vec", "id"]).withColumn("n", F.row_number().over(by_vector))
                      .filter(F.col("n") <= k + 1).groupBy("vec").agg(F.collect_list("id").alias("ids")), "vectors")
    total = distinct.count()
    kept = int(min(1, most_sample / max(1, total)) * (1 << 20))
    sample = distinct.filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < kept).select("vec").limit(2 * most_sample)
    points = sample.collect()
    points = sorted(tuple(p[0]) for p in points)
    # leaves of about leaf_rows rows, as long as the sample can halve that often
    depth = max(0, int(math.log2(max(1, min(total / leaf_rows, len(points) / 8)))))
    forest = Forest(unit_rows(points).astype(np.float32) if points else np.zeros((0, 1)), trees, depth, seed)
    wanted = max(share * len(points), min(1.0, least / max(1, total)) * len(points))
    asking = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    kind = distinct.schema["vec"].dataType.simpleString()
    id_kind = rows.schema["id"].dataType.simpleString()

    def probe(frames):
        for frame in frames:
            if len(frame):
                units = unit_rows(frame["vec"]).astype(np.float32)
                yield pd.DataFrame({"id": frame["id"], "vec": frame["vec"],
                                    "opened": [np.packbits(forest.opened(u, wanted)).tobytes() for u in units]})

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = stored(asking.repartition(partitions, F.xxhash64("id")).mapInPandas(probe, f"id {id_kind}, vec {kind}, opened binary"), "asked")
    blocks = max(1, -(-asked.count() // cell_queries))

    def met(block: int) -> DataFrame:
        # about ``cell_queries`` rows of a vector and a bit per leaf
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas()
        sent = spark.sparkContext.broadcast((mine["id"].to_numpy(), [np.asarray(v, dtype=np.float64) for v in mine["vec"]],
                                             mine["opened"].tolist()))
        return distinct.mapInPandas(lambda frames: _rerank(frames, k, forest, sent.value, cell_rows),
                                    f"query_id {id_kind}, id {id_kind}, score double")

    found = met(0)
    for block in range(1, blocks):
        found = found.unionByName(met(block))
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_column), "score")


TILE = 1024  # queries
ROUGH = 1e-5  # more than single precision errs in a cosine of a few thousand parts
PAIRS = 32768  # compared in full at once


def _rerank(frames, k: int, forest: Forest, asked: tuple, cell_rows: int):
    """The k best candidates of each query among the vectors of a task."""
    names, vectors, opened = asked
    if not len(names):
        return
    queries, lengths = scaled(np.stack(vectors))
    units = unit_rows(vectors).astype(np.float32)
    opened = np.frombuffer(b"".join(opened), dtype=np.uint8).reshape(len(names), -1)
    low = np.full(len(names), -np.inf)  # of each query, the score of its k-th best so far
    best: dict[int, tuple] = {}  # per tile of queries: (query, id, score) of the k best
    first_leaf, leaves = (1 << forest.depth) - 1, 1 << forest.depth

    for frame in frames:
        for start in range(0, len(frame), cell_rows):
            part = frame.iloc[start:start + cell_rows]
            rows, sizes = scaled(np.stack([np.asarray(v, dtype=np.float64) for v in part["vec"]]))
            unit = unit_rows(part["vec"]).astype(np.float32)
            bits = forest.leaves(unit) - first_leaf + np.arange(forest.trees) * leaves
            ids, n = np.concatenate([np.asarray(i) for i in part["ids"]]), np.array([len(i) for i in part["ids"]])
            ends = np.cumsum(n)

            def candidates(q, r):
                """(query, id, score) of pairs, of those that the forest lets meet."""
                for at in range(0, len(q), PAIRS):
                    mine, row = q[at:at + PAIRS], r[at:at + PAIRS]
                    bit = bits[row]
                    meets = (opened[mine[:, None], bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).any(axis=1)
                    mine, row = mine[meets], row[meets]
                    score = (rows[row] * queries[mine]).sum(axis=1) / (sizes[row] * lengths[mine])
                    count = n[row]
                    mine, score = np.repeat(mine, count), np.repeat(score, count)
                    i = ids[np.arange(len(mine)) + np.repeat(ends[row] - np.cumsum(count), count)]
                    other = i != names[mine]
                    yield mine[other], i[other], score[other]

            def add(tile, q, r):
                found = [*candidates(q, r)]
                if not sum(len(x[0]) for x in found):
                    return
                q, i, score = map(np.concatenate, zip(*found, *([best[tile]] if tile in best else [])))
                # an id that has several vectors counts by its best one
                order = np.lexsort((-score, i, q))
                q, i, score = q[order], i[order], score[order]
                once = np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])]
                q, i, score = q[once], i[once], score[once]
                order = np.lexsort((i, -score, q))
                q, i, score = q[order], i[order], score[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                kept = place < k
                best[tile] = q[kept], i[kept], score[kept]
                last = place == k - 1
                low[q[last]] = score[last]

            for tile in range(0, len(names), TILE):
                rough = units[tile:tile + TILE] @ unit.T
                new, some = np.flatnonzero(np.isinf(low[tile:tile + TILE])), 4 * (k + 1)
                if len(new) and len(unit) > 2 * some:
                    # a first k-th best from the nearest few, so that not all pairs of a tile are looked at
                    near = np.argpartition(rough[new], len(unit) - some, axis=1)[:, len(unit) - some:]
                    add(tile, np.repeat(new + tile, some), near.ravel())
                q, r = np.nonzero(rough >= (low[tile:tile + TILE, None] - ROUGH).astype(np.float32))
                if len(q):
                    add(tile, q + tile, r)
    for q, i, score in best.values():
        for at in range(0, len(q), 10000):
            yield pd.DataFrame({"query_id": names[q[at:at + 10000]], "id": i[at:at + 10000], "score": score[at:at + 10000]})
