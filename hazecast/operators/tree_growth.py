"""Regression trees grown level by level from second-order histograms.

Features are cut into at most 256 bins, a byte each. For a level, each task sums gradients
and second derivatives per (node, feature, bin) over its rows; tasks that hold a share of
the features each add these sums up and find the best cut of every node there; the driver
takes the best of a node and goes on. All trees of a forest grow together, in passes of a
bounded number of nodes, so a pass needs the same memory whatever the number of rows or trees.

A node of a forest whose rows are few enough for one task is not cut any further this way: its rows
are sent to one task, which grows all that is below. Boosting is one tree after another, so a table
that small is boosted by one task as a whole. Both give the trees that the passes would give.

The gain of a cut has penalties: with T(G) = sign(G) max(|G| - alpha, 0) a node is worth
T(G)^2 / (H + lambda), its value is -T(G) / (H + lambda).

Which rows a tree sees comes from a hash of the row and the tree; equal rows fare alike.
Gradients are rounded to a grid on which sums of all rows are exact, so neither the order nor
the partitioning of rows changes a tree.
"""

import base64
import io
import json
import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from hazecast.session import work_folder

PASS_BYTES = 96 << 20
TASK_CELLS = 4_000_000  # a task of fewer cells (rows x features) costs more to start than to run
ALONE_CELLS = 32_000_000  # rows x features of a node that one task grows on; a byte each
SENT_BYTES = 1 << 30  # of rows sent to such tasks in one job
SENT_ROWS = 8192  # in one record
ROUNDS_A_STEP = 20
SUMMARY = 8192  # values that stand for a feature's distribution
BLOCK_ROWS = 32768
PACKED = 2.0 ** 26  # more than a block's rows; sums of their weights stay below as much
FOUND = ["slot", "feature", "bin", "gain", "gl", "hl", "nl", "g", "h", "n"]


@dataclass(frozen=True)
class Growth:
    """Limits of a tree and the penalties of its values."""

    depth: int
    alpha: float = 0.0
    lam: float = 0.0
    child_weight: float = 0.0
    split_rows: int = 2
    leaf_rows: int = 1


@dataclass
class Tree:
    """Nodes in order of their making; the right child follows the left one."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    below: dict[int, tuple] = field(default_factory=dict)  # what other tasks grew on a node, as ``whole`` gives it

    def split(self, node: int, feature: int, cut: int, gain: float) -> int:
        self.feature[node], self.bin[node], self.gain[node], self.left[node] = feature, cut, gain, len(self.feature)
        for side in (self.feature, self.bin, self.left, self.value, self.gain):
            side += [0, 0]
        self.feature[-2:] = [-1, -1]
        return self.left[node]

    def arrays(self) -> tuple:
        return tuple(np.array(x) for x in (self.feature, self.bin, self.left, self.value))

    def whole(self) -> tuple:
        """Feature, bin, left child, value and gain of all nodes, in few bytes each."""
        parts = [[np.array(x, dtype=kind)] for x, kind in zip(
            (self.feature, self.bin, self.left, self.value, self.gain), KINDS)]
        size = len(self.feature)
        for node, grown in self.below.items():
            # the first of those nodes is the node itself; the others follow what is here
            grown = (*grown[:2], np.where(grown[0] >= 0, grown[2] + np.int32(size - 1), 0).astype(KINDS[2]), *grown[3:])
            for part, x in zip(parts, grown):
                part[0][node] = x[0]
                part.append(x[1:])
            size += len(grown[0]) - 1
        return tuple(np.concatenate(part) for part in parts)


KINDS = ("<i2", "u1", "<i4", "<f8", "<f8")
GROWN = "slot int, feature binary, bin binary, left binary, value binary, gain binary"


def _sent(slot: int, grown: tuple) -> pa.Table:
    """Nodes as a row of ``GROWN``."""
    return pa.table({"slot": pa.array([slot], pa.int32()), **{
        c: [x.tobytes()] for c, x in zip(("feature", "bin", "left", "value", "gain"), grown)}})


def _received(row: Row) -> tuple:
    return tuple(np.frombuffer(x, kind) for x, kind in zip(row[1:], KINDS))


def descend(arrays: tuple, bins: np.ndarray) -> np.ndarray:
    """Node each row ends in."""
    feature, cut, left, _ = arrays
    at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return at
        r, node = rows[inner], at[inner]
        at[inner] = left[node] + (bins[r, feature[node]] > cut[node])


def uniform(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row and a tree."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(times)
        return (x ^ x >> np.uint64(31)).astype(np.float64) / 2.0 ** 64


def share_of_rows(share: float, seed: int):
    """Each row with probability ``share``."""
    return lambda keys, tree: (uniform(keys, tree, seed) < share).astype(np.float64)


def bootstrap(seed: int):
    """How often each row is drawn: Poisson with mean 1, as drawing with replacement gives."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return lambda keys, tree: np.searchsorted(steps, uniform(keys, tree, seed), side="right").astype(np.float64)


def _summary(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights; of more than ``SUMMARY`` the middles of as many equal shares.

    Such a cut moves a rank by half a share at most; few values stay as they are, whatever the rows.
    """
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    values, weights = values[starts], np.add.reduceat(weights, starts)
    if len(values) > SUMMARY:
        upto = np.cumsum(weights)
        share = upto[-1] / SUMMARY
        picked, times = np.unique(np.searchsorted(upto, (np.arange(SUMMARY) + 0.5) * share), return_counts=True)
        values, weights = values[picked], times * share
    return values, weights


def _summaries(width: int, labels: int):
    """A summary per label and feature of a task's rows: (label, feature, values, weights).

    Columns of a row: the features, and per label a flag that tells whether it learns from the row.
    """
    def run(batches):
        # the summaries at place k stand for 2^k blocks of rows: a value is cut once per place, not per block
        held, flags, rows, places = [], [], 0, [[[] for _ in range(width)] for _ in range(labels)]

        def settle():
            x, learns = np.concatenate(held), np.concatenate(flags)
            for i, column in enumerate(x.T):
                order = np.argsort(column, kind="stable")  # once for all labels
                column, mine = column[order], learns[order]
                for label in range(labels):
                    values, own = column[mine[:, label]], places[label][i]
                    if not len(values):
                        continue
                    now = _summary(values, np.ones(len(values)))
                    for k in range(len(own) + 1):
                        if k == len(own):
                            own.append(now)
                        elif own[k] is None:
                            own[k] = now
                        else:
                            now, own[k] = _summary(*map(np.concatenate, zip(own[k], now))), None
                            continue
                        break
            held.clear()
            flags.clear()

        for b in batches:
            if b.num_rows:
                held.append(np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1))
                flags.append(np.column_stack([b.column(1 + k).to_numpy(zero_copy_only=False) for k in range(labels)]).astype(bool))
                rows += b.num_rows
                if rows >= BLOCK_ROWS:
                    settle()
                    rows = 0
        if held:
            settle()
        for label, i in ((label, i) for label in range(labels) for i in range(width)):
            parts = [p for p in places[label][i] if p is not None]
            if parts:
                values, weights = _summary(*map(np.concatenate, zip(*parts)))
                yield pa.RecordBatch.from_pydict(
                    {"label": [label], "feature": [i], "values": [values.tobytes()], "weights": [weights.tobytes()]},
                    pa.schema([("label", pa.int32()), ("feature", pa.int32()), ("values", pa.binary()), ("weights", pa.binary())]))
    return run


def cut_points(train: DataFrame, width: int, most: int) -> list[list[float]]:
    """Values that end a bin, per feature; every value if there are at most ``most``."""
    return label_cuts(train.select("x", F.lit(True)), width, 1, most)[0]


def label_cuts(rows: DataFrame, width: int, labels: int, most: int) -> list[list[list[float]]]:
    """Cut points of each label's rows, from one pass; ``rows`` are as ``_summaries`` takes them.

    A task sends one summary of at most ``SUMMARY`` values per label and feature; those that belong together meet in one group.
    """
    def run(key, table):
        parts = [(np.frombuffer(v), np.frombuffer(w)) for v, w in zip(table["values"].to_pylist(), table["weights"].to_pylist())]
        values, weights = map(np.concatenate, zip(*parts))
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(weights[order])
        distinct = np.unique(values)
        if len(distinct) <= most:
            cuts = distinct[:-1]
        else:
            # weights are sums of shares: a rank that falls on an edge is not to miss it by their last bits
            ranks = np.arange(1, most) * (upto[-1] / most) * (1 - 1e-12)
            cuts = np.unique(values[np.searchsorted(upto, ranks)])
        return pa.table({"label": [key[0].as_py()], "feature": [key[1].as_py()], "cuts": [cuts.tolist()]},
                        pa.schema([("label", pa.int32()), ("feature", pa.int32()), ("cuts", pa.list_(pa.float64()))]))

    found = rows.mapInArrow(_summaries(width, labels), "label int, feature int, values binary, weights binary").groupBy(
        "label", "feature").applyInArrow(run, "label int, feature int, cuts array<double>").collect()  # fewer than ``most`` each
    cuts = {(r.label, r.feature): list(r.cuts) for r in found}
    return [[cuts.get((label, i), []) for i in range(width)] for label in range(labels)]


def _bins(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    return np.column_stack([np.searchsorted(np.array(c), x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint8)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    data = b"".join(batch.column(batch.schema.get_field_index("bins")).to_pylist())
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, width)


BINNED = "key long, label double, margin double, bins binary"


def binned(train: DataFrame, cuts: list[list[float]], base: float) -> DataFrame:
    """(key, label, margin, bins) of the training rows."""
    return of_label(label_bins(train.select("x", F.lit(True).alias("f0"), F.col("label").alias("y0")), [cuts]), 0, base)


def label_bins(rows: DataFrame, cuts: list[list[list[float]]]) -> DataFrame:
    """(key, label, bins) of every label, by number, from one pass over (x, flags f0.., labels y0..).

    All three are null where a label does not learn from the row.
    """
    labels = range(len(cuts))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, out = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1), {}
            for i in labels:
                key, label, flag = b.columns[1 + 3 * i:4 + 3 * i]
                mine = flag.to_numpy(zero_copy_only=False).astype(bool)
                codes = iter(_bins(x[mine], cuts[i]))
                out |= {f"key{i}": key, f"y{i}": label, f"bins{i}": [next(codes).tobytes() if m else None for m in mine]}
            yield pa.RecordBatch.from_pydict(out)

    sent = [c for i in labels for c in (
        F.when(F.col(f"f{i}"), F.xxhash64("x", f"y{i}")).alias(f"key{i}"), F.when(F.col(f"f{i}"), F.col(f"y{i}")).alias(f"y{i}"), f"f{i}")]
    return rows.select("x", *sent).mapInArrow(run, ", ".join(f"key{i} long, y{i} double, bins{i} binary" for i in labels))


def of_label(table: DataFrame, i: int, base: float) -> DataFrame:
    """(key, label, margin, bins) of one label's rows."""
    return table.filter(f"bins{i} IS NOT NULL").select(
        F.col(f"key{i}").alias("key"), F.col(f"y{i}").alias("label"), F.lit(float(base)).alias("margin"), F.col(f"bins{i}").alias("bins"))


def _blocks(batches, width: int):
    """(bins, keys, labels, margins) of blocks of rows: sums over few rows cost more to begin than to make."""
    held, rows = [], 0

    def joined():
        return [np.concatenate(column) for column in zip(*held)]

    for b in batches:
        if b.num_rows:
            held.append((_matrix(b, width), *(_column(b, c) for c in ("key", "label", "margin"))))
            rows += b.num_rows
            if rows >= BLOCK_ROWS:
                yield joined()
                held, rows = [], 0
    if held:
        yield joined()


def _histograms(trees: range, weights, arrays: dict, slots: dict, n: int, width: int, bins: int, share: list,
                grid: float, more: list[tuple], rate: float):
    """Sums per (slot, feature, bin) of a task's rows: a row per share of the features, full cells alone."""
    def run(batches):
        total = np.zeros((3, n, width, bins))
        for x, keys, label, margin in _blocks(batches, width):
            for tree in more:
                margin = margin + rate * tree[3][descend(tree, x)]
            for t in arrays:
                weight = weights(keys, trees[t])
                rows = np.flatnonzero(weight)
                mine = x[rows]
                slot = slots[t][descend(arrays[t], mine)]
                if not (slot >= 0).all():
                    rows, mine, slot = rows[slot >= 0], mine[slot >= 0], slot[slot >= 0]
                if not len(rows):
                    continue
                w = weight[rows]
                g = np.rint(w * (margin[rows] - label[rows]) * grid)
                # a tree's slots lie together
                low, high = slot.min(), slot.max() + 1
                cells, start, once = (high - low) * bins, (slot - low) * bins, (w == 1.0).all()
                # weights and counts of a block are small whole numbers: one sum holds both
                both = None if once else w * PACKED + 1.0
                for f, column in enumerate(np.ascontiguousarray(mine.T)):
                    at = start + column
                    here = total[:, low:high, f]
                    here[0] += np.bincount(at, g, cells).reshape(-1, bins)
                    counts = np.bincount(at, both, cells).reshape(-1, bins)
                    sums = counts if once else np.floor(counts / PACKED)
                    here[1] += sums
                    here[2] += counts if once else counts - sums * PACKED
        for p, mine in enumerate(share):
            part = total[:, :, mine].reshape(3, -1)
            full = np.flatnonzero(part[2])
            if len(full):
                yield pa.RecordBatch.from_pydict({"part": [p], "cells": [full.astype("<i4").tobytes()], "sums": [part[:, full].tobytes()]},
                                                 pa.schema([("part", pa.int32()), ("cells", pa.binary()), ("sums", pa.binary())]))
    return run


def _searched(share: list, bins: int, allowed: np.ndarray, growth: "Growth", grid: float):
    """The histograms of a share of the features added up, and the best cut of each slot."""
    def run(key, table):
        mine = share[key[0].as_py()]
        total = np.zeros((3, len(allowed) * len(mine) * bins))
        for cells, values in zip(table["cells"], table["sums"]):
            at = np.frombuffer(cells.as_buffer(), "<i4")
            for k, v in enumerate(np.frombuffer(values.as_buffer()).reshape(3, -1)):
                total[k, at] += v
        rows = _best_cuts(total.reshape(3, len(allowed), len(mine), bins), mine, allowed[:, mine], growth, grid)
        return pa.table({c: rows[c] for c in FOUND})
    return run


def grow(data: DataFrame, trees: range, weights, masks: list[np.ndarray], growth: Growth, bins: int,
         grid: float, more: list[tuple] = (), rate: float = 1.0, tasks: int | None = None, rows: int | None = None) -> list[Tree]:
    """Grow trees together, a level at a time; ``tasks`` bounds those that search for cuts.

    ``rows`` counts the rows of the table. If it is given, nodes of few rows are grown by a task each.

    ``weights(keys, tree)`` counts rows; ``masks`` tells each tree's features; gradients are
    those of squared errors at ``margin`` plus ``rate`` times the values of the trees ``more``.
    """
    width = len(masks[0])
    parts = min(width, tasks or width, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = [np.flatnonzero(np.arange(width) % parts == p) for p in range(parts)]
    most_nodes = max(1, PASS_BYTES // (24 * width * bins))
    made = [Tree() for _ in trees]
    level, count = [(t, 0) for t in range(len(made))], dict.fromkeys(((t, 0) for t in range(len(made))), rows)
    for depth in range(growth.depth + 1):
        onward = []
        if rows is not None:
            few = [at for at in level if count[at] * width <= ALONE_CELLS]
            _grow_apart(data, trees, weights, masks, growth, bins, grid, more, rate, made, [(at, count[at]) for at in few], depth)
            level = [at for at in level if count[at] * width > ALONE_CELLS]
        for at in range(0, len(level), most_nodes):
            wanted = level[at:at + most_nodes]
            arrays = {t: made[t].arrays() for t in {t for t, _ in wanted}}
            slots = {t: np.full(len(made[t].feature), -1, dtype=np.int64) for t in arrays}
            for slot, (t, node) in enumerate(wanted):
                slots[t][node] = slot

            sums = _histograms(trees, weights, arrays, slots, len(wanted), width, bins, share, grid, more, rate)
            best = _searched(share, bins, np.array([masks[t] for t, _ in wanted]), growth, grid)
            kinds = "slot long, feature long, bin long, gain double, gl double, hl double, nl double, g double, h double, n double"
            found = data.mapInArrow(sums, "part int, cells binary, sums binary").groupBy("part").applyInArrow(best, kinds)
            chosen: dict = {}
            for r in found.collect():  # at most one row per node and share of features
                rank = (r.gain, -r.feature)
                if r.slot not in chosen or rank > chosen[r.slot][0]:
                    chosen[r.slot] = rank, r
            for slot, (t, node) in enumerate(wanted):
                if slot not in chosen:
                    continue  # no row
                r, tree = chosen[slot][1], made[t]
                tree.value[node] = _value(r.g, r.h, growth)
                if depth < growth.depth and r.gain > 1e-9 and r.n >= growth.split_rows:
                    left = tree.split(node, r.feature, r.bin, r.gain)
                    tree.value[left] = _value(r.gl, r.hl, growth)
                    tree.value[left + 1] = _value(r.g - r.gl, r.h - r.hl, growth)
                    if depth + 1 < growth.depth:
                        for k, n in enumerate((r.nl, r.n - r.nl)):
                            if n >= growth.split_rows:
                                onward.append((t, left + k))
                                count[t, left + k] = n
        level = onward
        if not level:
            break
    return made


def _value(g: float, h: float, growth: Growth) -> float:
    return -math.copysign(max(abs(g) - growth.alpha, 0.0), g) / (h + growth.lam) if h + growth.lam > 0 else 0.0


def _best_cuts(total: np.ndarray, features: np.ndarray, allowed: np.ndarray, growth: Growth, grid: float) -> dict:
    """The best cut of each node among some features; gain 0 where none may be made."""
    def worth(g, h):
        kept = np.maximum(np.abs(g) - growth.alpha, 0.0)
        return np.divide(kept * kept, h + growth.lam, out=np.zeros_like(kept), where=h + growth.lam > 0)

    g, h, n = np.cumsum(total, axis=3)
    g = g / grid
    whole = [x[:, :, -1:] for x in (g, h, n)]
    gain = 0.5 * (worth(g, h) + worth(whole[0] - g, whole[1] - h) - worth(whole[0], whole[1]))
    least = np.minimum(h, whole[1] - h) >= growth.child_weight
    least &= np.minimum(n, whole[2] - n) >= max(1, growth.leaf_rows)
    gain = np.where(least & allowed[:, :, None], gain, 0.0).reshape(len(g), -1)
    best = np.argmax(gain, axis=1)
    rows = np.arange(len(best))
    which, cut = np.divmod(best, g.shape[2])
    there = whole[2][:, 0, 0] > 0
    out = {"slot": rows, "feature": features[which], "bin": cut, "gain": gain[rows, best],
           **{k: x[rows, which, cut] for k, x in zip(("gl", "hl", "nl"), (g, h, n))},
           **{k: x[:, 0, 0] for k, x in zip("ghn", whole)}}
    return {k: v[there] for k, v in out.items()}


# --- nodes whose rows are all in one task ------------------------------------------------

def _values(g: np.ndarray, h: np.ndarray, growth: Growth) -> np.ndarray:
    """What ``_value`` gives, of many nodes."""
    there = h + growth.lam > 0
    return -np.divide(np.copysign(np.maximum(np.abs(g) - growth.alpha, 0.0), g), h + growth.lam, out=np.zeros(len(g)), where=there)


def _dense_cuts(columns: np.ndarray, g, w, sizes: np.ndarray, growth: Growth, bins: int) -> dict:
    """The best cut of each node from sums per bin; rows lie by node, ``sizes`` counts them."""
    width, found = len(columns), []
    step = max(1, 1_000_000 // (width * bins))
    ends = np.cumsum(sizes)
    for a in range(0, len(sizes), step):
        mine = sizes[a:a + step]
        low, high = ends[a] - sizes[a], ends[a + len(mine) - 1]
        start, n = np.repeat(np.arange(len(mine)) * bins, mine), len(mine) * bins
        total = np.zeros((3, len(mine), width, bins))
        both = None if w is None else w[low:high] * PACKED + 1.0
        for f in range(width):
            at = start + columns[f, low:high]
            total[0, :, f] = np.bincount(at, g[low:high], n).reshape(-1, bins)
            counts = np.bincount(at, both, n).reshape(-1, bins)
            sums = counts if w is None else np.floor(counts / PACKED)
            total[1, :, f] = sums
            total[2, :, f] = counts if w is None else counts - sums * PACKED
        found.append(_best_cuts(total, np.arange(width), np.ones((len(mine), width), dtype=bool), growth, 1.0))
    return {c: np.concatenate([x[c] for x in found]) for c in FOUND[1:]}


def _sparse_cuts(columns: np.ndarray, g, w, sizes: np.ndarray, growth: Growth, bins: int) -> dict:
    """The same of nodes of few rows, whose bins are nearly all empty: from their rows in order of bins.

    A node's rows take the same places in every feature's order, so a cut's row count is its place.
    """
    width, n = columns.shape
    node = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = np.ones(n) if w is None else w
    upto = [np.concatenate(([0.0], np.cumsum(x))) for x in (g, h)]
    before, whole = [x[starts] for x in upto], [x[ends] - x[starts] for x in upto]
    place = np.arange(n)
    count = place + 1 - starts[node]

    def worth(a, b):
        kept = np.maximum(np.abs(a) - growth.alpha, 0.0)
        kept *= kept
        kept /= b + growth.lam
        return kept

    best, feature, cut, gl, hl, nl = np.zeros(len(sizes)), *(np.zeros(len(sizes), dtype=k) for k in (np.int64, np.int64, float, float, float))
    rest = sizes[node] - count
    apart = np.minimum(count, rest) >= max(1, growth.leaf_rows)
    code = node * bins
    step = max(1, 200_000 // max(1, n))
    with np.errstate(divide="ignore", invalid="ignore"):
        base = worth(*whole)[node]
        for a in range(0, width, step):
            keys = np.sort((code + columns[a:a + step]) << 32 | place, axis=1)
            rows, kinds = keys & 0xFFFFFFFF, keys >> 32
            left = np.cumsum(g[rows], axis=1) - before[0][node]
            # with weights of 1 a node's sum of them is its count
            heavy = np.broadcast_to(count.astype(float), left.shape) if w is None else np.cumsum(h[rows], axis=1) - before[1][node]
            other = whole[1][node] - heavy
            gain = 0.5 * (worth(left, heavy) + worth(whole[0][node] - left, other) - base)
            valid = apart & (np.minimum(heavy, other) >= growth.child_weight)
            valid[:, :-1] &= kinds[:, 1:] != kinds[:, :-1]
            gain = np.where(valid, gain, 0.0)
            tops = np.maximum.reduceat(gain, starts, axis=1)
            first = np.argmax(tops, axis=0)
            top = tops[first, np.arange(len(sizes))]
            better = np.flatnonzero(top > best)
            if len(better):
                line = first[node]
                at = np.flatnonzero((gain[line, place] == top[node]) & (top > best)[node])
                owner = node[at]
                at = at[np.r_[True, owner[1:] != owner[:-1]]]
                mine = node[at]
                best[mine], feature[mine], cut[mine] = top[mine], first[mine] + a, kinds[first[mine], at] - mine * bins
                gl[mine], hl[mine], nl[mine] = left[first[mine], at], heavy[first[mine], at], count[at]
    return {"feature": feature, "bin": cut, "gain": best, "gl": gl, "hl": hl, "nl": nl, "g": whole[0], "h": whole[1], "n": sizes.astype(float)}


def _cuts_of_level(columns: np.ndarray, g, w, sizes: np.ndarray, growth: Growth, bins: int) -> dict:
    dense = sizes >= bins
    if dense.all() or not dense.any():
        return (_dense_cuts if dense.any() else _sparse_cuts)(columns, g, w, sizes, growth, bins)
    rows, out = np.repeat(dense, sizes), {}
    for search, nodes, mine in ((_dense_cuts, dense, rows), (_sparse_cuts, ~dense, ~rows)):
        mine = np.flatnonzero(mine)
        for c, x in search(columns[:, mine], g[mine], None if w is None else w[mine], sizes[nodes], growth, bins).items():
            out.setdefault(c, np.zeros(len(sizes), dtype=x.dtype))[nodes] = x
    return out


def _grown(columns: np.ndarray, features: np.ndarray, g, w, growth: Growth, bins: int, depth: int = 0) -> tuple:
    """The tree on one node at ``depth``, as ``Tree.whole`` gives it: the trees that passes of ``grow`` give.

    ``columns`` has the bins of the features that may be cut, a line each; ``w`` is None if all rows weigh 1.
    """
    n = len(g)
    most = min(2 * n + 1, (2 << growth.depth - depth) + 1)
    feature, cut, left, value, gain = (np.zeros(most, dtype=k) for k in KINDS)
    feature[:] = -1
    made = 1
    value[:1] = _values(np.array([g.sum()]), np.array([n if w is None else w.sum()], dtype=float), growth)
    sizes, nodes = np.array([n]), np.array([0])
    if not n or n < growth.split_rows:
        nodes = nodes[:0]
    while depth < growth.depth and len(nodes):
        found = _cuts_of_level(columns, g, w, sizes, growth, bins)
        split = found["gain"] > 1e-9
        if not split.any():
            break
        f = {c: x[split] for c, x in found.items()}
        at, k = nodes[split], int(split.sum())
        child = made + 2 * np.arange(k)
        made += 2 * k
        feature[at], cut[at], left[at], gain[at] = features[f["feature"]], f["bin"], child, f["gain"]
        value[child], value[child + 1] = _values(f["gl"], f["hl"], growth), _values(f["g"] - f["gl"], f["h"] - f["hl"], growth)
        depth += 1
        if depth == growth.depth:
            break
        counts = np.column_stack([f["nl"], f["n"] - f["nl"]]).astype(np.int64).ravel()
        onward = counts >= growth.split_rows
        number = np.where(onward, np.cumsum(onward) - 1, -1)
        rank = np.cumsum(split) - 1
        owner = np.repeat(np.arange(len(sizes)), sizes)
        rows = np.flatnonzero(split[owner])
        mine = rank[owner[rows]]
        slot = number[2 * mine + (columns[f["feature"][mine], rows] > f["bin"][mine])]
        kept = slot >= 0
        rows, slot = rows[kept], slot[kept]
        rows = rows[np.argsort(slot, kind="stable")]
        columns, g, w = columns[:, rows], g[rows], None if w is None else w[rows]
        nodes = np.column_stack([child, child + 1]).ravel()[onward]
        sizes = counts[onward]
    return tuple(x[:made] for x in (feature, cut, left, value, gain))


def _grow_apart(data: DataFrame, trees: range, weights, masks, growth: Growth, bins: int, grid: float, more, rate: float,
                made: list[Tree], few: list[tuple], depth: int) -> None:
    """Send the rows of each node to one task, which grows all that is below; ``few`` has (tree, node) and a count of rows."""
    if not few:
        return
    width, at = len(masks[0]), 0
    while at < len(few):
        wanted, sent = [], 0
        while at < len(few) and (not wanted or sent + few[at][1] * width <= SENT_BYTES):
            wanted.append(few[at][0])
            sent += few[at][1] * width
            at += 1
        arrays = {t: made[t].arrays() for t in {t for t, _ in wanted}}
        slots = {t: np.full(len(made[t].feature), -1, dtype=np.int64) for t in arrays}
        for slot, (t, node) in enumerate(wanted):
            slots[t][node] = slot
        allowed = [np.flatnonzero(masks[t]) for t, _ in wanted]

        def rows_of(batches):
            for x, keys, label, margin in _blocks(batches, width):
                for tree in more:
                    margin = margin + rate * tree[3][descend(tree, x)]
                for t in arrays:
                    weight = weights(keys, trees[t])
                    rows = np.flatnonzero(weight)
                    slot = slots[t][descend(arrays[t], x[rows])] if len(slots[t]) > 1 else np.full(len(rows), slots[t][0])
                    order = np.argsort(slot, kind="stable")
                    rows, slot = rows[order], slot[order]
                    g = np.rint(weight[rows] * (margin[rows] - label[rows]) * grid) / grid
                    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else slot
                    for a, b in zip(starts, np.r_[starts[1:], len(slot)]):
                        for c in range(a, b, SENT_ROWS) if slot[a] >= 0 else ():
                            mine = slice(c, min(b, c + SENT_ROWS))
                            yield pa.RecordBatch.from_pydict(
                                {"slot": pa.array([slot[a]], pa.int32()), "bins": [x[rows[mine]].tobytes()], "g": [g[mine].tobytes()],
                                 "w": [weight[rows[mine]].astype("u1").tobytes()]})

        def below(key, table):
            def joined(name, kind):
                return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table[name]])
            slot = key[0].as_py()
            w = joined("w", "u1")
            columns = np.ascontiguousarray(joined("bins", "u1").reshape(-1, width).T[allowed[slot]])
            return _sent(slot, _grown(columns, allowed[slot], joined("g", "<f8"), None if (w == 1).all() else w.astype(np.float64),
                                      growth, bins, depth))

        parts = min(len(wanted), 4 * _cores(data))
        sent = data.mapInArrow(rows_of, "slot int, bins binary, g binary, w binary").repartition(parts, "slot")
        for row in sent.groupBy("slot").applyInArrow(below, GROWN).collect():  # what one job grew
            t, node = wanted[row.slot]
            made[t].below[node] = _received(row)


def _boosted_alone(data: DataFrame, weights, masks: list[np.ndarray], growth: Growth, bins: int, grid: float, rate: float) -> list[tuple]:
    """All rounds of boosting by one task: what ``grow`` gives round by round."""
    width = len(masks[0])

    def run(batches):
        blocks = list(_blocks(batches, width))
        if not blocks:
            return
        x, keys, label, margin = map(np.concatenate, zip(*blocks))
        columns = np.ascontiguousarray(x.T)
        for round_, mask in enumerate(masks):
            rows, features = np.flatnonzero(weights(keys, round_)), np.flatnonzero(mask)
            g = np.rint((margin[rows] - label[rows]) * grid) / grid
            tree = _grown(columns[np.ix_(features, rows)], features, g, None, growth, bins)
            margin = margin + rate * tree[3][descend(tree[:4], x)]
            yield from _sent(round_, tree).to_batches()

    # a row per round
    return [_received(row) for row in sorted(data.coalesce(1).mapInArrow(run, GROWN).collect(), key=lambda r: r.slot)]


# --- models ----------------------------------------------------------------------------

class TreeModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Sum of trees: ``base`` + ``rate`` x values. Kept whole in its parameters."""

    @keyword_only
    def __init__(self, trees: str = "[]", cuts: str = "[]", base: float = 0.0, rate: float = 1.0, importance: str = "[]"):
        super().__init__()
        for name, kind in (("trees", TypeConverters.toString), ("cuts", TypeConverters.toString),
                           ("base", TypeConverters.toFloat), ("rate", TypeConverters.toFloat),
                           ("importance", TypeConverters.toString)):
            setattr(self, name, Param(self, name, name, kind))
        self._set(**self._input_kwargs)

    def value(self, name: str):
        found = self.getOrDefault(name)
        if name == "trees":
            return [[x.tolist() for x in tree] for tree in _unpacked(found)]
        return json.loads(found) if isinstance(found, str) else found

    @property
    def featureImportances(self):
        return Vectors.dense(self.value("importance"))

    def _transform(self, df: DataFrame) -> DataFrame:
        cuts, base, rate = self.value("cuts"), self.value("base"), self.value("rate")
        trees = _unpacked(self.getOrDefault("trees"))

        @F.pandas_udf("double")
        def predicted(features):
            x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, len(cuts)))
            rows = _bins(x.astype(np.float64), cuts)
            total = np.full(len(rows), base)
            for tree in trees:
                total += rate * tree[3][descend(tree, rows)]
            import pandas as pd
            return pd.Series(total)

        return df.withColumn("prediction", predicted(vector_to_array("features")))


def _importance(trees: list[tuple], width: int, average: bool) -> list[float]:
    """Gains per feature, as shares: of all cuts, or per cut with ``average``."""
    total, cuts = np.zeros(width), np.zeros(width)
    for feature, _, _, _, gain in trees:
        inner = feature >= 0
        np.add.at(total, feature[inner], gain[inner])
        np.add.at(cuts, feature[inner], 1)
    if average:
        total = total / np.maximum(cuts, 1)
    return (total / (total.sum() or 1.0)).tolist()


def _packed(trees: list[tuple]) -> str:
    """Feature, bin, left child and value of all nodes as text: a forest has millions of them."""
    out = io.BytesIO()
    np.savez(out, sizes=np.array([len(t[0]) for t in trees]), **{
        f"part{i}": np.concatenate([t[i] for t in trees] or [np.zeros(0, KINDS[i])]) for i in range(4)})
    return base64.b64encode(zlib.compress(out.getvalue(), 1)).decode()


def _unpacked(text: str) -> list[tuple]:
    """What ``_packed`` was given; models saved before are lists in JSON."""
    if text.startswith("["):
        return [tuple(np.array(x) for x in t) for t in json.loads(text)]
    held = np.load(io.BytesIO(zlib.decompress(base64.b64decode(text))))
    ends = np.cumsum(held["sizes"])[:-1]
    return list(zip(*(np.split(held[f"part{i}"], ends) for i in range(4))))


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


@dataclass
class Binned:
    """What a fit needs of one label: its rows in bins, and facts of them."""

    state: DataFrame
    cuts: list[list[float]]
    facts: Row
    grid: float
    tasks: int


def _facts(rows: DataFrame, labels: int) -> list[Row]:
    """Count, mean and range of each label, over the rows it learns from."""
    def of(i):
        label = F.when(F.col(f"f{i}"), F.col(f"y{i}"))
        # the mean of decimals: the same to the last bit however rows are dealt
        total = F.sum(label.cast("decimal(38,12)")).cast("double")
        n = F.count_if(F.col(f"f{i}"))
        return F.struct(n.alias("n"), F.try_divide(total, n).alias("mean"), F.min(label).alias("low"), F.max(label).alias("high")).alias(f"l{i}")
    return list(rows.agg(*[of(i) for i in range(labels)]).first())


def _grid(facts: Row) -> float:
    spread = max(facts.high - facts.mean, facts.mean - facts.low) or 1.0
    # sums of n gradients, each up to 16 spreads, stay whole numbers in a double
    return 2.0 ** math.floor(math.log2(2.0 ** 53 / (facts.n * 16.0 * spread)))


def _tasks(rows: DataFrame, n: int, width: int) -> int:
    """Small tables in few tasks, large ones in one per core.

    Each task sends histograms of all nodes, so more tasks would send more, and no sooner.
    """
    return min(1 + n * width // TASK_CELLS, _cores(rows))


class LabelBins:
    """Cut points and bins of several labels, for every fit that wants them: one pass over a table for each of the two.

    ``labels`` are (value, flag) pairs of columns; a null flag counts as false.
    """

    def __init__(self, table: DataFrame, labels: list[tuple[str, str]], bins: int):
        rows = table.select(vector_to_array("features").alias("x"), *[c for i, (value, flag) in enumerate(labels) for c in (
            F.coalesce(F.col(f"`{flag}`"), F.lit(False)).alias(f"f{i}"), F.col(f"`{value}`").cast("double").alias(f"y{i}"))])
        self.facts = _facts(rows, len(labels))
        most = max(f.n for f in self.facts)
        if not most:
            raise ValueError("trees need rows to learn from")
        learnt = rows.filter(" OR ".join(f"f{i}" for i in range(len(labels))))
        width = len(learnt.first()["x"])
        self.cuts = label_cuts(learnt.select("x", *[f"f{i}" for i in range(len(labels))]).coalesce(_cores(rows)), width, len(labels), bins)
        self.tasks = _tasks(rows, most, width)
        self.table = label_bins(learnt, self.cuts).coalesce(self.tasks).persist(StorageLevel.MEMORY_AND_DISK)
        self.table.count()  # made once, before fits ask for it at the same time

    def of(self, i: int) -> Binned:
        facts = self.facts[i]
        if not facts.n:
            raise ValueError("trees need rows to learn from")
        return Binned(of_label(self.table, i, facts.mean), self.cuts[i], facts, _grid(facts), self.tasks)

    def unpersist(self) -> None:
        self.table.unpersist()


class _Trees:
    def _prepared(self, train: DataFrame):
        rows = train.select(vector_to_array("features").alias("x"), "label")
        width = len(rows.first()["x"])
        cuts = cut_points(rows.coalesce(_cores(rows)), width, self.bins)
        facts, = _facts(rows.select(F.lit(True).alias("f0"), F.col("label").alias("y0")), 1)
        return rows, cuts, facts, _grid(facts)

    @staticmethod
    def _state(rows: DataFrame, cuts: list, facts) -> tuple[DataFrame, int]:
        """Binned rows, kept."""
        tasks = _tasks(rows, facts.n, len(cuts))
        return binned(rows, cuts, facts.mean).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK), tasks

    def fit(self, train: DataFrame) -> TreeModel:
        rows, cuts, facts, grid = self._prepared(train)
        state, tasks = self._state(rows, cuts, facts)
        try:
            return self.fit_binned(Binned(state, cuts, facts, grid, tasks))
        finally:
            state.unpersist()


class BoostedTrees(_Trees):
    """Gradient boosting of squared errors from the mean of the labels."""

    def __init__(self, rounds: int = 500, rate: float = 0.03, growth: Growth = Growth(8, 0.1, 1.0, 3.0),
                 rows: float = 0.8, features: float = 0.8, bins: int = 64, seed: int = 42):
        self.rounds, self.rate, self.growth, self.rows = rounds, rate, growth, rows
        self.features, self.bins, self.seed = features, bins, seed

    def fit_binned(self, given: Binned) -> TreeModel:
        state, spark = given.state, given.state.sparkSession
        draw, width, made, more, written = np.random.default_rng(self.seed), len(given.cuts), [], [], None
        masks = []
        for _ in range(self.rounds):
            mask = np.zeros(width, dtype=bool)
            mask[draw.choice(width, max(1, round(self.features * width)), replace=False)] = True
            masks.append(mask)
        weights = share_of_rows(self.rows, self.seed)
        if given.facts.n * width <= ALONE_CELLS:
            return self._model(given, _boosted_alone(state, weights, masks, self.growth, self.bins, given.grid, self.rate))
        for round_, mask in enumerate(masks):
            tree, = grow(state, range(round_, round_ + 1), weights, [mask], self.growth,
                         self.bins, given.grid, more, self.rate, given.tasks)
            made.append(tree.whole())
            more.append(tree.arrays())
            if len(more) == ROUNDS_A_STEP and round_ + 1 < self.rounds:
                # margins are written out, so neither a plan nor a task carries all rounds
                path = work_folder(spark, "margins")
                _with_margins(state, width, more, self.rate).write.parquet(path)
                if written:
                    written.unpersist()
                written = state = spark.read.schema(BINNED).parquet(path).persist(StorageLevel.MEMORY_AND_DISK)
                more = []
        if written:
            written.unpersist()
        return self._model(given, made)

    def _model(self, given: Binned, made: list[tuple]) -> TreeModel:
        return TreeModel(trees=_packed(made), cuts=json.dumps(given.cuts), base=float(given.facts.mean), rate=self.rate,
                         importance=json.dumps(_importance(made, len(given.cuts), average=True)))


def _with_margins(state: DataFrame, width: int, trees: list[tuple], rate: float) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, margin = _matrix(b, width), _column(b, "margin")
                for tree in trees:
                    margin = margin + rate * tree[3][descend(tree, x)]
                yield b.set_column(b.schema.get_field_index("margin"), "margin", pa.array(margin))

    return state.mapInArrow(run, BINNED)


class RandomForest(_Trees):
    """Mean of trees, each grown on rows drawn with replacement, over all features."""

    def __init__(self, trees: int = 200, growth: Growth = Growth(15, split_rows=5, leaf_rows=2), bins: int = 64,
                 seed: int = 42):
        self.trees, self.growth, self.bins, self.seed = trees, growth, bins, seed

    def fit_binned(self, given: Binned) -> TreeModel:
        every = np.ones(len(given.cuts), dtype=bool)
        made = grow(given.state, range(self.trees), bootstrap(self.seed), [every] * self.trees, self.growth, self.bins, given.grid,
                    tasks=given.tasks, rows=given.facts.n)
        made = [tree.whole() for tree in made]
        return TreeModel(trees=_packed(made), cuts=json.dumps(given.cuts), base=float(given.facts.mean), rate=1.0 / self.trees,
                         importance=json.dumps(_importance(made, len(given.cuts), average=False)))
