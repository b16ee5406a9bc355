"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most ``radius`` bits are linked. The 64 bits are grouped into
partitions, correlated bits together, and partition i gets a threshold t_i with
sum(t_i + 1) = radius + 1, so a linked pair is within t_i in at least one partition (-1: never
probed there). Thresholds and the number of partitions come from a dynamic program over the
candidate counts that bit statistics of all fingerprints predict. Each fingerprint is sent to
the cells of its partition values and of those within the threshold; cells are verified.

A cell with many fingerprints is cut again by the same principle over its other bits, until
no cell is large. Inside a cell a search takes linked fingerprints out of the pool as it
reaches them, so it writes one edge per fingerprint and not one per pair. Connected
components of the edges then come from rounds of joins.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import arrow_map, ascii_words, discard, stored

BITS = 64
SEED = 42
FEW = 64           # rows of a cell that are compared offset by offset
CELL_ROWS = 20000  # a larger cell is cut again


# --- Fingerprints -------------------------------------------------------------

def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned fingerprint of one text; zero without words."""
    words = ascii_words(text)
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, SEED) for s in shingles], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some 64-bit hashes have; zero of none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 keep: tuple | list = ()) -> DataFrame:
    """id, fp (the fingerprint as a signed long) and ``keep`` columns; a null text counts as empty."""
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]],
                names=["id", "fp", *keep])

    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *keep)
    schema = chosen.withColumn("fp", F.lit(0).cast("long")).select("id", "fp", *keep).schema
    return arrow_map(chosen, run, schema)


# --- Partitions and thresholds ------------------------------------------------

def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how many have both bits i and j (i = j: bit i); 64 x 64 numbers."""
    def count(batches):
        both, rows = np.zeros((BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            rows += len(fps)
        cell = np.concatenate(([rows], both.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cell))), pa.array(cell)], names=["i", "n"])

    sums = arrow_map(distinct.select("fp"), count, "i long, n long").groupBy("i").agg(F.sum("n"))
    cells = np.zeros(1 + BITS * BITS, dtype=np.int64)
    for i, n in sums.collect():  # 4,097 numbers
        cells[i] = n
    return int(cells[0]), cells[1:].reshape(BITS, BITS)


def _agreements(rows: int, both: np.ndarray):
    """P(two fingerprints agree in bit i), and P(agree in i and in j)."""
    p = (both + 1.0) / (rows + 4.0)
    one = np.diag(p)
    cells = [p, one[:, None] - p, one[None, :] - p, 1 - one[:, None] - one[None, :] + p]
    return one * one + (1 - one) ** 2, sum(np.clip(c, 1e-9, 1) ** 2 for c in cells)


def grouped_bits(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` groups of about equal size, each grown along strong correlations."""
    p = both / max(rows, 1)
    one = np.clip(np.diag(p), 1e-6, 1 - 1e-6)
    strength = np.abs(p - np.outer(one, one)) / np.sqrt(np.outer(one * (1 - one), one * (1 - one)))
    np.fill_diagonal(strength, -1)
    left, groups = set(range(BITS)), []
    for part in range(parts):
        size = len(left) // (parts - part)
        pool = sorted(left)
        seed = max(pool, key=lambda i: max((strength[i, j] for j in pool if j != i), default=0))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda j: strength[group, j].mean())
            group.append(best)
            left.remove(best)
        groups.append(group)
    return groups


def _within(group: list[int], agree: np.ndarray, joint: np.ndarray, most: int) -> np.ndarray:
    """P(at most t of the group's bits differ), t = 0..most, as a chain along the group."""
    state = np.zeros((2, most + 1))  # last bit differs / agrees, number that differ
    state[1, 0] = agree[group[0]]
    if most:
        state[0, 1] = 1 - agree[group[0]]
    for i, j in zip(group, group[1:]):
        stay = min(1.0, joint[i, j] / agree[i])
        back = min(1.0, max(0.0, (agree[j] - joint[i, j]) / max(1e-9, 1 - agree[i])))
        after = np.zeros_like(state)
        after[1] = state[1] * stay + state[0] * back
        after[0, 1:] = state[1, :-1] * (1 - stay) + state[0, :-1] * (1 - back)
        state = after
    return np.cumsum(state.sum(axis=0))


def _variants(width: int, threshold: int) -> int:
    return sum(len(list(combinations(range(width), d))) for d in range(threshold + 1))


def allocation(rows: int, both: np.ndarray, radius: int = 3, choices=(3, 4, 5, 6)
               ) -> list[tuple[list[int], int]]:
    """(bits, threshold) per probed partition, of the least predicted work.

    Work counts a row sent to a cell as 500 comparisons.
    """
    agree, joint = _agreements(rows, both)
    best = None
    for parts in choices:
        groups = grouped_bits(rows, both, parts)
        cost = []
        for group in groups:
            near = _within(group, agree, joint, radius)
            line = [0.0]
            for t in range(min(radius, 2) + 1):
                sent = _variants(len(group), t)
                line.append(500.0 * rows * sent + near[t] * sent * rows * rows / 2)
            cost.append(line)
        # least[u]: the least cost so far whose thresholds, each plus one, sum to u
        least = {0: (0.0, [])}
        for line in cost:
            after: dict = {}
            for used, (c, picks) in least.items():
                for k, more in enumerate(line):
                    u = used + k
                    if u <= radius + 1 and (u not in after or c + more < after[u][0]):
                        after[u] = (c + more, [*picks, k - 1])
            least = after
        if radius + 1 in least and (best is None or least[radius + 1][0] < best[0]):
            best = (least[radius + 1][0], groups, least[radius + 1][1])
    return [(sorted(g), t) for g, t in zip(best[1], best[2]) if t >= 0]


# --- Candidate cells ----------------------------------------------------------

def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def cells_of(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(cell, used, fp): one row per fingerprint and cell it is probed in; used: bits fixed."""
    rows = []
    for part, (bits, threshold) in enumerate(plan):
        flips = [mask_of(c) for d in range(threshold + 1) for c in combinations(bits, d)]
        value = F.col("fp").bitwiseAND(F.lit(signed(mask_of(bits))))
        probes = F.explode(F.array(*[value.bitwiseXOR(F.lit(signed(f))) for f in flips]))
        # what a cell with a threshold above zero shares is not fixed: nothing is used up there
        used = mask_of(bits) if threshold == 0 else 0
        rows.append(distinct.select(probes.alias("value"), "fp").select(
            F.xxhash64(F.lit(part), "value").alias("cell"), F.lit(signed(used)).cast("long").alias("used"), "fp"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _cut_again(cells: DataFrame) -> DataFrame:
    """Rows of large cells sent to smaller ones: four groups of the bits not yet fixed.

    A linked pair of the cell differs in at most three bits in all, so it agrees in one group.
    """
    def run(frames):
        for frame in frames:
            for used, part in frame.groupby("used", sort=True):
                free = [b for b in range(BITS) if not int(used) >> b & 1]
                fps = part["fp"].to_numpy().view(np.uint64)
                for group in (free[i::4] for i in range(4)):
                    mask = mask_of(group)
                    value = fps & np.uint64(mask)
                    names = [signed(xxhash.xxh64_intdigest(f"{c}:{mask}:{v}")) for c, v in
                             zip(part["cell"], value)]
                    yield pd.DataFrame({"cell": names, "used": signed(int(used) % (1 << 64) | mask),
                                        "fp": part["fp"].to_numpy()})

    return cells.mapInPandas(run, "cell long, used long, fp long")


def linked_in_cell(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (smallest member, member) that connect what is linked among distinct ``fps``."""
    pool, edges = np.sort(fps), []
    while len(pool):
        root, queue, pool = pool[0], [pool[0]], pool[1:]
        while queue and len(pool):
            near = np.bitwise_count(pool ^ queue.pop()) <= radius
            if near.any():
                found = pool[near]
                edges += [(root, f) for f in found]
                queue += list(found)
                pool = pool[~near]
    return edges


def _edges(cells: DataFrame, radius: int, partitions: int) -> DataFrame:
    """Verified edges (a < b as unsigned numbers, given as signed longs)."""
    def pairs(cell, fps):
        """Rows sorted by cell, whole cells only."""
        left, right = [], []
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        row_size = np.repeat(sizes, sizes)
        few = row_size <= FEW
        c, f = cell[few], fps[few]
        for k in range(1, min(FEW, int(sizes.max(initial=1)))):
            near = np.flatnonzero((c[k:] == c[:-k]) & (np.bitwise_count(f[k:] ^ f[:-k]) <= radius)
                                  & (f[k:] != f[:-k]))
            left.append(np.minimum(f[near], f[near + k]))
            right.append(np.maximum(f[near], f[near + k]))
        for at, size in zip(starts[sizes > FEW], sizes[sizes > FEW]):
            found = linked_in_cell(np.unique(fps[at:at + size]), radius)
            left.append(np.array([a for a, _ in found], dtype=np.uint64))
            right.append(np.array([b for _, b in found], dtype=np.uint64))
        return np.concatenate(left or [fps[:0]]), np.concatenate(right or [fps[:0]])

    def run(frames):
        kept_cell, kept_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for frame in frames:
            cell = np.concatenate((kept_cell, frame["cell"].to_numpy()))
            fps = np.concatenate((kept_fps, frame["fp"].to_numpy().view(np.uint64)))
            if not len(cell):
                continue
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            kept_cell, kept_fps = cell[cut:], fps[cut:]
            if cut:
                a, b = pairs(cell[:cut], fps[:cut])
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
        if len(kept_cell):
            a, b = pairs(kept_cell, kept_fps)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = cells.select("cell", "fp").repartition(partitions, "cell").sortWithinPartitions("cell")
    return dealt.mapInPandas(run, "a long, b long")


def links(distinct: DataFrame, radius: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges between fingerprints whose components are those of all linked pairs."""
    spark = distinct.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, both = bit_counts(distinct)
    cells = cells_of(distinct, allocation(rows, both, radius))
    found = []
    for _ in range(6):
        sizes = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows), "large")
        if not sizes.limit(1).count():
            break
        large = cells.join(sizes.select("cell"), "cell", "left_semi")
        found.append(_edges(cells.join(sizes.select("cell"), "cell", "left_anti"), radius, partitions))
        cells = stored(_cut_again(large), "cells")
    found.append(_edges(cells, radius, partitions))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


# --- Components ---------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node reachable.

    Rounds of large-star and small-star: every node's neighbours are hung on the least of
    them. Least neighbours are aggregates and neighbours meet them by join, so a node with
    very many neighbours is no single task's. Rounds end when the edges stay as they are.
    """
    def least(pairs):
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    now, before = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges"), None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        mins = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        down = large.distinct()
        roots = least(down)
        small = down.join(roots, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            roots.select("u", F.col("m").alias("v"))).filter("u <> v")
        done, now = now, stored(small.select(F.greatest("u", "v").alias("b"), F.least("u", "v").alias("a")).distinct(), "edges")
        discard(done)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = mark


def near_duplicates(docs: DataFrame, radius: int = 3, id_column: str = "doc_id", text_column: str = "text"
                    ) -> DataFrame:
    """Id, fingerprint (16 hex digits) and component_id (least id reachable) per row of ``docs``.

    Rows with one fingerprint are linked, and so are fingerprints within ``radius`` bits.
    Null ids take part but are never a component's id: a group of null ids alone has a null
    one. A text without words has fingerprint zero. Repeated rows repeat. Other columns are
    left out.
    """
    marked = stored(fingerprints(docs, id_column, text_column), "fingerprints")
    return with_components(marked, radius).select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least").alias("component_id"))


def with_components(marked: DataFrame, radius: int = 3) -> DataFrame:
    """``marked`` (fp, id, ...) with root (a fingerprint) and least (the component's least id)."""
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = stored(components(links(distinct, radius)), "components")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("least"))
    of_fp = rooted.select("fp", "root").join(lowest, "root")
    return marked.join(of_fp, "fp")


def one_of_each(docs: DataFrame, radius: int = 3, id_column: str = "doc_id", text_column: str = "text"
                ) -> DataFrame:
    """Rows of ``docs``, all columns: of each component the row of the least id.

    Rows that share that id are told apart by a digest of their text, and of rows equal in
    both one stays. Components whose ids are all null keep the row of the least digest.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    marks = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    marked = stored(fingerprints(marks, "id", "text", ["mark"]), "fingerprints")
    return least_rows(docs, with_components(marked, radius), id_column, text_column)


def least_rows(docs: DataFrame, rooted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Of each root in ``rooted`` (id, mark, root) the row of the least id; mark: xxhash64 of the text."""
    best = rooted.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("b")).select(
        F.col("b.id").alias("__id"), F.col("b.mark").alias("__mark"))
    ours = docs.withColumn("__text_mark", F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))))
    same = ours[id_column].eqNullSafe(best["__id"]) & (ours["__text_mark"] == best["__mark"])
    return ours.join(best, same, "left_semi").dropDuplicates([id_column, "__text_mark"]).select(*docs.columns)
