"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first: fingerprints of the shingle sets within three bits of each other are
candidates, found by the generalised pigeonhole of ``simhash``, and compared by the sets.
Most pairs just above 0.8 lie further apart than that, so MinHash finds the rest.

A text has 240 MinHash values in 40 bands of six. Texts that agree in a whole band share a cell;
a pair at a similarity of 0.8 misses all 40 cells with a chance of (1 - 0.8^6)^40 = 5e-6. What
shares a cell is compared by the shingle sets themselves, so nothing is linked that is less
similar. Texts with one set are one node.

The members of a cell are compared with a centre first, the one that meets the most others in
all its cells: in a group of edited copies that is the text they came from, or one close to it.
What this leaves in different components of a cell is compared inside tasks, a bounded block of
members against another: pairs whose 240 values, a byte of each, agree in fewer than 165 places
are passed over (at a similarity of 0.8 that happens with a chance of 4e-6), the others are
compared by their shingle sets, and alike ones alone become rows. So a large group costs some
rows per member and not one per pair.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.llm import simhash
from hazecast.llm.common import arrow_map, ascii_words, discard, stored
from hazecast.llm.repeats import text_key
from hazecast.llm.simhash import components, least_rows

WIDTH = 5
SIMILAR = (4, 5)  # at least 4/5, in whole numbers
BANDS, ROWS = 40, 6
SAME_BYTES = 165
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20  # of a cell's members in one block
SEED = 42
STEP = np.uint64(0x9E3779B97F4A7C15)
_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _draw.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle."""
    words = ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, SEED) for w in words], dtype=np.uint64)
    width = min(WIDTH, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = out * STEP + hashes[i:i + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray) -> tuple[list[int], bytes]:
    """One signed hash per band of the set's MinHash values, and a byte of each; an empty set has none."""
    if not len(found):
        return [], b""
    values = (found * STEP >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(FACTORS), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(values), 512):
        part = FACTORS[:, None] * values[None, at:at + 512]
        part += OFFSETS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    out = np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], dtype=np.uint64)
    return out.view(np.int64).tolist(), least.astype(np.uint8).tobytes()


def bands_of(found: np.ndarray) -> list[int]:
    return signature(found)[0]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def sketches(texts: DataFrame) -> DataFrame:
    """key (a digest of the shingle set), size, fp (its SimHash), bands, sketch, and all but the text, of (text, ...)."""
    keep = [c for c in texts.columns if c != "text"]

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            bands, made = zip(*map(signature, sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([simhash.signed(simhash.majority(s)) for s in sets], pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(made, pa.binary()), *batch.columns[1:]],
                names=["key", "size", "fp", "bands", "sketch", *keep])

    kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep]
    return arrow_map(texts.select("text", *keep), run,
                     ", ".join(["key binary", "size int", "fp long", "bands array<long>", "sketch binary", *kinds]))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts are alike."""
    def run(batches):
        known: dict = {}
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                for key, text in ((a, x), (b, y)):
                    if key not in known:
                        if len(known) >= 256:
                            known = {k: known[k] for k in (a, b) if k in known}
                        known[key] = shingles(text)
                out.append(alike(known[a], known[b]))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["a", "b"]).filter(pa.array(out, pa.bool_()))

    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")
    return stored(arrow_map(both.select("a", "b", "x", "y"), run, "a binary, b binary"), "alike")


def near_fingerprints(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b) of keys to compare: of each fingerprint one key with the others, and with those of near fingerprints.

    ``nodes`` has key and fp, a row per key.
    """
    first = stored(nodes.groupBy("fp").agg(F.min("key").alias("first")), "fingerprints")
    near = simhash.links(first, radius)
    same = nodes.join(first, "fp").filter("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    other = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(
        first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = stored(same.unionByName(other), "near-fingerprints")
    discard(first)
    return pairs


def links(marks: DataFrame, docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Edges (a, b) between keys whose components are those of all similar pairs that share a cell.

    ``marks`` has key, size, fp, bands and digest (``text_key`` of the text in ``docs``).
    """
    nodes = stored(marks.groupBy("key").agg(F.min("digest").alias("digest"), F.first("size").alias("size"),
                                            F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    near = near_fingerprints(nodes.filter("size > 0").select("key", "fp"))
    cells = nodes.select("key", "size", F.explode("bands").alias("cell"))
    shared = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "shared-cells")
    met = stored(cells.join(shared, "cell"), "met")
    weights = met.groupBy("key").agg(F.sum("n").alias("weight"))
    members = stored(met.select("cell", "key", "size").join(weights, "key"), "members")
    wanted = members.select("key").unionByName(near.select(F.col("a").alias("key"))).unionByName(
        near.select(F.col("b").alias("key"))).distinct()
    digests = nodes.join(wanted, "key", "left_semi").select("key", "digest", "sketch")
    texts = stored(docs.select(text_key(text_column).alias("digest"), F.col(text_column).alias("text")).join(
        digests, "digest").groupBy("key").agg(F.first("text").alias("text"), F.first("sketch").alias("sketch")), "near-texts")
    discard(shared, met, nodes)

    # sets of sizes this far apart are never alike
    def fits(one, other):
        return f"{SIMILAR[1]} * least({one}, {other}) >= {SIMILAR[0]} * greatest({one}, {other})"

    centres = members.groupBy("cell").agg(F.max(F.struct("weight", "key", "size")).alias("c")).select(
        "cell", F.col("c.key").alias("centre"), F.col("c.size").alias("centre_size"))
    with_centre = stored(members.join(centres, "cell"), "with-centre")
    stars = stored(with_centre.filter("key <> centre").filter(fits("size", "centre_size")).select(
        F.col("centre").alias("a"), F.col("key").alias("b")).unionByName(near).distinct(), "stars")
    found = _verified(stars, texts)
    roots = stored(components(found), "roots")
    parts = stored(with_centre.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "cell", "key", "size", "centre", F.coalesce("root", "key").alias("part")), "parts")
    divided = parts.groupBy("cell").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter(
        "low <> high").select("cell")
    left = stored(parts.filter("key <> centre").join(divided, "cell", "left_semi").select(
        "cell", "key", "size", "part"), "open")
    more = _compared(left, texts)
    discard(near, members, with_centre, stars, roots, parts, left, texts)
    return found.unionByName(more)


def _compared(left: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of alike members of different parts of one cell, of (cell, key, size, part)."""
    rows = left.join(texts.select("key", "sketch", "text"), "key")
    counts = left.join(texts.select("key", F.octet_length("text").alias("bytes")), "key").groupBy("cell").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = rows.join(counts, "cell").withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block",
        "key", "size", "part", "sketch", "text")

    def run(batches):
        held, now = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != now:
                    yield from alike_pairs(held)
                    held, now = [], row[:3]
                held.append(row[3:])
        yield from alike_pairs(held)

    def alike_pairs(held):
        if len(held) < 2:
            return
        block, size = (np.array([r[k] for r in held]) for k in (0, 2))
        part = np.unique([r[3].hex() for r in held], return_inverse=True)[1]
        sketch = np.frombuffer(b"".join(r[4] for r in held), np.uint8).reshape(len(held), -1)
        two, sets, out = block.min() != block.max(), {}, []
        for at in range(0, len(held), 32):
            mine = np.arange(at, min(at + 32, len(held)))
            same = (sketch[mine, None, :] == sketch[None, at:, :]).sum(axis=2)
            ahead = np.arange(at, len(held))
            ok = (same >= SAME_BYTES) & (part[mine, None] != part[ahead]) & (ahead > mine[:, None])
            ok &= SIMILAR[1] * np.minimum(size[mine, None], size[ahead]) >= SIMILAR[0] * np.maximum(size[mine, None], size[ahead])
            if two:
                ok &= block[mine, None] != block[ahead]
            for i, j in zip(*np.nonzero(ok)):
                i, j = int(mine[i]), int(ahead[j])
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingles(held[k][5])
                if alike(sets[i], sets[j]):
                    out.append((held[i][1], held[j][1]))
        if out:
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]},
                                             pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["cell", "low", "high"]
    met = dealt.repartition(partitions, *group).sortWithinPartitions(*group)
    return stored(arrow_map(met, run, "a binary, b binary").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "alike")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns: of each component of similar texts the row of the least id.

    Ties and null ids go as in ``simhash.one_of_each``. Texts without words are one group.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    marks = stored(sketches(docs.select(F.col(id_column).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"),
                                        text_key(text_column).alias("digest"))), "sketches")
    roots = stored(components(links(marks, docs, text_column)), "components")
    rooted = marks.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "id", "mark", F.coalesce("root", "key").alias("root"))
    return least_rows(docs, rooted, id_column, text_column)
