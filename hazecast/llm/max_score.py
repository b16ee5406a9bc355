"""Exact ranked search by Block-Max MaxScore over an inverted index in shards.

A shard is an inverted index over a bounded number of documents, made where they are read.
The postings of a term lie in blocks of 128, each compressed for itself (gaps and counts as
variable-length bytes). A block keeps the pairs (count, length of the document) that no other
posting of it beats in both; under any corpus statistics one of them has the block's greatest
impact, so block maxima are exact although the index is built before the statistics are known.

A search takes counts of documents from all shards, so scores are those of one index. In a
shard, the terms of a query are ordered by their greatest impact there. The first ones, whose
bounds together stay below the k-th best score so far, are not essential: a document without
any other term cannot enter. Documents are taken from the essential lists alone, in windows
that grow. Then the other lists follow, greatest bound first: a candidate whose score so far,
with the maximum of its block here and the bounds of the lists still to come, stays below the
k-th best is rejected, and a block is decompressed only if a candidate is left in it. The k
best of each shard are merged.

All scores are 64-bit integers. Queries meet shards in blocks of a bounded number of queries.
"""

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazecast.llm.common import arrow_map, stored

BLOCK = 128
SHARD_DOCS = 16384
SHARD_POSTINGS = 5_000_000
FIRST_WINDOW = 1024
#: A term is a run of these characters (fixed by the contract): letters and digits of ASCII
#: and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "shard long, term binary, n int, blocks binary, bounds binary, postings binary"
#: A block: its last place, bytes of its postings, postings, pairs of its bound.
BLOCK_HEAD = np.dtype([("last", "<u2"), ("bytes", "<u2"), ("postings", "u1"), ("pairs", "u1")])
_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, repeats included, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACES).split()


# --- numbers as bytes ---------------------------------------------------------------------

def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, the last byte of a number below 128; and bytes per number."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 64, 7):
        more = values >> np.uint64(bits) != 0
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for byte in range(int(sizes.max(initial=0))):
        here = sizes > byte
        low = (values[here] >> np.uint64(7 * byte) & np.uint64(127)).astype(np.uint8)
        out[(ends - sizes)[here] + byte] = low | np.where(sizes[here] > byte + 1, 128, 0).astype(np.uint8)
    return out, sizes


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers of ``packed``."""
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    ends = np.flatnonzero(last)
    starts = np.r_[0, ends[:-1] + 1]
    sizes = ends - starts + 1
    out = np.zeros(len(ends), dtype=np.int64)
    for byte in range(int(sizes.max(initial=0))):
        here = sizes > byte
        out[here] |= (data[starts[here] + byte] & 127).astype(np.int64) << 7 * byte
    return out


# --- the index --------------------------------------------------------------------------

class _Shard:
    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.counts, self.sizes = array("i"), array("q"), array("i")
        self.ids, self.lengths = [], array("q")

    def add(self, doc, words: list[bytes]) -> None:
        counted, known = Counter(words), self.vocabulary
        self.terms.extend([known.setdefault(w, len(known)) for w in counted])
        self.counts.extend(counted.values())
        self.sizes.append(len(counted))
        self.ids.append(doc)
        self.lengths.append(len(words))

    def rows(self, number: int) -> pa.RecordBatch:
        """A row per term, and one without a term: ids, lengths and which ids are not null."""
        lengths = np.array(self.lengths, dtype=np.int64)
        owner = np.array(self.terms, dtype=np.int64)
        place = np.repeat(np.arange(len(lengths)), np.array(self.sizes, dtype=np.int64))
        order = np.argsort(owner << 16 | place, kind="stable")
        owner, place, count = owner[order], place[order], np.array(self.counts, dtype=np.int64)[order]
        n = np.bincount(owner, minlength=len(self.vocabulary))
        first = np.cumsum(n) - n
        rank = np.arange(len(owner)) - np.repeat(first, n)  # of a posting in its list
        starts = np.flatnonzero(rank % BLOCK == 0)  # of blocks
        block = np.cumsum(rank % BLOCK == 0) - 1 if len(rank) else rank
        sizes = np.diff(np.r_[starts, len(owner)])
        blocks_of = -(-n // BLOCK)

        # a block starts from place 0: gaps and counts alternate
        gap = place.copy()
        inner = np.flatnonzero(rank % BLOCK)
        gap[inner] -= place[inner - 1]
        data, width = packed(np.column_stack((gap, count)).ravel())
        bytes_of = np.add.reduceat(width, 2 * starts) if len(starts) else starts

        # pairs no other posting of the block beats: by length, the counts that rise
        by = np.lexsort((-count, lengths[place], block))
        steps = block[by] << 40 | count[by]
        best = np.maximum.accumulate(steps) if len(steps) else steps
        rises = by[np.r_[True, best[1:] > best[:-1]]] if len(by) else by
        pairs, pair_width = packed(np.column_stack((count[rises], lengths[place[rises]])).ravel())
        pairs_of = np.bincount(block[rises], minlength=len(starts))
        pair_bytes = np.bincount(np.repeat(block[rises], 2), weights=pair_width, minlength=len(starts)).astype(np.int64)

        heads = np.zeros(len(starts), dtype=BLOCK_HEAD)
        if len(starts):
            heads["last"], heads["bytes"] = place[starts + sizes - 1], bytes_of
            heads["postings"], heads["pairs"] = sizes, pairs_of
        head_of = np.repeat(np.arange(len(n)), blocks_of)

        def cells(values, byte_counts):
            ends = np.r_[0, np.cumsum(byte_counts)].astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends),
                                                               pa.py_buffer(np.ascontiguousarray(values))])

        named = np.array([i is not None for i in self.ids], dtype=np.uint8)
        ids = np.array([i or 0 for i in self.ids], dtype="<i8")
        whole = [pa.array([number]), pa.array([None], pa.binary()), pa.array([len(ids)], pa.int32()),
                 pa.array([named.tobytes()], pa.binary()), pa.array([lengths.astype("<i8").tobytes()], pa.binary()),
                 pa.array([ids.tobytes()], pa.binary())]
        body = [pa.array(np.full(len(n), number)), pa.array(list(self.vocabulary), pa.binary()),
                pa.array(n.astype(np.int32)), cells(heads, blocks_of * BLOCK_HEAD.itemsize),
                cells(pairs, np.bincount(head_of, weights=pair_bytes, minlength=len(n)).astype(np.int64)),
                cells(data, np.bincount(head_of, weights=bytes_of, minlength=len(n)).astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(whole, body)],
                                          names=["shard", "term", "n", "blocks", "bounds", "postings"])


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A stored table (shard, term, n, blocks, bounds, postings): a list per shard and term.

    The row without a term has the shard's documents. A null text has no term. Rows without
    an id count in the statistics and are never found. Every row is a document of its own,
    repeated ones too. A table without rows makes an index without rows.
    """
    if shard_docs > 65536:
        raise ValueError("places have 16 bits")

    def run(batches):
        base, made, shard = TaskContext.get().partitionId() << 24, 0, _Shard()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard.add(doc, terms(text))
                if len(shard.ids) >= shard_docs or len(shard.terms) >= shard_postings:
                    yield shard.rows(base + made)
                    shard, made = _Shard(), made + 1
        if shard.ids:
            yield shard.rows(base + made)

    chosen = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    # shards are numbered by task, so the index is a table and not a plan that may run again
    return stored(arrow_map(chosen, run, INDEX), "lists")


# --- one query in one shard -----------------------------------------------------------------

def length_terms(lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    """100 - 90 + (90 n N) div L of each length n."""
    if 90 * int(lengths.max(initial=0)) * documents < 1 << 63:
        return 10 + 90 * lengths * documents // max(1, words)
    return 10 + np.array([90 * int(n) * documents // words for n in lengths], dtype=np.int64)


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


class PostingList:
    """The postings of a term in a shard: bounds of its blocks, and blocks when asked for."""

    def __init__(self, weight: int, blocks: bytes, bounds: bytes, postings: bytes, documents: int, words: int):
        heads = np.frombuffer(blocks, dtype=BLOCK_HEAD)
        self.weight, self.last = weight, heads["last"].astype(np.int64)
        self.ends = np.cumsum(heads["bytes"].astype(np.int64))
        self.data = np.frombuffer(postings, dtype=np.uint8)
        pairs = unpacked(np.frombuffer(bounds, dtype=np.uint8)).reshape(-1, 2)
        best = weight * impacts(pairs[:, 0], length_terms(pairs[:, 1], documents, words))
        first = np.cumsum(heads["pairs"].astype(np.int64)) - heads["pairs"]
        self.block_best = np.maximum.reduceat(best, first)
        self.best = int(self.block_best.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, number: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of a block, decompressed when first asked for."""
        if number not in self.open:
            begin = int(self.ends[number - 1]) if number else 0
            values = unpacked(self.data[begin:int(self.ends[number])]).reshape(-1, 2)
            places = np.cumsum(values[:, 0])
            self.open[number] = places, self.weight * impacts(values[:, 1], m[places])
        return self.open[number]


class OpenShard:
    """A shard with the lists of some terms, open for queries; decompressed blocks are kept."""

    def __init__(self, ids: bytes, lengths: bytes, named: bytes, documents: int, words: int):
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.named = np.frombuffer(named, dtype=np.uint8) > 0
        self.m = length_terms(np.frombuffer(lengths, dtype="<i8"), documents, words)
        self.lists: dict[int, PostingList] = {}
        self.score = np.zeros(len(self.ids), dtype=np.int64)

    def best(self, numbers: list[int], k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Ids and scores of the k best; blocks the query asked for, and blocks of its lists."""
        lists = sorted((self.lists[t] for t in numbers if t in self.lists), key=lambda p: p.best)
        bound = np.cumsum([0, *[p.best for p in lists]])  # of the first i lists together
        ids, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        asked, all_blocks = set(), sum(len(p.last) for p in lists)
        at, window = 0, FIRST_WINDOW
        while at < len(self.ids):
            # a document whose terms are all in the first ones scores below the k-th best
            essential = int(np.searchsorted(bound, least, side="left")) - 1
            if essential == len(lists):
                break
            end, score = min(len(self.ids), at + window), self.score
            for p in lists[essential:]:
                first, stop = np.searchsorted(p.last, at), min(len(p.last), np.searchsorted(p.last, end - 1) + 1)
                for b in range(first, stop):
                    places, gains = p.block(b, self.m)
                    asked.add((id(p), b))
                    if places[0] < at or places[-1] >= end:
                        inside = slice(*np.searchsorted(places, (at, end)))
                        places, gains = places[inside], gains[inside]
                    score[places] += gains
            near = at + np.flatnonzero(score[at:end])
            met = near
            near = near[self.named[near]]
            for i in range(essential - 1, -1, -1):
                near = near[score[near] + bound[i + 1] >= least]
                if not len(near):
                    break
                p = lists[i]
                block = np.searchsorted(p.last, near)
                there = block < len(p.last)
                most = np.zeros(len(near), dtype=np.int64)
                most[there] = p.block_best[block[there]]
                # what no bound of this block and of the lists to come lifts is rejected unopened
                alive = score[near] + most + bound[i] >= least
                near, block, there = near[alive], block[alive], there[alive]
                for b in np.unique(block[there]):
                    places, gains = p.block(int(b), self.m)
                    asked.add((id(p), int(b)))
                    mine = near[block == b]
                    found = np.searchsorted(places, mine)
                    found[found == len(places)] = 0
                    hit = places[found] == mine
                    score[mine[hit]] += gains[found[hit]]
            near = near[score[near] >= least]
            if len(near):
                ids, scores = np.r_[ids, self.ids[near]], np.r_[scores, score[near]]
                top = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[top], scores[top]
                if len(scores) == k:
                    least = int(scores[-1])  # an equal score may have a smaller id
            score[met] = 0
            at, window = end, 2 * window
        return ids, scores, len(asked), all_blocks


# --- the search -------------------------------------------------------------------------

FOUND = "item_id long, doc_id long, score long, asked int, blocks int"


def search(index: DataFrame, items: DataFrame, k: int = 10, block_items: int = 256,
           id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score, asked, blocks): the k best documents of each item.

    An item asks with the distinct terms of its whole text; of several texts with one id the
    least asks, and null ids ask as one. Items without a term, or whose terms no document has,
    have no answer, nor have terms of weight 0 a part. Equal scores go by id; documents that
    share an id and a score keep places of their own. ``asked`` of the ``blocks`` blocks of the
    item's lists in the document's shard were looked into.
    """
    asking = items.select(F.col(id_column).cast("long").alias("item_id"), F.col(text_column).alias("text")).groupBy(
        "item_id").agg(F.min("text").alias("text"))
    total = index.filter("term IS NULL")
    counted = total.select(F.expr("blocks AS named"), F.expr("bounds AS lengths")).mapInArrow(
        _totals, "documents long, words long").agg(F.sum("documents"), F.sum("words")).first()
    documents, words = counted[0] or 0, counted[1] or 0

    def exploded(batches):
        for batch in batches:
            found = [(i, t) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     for t in sorted(set(terms(text)))]
            yield pa.RecordBatch.from_pydict({"item_id": [i for i, _ in found], "term": [t for _, t in found]},
                                             pa.schema([("item_id", pa.int64()), ("term", pa.binary())]))

    asked = stored(arrow_map(asking, exploded, "item_id long, term binary"), "asked")
    blocks = max(1, -(-asking.count() // block_items))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")
    # a list is looked up once; its weight is that of the whole corpus
    df = F.sum("n")
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * documents + 2.0) / (F.lit(2.0) * df + 1.0))).cast("long")
    mine = stored(index.filter("term IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi"), "lists")
    known = stored(mine.groupBy("term").agg(weight.alias("weight")).filter("weight > 0").withColumn(
        "number", F.monotonically_increasing_id()), "terms")
    numbered = asked.join(known, "term").select("item_id", block, "number", "weight", "term")
    queries = numbered.groupBy("block", "item_id").agg(F.sort_array(F.collect_list("number")).alias("numbers")).groupBy(
        "block").agg(F.collect_list(F.struct("item_id", "numbers")).alias("queries"))  # block_items and few more
    used = numbered.select("block", "number", "weight", "term").distinct()
    lists = mine.join(used, "term").select(
        "shard", "block", "number", "weight", "blocks", "bounds", "postings", F.lit(None).cast(
            "array<struct<item_id:bigint,numbers:array<bigint>>>").alias("queries"))
    # each block of queries visits each shard: the shard's documents carry it there
    heads = total.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(queries, "block").select(
        "shard", "block", F.lit(-1).cast("long").alias("number"), F.lit(0).cast("long").alias("weight"),
        "blocks", "bounds", "postings", "queries")

    def answer(table: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        shard, queries = None, []
        number = table.column("number").to_numpy()
        order = np.argsort(number, kind="stable")  # the documents first
        columns = [table.column(c).combine_chunks() for c in ("weight", "blocks", "bounds", "postings")]
        for row in order.tolist():
            weight, blocks, bounds, postings = (c[row].as_py() for c in columns)
            if number[row] < 0:
                shard = OpenShard(postings, bounds, blocks, documents, words)
                queries = table.column("queries").combine_chunks()[row].as_py()
            elif shard is not None:
                shard.lists[int(number[row])] = PostingList(weight, blocks, bounds, postings, documents, words)
        for query in queries:
            ids, scores, asked, blocks = shard.best(query["numbers"], k)
            for column, value in zip(out, ([query["item_id"]] * len(ids), ids.tolist(), scores.tolist(),
                                           [asked] * len(ids), [blocks] * len(ids))):
                column += value
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array(v, t) for v, t in zip(out, kinds)],
                        names=[f.split(" ")[0] for f in FOUND.split(", ")])

    found = lists.unionByName(heads).groupBy("shard", "block").applyInArrow(answer, FOUND)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        F.col("item_id").alias(id_column), "rank", "doc_id", "score", "asked", "blocks")


def _totals(batches):
    """Documents with a term, and terms, of each shard."""
    for batch in batches:
        lengths = [np.frombuffer(b, dtype="<i8") for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_pydict({"documents": [int((x > 0).sum()) for x in lengths],
                                          "words": [int(x.sum()) for x in lengths]})
