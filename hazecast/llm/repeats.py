"""Suffix-array dedup: bytes covered by long strings that occur more than once.

A string of ``length`` bytes is keyed by its anchor: the leftmost of its ``gram``-byte pieces
with the least hash. Equal strings have equal anchors, and neighbouring starts mostly share
one, so a text falls into places: runs of starts with one anchor. Places are dealt out by the
anchor's hash. An anchor seen once is dropped. Equal places are collapsed to one with a count;
what is left of an anchor is compared by a suffix array, built by two-stage sorting: suffixes
smaller than their successors are sorted directly, the others follow from bucket scans, and
equal neighbours in the array give the repeated starts.

Only anchors whose places differ need bytes. Their texts are fetched once by digest. Texts
without any repeated anchor are left out before texts are grouped; as long as the digests of
the others are few enough to broadcast, by Spark's check of their size, they are not moved. An anchor whose places are too many for one
task (a passage that very many documents share, each in its own surroundings) is settled by
counting the digests of its strings instead, which has no group larger than one string's.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import arrow_map, discard, stored

LENGTH = 400
GRAM = 64
GROUP_BYTES = 1 << 19   # bytes of one anchor that are sorted in one task
SORT_BYTES = 1 << 18    # bytes sorted at once when anchors are small
BASE = 0x9E3779B97F4A7C15 | 1


# --- Places -------------------------------------------------------------------

def _powers(n: int):
    up = np.full(n, BASE, dtype=np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, gram: int, powers) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on."""
    up, down = powers[0][:len(data)], powers[1]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)))
    h = (sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each ``width`` neighbours, from running minima inside and across blocks."""
    n = len(keys) - width + 1
    padded = np.concatenate((keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, np.uint64)))
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def places_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int, powers):
    """(first start, number of starts, anchor hash) of each place; ``ends`` closes each text."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    hashes = gram_hashes(data, gram, powers)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = window_least(hashes >> np.uint64(24) << np.uint64(24) | place, length - gram + 1)
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(ends, starts, side="right")
    fits = starts + length <= ends[text]
    starts, anchor, text = starts[fits], anchor[fits], text[fits]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    return starts[new], np.diff(np.r_[new, len(starts)]), hashes[anchor[new]]


def places(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Places of (key, text): key, at, starts, anchor, content (its hash), copies."""
    most = (1 << 20) + 1

    def run(batches):
        powers = _powers(most)
        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            copies: dict = {}
            for key, text in zip(keys, values):
                if key in copies:
                    copies[key][1] += 1
                elif len(data := text.encode("utf-8", "surrogatepass")) >= length:
                    copies[key] = [data, 1]
            group, size = [], 0
            for key, (data, n) in copies.items():
                if size + len(data) >= most and group:
                    yield from emit(group, powers)
                    group, size = [], 0
                # longer than the tables: in overlapping slices, each start in one of them
                if len(data) >= most:
                    step = most - length
                    for at in range(0, len(data) - length + 1, step):
                        yield from emit([(key, data[at:at + step + length - 1], n, at)], powers)
                    continue
                group.append((key, data, n, 0))
                size += len(data)
            if group:
                yield from emit(group, powers)

    def emit(group, powers):
        whole = b"".join(g[1] for g in group)
        ends = np.cumsum([len(g[1]) for g in group])
        at, starts, anchor = places_of(np.frombuffer(whole, np.uint8), ends, length, gram, powers)
        owner = np.searchsorted(ends, at, side="right")
        base = ends - np.array([len(g[1]) for g in group]) - np.array([g[3] for g in group])
        digest, view = xxhash.xxh3_64_intdigest, memoryview(whole)
        content = np.array([digest(view[a:a + n + length - 1]) for a, n in
                            zip(at.tolist(), starts.tolist())], dtype=np.uint64)
        keys, copies = pa.array([g[0] for g in group], pa.binary()), np.array([g[2] for g in group])
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(owner)), pa.array(at - base[owner]), pa.array(starts.astype(np.int32)),
             pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(copies[owner])],
            names=["key", "at", "starts", "anchor", "content", "copies"])

    return arrow_map(texts, run, "key binary, at long, starts int, anchor long, content long, copies long")


# --- Suffix array -------------------------------------------------------------

def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Suffixes of ``text`` ordered by their first ``depth`` bytes at least, by two-stage sorting."""
    t = np.frombuffer(text, np.uint8).astype(np.int16)
    n = len(t)
    step = np.diff(t, append=np.int16(-1))
    # the next change of byte tells whether a suffix is smaller than its successor
    change = np.where(step != 0, np.arange(n), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    small = step[change] > 0
    direct = sorted(np.flatnonzero(small).tolist(), key=lambda i: text[i:i + depth])
    order = np.full(n, -1, dtype=np.int64)
    sizes = np.bincount(t, minlength=256)
    end = np.cumsum(sizes)
    begin = end - sizes
    small_sizes = np.bincount(t[small], minlength=256)
    at = 0
    for c in np.flatnonzero(small_sizes):
        order[end[c] - small_sizes[c]:end[c]] = direct[at:at + small_sizes[c]]
        at += small_sizes[c]
    front = begin.copy()
    order[front[t[-1]]] = n - 1
    front[t[-1]] += 1

    def induce(scanned):
        before = scanned - 1
        before = before[before >= 0]
        before = before[~small[before]]
        if not len(before):
            return
        first = t[before]
        ranked = np.argsort(first, kind="stable")
        before, first = before[ranked], first[ranked]
        counts = np.bincount(first, minlength=256)
        inside = np.arange(len(first)) - (np.cumsum(counts) - counts)[first]
        order[front[first] + inside] = before
        front[:] += counts

    for c in np.flatnonzero(sizes):
        done = begin[c]
        while done < front[c]:  # a scan may add to the bucket it reads
            upto = front[c]
            induce(order[done:upto])
            done = upto
        induce(order[end[c] - small_sizes[c]:end[c]])
    return order


def repeated_starts(contents: list[bytes], copies: list[int], length: int) -> list[np.ndarray]:
    """For each content the starts of ``length``-byte strings found at another start as well."""
    text = b"".join(contents)
    ends = np.cumsum([len(c) for c in contents])
    begin = ends - np.array([len(c) for c in contents])
    flags = np.zeros(len(text), dtype=bool)
    for b, e, n in zip(begin, ends, copies):
        if n > 1:
            flags[b:e - length + 1] = True
    array = suffix_array(text, length)
    owner = np.searchsorted(ends, array, side="right")
    array = array[array + length <= ends[owner]].tolist()
    previous, piece = -1, None
    for start in array:
        this = text[start:start + length]
        if this == piece:
            flags[start] = flags[previous] = True
        previous, piece = start, this
    return [np.flatnonzero(flags[b:e - length + 1]) for b, e in zip(begin, ends)]


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist()))


def _sorted_groups(contents: DataFrame, length: int) -> DataFrame:
    """anchor, content, first, last per run of repeated starts; rows of an anchor meet in one task."""
    def settle(rows):
        frame = pd.concat(rows, ignore_index=True) if len(rows) > 1 else rows[0]
        found = repeated_starts([bytes(b) for b in frame["bytes"]], frame["copies"].tolist(), length)
        out = [(a, c, lo, hi) for a, c, s in zip(frame["anchor"], frame["content"], found)
               for lo, hi in runs_of(s)]
        return pd.DataFrame(out, columns=["anchor", "content", "first", "last"])

    def run(frames):
        held, size, last = [], 0, None
        for frame in frames:
            for anchor, part in frame.groupby("anchor", sort=False):
                if size >= SORT_BYTES and anchor != last:
                    yield settle(held)
                    held, size = [], 0
                held.append(part)
                size += int(part["bytes"].str.len().sum())
                last = anchor
        if held:
            yield settle(held)

    spark = contents.sparkSession
    dealt = contents.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "anchor")
    return dealt.sortWithinPartitions("anchor").mapInPandas(
        run, "anchor long, content long, first long, last long")


# --- Whole operator -----------------------------------------------------------

def text_key(column: str):
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def repeated_places(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_column: str = "text",
                    group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """(key, text) of the distinct texts in question and (key, covers) of those with repeated strings.

    ``key`` is the MD5 of the text (null counts as empty), ``covers`` what repeated strings take
    (start, end) in bytes, neither sorted nor merged. Copies of a text count as other places.
    """
    texts = docs.select(text_key(text_column).alias("key"),
                        F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    long = texts.filter(F.octet_length("text") >= length)
    every = stored(places(long, length, gram), "places")
    # stored, so that the join below has plain exchanges on both sides: Spark splits an
    # anchor that very many places share only then
    shared = stored(every.groupBy("anchor").agg(
        F.sum("copies").alias("seen"), F.min("content").alias("low"), F.max("content").alias("high")
    ).filter("seen > 1").select("anchor", (F.col("low") != F.col("high")).alias("differ")), "shared")
    found = stored(every.join(shared, "anchor"), "shared-places")
    discard(every, shared)

    same = found.filter("not differ").select("key", F.col("at").alias("start"),
                                             (F.col("at") + F.col("starts") - 1 + length).alias("end"))
    # stored, so that its size is known when the join is planned
    touched = stored(found.select("key").distinct(), "touched")
    held = stored(long.join(touched, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "shared-texts")
    discard(touched)

    distinct = found.filter("differ").groupBy("anchor", "content").agg(
        F.sum("copies").alias("copies"), F.min(F.struct("key", "at", "starts")).alias("p"))
    sizes = distinct.groupBy("anchor").agg(F.sum(F.col("p.starts") + length - 1).alias("size"))
    contents = stored(
        distinct.join(sizes, "anchor").select("anchor", "content", "copies", "size", "p.*").join(held, "key").select(
            "anchor", "content", "copies", "size", "starts",
            F.expr(f"substring(cast(text AS binary), cast(at AS int) + 1, starts + {length - 1})").alias("bytes")),
        "contents")
    few = _sorted_groups(contents.filter(F.col("size") <= group_bytes).select(
        "anchor", "content", "copies", "bytes"), length)
    strings = contents.filter(F.col("size") > group_bytes).select(
        "anchor", "content", "copies", "bytes", F.explode(F.sequence(F.lit(0), F.col("starts") - 1)).alias("s")
    ).select("anchor", "content", "copies", "s", F.unhex(F.md5(F.expr(f"substring(bytes, s + 1, {length})"))).alias("d"))
    often = strings.groupBy("d").agg(F.sum("copies").alias("n")).filter("n > 1").select("d")
    many = strings.join(often, "d", "left_semi").select(
        "anchor", "content", F.col("s").cast("long").alias("first"), F.col("s").cast("long").alias("last"))
    marks = few.unionByName(many)
    differing = found.filter("differ").join(marks, ["anchor", "content"]).select(
        "key", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last") + length).alias("end"))
    return held, same.unionByName(differing).groupBy("key").agg(
        F.collect_set(F.struct("start", "end")).alias("covers"))


def cut(text: str, covers: list[dict], least_words: int = 0) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs (start, end) of what ``covers`` take, and the bytes left.

    Runs of fewer than ``least_words`` words (a part of one counts) and under ``LENGTH`` bytes stay.
    """
    data, runs = text.encode("utf-8", "surrogatepass"), []
    for start, end in sorted((c["start"], c["end"]) for c in covers):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    runs = [(a, b) for a, b in runs if b - a >= LENGTH or len(data[a:b].split()) >= least_words]
    edges = [0, *(x for r in runs for x in r), len(data)]
    return runs, b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeated_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_column: str = "text",
                   group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(key, spans, kept) of each distinct text that loses bytes: the runs removed and the bytes left."""
    held, covers = repeated_places(docs, length, gram, text_column, group_bytes)

    def run(batches):
        for batch in batches:
            done = [cut(t, c) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            spans = [[{"start": a, "end": b} for a, b in runs] for runs, _ in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([kept for _, kept in done], pa.binary())], names=["key", "spans", "kept"])

    return arrow_map(held.join(covers, "key").select("key", "text", "covers"), run,
                     "key binary, spans array<struct<start: long, end: long>>, kept binary")


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """Id, n_bytes, spans, and kept_sha256 per row of ``docs``.

    A null text is empty; texts shorter than ``length`` lose nothing; repeated rows lose all
    if they are long enough. Null ids are kept. Other columns are left out.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_column).alias("id"), text_key(text_column).alias("key"),
                       F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    cuts = repeated_texts(docs, length, gram, text_column).select(
        "key", "spans", F.sha2("kept", 256).alias("kept_sha"))
    none = F.expr("cast(array() AS array<struct<start: long, end: long>>)")
    return rows.join(cuts, "key", "left").select(
        F.col("id").alias(id_column), "n_bytes", F.coalesce("spans", none).alias("spans"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_column: str = "text",
                    chars_column: str | None = "n_chars", least_words: int = 0) -> DataFrame:
    """Rows of ``docs``, all columns, with the repeated bytes taken out of the text.

    A cut inside a character drops what is left of it. With ``least_words``, runs of fewer words
    and under ``LENGTH`` bytes stay. The column of text lengths follows,
    if there is one. Untouched rows stay as they are, null texts too.
    """
    @F.arrow_udf("string")
    def kept_text(texts: pa.Array, covers: pa.Array) -> pa.Array:
        out = []
        for text, covers_of in zip(texts.to_pylist(), covers.to_pylist()):
            runs, kept = cut(text, covers_of, least_words) if text is not None and covers_of else ([], b"")
            out.append(kept.decode("utf-8", "ignore") if runs else None)
        return pa.array(out, pa.string())

    # the rows meet the places, not the texts that are left: whole texts move once
    held, covers = repeated_places(docs, length, gram, text_column)
    discard(held)
    covers = covers.select(F.col("key").alias("__key"), F.col("covers").alias("__covers"))
    joined = docs.withColumn("__text_key", text_key(text_column)).join(
        covers, F.col("__text_key") == F.col("__key"), "left")
    touched = F.when(F.col("__covers").isNotNull(), F.col(text_column))
    joined = joined.withColumn("__kept", kept_text(touched, F.col("__covers")))
    hit = F.col("__kept").isNotNull()
    out = joined.withColumn(text_column, F.when(hit, F.col("__kept")).otherwise(F.col(text_column)))
    if chars_column in docs.columns:
        kind = docs.schema[chars_column].dataType
        out = out.withColumn(chars_column, F.when(hit, F.char_length(text_column)).otherwise(
            F.col(chars_column)).cast(kind))
    return out.select(*docs.columns)
