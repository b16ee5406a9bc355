import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hazecast.llm import max_score
from llm_helpers import documents, hard_rows, prose


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(rows, items, k=10):
    docs = [(i, Counter(words(t))) for i, t in rows]
    docs_with = sum(bool(c) for _, c in docs)
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = {}
    for item, text in items.items():
        scored = []
        for i, c in docs:
            if i is None:
                continue
            m = 10 + 90 * sum(c.values()) * docs_with // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * docs_with + 2) / (2 * df[w] + 1)))
                    * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words(text)) if c[w])
            if s > 0:
                scored.append((-s, i))
        if scored:
            out[item] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(spark, docs, items, k=10, block_items=256, **settings):
    index = max_score.build_index(docs, **settings)
    out: dict = {}
    for r in max_score.search(index, items, k, block_items).orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert len(out[r.item_id]) == r["rank"] and r.asked <= r.blocks
    return out


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_terms(text):
    assert max_score.terms(text) == [w.encode("utf-8", "surrogatepass") for w in words(text)]


@given(st.lists(st.integers(0, 2**62), max_size=50))
@settings(max_examples=200, deadline=None)
def test_numbers_as_bytes(values):
    data, sizes = max_score.packed(np.array(values, dtype=np.int64))
    assert max_score.unpacked(data).tolist() == values and sizes.sum() == len(data)


def test_equals_brute_force(spark):
    rows = [(i, prose(5 + i % 60, i, "abcd")) for i in range(500)] + [(1000 + i, "To be, or not to be!") for i in range(150)]
    rows += [(r[0] + 5000 if r[0] else None, r[1]) for r in hard_rows()]
    texts = {n: prose(30, 900 + n, "abcd") for n in range(20)} | {50: "to be", 51: "", 52: None, 53: "zzzzzzz none", 54: "ÜNÏ Ünïcödé 漢字"}
    items = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "item_id long, text string, shard int")
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows]).repartition(2)
    wanted = brute(rows, texts)
    for block_items in (256, 3):
        assert found(spark, docs, items, block_items=block_items, shard_docs=150) == wanted
    assert found(spark, docs, items, k=3) == {i: best[:3] for i, best in wanted.items()}
    assert found(spark, docs, items, k=10_000) == brute(rows, texts, 10_000)


def test_many_windows_and_blocks(spark):
    """Lists of many blocks in one shard, where candidates are rejected unopened."""
    rows = [(i, f"common c{i % 3} d{i % 50} " + prose(8, i, "abcdef") + (" needle" * 5 if i in (77, 4000) else ""))
            for i in range(6000)]
    texts = {1: "common needle d27", 2: "common c1 d7", 3: "common", 4: rows[3000][1]}
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows], extra=False).coalesce(1)
    assert found(spark, docs, items) == brute(rows, texts)
    index = max_score.build_index(docs)
    best = {r.item_id: r for r in max_score.search(index, items, k=1).collect()}
    assert best[4].doc_id == 3000 and best[4].asked < 0.6 * best[4].blocks, (best[4].asked, best[4].blocks)


def test_word_in_every_document(spark):
    """Its weight is 0 once documents are many: no answer, and no harm."""
    rows = [(i, "the") for i in range(600)] + [(700, "the end")]
    items = spark.createDataFrame([(1, "the"), (2, "the end")], "item_id long, text string")
    got = found(spark, documents(spark, [(i, t, "en", "a") for i, t in rows]), items)
    assert got == brute(rows, {1: "the", 2: "the end"}) and sorted(got) == [2]


def test_odd_items_and_empty_tables(spark):
    docs = documents(spark, [(i, t, "en", "a") for i, t in ((1, "a b"), (1, "a b"), (2, "b c"), (None, "a"), (3, None))])
    items = spark.createDataFrame([(7, "b"), (7, "a"), (7, "a"), (None, "c")], "item_id long, text string")
    got = found(spark, docs, items)
    score = brute([(1, "a b"), (1, "a b"), (2, "b c"), (None, "a"), (3, None)], {7: "a", None: "c"})
    assert got == score and [d for d, _ in got[7]] == [1, 1]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert found(spark, documents(spark, []), items) == {} and found(spark, docs, nothing) == {}


def test_lengths_beyond_64_bits():
    lengths = np.array([3, 10**9], dtype=np.int64)
    assert max_score.length_terms(lengths, 10**10, 10**12).tolist() == [10 + 90 * 3 * 10**10 // 10**12, 10 + 90 * 10**19 // 10**12]
