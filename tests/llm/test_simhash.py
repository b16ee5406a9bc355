import re

import numpy as np
import pytest
import xxhash

from hazecast.llm import simhash
from llm_helpers import documents, hard_rows, prose


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 3 else [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius=3):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprint():
    for text in (None, "", " ", "A", "a b", "A b C d", prose(500, 1), prose(5000, 2), "ÄÖ Straße 漢"):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 40])
def test_links_equal_brute_force(spark, cell_rows):
    """Random values, chains, and a dense ball that fills cells; also with cells cut again."""
    draw = np.random.default_rng(1)
    values = {int(x) for x in draw.integers(0, 1 << 63, 300)}
    centre = int(draw.integers(0, 1 << 63))
    for _ in range(400):
        values.add(centre ^ sum(1 << int(b) for b in draw.choice(64, int(draw.integers(1, 7)), replace=False)))
    step = int(draw.integers(0, 1 << 63))
    for i in range(30):
        step ^= 7 << (2 * i)
        values.add(step)
    rows = [(i, simhash.signed(v)) for i, v in enumerate(sorted(values))]
    marked = spark.createDataFrame(rows, "id long, fp long")
    distinct = marked.select("fp")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in map(tuple, simhash.links(distinct, 3, cell_rows).collect())]
    nodes = {r.node % (1 << 64): r.root for r in simhash.components(
        spark.createDataFrame([(simhash.signed(a), simhash.signed(b)) for a, b in edges], "a long, b long")).collect()}
    wanted = slow_components(values)
    # an edge may join two ends of a chain of links, never two components
    assert all(a != b and wanted[a] == wanted[b] for a, b in edges)
    groups: dict = {}
    for v in values:
        groups.setdefault(wanted[v], set()).add(v)
    for group in groups.values():
        assert len({nodes.get(v, ("alone", v)) for v in group}) == 1
        assert len(group) > 1 or not group & nodes.keys()
    assert len(edges) <= 8 * len(values)


@pytest.mark.parametrize("seed", range(4))
def test_any_allocation_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    bits = rng.random((2000, 64)) < rng.uniform(0.02, 0.5, 64)
    bits[:, 1] = bits[:, 0]  # two bits that always agree
    both = (bits.T.astype(np.int64) @ bits.astype(np.int64)) * 1000
    plan = simhash.allocation(2_000_000, both)
    masks = [(sum(1 << int(b) for b in own), limit) for own, limit in plan]
    assert all(not a & b for i, (a, _) in enumerate(masks) for b, _ in masks[:i])
    for _ in range(3000):
        flipped = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))
        assert any((flipped & mask).bit_count() <= limit for mask, limit in masks)


def test_allocation_sums_and_skips_dull_bits():
    rows = 1_000_000
    both = np.full((64, 64), rows // 4, dtype=np.int64)
    np.fill_diagonal(both, rows // 2)
    plan = simhash.allocation(rows, both)
    assert sum(t + 1 for _, t in plan) == 4
    both[:20, :] = both[:, :20] = 0  # 20 bits that are never set
    plan = simhash.allocation(rows, both)
    assert sum(t + 1 for _, t in plan) == 4 and len({b for bits, _ in plan for b in bits}) <= 64


def test_probing_with_thresholds(spark, monkeypatch):
    """Unequal thresholds find the same components."""
    draw = np.random.default_rng(2)
    base = [int(x) for x in draw.integers(0, 1 << 63, 60)]
    values = {*base, *(v ^ sum(1 << int(b) for b in draw.choice(64, 3, replace=False)) for v in base)}
    plan = [(list(range(0, 20)), 1), (list(range(20, 42)), 0), (list(range(42, 64)), 0)]
    monkeypatch.setattr(simhash, "allocation", lambda *_: plan)
    edges = simhash.links(spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")).collect()
    wanted = slow_components(values)
    linked = {a % (1 << 64) for e in edges for a in e}
    assert linked == {v for v in values if sum(wanted[v] == w for w in wanted.values()) > 1}


def test_documents(spark):
    text = prose(400, 9)
    words = text.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1:]]) for k in (100, 200, 300)]
    rows = [*hard_rows(), *((100 + i, t, "en", "a") for i, t in enumerate([text, *near, text]))]
    rows += [(200 + i, "same text again and again", "en", "hot") for i in range(50)]
    docs = documents(spark, rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {f"{slow_fingerprint(t):016x}" for _, t, *_ in rows}
    assert {r.fingerprint for r in got} == prints
    wanted = slow_components({slow_fingerprint(t) for _, t, *_ in rows})
    least: dict = {}
    for i, t, *_ in rows:
        root = wanted[slow_fingerprint(t)]
        if i is not None:
            least[root] = min(i, least.get(root, i))
    for r in got:
        assert r.component_id == least.get(wanted[int(r.fingerprint, 16)])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(wanted.values())) and set(least.values()) <= {*ids}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.one_of_each(documents(spark, [])).count() == 0
