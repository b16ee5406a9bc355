import pytest

from hazecast.llm import mixing
from llm_helpers import documents, hard_rows, prose


def level(sizes, weights, budget):
    """Water-filling by bisection of the level."""
    low, high = 0.0, 1e12
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(2 * s, middle * w) for s, w in zip(sizes, weights)) < budget else (low, middle)
    return [min(2 * s, high * w) for s, w in zip(sizes, weights)]


def test_targets_and_taken(spark):
    rows = [(i, prose(1 + i % 40, i), "en", f"s{i % 7}" if i % 3 else "hot") for i in range(600)]
    got = mixing.mixed(documents(spark, rows)).collect()
    assert len(got) == 600
    sizes: dict = {}
    for i, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    names = sorted(sizes)
    wanted = dict(zip(names, level([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))],
                                   1.5 * sum(sizes.values()))))
    taken: dict = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert r.taken == r.times * r.size and 0 <= r.times <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[n] - wanted[n]) <= 20 for n in names)
    again = mixing.mixed(documents(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_repeats_rows(spark):
    rows = [(i, prose(5, i), "en", "ab"[i % 2]) for i in range(50)]
    docs = documents(spark, rows)
    times = {r.doc_id: r.times for r in mixing.mixed(docs).collect()}
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in times.items() if n}


def test_hard_rows(spark):
    rows = hard_rows()
    got = mixing.mixed(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.source for r in got} == {r[3] for r in rows}
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.mixed(documents(spark, [])).count() == 0


def test_budget_beyond_caps(spark):
    with pytest.raises(ValueError):
        mixing.mixed(documents(spark, []), share_halves=5)
