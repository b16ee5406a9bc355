import random

import corpus_pipeline
from hazecast.llm import near_copies
from llm_helpers import documents, hard_rows, prose


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """Least id of each component of texts with Jaccard >= 0.8, over all pairs; no null ids."""
    sets, group = [slow_set(t) for _, t, *_ in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and 5 * len(a & b) >= 4 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    return {min(r[0] for r, g in zip(rows, group) if g == at) for at in group}


def edited(words, edits, draw):
    """Each edit changes up to five shingles."""
    words = list(words)
    for at in draw.sample(range(len(words)), edits):
        words[at] = f"new{draw.random()}"
    return " ".join(words)


def test_edited_copies_equal_brute_force(spark):
    """Copies from far above to just below the limit; the stage must link what reaches it."""
    draw, texts = random.Random(3), []
    for i in range(60):
        words = prose(draw.randint(60, 400), i).split()
        texts += [" ".join(words), *(edited(words, max(1, round(len(words) * share)), draw)
                                     for share in (0.002, 0.01, 0.02, 0.022, 0.025, 0.04))]
    template = prose(100, 900)  # many texts that share a passage and are not alike
    texts += [template + " " + prose(draw.randint(20, 60), 1000 + i) for i in range(60)]
    texts += ["a b c", "A  b c", "a b d", "one two three four five", "One two three four five", "", " "]
    draw.shuffle(texts)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    kept = corpus_pipeline.without_near_duplicates(spark, documents(spark, rows).repartition(3), "")
    assert {r.doc_id for r in kept.collect()} == slow_kept(rows)


def test_recall_at_the_limit():
    """Pairs of Jaccard 0.80 to 0.82 share a cell."""
    draw = random.Random(5)
    for _ in range(200):
        words = prose(300, draw.randrange(1 << 30)).split()
        a = near_copies.shingles(" ".join(words))
        b = near_copies.shingles(" ".join(words[:269]) + " " + prose(31, draw.randrange(1 << 30)))
        both = len({*a.tolist()} & {*b.tolist()})
        assert 0.8 <= both / (len(a) + len(b) - both) < 0.82
        assert {*near_copies.bands_of(a)} & {*near_copies.bands_of(b)}


def test_hard_rows_and_large_group(spark):
    words = prose(300, 7).split()
    rows = [*hard_rows(), *((100 + i, " ".join([*words[:i], "changed", *words[i + 1:]]), "en", "a") for i in range(80))]
    kept = near_copies.one_of_each(documents(spark, rows))
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == [1, 2, 5, 7, 8, 9, 100] and got.count(None) == 1
    assert near_copies.one_of_each(documents(spark, [])).count() == 0


def test_blocks_of_a_cell_change_nothing(spark, monkeypatch):
    """A group of edited copies, most of them too far apart: any two blocks meet."""
    import random
    draw, base = random.Random(4), prose(120, 1).split()
    rows = [(0, " ".join(base), "en", "a")]
    for i in range(1, 90):
        words = list(base)
        for _ in range(draw.randint(1, 9)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "a"))
    docs = documents(spark, rows[1:])  # without the text they came from
    sets = {i: set(near_copies.shingles(t).tolist()) for i, t, *_ in rows[1:]}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    wanted = sorted(set(root.values()))
    assert 2 < len(wanted) < 80
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == wanted
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 4)
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == wanted


def test_fingerprints_within_three_bits_are_compared(spark):
    """The SimHash step gives candidates that connect all keys whose fingerprints are near; the sets decide."""
    import itertools

    import corpus_pipeline as pipeline
    from hazecast.llm import simhash
    from pyspark.sql import functions as F

    draw, texts = random.Random(9), []
    for i in range(20):
        words = prose(300, 2000 + i).split()
        texts += [" ".join(words), *(edited(words, k, draw) for k in (1, 1, 2))]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    marks = near_copies.sketches(docs.select("text"))
    fps = {bytes(r.key): r.fp % (1 << 64) for r in marks.collect()}
    got = [(bytes(r.a), bytes(r.b)) for r in near_copies.near_fingerprints(marks.select("key", "fp").distinct()).collect()]
    roots = {r.node: r.root for r in simhash.components(
        spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in got], "a binary, b binary").withColumns(
            {c: F.hex(c) for c in "ab"})).collect()}
    close = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert close and all(roots[a.hex().upper()] == roots[b.hex().upper()] for a, b in close)
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in got)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    assert {r.doc_id for r in pipeline.without_near_duplicates(spark, docs, "").collect()} == slow_kept(rows)
