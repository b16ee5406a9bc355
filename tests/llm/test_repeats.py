import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from hazecast.llm import repeats
from llm_helpers import documents, hard_rows, prose


def brute(texts, length):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        cover = np.zeros(len(d) + 1, dtype=int)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:len(d)] > 0
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])], hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("letters", [b"ab", b"\x00a\xff", b"abcdefgh", b"a"])
def test_suffix_array(letters):
    draw = random.Random(1)
    for n in (1, 2, 3, 10, 200, 500):
        text = bytes(draw.choice(letters) for _ in range(n))
        assert repeats.suffix_array(text, n + 1).tolist() == sorted(range(n), key=lambda i: text[i:])


def mixture():
    draw = random.Random(4)
    passage = prose(90, 100)
    rows = [prose(draw.randint(5, 300), i) for i in range(60)]
    rows += [prose(30, 200 + i) + " " + passage + " " + prose(30, 300 + i) for i in range(25)]
    rows += [rows[0], rows[1], rows[1], "ab" * 700, "xyz " * 300, passage[3:460] + passage[:450]]
    near = prose(300, 77).split()
    rows += [" ".join([*near[:k], "edit", *near[k + 1:]]) for k in range(40, 260, 20)]
    return rows


@pytest.mark.parametrize("group_bytes", [repeats.GROUP_BYTES, 2000])
def test_equals_brute_force(spark, group_bytes, monkeypatch):
    """Also when most anchors have too many places for one task."""
    monkeypatch.setattr(repeats, "SORT_BYTES", 4000)
    texts = mixture() + [r[1] for r in hard_rows()]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).repartition(3)
    cuts = {bytes(r.key): r for r in repeats.repeated_texts(docs, group_bytes=group_bytes).collect()}
    for text, (_, spans, sha) in zip(texts, brute(texts, 400)):
        found = cuts.get(hashlib.md5((text or "").encode()).digest())
        assert [(s.start, s.end) for s in found.spans] == spans if spans else found is None
        assert not found or hashlib.sha256(bytes(found.kept)).hexdigest() == sha


def test_rows(spark):
    texts = mixture()[55:]
    docs = documents(spark, [(i if i % 5 else None, t, "en", "a") for i, t in enumerate(texts)])
    got = sorted((r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256) for r in repeats.removals(docs).collect())
    assert got == sorted(brute(texts, 400))
    kept = repeats.without_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in kept.collect()) == sorted(x[2] for x in got)
    assert kept.filter("n_chars <> char_length(text)").count() == 0


def test_short_strings_and_other_lengths(spark):
    texts = ["abcabcabcabc", "xbcabcab", "zzzzz", None, "", "äöüäöü"]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256)
           for r in repeats.removals(docs, length=5, gram=2).collect()}
    assert got == dict(enumerate(brute(texts, 5)))


def test_cut_inside_a_character(spark):
    """The shared bytes end with the first byte of two different letters."""
    texts = ["x" + "ä" + "abcd" + "é", "y" + "ä" + "abcd" + "è", "no \ufffd mark"]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    kept = {r.doc_id: r.text for r in repeats.without_repeats(docs, length=5, gram=2).collect()}
    assert kept == {0: "x", 1: "y", 2: texts[2]}


def test_hard_rows_and_empty_table(spark):
    rows = hard_rows()
    kept = repeats.without_repeats(documents(spark, rows))
    assert kept.count() == len(rows)
    by_id = {r.doc_id: r.text for r in kept.collect()}
    assert by_id[2] is None and by_id[5] == by_id[6] == "" and by_id[9] == ""
    assert repeats.removals(documents(spark, [])).count() == 0
    assert repeats.without_repeats(documents(spark, [])).count() == 0


def test_stage_takes_passages_of_over_50_words(spark):
    """Planted amid differing text, of short words and of long ones; shorter repeats stay."""
    letters = " ".join("abcdefghijklmnopqrstuvwxy"[i % 25] for i in range(51))
    passages = {n: prose(n, 900 + n) for n in (51, 52, 55, 60)} | {1: letters}
    below = prose(45, 990)  # under 400 bytes and under 50 words
    texts, wanted = [], []
    for i in range(4):
        for n, passage in passages.items():
            head, tail = prose(30, 10 * n + i) + f" {i}", f"{i} " + prose(30, 5000 + 10 * n + i)
            texts.append(f"{head} {passage} {tail}")
            wanted.append(head + tail)
        texts.append(f"{prose(30, 7000 + i)} {i} {below} {i} {prose(30, 8000 + i)}")
        wanted.append(texts[-1])
    assert all(len(p) < 400 for p in passages.values()) and len(letters) == 101 and 101 < len(below) < 400
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, "").collect()}
    assert got == dict(enumerate(wanted))


@pytest.mark.parametrize("gram", [32, 64])
def test_short_length_equals_brute_force(spark, gram):
    texts = mixture()[40:]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = sorted((r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256)
                 for r in repeats.removals(docs, 101, gram).collect())
    assert got == sorted(brute(texts, 101))


def test_whole_texts_move_once_at_the_end_and_shuffles_are_deleted(spark, tmp_path):
    """The last query shuffles the rows' texts alone; stored tables leave no shuffle files."""
    shared = "one passage that two texts share " * 20
    docs = spark.createDataFrame([(i, f"{i} begins {shared} and {i} ends", "x") for i in range(20)],
                                 "doc_id long, text string, other string")
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()

    def shuffles():
        return set(tracker.shuffleStatuses().keys().mkString(",").split(","))

    before = shuffles()
    out = repeats.without_repeats(docs, length=101, gram=32, least_words=51)
    assert shuffles() <= before
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "shared-texts" not in plan and plan.count("MapInArrow") == 0
    assert {r.other for r in out.collect()} == {"x"} and all("passage" not in r.text for r in out.collect())
