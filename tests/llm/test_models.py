import math
import random

import numpy as np
import pytest

from hazecast.llm import languages, toxicity
from llm_helpers import documents, hard_rows, prose


def test_toxicity_on_held_out_texts(spark):
    """A third of the toxic texts are labelled; the rest lie among the unlabelled ones."""
    draw = random.Random(1)
    rows, labels, truth = [], [], {}
    for i in range(1500):
        bad = i % 8 == 0
        words = prose(draw.randint(3, 120), i).split()
        for _ in range(draw.randint(1, 4) if bad else 0):
            words.insert(draw.randint(0, len(words)), draw.choice(["vilest", "rotter", "grumpf" + draw.choice("abcde")]))
        rows.append((i, " ".join(words), "en", "a"))
        truth[i] = bad
        if i % 3 != 1:
            labels.append((i, int(bad) if i % 3 == 0 else None))
    docs = documents(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.trained(docs.filter("doc_id % 3 <> 1"), known)
    score = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [i for i in truth if i % 3 == 1]
    assert np.mean([score[i] >= 0.7 for i in held if truth[i]]) > 0.95
    assert np.mean([score[i] >= 0.7 for i in held if not truth[i]]) < 0.02
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in truth if score[i] < 0.7}
    again = toxicity.trained(docs.filter("doc_id % 3 <> 1").repartition(7), known)
    assert again == model


@pytest.mark.parametrize("every, stems", [(100, 70), (1000, 10)])
def test_rare_toxicity(spark, every, stems):
    """One text in 100 or 1,000 is toxic, by one of many stems; each stem is in few of them."""
    draw = random.Random(every)
    plain = prose(5000, every, "abcdefghijklmnop").split()
    bad = ["q" + "".join(draw.choice("rstuvwxyz") for _ in range(8)) for _ in range(stems)]
    rows = []
    for i in range(100_000):
        words = draw.choices(plain, k=10)
        if i % every == 0:
            words[draw.randrange(10)] = draw.choice(bad)
        rows.append((i, " ".join(words), "en", "a"))
    docs = documents(spark, rows, extra=False).repartition(8)
    held = "pmod(xxhash64(doc_id), 3) = 1"
    known = docs.selectExpr("doc_id", f"CAST(doc_id % {every} = 0 AS int) AS toxic").filter(f"NOT {held}")
    model = toxicity.trained(docs.filter(f"NOT {held}"), known)
    got = toxicity.scored(docs.filter(held), model).selectExpr(f"doc_id % {every} = 0 AS bad", "score >= 0.7 AS called")
    n = {(r.bad, r.called): r["count"] for r in got.groupBy("bad", "called").count().collect()}
    assert n[True, True] > 0.8 * (n[True, True] + n.get((True, False), 0))
    assert n.get((False, True), 0) < 0.002 * n[False, False]


def test_the_risk_does_not_go_negative():
    """Without the correction, single features of positives would run away."""
    positive = [[i] for i in range(20)]
    unlabelled = [[] for _ in range(200)]
    weights, _ = toxicity.fit_nnpu(positive, unlabelled, 20, 0.1)
    assert np.isfinite(weights).all() and (weights > 0).all()


def test_toxicity_hard_rows(spark):
    docs = documents(spark, hard_rows())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.trained(docs, none)
    assert {r.score for r in toxicity.scored(docs, model).collect()} == {0.0}
    known = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.trained(docs, known)).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(documents(spark, []), model).count() == 0
    assert toxicity.trained(documents(spark, []), known)["weights"] == {}


LETTERS = {"xx": "abcdeij", "yy": "mnoprst", "zz": "äöuvwxe"}


def test_languages_on_held_out_texts(spark):
    rows = []
    for i in range(400):
        lang = sorted(LETTERS)[i % 3]
        text = prose(20 + i % 50, i, LETTERS[lang])
        if i % 5 == 0:  # code-switched: a shorter run of another language
            text += " " + prose(8, i, LETTERS[sorted(LETTERS)[(i + 1) % 3]])
        rows.append((i, text, lang if i % 7 else None, "a"))
    docs = documents(spark, rows)
    model = languages.trained(docs.filter("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in languages.predicted(docs, model).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert np.mean([got[i].lang_pred == sorted(LETTERS)[i % 3] for i, *_ in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    switched = [got[i].score for i in range(0, 400, 5)]
    pure = [got[i].score for i in range(400) if i % 5]
    assert np.mean(switched) < np.mean(pure)


def test_forward_backward_equals_enumeration():
    draw = np.random.default_rng(1)
    lengths = np.array([3, 1, 4])
    scores = draw.normal(size=(8, 3)).astype(np.float64)
    steps, first = draw.normal(size=(3, 3)), draw.normal(size=3)
    got, pairs = languages.forward_backward(scores, lengths, steps, first, pairs=True)
    at, expected = 0, np.zeros((3, 3))
    for n in lengths:
        mass, total = np.zeros((n, 3)), 0.0
        counts = np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            p = np.exp(first[path[0]] + sum(scores[at + t, path[t]] for t in range(n))
                       + sum(steps[path[t - 1], path[t]] for t in range(1, n)))
            total += p
            for t in range(n):
                mass[t, path[t]] += p
                if t:
                    counts[path[t - 1], path[t]] += p
        assert np.allclose(got[at:at + n], mass / total)
        expected += counts / total
        at += n
    assert np.allclose(pairs, expected)


def test_word_n_grams_stay_inside_words():
    together = languages.word_hashes([b"one", b"two", "ä".encode()])
    alone = [languages.word_hashes([w]) for w in (b"one", b"two", "ä".encode())]
    assert together[2].tolist() == [int(a[2][0]) for a in alone]
    for n, (slots, owners) in enumerate(zip(together[0], together[1])):
        for i, a in enumerate(alone):
            assert sorted(slots[owners == i]) == sorted(a[0][n])


def test_languages_hard_rows(spark):
    docs = documents(spark, hard_rows())
    assert {(r.lang_pred, r.score) for r in languages.predicted(docs, None).collect()} == {("und", 0.0)}
    model = languages.trained(docs)
    got = {r.doc_id: r for r in languages.predicted(docs, model).collect()}
    assert all(got[i].lang_pred == "und" for i in (2, 3, 4, 7)) and got[5].lang_pred == "en"
    assert languages.trained(documents(spark, [])) is None
    assert languages.predicted(documents(spark, []), model).count() == 0


def slow_nnpu(positive, unlabelled, width, prior, steps, rate, blank, correct):
    """The non-negative risk and its gradient text by text, without sparsity; steps like Adagrad's."""
    w, b = np.zeros(width), math.log(prior / (1 - prior))
    square, square_b, turned = np.full(width, 1e-8), 1e-8, 0

    def sums(texts, slope):
        g, gb = np.zeros(width), 0.0
        for t in texts:
            z = b + sum(w[f] for f in t)
            g[list(t)] += slope(z) / len(texts)
            gb += slope(z) / len(texts)
        return g, gb

    def mean(texts):
        return sum(math.log1p(math.exp(b + sum(w[f] for f in t))) for t in texts) / len(texts)

    def rise(z):
        return 1 / (1 + math.exp(-z))

    for _ in range(steps):
        every, minus, plus = sums(unlabelled, rise), sums(positive, rise), sums(positive, lambda z: -rise(-z))
        clean = (1 - blank) * mean(unlabelled) + blank * mean([[]]) - prior * mean(positive)
        g = (1 - blank) * every[0] - prior * minus[0]
        gb = (1 - blank) * every[1] + blank * rise(b) - prior * minus[1]
        if correct and clean < 0:
            g, gb, turned = -g, -gb, turned + 1
        else:
            g, gb = g + prior * plus[0], gb + prior * plus[1]
        square, square_b = square + g * g, square_b + gb * gb
        w, b = w - rate * g / np.sqrt(square), b - rate * gb / math.sqrt(square_b)
    return w, b, turned


def test_the_fit_follows_the_non_negative_risk():
    rng = np.random.default_rng(2)
    positive = [sorted(rng.choice(8, 4, replace=False)) for _ in range(12)]
    unlabelled = [sorted(rng.choice(12, 2, replace=False)) for _ in range(30)]
    settings = dict(steps=120, rate=0.3, blank=0.25)
    w, b, turned = slow_nnpu(positive, unlabelled, 12, 0.6, correct=True, **settings)
    assert turned > 0  # the correction is met
    got, bias = toxicity.fit_nnpu(positive, unlabelled, 12, 0.6, sparsity=0.0, slack=0.0, **settings)
    assert np.allclose(got, w, atol=1e-6) and abs(bias - b) < 1e-6
    off, _ = toxicity.fit_nnpu(positive, unlabelled, 12, 0.6, sparsity=0.0, slack=1e9, **settings)
    plain, _, _ = slow_nnpu(positive, unlabelled, 12, 0.6, correct=False, **settings)
    assert np.allclose(off, plain, atol=1e-6) and not np.allclose(off, got, atol=1e-2)


def test_words_are_tallied_over_a_share_of_the_texts(spark, monkeypatch):
    """Common words fall out by a share of the clean texts; those chosen are counted in all."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('common words here ', "
                                        "CASE WHEN id % 40 = 0 THEN 'vile' ELSE 'kind' END) AS text")
    known = docs.selectExpr("doc_id", "CAST(doc_id % 40 = 0 AS int) AS toxic")
    tallied, map_of = [], toxicity.arrow_map

    def noted(df, function, schema):
        if schema.startswith("feature "):
            tallied.append(df.count())
        return map_of(df, function, schema)

    monkeypatch.setattr(toxicity, "arrow_map", noted)
    model = toxicity.trained(docs, known)
    assert len(tallied) == 1 and tallied[0] < 500
    assert model["weights"] and all(f.startswith("vil") for f in model["weights"])


def test_many_candidates_are_counted_in_parts(spark, monkeypatch):
    """More words than a task holds pass the share: they are counted in all texts, others are not again."""
    rows = []
    for i in range(1500):
        toxic, j = i % 30 == 0, i // 30
        words = [f"{'abcdefghijkl'[k]}q" for k in range(12)
                 if ((j + k) % 2 == 0 if toxic else (i + 17 * k) % 14 == 0)]
        if toxic:
            words += ["zx", "zy"] * (j % 5 < 2) + ["zz"] * (j % 5 == 0)
        rows.append((i, " ".join(["some", "text", *words]), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    passes, map_of = [], toxicity.arrow_map

    def noted(df, function, schema):
        passes.append(schema.split()[0])
        return map_of(df, function, schema)

    monkeypatch.setattr(toxicity, "arrow_map", noted)
    model = toxicity.trained(docs.drop("toxic"), docs.drop("text"), most_features=2)
    # the twelve common words lead by their count in toxic texts, and all fall out
    assert set(model["weights"]) == {"zx", "zy"}
    assert passes.count("feature") == 1 and passes.count("place") == 2
