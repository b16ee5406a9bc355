"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts train a sparse logistic classifier in numpy. With
class prior p, positives P and unlabelled U, the risk is

    p E_P[loss(+)] + max(0, E_U[loss(-)] - p E_P[loss(-)])

The second part estimates the risk on clean texts; when it falls below zero the fit has
begun to memorise, and the step goes against that part alone. A proximal step keeps the
weights sparse. Features of a text are its distinct words and their first letters; those
far more common among toxic texts than elsewhere are selected by counts over all texts. Texts
without such a feature are alike to the fit and enter it as one number, so its bounded sample
of unlabelled texts is drawn from those that have one, however rare these are.
"""

import math
import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import arrow_map, stored

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7, 8)


def features_of(word: str) -> list[str]:
    """The word itself and its first letters, marked as such."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def document_features(text: str | None) -> set[str]:
    return {f for w in set(WORDS.findall((text or "").lower())) for f in features_of(w)}


def _remembered(chosen: dict | None = None, most_known: int = 300_000):
    """``document_features``, less those not ``chosen``, that remembers the features of words."""
    known: dict[str, tuple] = {}

    def features(text: str | None) -> set[str]:
        out: set = set()
        for word in set(WORDS.findall((text or "").lower())):
            found = known.get(word)
            if found is None:
                found = tuple(f for f in features_of(word) if chosen is None or f in chosen)
                if len(known) < most_known:
                    known[word] = found
            out.update(found)
        return out

    return features


def fit_nnpu(positive: list, unlabelled: list, features: int, prior: float, steps: int = 800,
             rate: float = 0.3, sparsity: float = 2e-5, slack: float = 0.0, blank: float = 0.0):
    """Weights and bias from lists of feature-index arrays, one per text.

    ``blank`` is the share of unlabelled texts that are not listed as they have no feature. A
    prior under 0.1 weakens the pull to zero in step with the gradients, which have it as a factor.
    """
    sparsity *= min(1.0, prior / 0.1)

    def packed(texts):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        flat = np.concatenate([np.asarray(t, dtype=np.int64) for t in texts] or [np.zeros(0, np.int64)])
        return flat, np.repeat(np.arange(len(texts)), sizes), len(texts)

    pos, unl = packed(positive), packed(unlabelled)
    weights, bias = np.zeros(features), math.log(prior / (1 - prior))
    square, square_bias = np.full(features, 1e-8), 1e-8

    def scores(data):
        flat, rows, n = data
        return bias + np.bincount(rows, weights=weights[flat], minlength=n)

    def pull(data, slope):
        flat, rows, _ = data
        return np.bincount(flat, weights=slope[rows], minlength=features), slope.sum()

    def sigmoid(z):
        return 0.5 * (1 + np.tanh(0.5 * z))

    for _ in range(steps):
        zp, zu = scores(pos), scores(unl)
        listed = (1 - blank) / max(1, len(zu))
        clean = (np.logaddexp(0, zu).sum() * listed + blank * np.logaddexp(0, bias)
                 - prior * np.logaddexp(0, zp).mean())
        gw, gb = pull(unl, sigmoid(zu) * listed)
        gb += blank * sigmoid(bias)
        minus = pull(pos, prior * sigmoid(zp) / len(zp))
        gw, gb = gw - minus[0], gb - minus[1]
        if clean < -slack:
            gw, gb = -gw, -gb
        else:
            plus = pull(pos, -prior * sigmoid(-zp) / len(zp))
            gw, gb = gw + plus[0], gb + plus[1]
        square += gw * gw
        square_bias += gb * gb
        step = rate / np.sqrt(square)
        weights = weights - step * gw
        weights = np.sign(weights) * np.maximum(np.abs(weights) - step * sparsity, 0)
        bias -= rate * gb / math.sqrt(square_bias)
    return weights, bias


def trained(docs: DataFrame, labels: DataFrame, most_positive: int = 6000, most_unlabelled: int = 18000,
            most_features: int = 20000, least_documents: int = 4, id_column: str = "doc_id",
            text_column: str = "text", label_column: str = "toxic") -> dict:
    """A model {weights: feature -> weight, bias} from the texts of ``docs``.

    Features are chosen by the texts of all rows that have them: a subset of the rows shows which
    cannot be chosen, as further rows only lower their chance, the rest is counted in all, as many
    at a time as a task holds. They are fitted on about
    ``most_positive`` texts labelled 1 and ``most_unlabelled`` texts of any label with a chosen
    feature, drawn by a hash of their id. The prior is the share of 1 among labelled rows. Of
    labels with one id the largest counts; null labels and ids do not. Without texts labelled
    1 the model has no weights and a score of zero.
    """
    ids = docs.select(F.col(id_column).alias("id"))
    known = labels.groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).alias("label"))
    tagged = ids.join(known, "id", "left").select("id", (F.col("label") == 1).alias("positive"))
    rows, labelled, positives = tagged.agg(
        F.count("*"), F.count("positive"), F.count_if("positive")).first()
    if not positives:
        return {"weights": {}, "bias": -math.inf}
    prior = min(max(positives / labelled, 1e-4), 0.9)

    # stored, so that its true size decides how texts meet it
    toxic = stored(known.filter("label = 1").select("id", F.lit(True).alias("p")), "toxic-ids")
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(toxic, "id", "left").select(
        F.coalesce("p", F.lit(False)).alias("p"), "id", "text")

    def tallied(batches):
        """Counts of each feature over many texts; a feature may come several times."""
        def rows_of(every, bad):
            names = list(every)
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([bad[f] for f in names], pa.int64()),
                 pa.array(every.values(), pa.int64())], names=["feature", "in_p", "in_u"])

        found, every, bad = _remembered(), Counter(), Counter()
        for batch in batches:
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                features = found(text)
                every.update(features)
                if p:
                    bad.update(features)
                if len(every) > 200_000:
                    yield rows_of(every, bad)
                    every, bad = Counter(), Counter()
        if every:
            yield rows_of(every, bad)

    def part(share, salt):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20)) < int(min(1, share) * (1 << 20))

    # a word of toxic texts alone is 1 / prior times as common there as in all texts
    chance = (F.col("in_u") + 1) * positives / rows
    telling = (F.col("in_p") >= least_documents) & (F.col("in_p") * prior > 0.75 * chance) & (
        F.col("in_p") - chance > 5 * F.sqrt(chance))
    # well above the share at which a word as common in toxic texts as in others falls out:
    # near it many rare words, and those of long texts, still pass
    share = 3 * max(0.0, prior / 0.75 - positives / rows) / max(1e-9, 1 - positives / rows)
    some = texts.filter(F.col("p") | part(share, 3)).select("p", "text")
    counts = [F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u")]
    passing = stored(arrow_map(some, tallied, "feature string, in_p long, in_u long").groupBy(
        "feature").agg(*counts).filter(telling), "passing")

    def chosen_of(part_of):
        """Those of a list of features that the counts over all texts let pass, in its order."""
        places = {f: i for i, f in enumerate(part_of)}

        def counted(batches):
            found, every, bad = _remembered(places), Counter(), Counter()
            for batch in batches:
                for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    features = found(text)
                    every.update(features)
                    if p:
                        bad.update(features)
            names = list(every)
            yield pa.RecordBatch.from_arrays(
                [pa.array([places[f] for f in names], pa.int32()), pa.array([bad[f] for f in names], pa.int64()),
                 pa.array(every.values(), pa.int64())], names=["place", "in_p", "in_u"])

        passed = arrow_map(texts.select("p", "text"), counted, "place int, in_p long, in_u long").groupBy(
            "place").agg(*counts).filter(telling).select("place").collect()
        return [part_of[i] for i in sorted(r.place for r in passed)]

    most_held = 5 * most_features
    if passing.count() <= most_held:
        candidates = [r.feature for r in passing.collect()]
    else:
        # the count in toxic texts is final, so the best ones come first
        candidates, ranked = [], (r.feature for r in passing.orderBy(F.desc("in_p"), "feature").toLocalIterator())
        while len(candidates) < most_features and (held := list(islice(ranked, most_held))):
            candidates += chosen_of(held)
    place = {f: i for i, f in enumerate(candidates)}

    def indexed(batches):
        """Texts that have a candidate, and all toxic ones."""
        found = _remembered(place)
        for batch in batches:
            lists = [sorted(place[f] for f in found(t)) for t in batch.column(2).to_pylist()]
            out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lists, pa.list_(pa.int32()))],
                                             names=["p", "id", "features"])
            yield out.filter(pa.array([p or bool(x) for p, x in zip(batch.column(0).to_pylist(), lists)], pa.bool_()))

    kind = docs.schema[id_column].dataType.simpleString()
    kinds = f"p boolean, id {kind}, features array<int>"
    points = stored(arrow_map(texts, indexed, kinds), "points")
    exact = points.select("p", F.explode("features").alias("place")).groupBy("place").agg(
        F.count_if("p").alias("in_p"), F.count("*").alias("in_u")).filter(telling).collect()
    kept = sorted(((-r.in_p, candidates[r.place], r.place) for r in exact),
                  key=lambda k: (k[0], k[1].encode()))[:most_features]
    renumber = np.full(len(candidates), -1)
    renumber[[k[2] for k in kept]] = np.arange(len(kept))
    kept = [k[1] for k in kept]

    def renumbered(batches):
        for batch in batches:
            lists = [np.sort(new[new >= 0]) for new in (
                renumber[np.asarray(f, dtype=np.int64)] for f in batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lists, pa.list_(pa.int32()))],
                                             names=["p", "id", "features"])

    points = arrow_map(points, renumbered, kinds)
    having = points.filter(F.size("features") > 0).count()
    points = points.select((F.col("p") & part(most_positive / max(1, positives), 1)).alias("p"),
                           ((F.size("features") > 0) & part(most_unlabelled / max(1, having), 2)).alias("u"), "features")
    # bounded by the two parameters: the limit only meets tables whose ids repeat
    points = points.filter("p or u").limit(2 * (most_positive + most_unlabelled)).toPandas()
    if not points.p.any():
        return {"weights": {}, "bias": math.log(prior / (1 - prior))}
    points = points.sort_values("features", key=lambda s: s.map(tuple), ignore_index=True)
    positive, unlabelled = list(points.features[points.p]), list(points.features[points.u])
    blank = 1 - having / rows
    # a first fit with a strong pull to zero chooses features, a second one weighs them: many
    # small weights would add up in long texts
    chosen, _ = fit_nnpu(positive, unlabelled, len(kept), prior, sparsity=2e-4, blank=blank)
    places = np.flatnonzero(chosen > 0.05)
    renumber = np.full(len(kept), -1)
    renumber[places] = np.arange(len(places))

    def only_chosen(texts):
        return [r[r >= 0] for r in (renumber[np.asarray(t, dtype=np.int64)] for t in texts)]

    weights, bias = fit_nnpu(only_chosen(positive), only_chosen(unlabelled), len(places), prior, blank=blank)
    kept = [kept[i] for i in places]
    return {"weights": {f: float(w) for f, w in zip(kept, weights) if w}, "bias": float(bias)}


def scorer(model: dict, most_known: int = 300_000):
    """A function from a text to its score, which remembers the features of words it has met."""
    weights, bias = model["weights"], model["bias"]
    known: dict[str, tuple] = {}

    def score(text: str | None) -> float:
        hit: set = set()
        for word in set(WORDS.findall((text or "").lower())):
            found = known.get(word)
            if found is None:
                found = tuple(f for f in features_of(word) if f in weights)
                if len(known) < most_known:
                    known[word] = found
            hit.update(found)
        z = bias + sum(weights[f] for f in sorted(hit))
        return 0.5 * (1 + math.tanh(0.5 * z)) if z > -700 else 0.0

    return score


def scored(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and toxicity score (0 to 1) per row; a null text scores like an empty one.

    Whole texts are read, however long. Repeated rows repeat; other columns are left out.
    """
    def score(batches):
        scores = scorer(model)
        for batch in batches:
            out = [scores(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())],
                                             names=["id", "score"])

    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return arrow_map(chosen, score, f"id {kind}, score double").withColumnRenamed("id", id_column)


def without_toxic(docs: DataFrame, model: dict, limit: float = 0.7, text_column: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose score is below ``limit``."""
    place = docs.columns.index(text_column)

    def keep(batches):
        scores = scorer(model)
        for batch in batches:
            flags = [scores(text) < limit for text in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(flags, pa.bool_()))

    return arrow_map(docs, keep, docs.schema)
