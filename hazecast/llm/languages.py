"""Language of words by a linear-chain conditional random field, and of texts by their words.

A word's score for each language sums the weights of its letter n-grams (those at its ends
are its affixes) and of its entry in a lexicon; learned transitions tie neighbours. The
forward-backward pass gives each word a distribution over languages, also where a text
switches between them; a text gets the language with most of that mass. All of it works on
arrays: n-grams of many words at once, one step of many texts at once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import arrow_map

SLOTS = 1 << 17        # n-gram weights
LEXICON_BITS = 16
GRAMS = (2, 3, 4)      # bytes, the blank at either end of a word included
UNKNOWN = "und"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]):
    """For each word its n-gram slots (flat, with the start of each word's run) and a hash."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))  # of the blank before a word
    place = np.arange(len(data), dtype=np.int64)
    letters = data.astype(np.uint32)
    slots, owners = [], []
    word_of = np.repeat(np.arange(len(words)), lengths + 1)
    rolling = letters
    for n in range(2, max(GRAMS) + 1):
        rolling = rolling[:-1] * np.uint32(0x01000193) ^ letters[n - 1:]  # ends at place + n - 1
        if n not in GRAMS:
            continue
        ends = place[n - 1:]
        mixed = (rolling * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(15)
        begin = ends - (n - 1)
        # inside one word, the blanks at its two ends allowed
        owner = word_of[np.minimum(begin, len(word_of) - 1)]
        inside = (begin < len(word_of)) & (ends <= starts[owner] + lengths[owner] + 1)
        slots.append(mixed[inside])
        owners.append(owner[inside])
    powers = np.multiply.accumulate(np.full(len(data), 0x100000001B3, dtype=np.uint64))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)))
    inverse = pow(0x100000001B3, -1, 1 << 64)
    undo = np.multiply.accumulate(np.full(len(data), inverse, dtype=np.uint64))
    whole = (sums[starts + 1 + lengths] - sums[starts + 1]) * undo[starts]
    whole ^= whole >> np.uint64(29)
    whole *= np.uint64(0xBF58476D1CE4E5B9)
    whole ^= whole >> np.uint64(32)
    return slots, owners, whole


class Crf:
    """Weights of n-gram slots, lexicon entries, transitions and starts, per language."""

    def __init__(self, languages: list[str], lexicon: np.ndarray):
        k = len(languages)
        self.languages = languages
        self.grams = np.zeros((SLOTS, k), dtype=np.float32)
        self.known = np.zeros(1 << LEXICON_BITS, dtype=np.uint64)
        self.known[(lexicon & np.uint64((1 << LEXICON_BITS) - 1)).astype(np.int64)] = lexicon
        self.entries = np.zeros((1 << LEXICON_BITS, k), dtype=np.float32)
        self.steps = np.zeros((k, k), dtype=np.float32)
        self.first = np.zeros(k, dtype=np.float32)

    def lexicon_places(self, whole):
        at = (whole & np.uint64((1 << LEXICON_BITS) - 1)).astype(np.int64)
        return at, self.known[at] == whole

    def emissions(self, words: list[bytes], most_bytes: int = 1 << 18) -> np.ndarray:
        """Scores of words per language, made for a bounded run of words at a time."""
        parts, run, size = [], [], 0
        for word in words:
            run.append(word)
            size += len(word) + 1
            if size >= most_bytes:
                parts.append(self._emissions(run))
                run, size = [], 0
        if run:
            parts.append(self._emissions(run))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def _emissions(self, words):
        slots, owners, whole = word_hashes(words)
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        for s, o in zip(slots, owners):
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(o, weights=self.grams[s, k], minlength=len(words))
        at, hit = self.lexicon_places(whole)
        out += self.entries[at] * hit[:, None]
        return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray, first: np.ndarray,
                     pairs: bool = False):
    """Marginals per word of texts laid end to end; with ``pairs`` the transition counts too.

    Texts run side by side, longest first: step t works on all that have a word t.
    """
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    local = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60))
    move = np.exp(steps - steps.max())
    alpha = np.empty_like(local)
    state = np.exp(first - first.max())[None, :]
    for t in range(longest):
        rows = begin[:active[t]] + t
        state = (np.broadcast_to(state, (active[t], state.shape[1])) if t == 0
                 else state[:active[t]] @ move) * local[rows]
        state /= state.sum(axis=1, keepdims=True)
        alpha[rows] = state
    back = np.ones((0, local.shape[1]), dtype=local.dtype)
    expected = np.zeros_like(move, dtype=np.float64)
    for t in range(longest - 1, -1, -1):
        rows = begin[:active[t]] + t
        if len(back) < active[t]:
            back = np.concatenate((back, np.ones((active[t] - len(back), local.shape[1]), local.dtype)))
        both = alpha[rows] * back
        both /= both.sum(axis=1, keepdims=True)
        if t:
            ahead = back * local[rows]
            if pairs:
                joint = alpha[rows - 1][:, :, None] * move[None] * ahead[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = ahead @ move.T
            back /= back.sum(axis=1, keepdims=True)
        alpha[rows] = both
    return (alpha, expected) if pairs else alpha


def fit(segments: list[tuple[str, list[bytes]]], epochs: int = 6, rate: float = 0.5, batch: int = 256,
        seed: int = 1) -> Crf:
    """A CRF from labelled runs of words, joined at random so that labels switch inside a chain."""
    languages = sorted({lang for lang, _ in segments})
    number = {lang: i for i, lang in enumerate(languages)}
    counts: dict[bytes, int] = {}
    for _, words in segments:
        for word in words:
            counts[word] = counts.get(word, 0) + 1
    frequent = sorted((w for w, n in counts.items() if n >= 3), key=lambda w: (counts[w], w))
    model = Crf(languages, word_hashes(frequent)[2] if frequent else np.zeros(0, np.uint64))
    draw = np.random.default_rng(seed)
    sums = {name: np.full_like(getattr(model, name), 1e-3) for name in ("grams", "entries", "steps", "first")}

    def descend(name, gradient, rows=slice(None)):
        sums[name][rows] += gradient * gradient
        getattr(model, name)[rows] -= rate * gradient / np.sqrt(sums[name][rows])

    for _ in range(epochs):
        order, chains = draw.permutation(len(segments)), []
        while len(order):
            take = int(draw.integers(1, 5))
            chains.append(order[:take])
            order = order[take:]
        for at in range(0, len(chains), batch):
            words, truth, lengths = [], [], []
            for chain in chains[at:at + batch]:
                lengths.append(sum(len(segments[i][1]) for i in chain))
                for i in chain:
                    words += segments[i][1]
                    truth += [number[segments[i][0]]] * len(segments[i][1])
            lengths, truth = np.array(lengths), np.array(truth)
            slots, owners, whole = word_hashes(words)
            marginals, pairs = forward_backward(model.emissions(words), lengths, model.steps,
                                                model.first, pairs=True)
            starts = np.cumsum(lengths) - lengths
            wrong = marginals.copy()
            wrong[np.arange(len(truth)), truth] -= 1
            wrong /= len(lengths)
            gradient = np.zeros_like(model.grams)
            for s, o in zip(slots, owners):
                for k in range(wrong.shape[1]):
                    gradient[:, k] += np.bincount(s, weights=wrong[o, k], minlength=SLOTS)
            descend("grams", gradient)
            place, hit = model.lexicon_places(whole)
            gradient = np.zeros_like(model.entries)
            for k in range(wrong.shape[1]):
                gradient[:, k] = np.bincount(place[hit], weights=wrong[hit, k], minlength=len(gradient))
            descend("entries", gradient)
            inner = np.ones(len(truth), dtype=bool)
            inner[starts] = False
            seen = np.zeros_like(pairs)
            np.add.at(seen, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
            descend("steps", ((pairs - seen) / len(lengths)).astype(np.float32))
            descend("first", wrong[starts].sum(axis=0))
    return model


def trained(docs: DataFrame, most_per_language: int = 800, runs: int = 6, run_words: int = 25,
            text_column: str = "text", lang_column: str = "lang") -> Crf | None:
    """A CRF fitted on about ``most_per_language`` texts of each language of ``docs``.

    Texts are chosen by a hash of the text; each gives up to ``runs`` runs of words spread
    over its whole length. Null languages and texts teach nothing; None if nothing is left.
    """
    known = docs.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items())
                           for x in (lang, int(min(1, most_per_language / n) * (1 << 20)))])
    sample = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(limit, F.col("lang")))

    def cut(batches):
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                step = max(run_words, -(-len(words) // runs))
                for at in range(0, len(words), step):
                    langs.append(lang)
                    found.append(b" ".join(words[at:at + run_words]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())],
                                             names=["lang", "words"])

    most = 4 * most_per_language * runs * len(counts)  # met only if one text fills the sample
    rows = arrow_map(sample, cut, "lang string, words binary").limit(most).collect()
    segments = sorted((r[0], bytes(r[1])) for r in rows)
    return fit([(lang, words.split()) for lang, words in segments]) if segments else None


def predicted(docs: DataFrame, model: Crf | None, id_column: str = "doc_id", text_column: str = "text"
              ) -> DataFrame:
    """Id, lang_pred and score (share of the word mass, 0 to 1) per row.

    A null text, and one without a letter, is ``und`` with score 0; so is every text if there
    is no model. Whole texts are read; repeated rows repeat; other columns are left out.
    """
    # the model, of a fixed size per language, goes with the function: a broadcast would name its
    # class by a module that workers may not have
    crf = model

    def predict(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spoken = [i for i, t in enumerate(texts)
                      if crf and t and next((True for c in t if c.isalpha()), False)]
            langs, shares = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if spoken:
                lists = [words_of(texts[i]) for i in spoken]
                lengths = np.array([len(w) for w in lists])
                mass = forward_backward(crf.emissions([w for words in lists for w in words]),
                                        lengths, crf.steps, crf.first)
                sums = np.add.reduceat(mass, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64)
                best = sums.argmax(axis=1)
                for i, b, s, n in zip(spoken, best, sums.max(axis=1), lengths):
                    langs[i], shares[i] = crf.languages[b], float(min(1.0, s / n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(shares, pa.float64())],
                names=["id", "lang_pred", "score"])

    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return arrow_map(chosen, predict, f"id {kind}, lang_pred string, score double").withColumnRenamed(
        "id", id_column)
