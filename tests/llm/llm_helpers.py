"""Small inputs for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(words: int, seed: int, letters: str = "abcdefghij") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(words))


def documents(spark, rows, extra: bool = True):
    """(doc_id, text, lang, source) rows, with columns whose names clash with outputs."""
    full = [(i, t, lang, source, len(t) if t is not None else None) for i, t, lang, source in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        for name in ("id", "fp", "key", "score", "size", "target", "digest", "length", "rank", "kept", "cell"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def hard_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = prose(6000, 5)
    return [(1, "One two three four.", "en", "a"), (1, "One two three four.", "en", "a"),
            (None, "No id here", "en", "b"), (None, None, None, None), (2, None, "de", "a"),
            (3, "", "fr", None), (4, " \t\n ", "es", ""), (5, long, "en", "a"), (6, long, "en", "é"),
            (7, "!!! ??? 123", None, "b"), (8, "Ünïcödé ß 漢字 \U0001f600", "de", "b"), (9, "a" * 3000, "en", "c")]
