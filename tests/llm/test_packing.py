import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hazecast.llm import packing
from llm_helpers import documents, hard_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER, REFERENCE = packing.Encoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(blacklist_categories=["Cs"]), max_size=80))
def test_ids_are_those_of_tokenizers(text):
    assert ENCODER.ids(text) == REFERENCE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", " " * 3000, "x" * 5000, "\n\n \t" * 500,
                                  "\n " * 500000, " " * 1000000])
def test_ids_of_odd_texts(text):
    assert ENCODER.ids(text) == REFERENCE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000])
def test_binary_lengths(n):
    lengths = packing.piece_lengths(n)
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 2048 for x in lengths)
    assert len(lengths) == n // 2048 + bin(n % 2048).count("1")


def test_round_trip(spark):
    rows = hard_rows()
    got = packing.pieces(documents(spark, rows).repartition(3), PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and r.length == 1 << r.bucket for r in got)
    whole: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) >= 0
        whole.setdefault(r.doc_id, []).append((r.start, r.doc_tokens, ids.tolist()))
    wanted: dict = {}
    for i, text, *_ in rows:
        ids = [*REFERENCE.encode(text or "", add_special_tokens=False).ids, 1]
        wanted.setdefault(i, []).append(ids)
    for i, texts in wanted.items():
        have = sorted(whole[i])
        assert sum(len(p[2]) for p in have) == sum(map(len, texts))
        if len(texts) == 1:
            assert [x for p in have for x in p[2]] == texts[0] and {p[1] for p in have} == {len(texts[0])}


def test_empty_table(spark):
    assert packing.pieces(documents(spark, []), PATH).count() == 0


def test_buckets_on_disk(spark, tmp_path):
    packing.write_buckets(packing.pieces(documents(spark, hard_rows()), PATH), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).filter("length <> shiftleft(1, bucket)").count() == 0


def test_longest_must_be_binary(spark):
    with pytest.raises(ValueError):
        packing.pieces(documents(spark, []), PATH, longest=1000)
