"""Packing without padding: documents cut into pieces of power-of-two length.

A document of n ids is cut by the binary digits of n: as many pieces of the longest
length as fit, then one piece for each set bit of the rest, long ones first. Pieces of
equal length form a bucket; a training step draws a batch from one bucket. A sequence is
one piece, so it never crosses documents and needs no padding. There is no shuffle: the
cut of a document depends on that document alone.
"""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.llm.common import arrow_map

LONGEST = 2048
END_ID = 1


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Binary lengths that sum to n; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1)
                                         if rest >> b & 1]


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of a byte-level BPE file, as the ``tokenizers`` library gives them.

    ``tiktoken`` runs the same merges several times faster, given the file's vocabulary as
    ranks. Texts that spell a special token, and whatever its pattern engine refuses, go
    to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.reference = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = [t["content"] for t in content["added_tokens"]]
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in word): i for word, i in content["model"]["vocab"].items()
                 if word not in self.special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN,
                                      mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as reason:  # noqa: BLE001
                # its regex engine gives up on some very long runs, by an error or by a panic,
                # which is no Exception; an interrupt or exit goes on
                if not isinstance(reason, Exception) and type(reason).__name__ != "PanicException":
                    raise
        return self.reference.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = END_ID,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, bucket, sequence_id, offset, ids.

    ``tokenizer`` is the path of a byte-level BPE file that every executor has. ``ids`` are
    little-endian unsigned 32-bit numbers. A null text counts as empty, and an empty text
    gives the end id alone. A null id is kept. Repeated rows are packed each for itself.
    A text is encoded whole: its ids are held once as a list, some 50 bytes of memory a
    character; a run of a million blanks is tested. A table without rows gives none.
    Other columns are left out, whatever their names. ``sequence_id`` numbers sequences
    within the input's partitions: unique, with gaps.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")

    def cut(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows, starts, lengths, totals, ids = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                encoded = np.array([*encoder.ids(text or ""), end_id], dtype="<u4")
                data, at = encoded.tobytes(), 0
                for length in piece_lengths(len(encoded), longest):
                    rows.append(row)
                    starts.append(at)
                    lengths.append(length)
                    totals.append(len(encoded))
                    ids.append(data[4 * at:4 * (at + length)])
                    at += length
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array(ids, pa.binary())],
                names=["id", "start", "length", "doc_tokens", "ids"])

    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    cut_up = arrow_map(chosen, cut, f"id {kind}, start long, length long, doc_tokens long, ids binary")
    return cut_up.select(
        F.col("id").alias(id_column), "start", "length", "doc_tokens",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), "ids")


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length, so that a training step reads sequences of one length."""
    packed.write.partitionBy("bucket").parquet(path)
