import struct

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

from hazecast.llm import token_files
from llm_helpers import documents, hard_rows, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)


def expected(text):
    return [*REFERENCE.encode(text or "", add_special_tokens=False).ids, 0]


def numbers(data):
    return np.frombuffer(data, "<u4").tolist()


def test_round_trip(spark, tmp_path):
    rows = hard_rows() + [(100 - i, prose(40, i), "en", "a") for i in range(60)]
    path = str(tmp_path / "out")
    listed = token_files.write(documents(spark, rows).repartition(3), path, PATH, frame_ids=512, file_docs=20)
    assert listed.count() > 3 and listed.agg({"documents": "sum"}).first()[0] == len(rows)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    # ascending ids, null ones last, gapless starts
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is None, i))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert all(len(r.ids) == 4 * r.n_tokens and r.frames == -(-r.n_tokens // 512) for r in got)
    assert sorted((str(r.doc_id), numbers(r.ids)) for r in got) == sorted((str(i), expected(t)) for i, t, *_ in rows)


def test_frames_are_any_readers(spark, tmp_path):
    """The file is the seekable format: plain zstandard decodes it, and the table describes it."""
    rows = [(i, prose(30 * i, i), "en", "a") for i in range(1, 30)]
    path = str(tmp_path / "out")
    token_files.write(documents(spark, rows).coalesce(1), path, PATH, frame_ids=256)
    name = token_files.manifest(spark, path).orderBy("number").first().file
    data = open(f"{path}/{name}", "rb").read()
    frames, flags, magic = struct.unpack("<IBI", data[-9:])
    assert (flags, magic) == (0x80, 0x8F92EAB1)
    table = [struct.unpack_from("<III", data, len(data) - 9 - 12 * (frames - i)) for i in range(frames)]
    at, out = 0, b""
    for packed, size, checksum in table[:-1]:
        frame = zstandard.ZstdDecompressor().decompress(data[at:at + packed])
        assert len(frame) == size and xxhash.xxh64_intdigest(frame) & 0xFFFFFFFF == checksum
        at, out = at + packed, out + frame
    assert struct.unpack_from("<I", data, at)[0] == 0x184D2A50 and table[-1][1] == 0
    documents_there = token_files.manifest(spark, path).orderBy("number").first().documents
    assert numbers(out) == [x for _, t, *_ in rows[:documents_there] for x in expected(t)]


def test_only_wanted_frames_are_read(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(i, prose(50, i), "en", "a") for i in range(40)] + [(None, "no id", "en", "a")]
    token_files.write(documents(spark, rows).coalesce(1), path, PATH)
    wanted = spark.createDataFrame([(3,), (3,), (39,), (77,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in token_files.fetch(spark, path, wanted).collect()}
    assert sorted(got) == [3, 39] and all(numbers(got[i].ids) == expected(prose(50, i)) for i in got)
    whole = {r.doc_id: r.start for r in token_files.read(spark, path).collect()}
    assert all(got[i].start == whole[i] for i in got)
    # damage every frame but those of document 3: it is still read
    for name in [r.file for r in token_files.manifest(spark, path).collect()]:
        reader = token_files.FileReader(f"{path}/{name}")
        data = bytearray(open(f"{path}/{name}", "rb").read())
        kept = np.flatnonzero(reader.ids == 3)
        begin, end = 0, 0
        if len(kept):
            f = int(reader.first[kept[0]])
            begin, end = int(reader.ends[f - 1]) if f else 0, int(reader.ends[f])
        for at in range(int(reader.ends[-2])):
            if not begin <= at < end:
                data[at] ^= 0x55
        open(f"{path}/{name}", "wb").write(data)
    again = token_files.fetch(spark, path, wanted.filter("doc_id = 3")).collect()
    assert [numbers(r.ids) for r in again] == [expected(prose(50, 3))]
    with pytest.raises(Exception, match="DamagedFile|ZstdError|zstd"):
        token_files.read(spark, path).collect()


def test_damage_is_named(tmp_path):
    path = f"{tmp_path}/one.zst"
    writer = token_files.FileWriter(path, level=1)
    writer.add(7, np.arange(1000))
    writer.close()
    assert numbers(token_files.FileReader(path).document(0)) == list(range(1000))
    data = bytearray(open(path, "rb").read())
    open(path, "wb").write(data[:-3])
    with pytest.raises(token_files.DamagedFile):
        token_files.FileReader(path)
    data[-9 - 12 * 2 + 8] ^= 1  # the first frame's checksum
    open(path, "wb").write(data)
    with pytest.raises(token_files.DamagedFile):
        token_files.FileReader(path).document(0)


def test_empty_and_repeated(spark, tmp_path):
    assert token_files.write(documents(spark, []), str(tmp_path / "a"), PATH).count() == 0
    assert token_files.read(spark, str(tmp_path / "a")).count() == 0
    same = [(5, "same words here", "en", "a")] * 300 + [(6, None, "en", "a")]
    token_files.write(documents(spark, same).repartition(4), str(tmp_path / "b"), PATH)
    got = token_files.read(spark, str(tmp_path / "b")).collect()
    assert len(got) == 301 and len({r.start for r in got}) == 301
    assert {numbers(r.ids) == expected("same words here") for r in got if r.doc_id == 5} == {True}


def test_a_million_blanks(spark, tmp_path):
    long = "\n " * 500000
    token_files.write(documents(spark, [(1, long, "en", "a"), (2, "b", "en", "a")]), str(tmp_path / "c"), PATH)
    got = {r.doc_id: r for r in token_files.read(spark, str(tmp_path / "c")).collect()}
    assert numbers(got[1].ids) == expected(long) and got[1].frames == -(-got[1].n_tokens // 65536)
