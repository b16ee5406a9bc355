"""Token ids in files of independent zstandard frames, read back one document at a time.

A file is in Zstandard's public seekable format, so any zstandard reader decodes it to the
ids of its documents, one after another, as little-endian unsigned 32-bit numbers:

* data frames, each compressed for itself. A document begins a frame; one of over
  ``FRAME_IDS`` ids takes several. So a reader decompresses the documents it wants alone.
* a skippable frame with the file's index: id and count of ids of every document.
* a skippable frame with the seek table: compressed size, size and checksum (the low half of
  XXH64) of every frame, then its footer.

Documents are dealt to tasks by ranges of their id, sorted, and written file by file, so the
files by name hold all documents in ascending order. A file is written under a name of its
attempt and renamed when whole: a task that runs again replaces it by the same bytes. What is
there is what the manifest lists, a table of one row per file.
"""

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazecast.llm.common import arrow_map
from hazecast.llm.packing import Encoder

END_ID = 0
FRAME_IDS = 65536
FILE_BYTES = 64 << 20
FILE_DOCS = 1 << 20
# fixed values of the seekable format
SEEK_MAGIC, SEEKABLE, INDEX_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50, 0x80

MANIFEST = "number long, file string, documents long, tokens long, bytes long"
FOUND = "doc_id long, start long, n_tokens long, ids binary, frames int"


class DamagedFile(ValueError):
    """A file that ends early, or a frame that is not what its checksum says."""


def _opened(uri: str):
    """File system and path of a uri or a path; whatever pyarrow can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """One file: documents in, frames out; holds one frame and 17 bytes a document."""

    def __init__(self, uri: str, frame_ids: int = FRAME_IDS, level: int = 3):
        import zstandard

        self.system, self.path = _opened(uri)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.attempt = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.system.open_output_stream(self.attempt)
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frame_bytes, self.bytes, self.tokens = 4 * frame_ids, 0, 0
        self.ids, self.named, self.counts, self.table = [], bytearray(), [], []

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.bytes += len(packed)
        self.table.append(struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """``ids`` is never empty: each document has its end id."""
        data = ids.astype("<u4").tobytes()
        for at in range(0, len(data), self.frame_bytes):
            self._frame(data[at:at + self.frame_bytes])
        self.ids.append(doc_id or 0)
        self.named.append(doc_id is not None)
        self.counts.append(len(ids))
        self.tokens += len(ids)

    def close(self) -> tuple[int, int, int]:
        """Documents, tokens and bytes of the file, which now has its name."""
        index = struct.pack("<QQ", len(self.ids), self.frame_bytes) + np.array(self.ids, "<i8").tobytes() \
            + np.array(self.counts, "<u8").tobytes() + bytes(self.named)
        index = self.compressor.compress(index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        # the index is listed as a frame that holds no data
        self.table.append(struct.pack("<III", len(index) + 8, 0, 0))
        table = b"".join(self.table) + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.bytes += len(index) + 8 + len(table) + 8
        self.out.close()
        self.system.move(self.attempt, self.path)
        return len(self.ids), self.tokens, self.bytes


class FileReader:
    """Seek table and index of a file; frames are read and decompressed when asked for."""

    def __init__(self, uri: str):
        import zstandard

        system, path = _opened(uri)
        self.uri, self.file = uri, system.open_input_file(path)
        self.decompressor = zstandard.ZstdDecompressor()
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9)) if size >= 9 else (0, 0, 0)
        if magic != SEEKABLE or not flags & HAS_CHECKSUMS:
            raise DamagedFile(f"{uri}: no seek table")
        table = np.frombuffer(self._read(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3)
        self.ends = np.cumsum(table[:, 0], dtype=np.int64)
        self.sizes, self.checksums = table[:, 1], table[:, 2]
        start = int(self.ends[-2]) if frames > 1 else 0
        index = self.decompressor.decompress(self._read(start + 8, int(table[-1, 0]) - 8))
        n, self.frame_bytes = struct.unpack_from("<QQ", index)
        self.ids = np.frombuffer(index, "<i8", n, 16)
        self.counts = np.frombuffer(index, "<u8", n, 16 + 8 * n).astype(np.int64)
        self.named = np.frombuffer(index, "u1", n, 16 + 16 * n).astype(bool)
        self.starts = np.cumsum(self.counts) - self.counts
        frames_each = -(-4 * self.counts // self.frame_bytes)
        self.first = np.cumsum(frames_each) - frames_each
        self.frames = frames_each

    def _read(self, at: int, n: int) -> bytes:
        if at < 0:
            raise DamagedFile(f"{self.uri}: too short")
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise DamagedFile(f"{self.uri}: {len(data)} of {n} bytes at {at}")
        return data

    def document(self, place: int) -> bytes:
        """The ids of one document; its frames alone are read, and checked."""
        import xxhash

        first, n = int(self.first[place]), int(self.frames[place])
        begin = int(self.ends[first - 1]) if first else 0
        packed, out = self._read(begin, int(self.ends[first + n - 1]) - begin), []
        for f in range(first, first + n):
            here = packed[(int(self.ends[f - 1]) if f else 0) - begin:int(self.ends[f]) - begin]
            data = self.decompressor.decompress(here, max_output_size=int(self.sizes[f]))
            if len(data) != self.sizes[f] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checksums[f]:
                raise DamagedFile(f"{self.uri}: frame {f} is not what was written")
            out.append(data)
        return out[0] if n == 1 else b"".join(out)

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, frame_ids: int = FRAME_IDS,
          file_bytes: int = FILE_BYTES, file_docs: int = FILE_DOCS,
          id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write all documents in ascending order of id; returns the manifest, which is stored too.

    A null text is empty, and an empty text is the end id alone. Null ids come last. Rows of
    one id follow one another by a hash of their text, each as a document; ranges are cut by
    id, hash and a row number, so neither an id nor a row that a third of all rows share makes
    one task's work. A text is encoded whole, some 50 bytes of memory a character. A table
    without rows gives a manifest without rows. Other columns are left out. ``path`` is a new
    folder that executors share.
    """
    def files(batches):
        encoder, task = Encoder(tokenizer), TaskContext.get().partitionId()
        writer, made = None, 0

        def done():
            return pa.RecordBatch.from_pydict(
                {"number": [task << 24 | made], "file": [name], **dict(zip(
                    ("documents", "tokens", "bytes"), ([n] for n in writer.close())))},
                pa.schema([("number", pa.int64()), ("file", pa.string()), ("documents", pa.int64()),
                           ("tokens", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    name = f"data/part-{task:06d}-{made:06d}.zst"
                    writer = FileWriter(f"{path}/{name}", frame_ids)
                writer.add(doc, np.array([*encoder.ids(text or ""), end_id], dtype="<u4"))
                if writer.bytes >= file_bytes or len(writer.ids) >= file_docs:
                    yield done()
                    writer, made = None, made + 1
        if writer is not None:
            yield done()

    keyed = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"),
                        F.xxhash64(text_column).alias("digest"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_last(), F.col("digest")]
    dealt = keyed.repartitionByRange(*order, F.col("row")).sortWithinPartitions(*order).select("id", "text")
    arrow_map(dealt, files, MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(docs.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, with ``before``: the ids in all files ahead of it."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # one row per file of up to FILE_BYTES: small whatever the corpus
    ahead = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("tokens").over(ahead), F.lit(0).cast("long")))


def _documents(path: str, files: list[str], before: list[int], places: list, with_ids: bool):
    """Batches of documents: all of a file, or those at ``places``."""
    names = [f.split(" ")[0] for f in FOUND.split(", ")]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids", pa.binary()), ("frames", pa.int32())])
    for name, ahead, chosen in zip(files, before, places):
        reader, rows, held = FileReader(f"{path}/{name}"), [], 0
        try:
            for p in range(len(reader.ids)) if chosen is None else chosen:
                ids = reader.document(p) if with_ids else None
                rows.append((int(reader.ids[p]) if reader.named[p] else None, ahead + int(reader.starts[p]),
                             int(reader.counts[p]), ids, int(reader.frames[p])))
                held += len(ids or b"") + 64
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))), schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))), schema)
        finally:
            reader.close()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, frames) of every document, from the files.

    ``start`` counts the ids of all documents before it. Each frame is checked.
    """
    def whole(batches):
        for b in batches:
            files = b.column(0).to_pylist()
            yield from _documents(path, files, b.column(1).to_pylist(), [None] * len(files), True)

    listed = manifest(spark, path).select("file", "before")
    return listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(whole, FOUND)


def located(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, before, place) of every document: indexes are read, no data frame is."""
    schema = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("before", pa.int64()), ("place", pa.int64())])

    def indexes(batches):
        for b in batches:
            for name, ahead in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader = FileReader(f"{path}/{name}")
                reader.close()
                n = len(reader.ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.ids, mask=~reader.named), pa.array([name] * n, pa.string()),
                     pa.array(np.full(n, ahead), pa.int64()), pa.array(np.arange(n), pa.int64())], schema=schema)

    listed = manifest(spark, path).select("file", "before")
    return listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(
        indexes, "doc_id long, file string, before long, place long")


def fetch(spark: SparkSession, path: str, wanted: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Like ``read`` for the documents whose id is in ``wanted``: only their frames are decompressed.

    Ids asked for twice answer once; unknown and null ids have no answer.
    """
    def chosen(batches):
        name, ahead, places = None, 0, []
        for b in batches:
            for f, a, p in zip(*(b.column(c).to_pylist() for c in range(3))):
                if f != name and places:
                    yield from _documents(path, [name], [ahead], [places], True)
                    places = []
                name, ahead = f, a
                places.append(p)
        if places:
            yield from _documents(path, [name], [ahead], [places], True)

    asked = wanted.select(F.col(id_column).cast("long").alias("doc_id")).distinct()
    places = located(spark, path).join(asked, "doc_id", "left_semi").select("file", "before", "place")
    return places.repartition("file").sortWithinPartitions("file", "place").mapInArrow(chosen, FOUND)
