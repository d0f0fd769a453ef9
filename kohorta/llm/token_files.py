"""Token ids in binary files: one zstandard dictionary for all documents, which are compressed one by one.

A store is a folder::

    dictionary.bin          the dictionary, trained on serialized id arrays of a bounded sample of documents
    part-<number>-<name>    the documents of one range of ids, in ascending order, and their offset index

A part holds, all little-endian: the magic ``KTOK1``; the documents' frames end to end; the index, 32 bytes a
document (document id, first byte, first id within the part, ids); the footer, 72 bytes: the number of
documents, the index's place, the ids in the part, the dictionary's SHA-256 and the magic again with padding.
A short document is read with one range read once its part's index is known.  Ids are stored as unsigned
16-bit integers where all of a document fit, else as 32-bit ones (the frame's first byte says which).

A part is written under a name of its own by each attempt of a task; the rows that tasks return name the
files that count, and the manifest is made of those, so lost executors and repeated attempts do no harm.
Within a part of at most ``PART_BYTES`` or so, memory is bounded by one frame and the index.

Defined results: null and empty texts hold the end id alone; repeated ids keep one entry a row; null ids come
first, stored as the least integer.  Ids are whole numbers, or texts of them: others raise.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, frugal, shared_path, slices, small_batches, stored
from .tokenizing import encoder

MAGIC = b"KTOK1\0\0\0"
#: Documents that the dictionary is trained on, at most, and bytes of each that count.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 4096, 64 * 1024
PART_BYTES = 64 << 20
LEVEL = 3
#: Stands for null in files.
NULL_ID = -(2**63)
INDEX = np.dtype([("doc", "<i8"), ("first", "<u8"), ("start", "<u8"), ("n", "<u8")])
FOOTER = struct.Struct("<QQQ32s8s8x")


def serialize(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, dtype="<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\x04" + ids


def deserialize(data: bytes) -> bytes:
    return np.frombuffer(data, dtype="<u2", offset=1).astype("<u4").tobytes() if data[:1] == b"\x02" else data[1:]


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary, or an empty one where there is too little to learn from."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


class Codec:
    def __init__(self, dictionary: bytes):
        import zstandard

        self.hash = hashlib.sha256(dictionary).digest()
        found = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self._compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=False, **found)
        self._decompress = zstandard.ZstdDecompressor(**found)

    def encode(self, ids: bytes) -> bytes:
        return self._compress.compress(serialize(ids))

    def decode(self, frame: bytes) -> bytes:
        return deserialize(self._decompress.decompress(frame))


def read_bytes(uri: str, start: int = 0, size: int | None = None) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        total = f.size()
        start = max(0, total + start) if start < 0 else start
        return f.read_at(total - start if size is None else size, start)


def write_bytes(uri: str, data: bytes) -> None:
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(data)


class Part:
    """Random access to one part file."""

    def __init__(self, uri: str, codec: Codec):
        fs, path = file_system(uri)
        self.file, self.codec = fs.open_input_file(path), codec
        size = self.file.size()
        n, at, self.n_ids, digest, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        if digest != codec.hash:
            raise ValueError(f"another dictionary than that of {uri}")
        self.index = np.frombuffer(self.file.read_at(n * INDEX.itemsize, at), dtype=INDEX)
        self.ends = np.r_[self.index["first"][1:], at].astype(np.int64)

    def __enter__(self) -> Part:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def ids(self, place: int) -> bytes:
        first = int(self.index["first"][place])
        return self.codec.decode(self.file.read_at(int(self.ends[place]) - first, first))

    def find(self, doc: int) -> Iterator[bytes]:
        for place in range(*np.searchsorted(self.index["doc"], [doc, doc + 1])):
            yield self.ids(place)


class _Writer:
    def __init__(self, folder: str, name: str, codec: Codec):
        self.uri = f"{folder}/part-{name}-{uuid.uuid4().hex}"
        fs, path = file_system(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.codec, self.rows, self.at, self.n_ids = fs.open_output_stream(path, compression=None), codec, [], len(MAGIC), 0
        self.out.write(MAGIC)

    def add(self, doc: int, n: int, frame: bytes) -> None:
        self.rows.append((doc, self.at, self.n_ids, n))
        self.out.write(frame)
        self.at += len(frame)
        self.n_ids += n

    def close(self) -> tuple:
        self.out.write(np.array(self.rows, dtype=INDEX).tobytes())
        self.out.write(FOOTER.pack(len(self.rows), self.at, self.n_ids, self.codec.hash, MAGIC))
        self.out.close()
        return self.uri, self.rows[0][0], self.rows[-1][0], len(self.rows), self.n_ids


@frugal
def _encode(batches: Iterator[pa.RecordBatch], path: str, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    made, codec = encoder(path), Codec(dictionary)
    for batch in slices(batches, "text", 1 << 22):
        ids = made.ids(batch.column("text"))
        frames = [codec.encode(x) for x in ids]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(frames, pa.binary())], ["id", "n", "frame"])


@frugal
def _write(batches: Iterator[pa.RecordBatch], folder: str, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    codec, writer, made, part = Codec(dictionary), None, [], ""
    for batch in batches:
        for doc, n, frame, own in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "frame", "part")), strict=True):
            if writer and writer.at > PART_BYTES:
                made.append((*writer.close(), own, len(made)))
                writer = None
            if writer is None:
                writer = _Writer(folder, f"{own:05d}-{len(made):03d}", codec)
            writer.add(doc, n, frame)
            part = own
    if writer:
        made.append((*writer.close(), part, len(made)))
    names = ("uri", "low", "high", "docs", "ids", "part", "place")
    columns = list(zip(*made, strict=True)) if made else [[] for _ in names]
    types = (pa.string(), *[pa.int64()] * 6)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], list(names))


def _sample(docs: DataFrame, tokenizer: str) -> list[bytes]:
    chosen = docs.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).distinct()
    some = docs.select("id", F.substring("text", 1, SAMPLE_BYTES).alias("text")).join(F.broadcast(chosen), "id").limit(SAMPLE_DOCS)
    ids = encoder(tokenizer).ids(sorted(r["text"] for r in some.collect()))  # both are bounded by SAMPLE_DOCS
    return [serialize(x)[:SAMPLE_BYTES] for x in ids]


def write_store(docs: DataFrame, tokenizer: str, folder: str, text: str = "text", key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Writes the store; returns its manifest: (uri, low, high, docs, ids, part, place, start) of each file."""
    spark = docs.sparkSession
    small_batches(spark)
    made = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    dictionary = train(_sample(made.where(F.length("text") > 0), tokenizer))
    write_bytes(f"{folder}/dictionary.bin", dictionary)
    frames = stored(made.mapInArrow(lambda it: _encode(it, tokenizer, dictionary), "id bigint, n bigint, frame binary"), "frames")
    dealt = frames.repartitionByRange(partitions, "id") if partitions else frames.repartitionByRange("id")
    ordered = dealt.sortWithinPartitions("id", "n", "frame").withColumn("part", F.spark_partition_id())
    files = ordered.mapInArrow(lambda it: _write(it, folder, dictionary), "uri string, low bigint, high bigint, docs bigint, ids bigint, part bigint, place bigint")
    path = f"{folder}-manifest"
    files.write.parquet(path)
    found = spark.read.parquet(path)  # one row a file: a few thousand at most
    before = F.sum("ids").over(Window.orderBy("low", "part", "place").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("start", F.coalesce(before, F.lit(0)))


@frugal
def _read(batches: Iterator[pa.RecordBatch], dictionary_uri: str) -> Iterator[pa.RecordBatch]:
    codec = Codec(read_bytes(dictionary_uri))
    for batch in batches:
        for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with Part(uri, codec) as part:
                for first in range(0, len(part.index), 2000):
                    some = part.index[first : first + 2000]
                    crc = [zlib.crc32(part.ids(first + i)) for i in range(len(some))]
                    columns = [some["doc"].astype(np.int64), some["start"].astype(np.int64) + start, some["n"].astype(np.int64), np.array(crc, dtype=np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_store(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of a manifest."""
    spread = files.select("uri", "start").repartition("uri")
    return spread.mapInArrow(lambda it: _read(it, f"{folder}/dictionary.bin"), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_document(spark: SparkSession, files: DataFrame, folder: str, doc: int) -> list[list[int]]:
    """The ids of one document (of each row that had its id): an index read and one range read."""
    codec = Codec(read_bytes(f"{folder}/dictionary.bin"))
    out = []
    for r in files.where((F.col("low") <= doc) & (F.col("high") >= doc)).select("uri").collect():
        with Part(r["uri"], codec) as part:
            out += [np.frombuffer(x, dtype="<u4").tolist() for x in part.find(doc)]
    return out


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What ``read_store`` gives of a store of ``docs``; null ids are null again."""
    folder = shared_path(docs.sparkSession, "tokens")
    found = read_store(write_store(docs, tokenizer, folder, text, key), folder)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
