"""Best-fit decreasing packing of documents' tokens into sequences.

Every document's ids are first cut into full windows; what is left over is a piece shorter than a window.
Pieces are dealt to shards by a hash of their document and place, and each shard packs its pieces in decreasing length,
each into the open sequence with the least room that still holds it.  A segment tree over the possible rooms
(0 to ``window``) finds that room in as many steps as the tree is high.  A sequence's used length is padded
to the window unless it is a power of two.

Defined results: null and empty texts have the end id alone; repeated rows are documents of their own;
shards, and with them the sequence ids, depend on the rows only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices, small_batches, stored
from .tokenizing import encoder

WINDOW = 2048
#: Pieces a shard is meant to have.
PIECES_PER_SHARD = 200_000


class Rooms:
    """A segment tree over rooms: how many open sequences have each, and the least room of at least x."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _set(self, room: int, has: int) -> None:
        i = room + self.size
        while i and self.tree[i] != has:
            self.tree[i] = has
            i >>= 1
            if i:
                has = self.tree[2 * i] | self.tree[2 * i + 1]

    def put(self, room: int, sequence: int) -> None:
        if not self.open[room]:
            self._set(room, 1)
        self.open[room].append(sequence)

    def take(self, least: int) -> tuple[int, int] | None:
        """The (room, sequence) with the least room of at least ``least``, taken out."""
        i = least + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        sequence = self.open[room].pop()
        if not self.open[room]:
            self._set(room, 0)
        return room, sequence


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(sequence, offset) of each of the pieces, which come in decreasing length."""
    rooms, out, n = Rooms(window), [], 0
    for length in lengths:
        found = rooms.take(length)
        if found is None:
            room, sequence, n = window, n, n + 1
        else:
            room, sequence = found
        out.append((sequence, window - room))
        if room > length:
            rooms.put(room - length, sequence)
    return out


@frugal
def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int) -> Iterator[pa.RecordBatch]:
    made = encoder(path)
    for batch in slices(batches, "text", 1 << 22):
        rows: dict[str, list] = {n: [] for n in ("row", "start", "length", "crc", "total")}
        for row, ids in enumerate(made.ids(batch.column("text"))):
            total = len(ids) // 4
            for start in range(0, total, window):
                piece = ids[4 * start : 4 * (start + window)]
                for name, value in zip(rows, (row, start, len(piece) // 4, zlib.crc32(piece), total), strict=True):
                    rows[name].append(value)
        keys = batch.column("id").take(pa.array(rows["row"], pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, *[pa.array(rows[n], pa.int64()) for n in ("start", "length", "crc", "total")]], ["id", "start", "length", "crc", "total"])


def _pack(key, table: pa.Table, window: int) -> pa.Table:
    shard = key[0].as_py()
    table = table.sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending"), ("crc", "ascending")])
    placed = np.array(best_fit(table["length"].to_pylist(), window), dtype=np.int64).reshape(-1, 2)
    return table.drop_columns(["shard"]).append_column("sequence", pa.array((shard << 40) + placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))


def packed(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", window: int = WINDOW, shards: int | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    ``shards``: how many shards pack on their own; by default one for every ``PIECES_PER_SHARD`` pieces, but
    eight at least.  The pieces are stored first, without their ids, so that they are cut once and counted.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    pieces = stored(made.mapInArrow(lambda it: _pieces(it, tokenizer, window), f"id {kind}, start bigint, length bigint, crc bigint, total bigint"), "pieces")
    if shards is None:
        shards = max(8, -(-pieces.count() // PIECES_PER_SHARD))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "start", "crc", "total"), F.lit(shards)))
    out = dealt.groupBy("shard").applyInArrow(
        lambda k, t: _pack(k, t, window), f"id {kind}, start bigint, length bigint, crc bigint, total bigint, sequence bigint, offset bigint"
    )
    return out.select(
        F.col("id").alias(key), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset"
    )


def padded_length(used: int, window: int = WINDOW) -> int:
    return used if used & (used - 1) == 0 else window
