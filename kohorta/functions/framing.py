"""Canonical text forms of values and rows, and digests of lists of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Fixed values of the digest format.
PREFIX, SEPARATOR, NULL_FRAME = "sha256:", "\x1f", "-1:"


@F.arrow_udf(T.StringType())
def double_bits(values: pa.Array) -> pa.Array:
    """The IEEE bits of doubles as unsigned decimals; null stays null, NaN and -0.0 keep their bits."""
    bits = pa.Array.from_buffers(pa.uint64(), len(values), values.buffers(), values.null_count, values.offset)
    return bits.cast(pa.string())


def framed(value: Column) -> Column:
    """``<bytes>:<value>``, and ``-1:`` for null."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit(NULL_FRAME))


def rendered(column: Column, kind: T.DataType, name: str) -> Column:
    """The canonical text of a value of type ``kind``."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return double_bits(column.cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("string")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.when(column.isNotNull(), F.concat_ws("", F.transform(column, framed)))
    if isinstance(kind, (T.IntegralType, T.StringType, T.BooleanType, T.DateType, T.NullType)):
        return column.cast("string")
    raise TypeError(f"column {name!r} of type {kind.simpleString()} has no canonical form")


def canonical_row(schema: T.StructType, names: list[str] | None = None) -> Column:
    """The row's fields ``name=<framed>`` in the order of their names, parted by 0x1F."""
    names = sorted(schema.names if names is None else names)
    if not names:
        raise ValueError("a row without columns has no canonical form")
    for name in names:
        if SEPARATOR in name or "=" in name:
            raise ValueError(f"column name {name!r} holds a reserved character")
    kinds = {f.name: f.dataType for f in schema}
    field = lambda n: F.concat(F.lit(f"{n}="), framed(rendered(F.col(f"`{n}`"), kinds[n], n)))
    return F.concat_ws(SEPARATOR, *[field(n) for n in names])


def digest(items: Column) -> Column:
    """The digest of an array of texts: SHA-256 over their frames."""
    return F.concat(F.lit(PREFIX), F.sha2(F.concat_ws("", F.transform(items, framed)), 256))


def combined(digests: Column) -> Column:
    """An aggregate: the digest of all digests in order; multiplicity counts, order doesn't.  For groups that fit an array."""
    return digest(F.sort_array(F.collect_list(digests)))


def text_digest(items: Iterable[str]) -> str:
    """The digest of texts that the driver holds."""
    made = sha256()
    for item in items:
        data = item.encode()
        made.update(f"{len(data)}:".encode() + data)
    return PREFIX + made.hexdigest()


def combined_ids(ids: dict[str, str]) -> str:
    """One id of named ids, in whatever order they come."""
    return text_digest(sorted(f"{name}={value}" for name, value in ids.items()))


def _frames(values: pa.Array) -> pa.Array:
    data = values.cast(pa.large_binary())
    size = pc.binary_length(data).cast(pa.large_string()).cast(pa.large_binary())
    return pc.binary_join_element_wise(size, data, pa.scalar(b":", pa.large_binary()))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, memoryview]]:
    """(key, frames end to end) of each stretch of rows with equal keys (the first columns) in a batch; the next column has the texts."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, dtype=bool)
        new[0] = True
        for column in batch.columns[:keys]:
            code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        frames = _frames(batch.column(keys))
        _, ends, data = frames.buffers()
        edges = np.frombuffer(ends, dtype=np.int64)[frames.offset : frames.offset + n + 1]
        starts = np.flatnonzero(new).tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        for first, end in zip(starts, [*starts[1:], n], strict=True):
            yield tuple(c[first].as_py() for c in batch.columns[:keys]), view[edges[first] : edges[end]]


#: Digests that a task gives back at a time; bytes of frames in a block.
ROWS_OUT, BLOCK = 1 << 14, 1 << 20


def _fold(batches: Iterator[pa.RecordBatch], into: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(group, digest) of rows (group, text) that come group by group in order; holds one batch."""
    now, made, began = None, sha256(), False
    groups: list = []
    done: list[str] = []

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(groups, kind), pa.array(done, pa.string())], ["group", into])
        groups.clear()
        done.clear()
        return rows

    for (group,), frames in _runs(batches, 1):
        if began and group != now:
            groups.append(now)
            done.append(PREFIX + made.hexdigest())
            made = sha256()
            if len(done) >= ROWS_OUT:
                yield out()
        now, began = group, True
        made.update(frames)
    if began:
        groups.append(now)
        done.append(PREFIX + made.hexdigest())
    yield out()


def _pack(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """(group, part, place, block) of rows (group, part, text) in order: the texts' frames in blocks of about ``limit`` bytes."""
    now, place, size = None, 0, 0
    held: list[bytes] = []

    def block() -> pa.RecordBatch:
        columns = [pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int32()), pa.array([place], pa.int32()), pa.array([b"".join(held)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["group", "part", "place", "block"])

    for key, frames in _runs(batches, 2):
        if held and (key != now or size >= limit):
            yield block()
            place, size = (place + 1, 0) if key == now else (0, 0)
            held.clear()
        now = key
        held.append(bytes(frames))
        size += len(frames)
    if held:
        yield block()


def _fold_blocks(batches: Iterator[pa.RecordBatch], into: str) -> Iterator[pa.RecordBatch]:
    """(group, digest) of rows (group, block) that come group by group in order; holds one batch of blocks."""
    digests: dict[str | None, object] = {}
    for batch in batches:
        for group, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            digests.setdefault(group, sha256()).update(block.as_buffer())
    yield pa.RecordBatch.from_arrays([pa.array(list(digests), pa.string()), pa.array([PREFIX + d.hexdigest() for d in digests.values()], pa.string())], ["group", into])


def by_digest(value: Column) -> Column:
    """The range, of 256, that a digest lies in: its first two digits."""
    return F.conv(F.substring(value, len(PREFIX) + 1, 2), 16, 10).cast("int")


def folded(rows: DataFrame, group: Column, value: Column, order: Column | None = None, into: str = "digest", part: Column | None = None) -> DataFrame:
    """(group, ``into``): the digest of each group's texts in the order of ``order``, or of the texts themselves.

    SHA-256 reads one text after the other, so a group is one task's.  ``part`` numbers ranges of ``order``, in its order:
    each range is then sorted and framed by itself, and the group's task gets blocks of a megabyte, orders those and streams
    them.  Without it the group's task sorts all its rows, with spilling, and holds one batch: for small groups.
    """
    keyed = rows.select(
        group.cast("string").alias("group"), (F.lit(0) if part is None else part).cast("int").alias("part"), value.alias("value"), (value if order is None else order).alias("order")
    )
    if part is None:
        ready = keyed.repartition("group").sortWithinPartitions("group", "order").select("group", "value")
        return ready.mapInArrow(lambda it: _fold(it, into, pa.string()), f"group string, {into} string")
    ranged = keyed.repartition("group", "part").sortWithinPartitions("group", "part", "order").select("group", "part", "value")
    blocks = ranged.mapInArrow(lambda it: _pack(it, BLOCK), "group string, part int, place int, block binary")
    ready = blocks.repartition("group").sortWithinPartitions("group", "part", "place").select("group", "block")
    return ready.mapInArrow(lambda it: _fold_blocks(it, into), f"group string, {into} string")


def folded_by(rows: DataFrame, group: str, value: str, into: str = "digest", dealt: bool = False) -> DataFrame:
    """(``group``, ``into``): the digest of each group's sorted texts, for many groups of any size; groups keep their type, a null is one.

    ``dealt``: every group's rows lie in one partition already.
    """
    kind = rows.schema[group].dataType
    keyed = rows.select(F.col(group).alias("group"), F.col(value).alias("value"))
    ready = (keyed if dealt else keyed.repartition("group")).sortWithinPartitions("group", "value")
    made = ready.mapInArrow(lambda it: _fold(it, into, to_arrow_type(kind)), f"group {kind.simpleString()}, {into} string")
    return made.select(F.col("group").alias(group), into)


def folded_whole(rows: DataFrame, value: Column, order: Column | None = None, into: str = "digest", part: Column | None = None) -> DataFrame:
    """One row: the digest of all rows' texts; that of no text if there are none."""
    made = folded(rows, F.lit(""), value, order, into, part).select(into)
    return made.agg(F.coalesce(F.max(into), F.lit(text_digest([]))).alias(into))


def short_id(value: Column, n: int = 16) -> Column:
    """The first ``n`` hex digits of a digest; others than digests raise."""
    if not 1 <= n <= 64:
        raise ValueError(f"n must be between 1 and 64; got {n}")
    bare = F.regexp_replace(value, f"^{PREFIX}", "")
    wrong = F.raise_error(F.concat(F.lit("not a digest: "), value))
    return F.when(value.isNull(), F.lit(None)).when(bare.rlike("^[0-9a-f]{64}$"), F.substring(bare, 1, n)).otherwise(wrong)
