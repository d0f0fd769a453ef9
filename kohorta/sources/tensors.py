"""Ragged tensors of event cohorts: one safetensors file a shard beside a Parquet schema of its subjects.

``tokenization/schemas/<shard>.parquet`` has a row a subject, ``data/<shard>.nrt`` the tensors; row i of the schema
is subject i of the tensors.  A tensor ``dim1/<name>`` has one value an event and ``dim2/<name>`` one a measurement;
``dim1/bounds`` has the end of each subject's events, ``dim2/bounds`` the end of each event's measurements.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dataset import NotADatasetError, footers, literal, read_shards, shard_name, shard_paths, split_label

SCHEMAS, DATA, SUFFIX = "tokenization/schemas", "data", ".nrt"
# The format's names of types.
TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "u1", "BOOL": "?"}
PREFIX = struct.Struct("<Q")
EVENT_BOUNDS, MEASUREMENT_BOUNDS = "dim1/bounds", "dim2/bounds"


def tensor_header(path: str | Path) -> dict[str, dict]:
    """What the file says of each tensor; the tensors themselves are not read."""
    return _header(Path(path))[0]


def _header(path: Path) -> tuple[dict[str, dict], int]:
    """The tensors' descriptions, and where their bytes begin."""

    def bad(why: str) -> ValueError:
        return ValueError(f"{path} {why}")

    whole = path.stat().st_size
    if whole < PREFIX.size:
        raise bad(f"is too short for a safetensors file: {whole} bytes")
    with path.open("rb") as f:
        (length,) = PREFIX.unpack(f.read(PREFIX.size))
        begin = PREFIX.size + length
        if begin > whole:
            raise bad(f"is truncated: its header ends at byte {begin} of {whole}")
        text = f.read(length)
    try:
        described = json.loads(text)
    except ValueError:
        raise bad("has a header that is not JSON") from None
    if not isinstance(described, dict):
        raise bad("has a header that is not an object")
    described.pop("__metadata__", None)
    return described, begin


def tensor_length(header: Mapping[str, dict], key: str) -> int:
    """A tensor's first dimension; none, or a scalar, has length 0."""
    shape = header[key]["shape"] if key in header else []
    return int(shape[0]) if shape else 0


def read_tensors(path: str | Path) -> dict[str, np.ndarray]:
    path = Path(path)
    described, begin = _header(path)
    data = np.memmap(path, dtype=np.uint8, mode="r", offset=begin) if path.stat().st_size > begin else np.zeros(0, np.uint8)
    out = {}
    for name, about in described.items():
        first, end = about["data_offsets"]
        out[name] = data[first:end].view(TYPES[about["dtype"]]).reshape(about["shape"])
    return out


class Stored:
    """A tensor in a file: slices and places of its first dimension are read when they are asked for, and nothing is mapped or kept."""

    #: Bytes of a window that places are taken from.
    STEP = 8 << 20

    def __init__(self, file, begin: int, dtype: str, shape: list[int]):
        self.file, self.begin, self.dtype, self.shape = file, begin, np.dtype(dtype), tuple(shape)
        self.itemsize = self.dtype.itemsize
        self._row = self.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))

    def __len__(self) -> int:
        return self.shape[0] if self.shape else 0

    def __getitem__(self, which: slice | np.ndarray) -> np.ndarray:
        if isinstance(which, slice):
            first, end, _ = which.indices(len(self))
            data = os.pread(self.file.fileno(), max(0, end - first) * self._row, self.begin + first * self._row)
            return np.frombuffer(data, self.dtype).reshape(max(0, end - first), *self.shape[1:])
        order = np.argsort(which, kind="stable")
        ascending, out = which[order], np.empty((len(which), *self.shape[1:]), self.dtype)
        at, step = 0, max(1, self.STEP // max(1, self._row))
        while at < len(ascending):
            first = int(ascending[at])
            end = int(np.searchsorted(ascending, first + step))
            out[order[at:end]] = self[first : int(ascending[end - 1]) + 1][ascending[at:end] - first]
            at = end
        return out


def open_tensors(path: str | Path) -> dict[str, Stored]:
    """The tensors of a file, to be read in pieces."""
    path = Path(path)
    described, begin = _header(path)
    file = path.open("rb", buffering=0)  # closed with the last tensor
    return {name: Stored(file, begin + about["data_offsets"][0], TYPES[about["dtype"]], about["shape"]) for name, about in described.items()}


def write_tensors(path: str | Path, tensors: Mapping[str, np.ndarray]) -> None:
    about = {name: (values.dtype, list(values.shape)) for name, values in tensors.items()}
    stream_tensors(path, about, lambda name: iter([tensors[name]]))


def stream_tensors(path: str | Path, about: Mapping[str, tuple[np.dtype, list[int]]], parts: Callable[[str], Iterator[np.ndarray]]) -> None:
    """Writes tensors of known types and shapes from their parts, which are asked for one tensor after the other."""
    names = {np.dtype(v): k for k, v in TYPES.items()}
    described, at = {}, 0
    for name, (dtype, shape) in about.items():
        size = int(np.prod(shape, dtype=np.int64)) * dtype.itemsize
        described[name] = {"dtype": names[np.dtype(dtype)], "shape": shape, "data_offsets": [at, at + size]}
        at += size
    text = json.dumps(described).encode()
    text += b" " * (-len(text) % 8)
    with open(path, "wb") as f:
        f.write(PREFIX.pack(len(text)) + text)
        for name, (dtype, _) in about.items():
            for values in parts(name):
                f.write(np.ascontiguousarray(values, dtype=dtype).data)
        if f.tell() != len(text) + PREFIX.size + at:
            raise ValueError(f"the parts of {path} are not as long as their shapes")


def _edges(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the values of rows whose values end at ``ends``."""
    if not len(ends):
        return np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    first = np.where(rows > 0, ends[np.maximum(rows - 1, 0)], 0).astype(np.int64)
    return first, np.asarray(ends[rows], dtype=np.int64)


class Slice:
    """The chosen subjects of one file: ranges of its tensors' bytes.  Holds four numbers a subject; values are read when they are written."""

    #: Bytes of a tensor that are copied at a time.
    STEP = 8 << 20

    def __init__(self, tensors: Mapping[str, np.ndarray], rows: np.ndarray):
        self.tensors, self.rows = tensors, np.asarray(rows, dtype=np.int64)
        if EVENT_BOUNDS not in tensors and len(self.rows):
            raise ValueError("no subject has events in these tensors")
        events = _edges(self.tensors.get(EVENT_BOUNDS, np.zeros(0, np.int64)), self.rows)
        ends = self.tensors.get(MEASUREMENT_BOUNDS, np.zeros(0, np.int64))
        self.edges = {"dim1": events, "dim2": tuple(np.where(e > 0, ends[np.maximum(e - 1, 0)], 0).astype(np.int64) if len(ends) else np.zeros(len(e), np.int64) for e in events)}

    def length(self, name: str) -> int:
        if name == EVENT_BOUNDS:
            return len(self.rows)
        first, end = self.edges["dim1" if name == MEASUREMENT_BOUNDS else name.split("/")[0]]
        return int((end - first).sum())

    def parts(self, name: str, before: int) -> Iterator[np.ndarray]:
        """The values of a tensor, a bounded number at a time; bounds go on from ``before``."""
        if name == EVENT_BOUNDS:
            first, end = self.edges["dim1"]
            yield before + np.cumsum(end - first)
            return
        level = "dim1" if name == MEASUREMENT_BOUNDS else name.split("/")[0]
        values, (first, end) = self.tensors[name], self.edges[level]
        if name == MEASUREMENT_BOUNDS:  # each subject's ends go on from those of the subject before
            low, high = self.edges["dim2"]
            shift = before + np.r_[0, np.cumsum(high - low)[:-1]] - low
            for at, to, i in self._stretches(first, end, self._step(values)):
                yield np.asarray(values[at:to], dtype=np.int64) + shift[i]
            return
        for at, to, _ in self._stretches(first, end, self._step(values)):
            yield values[at:to]

    @staticmethod
    def _stretches(first: np.ndarray, end: np.ndarray, step: int) -> Iterator[tuple[int, int, int]]:
        """(first, end, a subject) of what is read at a time; neighbours are one range."""
        some = np.flatnonzero(end > first)
        if not len(some):
            return
        first, end = first[some], end[some]
        new = np.flatnonzero(np.r_[True, first[1:] != end[:-1]])
        for low, high, i in zip(first[new].tolist(), end[np.r_[new[1:] - 1, len(end) - 1]].tolist(), some[new].tolist(), strict=True):
            for at in range(low, high, step):
                yield at, min(high, at + step), i

    def _step(self, values: np.ndarray) -> int:
        return max(1, self.STEP // max(1, values.itemsize * int(np.prod(values.shape[1:], dtype=np.int64))))


def write_slices(path: str | Path, slices: list[Slice]) -> None:
    """One file of the slices' subjects in their order, whatever their number: no tensor is held as a whole."""
    lead = next((s.tensors for s in slices if s.tensors), {})
    for s in slices:
        if [(n, v.dtype, v.shape[1:]) for n, v in s.tensors.items()] != [(n, v.dtype, v.shape[1:]) for n, v in lead.items()]:
            raise ValueError(f"the tensors of the sources of {path} differ in names or types")
    about = {name: (v.dtype, [sum(s.length(name) for s in slices), *v.shape[1:]]) for name, v in lead.items()}

    def parts(name: str) -> Iterator[np.ndarray]:
        before = 0
        level = {EVENT_BOUNDS: "dim1", MEASUREMENT_BOUNDS: "dim2"}.get(name)
        for s in slices:
            yield from s.parts(name, before)
            if level:
                first, end = s.edges[level]
                before += int((end - first).sum())

    stream_tensors(path, about, parts)


def sliced(tensors: Mapping[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    """The tensors of the chosen subjects, in that order, as arrays: for cohorts that fit memory."""
    made = Slice(tensors, rows)
    return {name: np.concatenate([values[:0], *(np.asarray(p, dtype=values.dtype) for p in made.parts(name, 0))]) for name, values in tensors.items()}


# Spark's types of the format's types that it has.
SPARK_TYPES = {
    "F64": "double", "F32": "float", "F16": "float", "I64": "bigint", "I32": "int", "I16": "smallint", "I8": "tinyint", "U32": "bigint", "U16": "int", "U8": "smallint", "BOOL": "boolean",
}
ARROW_TYPES = {
    "double": pa.float64(), "float": pa.float32(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "boolean": pa.bool_(),
}
#: Values of a subject batch, about; subjects that a task reads.
BATCH_VALUES, TASK_SUBJECTS = 1 << 18, 1 << 15


def ragged_batches(path: str | Path, types: Mapping[str, str], limit: int = BATCH_VALUES, subjects: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """(row_index, values of each tensor) of the subjects of a file, or of a range of them, a batch of about ``limit`` values at a time.

    ``types``: the tensors' names and Spark types; a dim1 tensor is a list a subject, a dim2 tensor a list of lists.
    """
    tensors = open_tensors(path)
    ends = tensors.get(EVENT_BOUNDS, np.zeros(0, np.int64))
    inner = tensors.get(MEASUREMENT_BOUNDS)
    first, n = subjects or (0, len(ends))
    n = min(n, len(ends))
    event = int(ends[first - 1 : first][0]) if first else 0
    own, base = np.asarray(ends[first:n], dtype=np.int64), first
    while first < n:
        last = max(first + 1, base + int(np.searchsorted(own, event + max(1, limit // 4), side="right")))  # a few values an event
        bounds = np.r_[event, own[first - base : last - base]]
        columns = [pa.array(np.arange(first, last))]
        offsets = pa.array((bounds - event).astype(np.int32))
        if inner is not None:
            low = int(inner[event - 1 : event][0]) if event else 0
            cuts = np.r_[low, np.asarray(inner[event : bounds[-1]], dtype=np.int64)]
        for name, kind in types.items():
            level = name.split("/")[0]
            part = tensors[name][event : bounds[-1]] if level == "dim1" else tensors[name][cuts[0] : cuts[-1]]
            values = pa.array(np.asarray(part)).cast(ARROW_TYPES[kind])
            if level == "dim2":
                values = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), values)
            columns.append(pa.ListArray.from_arrays(offsets, values))
        yield pa.RecordBatch.from_arrays(columns, ["row_index", *(x.split("/", 1)[1] for x in types)])
        event, first = int(bounds[-1]), last


class TensorCohort:
    """A folder of schemas and tensors; splits are the parts of shards' names before the last."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)
        self.schemas = self.root / SCHEMAS
        self.paths = shard_paths(self.schemas)
        if not self.paths:
            raise NotADatasetError(f"no schemas of tensors in {self.schemas}")
        self.shards = [shard_name(self.schemas, p) for p in self.paths]

    def schema_path(self, shard: str) -> Path:
        return self.schemas / f"{shard}.parquet"

    def tensor_path(self, shard: str) -> Path:
        return self.root / DATA / f"{shard}{SUFFIX}"

    def headers(self) -> DataFrame:
        """(shard, n_tensors, n_events, n_dynamic, n_bytes) of every shard, from the tensors' headers alone."""
        rows = []
        for shard in self.shards:
            path = self.tensor_path(shard)
            if not path.is_file():
                raise FileNotFoundError(f"no tensors at {path} for the schema {self.schema_path(shard)}")
            rows.append((shard, str(path), self.schema_path(shard).stat().st_size + path.stat().st_size))
        listed = self.spark.createDataFrame(rows, "shard string, path string, n_bytes bigint")

        def read(frames):
            for frame in frames:
                found = [tensor_header(p) for p in frame["path"]]
                for column, key in (("n_tensors", EVENT_BOUNDS), ("n_events", "dim1/time_delta_days"), ("n_dynamic", "dim2/code")):
                    frame[column] = [tensor_length(h, key) for h in found]
                yield frame[["shard", "n_tensors", "n_events", "n_dynamic", "n_bytes"]]

        return listed.repartition("shard").mapInPandas(read, "shard string, n_tensors bigint, n_events bigint, n_dynamic bigint, n_bytes bigint")

    def rows(self) -> DataFrame:
        """(subject_id, static_code, shard, _row) of the schemas' rows; a row's place is the subject's place in the tensors."""
        for path, schema in zip(self.paths, footers(self.paths, self.spark), strict=True):
            kind = schema.field("static_code").type if "static_code" in schema.names else None
            if kind is None or not (pa.types.is_list(kind) or pa.types.is_large_list(kind)):
                raise ValueError(f"{path} is no schema of tensors: its static_code is {kind}, not a list")
        return read_shards(self.spark, self.schemas, self.paths, {"subject_id": "bigint", "static_code": "array<bigint>"}, places=True)

    def tensors(self) -> DataFrame:
        """(shard, row_index, and a column for each tensor but the bounds) of every subject: lists of its events' values, or of lists of their measurements'.

        A task reads a range of a shard's subjects, a bounded number at a time; all shards have the first one's tensors.
        """
        header = tensor_header(self.tensor_path(self.shards[0]))
        wanted = {n: a["dtype"] for n, a in header.items() if n not in (EVENT_BOUNDS, MEASUREMENT_BOUNDS)}
        if unknown := {n: t for n, t in wanted.items() if t not in SPARK_TYPES or n.split("/")[0] not in ("dim1", "dim2")}:
            raise ValueError(f"tensors that Spark has no type for: {unknown}")
        types = {n: SPARK_TYPES[t] for n, t in wanted.items()}
        ddl = ", ".join(f"`{n.split('/', 1)[1]}` " + ("array<%s>" if n.startswith("dim1") else "array<array<%s>>") % t for n, t in types.items())
        firsts = F.sequence(F.lit(0).cast("long"), F.col("n_tensors") - 1, F.lit(TASK_SUBJECTS).cast("long"))
        listed = self.headers().where("n_tensors > 0").select("shard", F.explode(firsts).alias("first"))
        data = self.root / DATA

        def read(batches):
            for batch in batches:
                for shard, first in zip(batch.column("shard").to_pylist(), batch.column("first").to_pylist(), strict=True):
                    for rows in ragged_batches(data / f"{shard}{SUFFIX}", types, subjects=(first, first + TASK_SUBJECTS)):
                        yield pa.RecordBatch.from_arrays([pa.array([shard] * rows.num_rows, pa.string()), *rows.columns], ["shard", *rows.schema.names])

        return listed.repartition(max(1, listed.count())).mapInArrow(read, f"shard string, row_index bigint, {ddl}")  # a task a range

    def codes(self) -> DataFrame:
        path = self.root / "metadata/codes.parquet"
        if not path.is_file():
            raise FileNotFoundError(f"no code metadata at {path}")
        found = self.spark.read.parquet(literal(path))
        if "code" not in found.columns:
            raise ValueError(f"{path} has no column 'code': {found.columns}")
        return found

    def locations(self) -> DataFrame:
        """(subject_id, shard, row_index); shards whose schema and tensors differ in height are an error, as are subjects in two places."""
        from ..operators.ragged import require_one_shard

        found = self.rows().select("subject_id", "shard", F.col("_row").alias("row_index"))
        heights = found.groupBy("shard").agg(F.count("*").alias("n_rows"))
        wrong = self.headers().join(heights, "shard", "left").where(F.coalesce("n_rows", F.lit(0)) != F.col("n_tensors")).limit(5).collect()
        if wrong:
            raise NotADatasetError("schemas and tensors differ in height: " + ", ".join(f"{r['shard']} ({r['n_rows']} and {r['n_tensors']})" for r in wrong))
        try:
            require_one_shard(found)
        except ValueError as e:
            raise NotADatasetError(str(e)) from None
        return found

    def splits(self) -> DataFrame:
        flat = [s for s in self.shards if "/" not in s]
        if flat:
            raise NotADatasetError(f"shards {flat[:5]} of {self.root} name no split")
        return self.locations().select("subject_id", split_label(F.col("shard")).alias("split")).distinct()
