"""Event datasets in folders: shards under ``data/``, splits and codes under ``metadata/``.

Folders are listed on the driver and must be seen by executors under the same paths.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.framing import text_digest

SPLITS_FILE, CODES_FILE, DATASET_FILE = "metadata/subject_splits.parquet", "metadata/codes.parquet", "metadata/dataset.json"
#: Types that a size report reads its columns as, whatever width a file has them in.
SIZED = {"subject_id": "bigint", "time": "timestamp_ntz", "code": "string"}
#: Footers that a process reads at the same time, that the driver or a task reads, and that are kept.
READERS, DRIVER_FOOTERS, KEPT_FOOTERS = 32, 128, 1_000_000


class NotADatasetError(ValueError):
    """The folder holds no dataset of this kind."""


def hidden(name: str) -> bool:
    return any(p.startswith(".") for p in name.split("/"))


def shard_paths(folder: Path) -> list[Path]:
    """All Parquet files below a folder, sorted; names with a leading dot are skipped, a dangling link is an error."""
    out = []
    for path in sorted(folder.rglob("*.parquet")) if folder.is_dir() else []:
        if hidden(path.relative_to(folder).as_posix()) or path.is_dir():
            continue
        if not path.exists():
            raise FileNotFoundError(f"dangling link: {path}")
        out.append(path)
    return out


def shard_name(folder: Path, path: Path) -> str:
    return path.relative_to(folder).with_suffix("").as_posix()


def split_of(name: str) -> str:
    """The first part of a shard's name."""
    return name.split("/", 1)[0] if "/" in name else "__all__"


def split_label(shard: Column) -> Column:
    """All of a shard's name but its last part, as split labels may nest."""
    return F.regexp_replace(shard, "/[^/]*$", "")


def literal(path: Path | str) -> str:
    """The path with the characters that Spark would expand escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", str(path))


def _footer(path: str) -> tuple[pa.Schema | None, str]:
    """The file's schema without columns of the null type only, which other files type; or what is wrong with it."""
    found = pq.read_schema(path)
    for f in found:
        if pa.types.is_timestamp(f.type) and f.type.unit == "ns":
            return None, f"{path}: column {f.name!r} has nanoseconds, which Spark can't read"
    return pa.schema([f for f in found if not pa.types.is_null(f.type)]), ""


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("path").to_pylist()
        with ThreadPoolExecutor(READERS) as pool:
            found = list(pool.map(_footer, paths))
        texts = [None if s is None else s.remove_metadata().serialize().to_pybytes() for s, _ in found]
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts, pa.binary()), pa.array([e for _, e in found])], ["path", "schema", "error"])


_known: dict[tuple[str, int, int], pa.Schema] = {}


def footers(paths: list[Path], spark: SparkSession | None = None) -> list[pa.Schema]:
    """The files' schemas, read once for each path, size and time: few by the driver, many in a job."""
    keys = [(str(p), stat.st_size, stat.st_mtime_ns) for p in paths for stat in (p.stat(),)]
    unread = [k for k in dict.fromkeys(keys) if k not in _known]
    if len(_known) + len(unread) > KEPT_FOOTERS:
        _known.clear()
        unread = list(dict.fromkeys(keys))
    by_path = {k[0]: k for k in unread}
    if spark is None or len(unread) <= DRIVER_FOOTERS:
        with ThreadPoolExecutor(READERS) as pool:
            found = zip(by_path, pool.map(_footer, by_path), strict=True)
            made = [(path, schema, error) for path, (schema, error) in found]
    else:
        listed = spark.createDataFrame([(p,) for p in by_path], "path string").repartition(-(-len(by_path) // DRIVER_FOOTERS))
        rows = listed.mapInArrow(_footers, "path string, schema binary, error string")
        each = rows.groupBy("schema", "error").agg(F.collect_list("path").alias("paths")).collect()  # a row a schema; the driver listed the paths
        made = [(p, pa.ipc.read_schema(pa.py_buffer(bytes(r["schema"]))) if r["schema"] is not None else None, r["error"]) for r in each for p in r["paths"]]
    for path, schema, error in made:
        if error:
            raise ValueError(error)
        _known[by_path[path]] = schema
    return [_known[k] for k in keys]


def pinned_schema(paths: list[Path], found: list[pa.Schema] | None = None) -> dict[str, pa.DataType]:
    """The union of the files' columns in first-seen order; a type conflict is an error."""
    if not paths:
        raise ValueError("no files to take a schema from")
    out: dict[str, pa.DataType] = {}
    for path, schema in zip(paths, found or footers(paths), strict=True):
        for f in schema:
            kind = f.type.value_type if pa.types.is_dictionary(f.type) else f.type
            kind = pa.string() if pa.types.is_large_string(kind) else kind
            if out.setdefault(f.name, kind) != kind:
                raise ValueError(f"{path}: column {f.name!r} is {kind}, and {out[f.name]} elsewhere")
    return out


def _shown(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of the files named in the batches, with the file's path and the rows' places."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            place = 0
            for rows in pq.ParquetFile(path).iter_batches(1 << 16, columns=schema.names[:-2]):
                n = rows.num_rows
                columns = [rows.column(f.name).cast(f.type) for f in list(schema)[:-2]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([path] * n, pa.string()), pa.array(range(place, place + n), pa.int64())], schema=schema)
                place += n


def below(path: Column, prefix: str, slow: Column) -> Column:
    """The shard's name from a file's escaped path: what follows ``prefix``, without its suffix; ``slow`` where that needs more than a cut.

    Every row has its file's path, so decoding and patterns are kept for paths that need them.  An empty authority is
    written as ``//`` or left out.
    """
    made = slow
    for start in {prefix, prefix.replace(":///", ":/", 1)}:
        rest = F.substring(path, F.lit(len(start) + 1), F.length(path) - F.lit(len(start) + len(".parquet")))
        made = F.when(path.startswith(start) & path.endswith(".parquet") & ~path.contains("%"), rest).otherwise(made)
    return made


def _scan(spark: SparkSession, paths: list[Path], schema: pa.Schema, prefix: str, shard: Callable[[Column], Column]) -> DataFrame:
    """The rows of files of one schema, and the columns shard and _row: the file's name and the place in it."""
    seen = [p for p in paths if not p.name.startswith("_")]
    out = None
    if seen:
        raw = F.col("_metadata.file_path")
        path = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))  # a plus is a plus in paths
        out = spark.read.parquet(*map(literal, seen)).select(*[F.col(f"`{n}`") for n in schema.names], below(raw, prefix, shard(path)).alias("shard"), F.col("_metadata.row_index").alias("_row"))
    if rest := [p for p in paths if p.name.startswith("_")]:  # Spark doesn't read them, so Arrow does
        plain = lambda t: t.value_type if pa.types.is_dictionary(t) else t
        full = pa.schema([pa.field(f.name, plain(f.type)) for f in schema] + [pa.field("_path", pa.string()), pa.field("_row", pa.int64())])
        named = spark.createDataFrame([(str(p),) for p in rest], "path string").repartition(len(rest))
        made = named.mapInArrow(lambda it: _shown(it, full), from_arrow_schema(full, prefer_timestamp_ntz=True))
        made = made.select(*[F.col(f"`{n}`") for n in schema.names], shard(F.col("_path")).alias("shard"), "_row")
        out = made if out is None else out.unionByName(made)
    return out


def read_shards(spark: SparkSession, folder: Path, paths: list[Path], columns: dict[str, str] | None = None, places: bool = False) -> DataFrame:
    """The shards' rows and their shard's name: the union of the columns in first-seen order, missing ones null.

    ``columns``: read these alone, each cast to its type (others are ignored, missing ones null), so that
    files that differ in width go together; without it a type conflict is an error.  ``places``: with the
    column _row, the row's place in its file.
    """
    if not paths:
        raise ValueError(f"no shards in {folder}")
    found = footers(paths, spark)
    names = list(columns) if columns is not None else list(pinned_schema(paths, found))
    groups: dict[tuple, list[Path]] = {}
    schemas: dict[tuple, pa.Schema] = {}
    for path, schema in zip(paths, found, strict=True):
        own = [f for f in schema if f.name in names]
        key = tuple((f.name, str(f.type)) for f in own)
        groups.setdefault(key, []).append(path)
        schemas.setdefault(key, pa.schema(own))

    def shard(path: Column) -> Column:
        found = F.regexp_replace(F.regexp_replace(path, "^.*?" + re.escape(folder.resolve().as_posix()) + "/", ""), r"\.parquet$", "")
        return found if folder.resolve() == folder else F.regexp_replace(found, "^.*?" + re.escape(folder.as_posix()) + "/", "")

    out = None
    for key, files in groups.items():
        made = _scan(spark, files, schemas[key], folder.absolute().as_uri() + "/", shard)
        kept = [F.col(f"`{n}`").cast(columns[n]).alias(n) if columns else F.col(f"`{n}`") for n, _ in key]
        made = made.select(*kept, "shard", "_row")
        out = made if out is None else out.unionByName(made, allowMissingColumns=True)
    for n in names:
        if n not in out.columns:
            out = out.withColumn(n, F.lit(None).cast(columns[n]))
    return out.select(*[F.col(f"`{n}`") for n in names], "shard", *(["_row"] if places else []))


class EventDataset:
    """A dataset folder; everything but the listing is lazy."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)
        self.data = self.root / "data"
        self.paths = shard_paths(self.data)
        if not self.paths:
            raise NotADatasetError(f"{root} has no shards under data/")

    def events(self, places: bool = False) -> DataFrame:
        return read_shards(self.spark, self.data, self.paths, places=places)

    def sized_events(self) -> DataFrame:
        """The columns that sizes depend on, of shards of any width."""
        return read_shards(self.spark, self.data, self.paths, SIZED)

    def subject_shards(self) -> DataFrame:
        """(subject_id, shard) of every subject and shard that has rows of it."""
        return read_shards(self.spark, self.data, self.paths, {"subject_id": "bigint"}).distinct()

    def files(self) -> DataFrame:
        """(shard, n_bytes) of every shard."""
        rows = [(shard_name(self.data, p), p.stat().st_size) for p in self.paths]
        return self.spark.createDataFrame(rows, "shard string, n_bytes bigint")

    def splits(self) -> DataFrame:
        """From the splits file, else from the first part of the shards' names."""
        path = self.root / SPLITS_FILE
        if path.is_file():
            return read_splits(self.spark, path)
        if any("/" not in shard_name(self.data, p) for p in self.paths):
            raise NotADatasetError(f"{self.root} has no splits file, and flat shard names")
        return self.subject_shards().select("subject_id", F.split_part("shard", F.lit("/"), F.lit(1)).alias("split")).distinct()

    def codes(self) -> DataFrame | None:
        path = self.root / CODES_FILE
        return self.spark.read.parquet(literal(path)) if path.is_file() else None

    def fingerprint(self) -> str:
        """A digest of the names, sizes and times of shards, code table and splits file."""
        beside = [p for p in (self.root / CODES_FILE, self.root / SPLITS_FILE) if p.is_file()]
        stats = [(p.relative_to(self.root).as_posix(), p.stat()) for p in [*self.paths, *beside]]
        return text_digest(f"{name}\x1f{stat.st_size}\x1f{stat.st_mtime_ns}" for name, stat in stats)


def read_splits(spark: SparkSession, path: Path) -> DataFrame:
    """(subject_id, split), each pair once."""
    return spark.read.parquet(literal(path)).select(F.col("subject_id").cast("long"), F.col("split").cast("string")).distinct()


def read_excluded(spark: SparkSession, path: Path) -> DataFrame:
    """The subjects of a dataset's splits file, or of a splits file itself, whatever their split."""
    found = path if path.is_file() else path / SPLITS_FILE
    if not found.is_file():
        raise FileNotFoundError(f"no {SPLITS_FILE} in {path}")
    return spark.read.parquet(literal(found)).select(F.col("subject_id").cast("long").alias("subject_id")).distinct()


def read_labels(spark: SparkSession, folder: Path, places: bool = False) -> DataFrame:
    """The label rows of a folder, at the union of its files' columns, with their file's name (``shard``)."""
    paths = shard_paths(folder)
    if not paths:
        raise FileNotFoundError(f"no label files in {folder}")
    return read_shards(spark, folder, paths, places=places)


def is_tensorized(root: Path) -> bool:
    from .tensors import SCHEMAS

    return (root / SCHEMAS).is_dir()


def bytes_below(folder: Path) -> tuple[int, int]:
    """(bytes with links followed, bytes of distinct files) below a folder."""
    seen: dict[tuple[int, int], int] = {}
    total = 0
    for top, _, names in os.walk(folder):
        for name in names:
            stat = os.stat(os.path.join(top, name))
            total += stat.st_size
            seen[stat.st_dev, stat.st_ino] = stat.st_size
    return total, sum(seen.values())
