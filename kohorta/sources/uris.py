"""Event datasets and small records on any file system that Spark reads.

Nothing here opens a file but through Spark: data and listings are read by executors, records of a few kilobytes
through Spark's file-system classes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cached_property
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.framing import folded_whole
from .dataset import CODES_FILE, SIZED, SPLITS_FILE, EventDataset, NotADatasetError, below, literal


def is_uri(path: object) -> bool:
    return re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", str(path)) is not None


def as_uri(path: str | Path) -> str:
    return str(path) if is_uri(path) else f"file://{Path(path).absolute()}"  # not escaped: Hadoop's paths are plain text


def read_rows(spark: SparkSession, uri: str) -> DataFrame:
    """The rows of all Parquet files below a URI, at the union of their columns."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(literal(uri))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines see; in local mode without that setting a new one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kohorta-")
        spark.conf.set("spark.checkpoint.dir", "file://" + found)
    return (found if "://" in found else "file://" + found).rstrip("/")


class Folder:
    """A folder at a URI, and the small files in it."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, str(uri).rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str = "") -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder of few files, without names that begin with a dot."""
        fs, path = self._at(name)
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(x for x in found if not x.startswith("."))

    def read(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a file of a new name: as a whole, by a rename, or not at all."""
        fs, target = self._at(name)
        _, aside = self._at(f".aside-{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(aside, target):
            fs.delete(aside, False)
            raise FileExistsError(f"{self.uri}/{name}")

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def prefix(self, name: str = "") -> str:
        """What the paths of files in this folder (or in ``name``), as Spark gives them, begin with."""
        fs, own = self._at(name)
        found = fs.makeQualified(own).toUri()
        return f"{found.getScheme()}://{found.getAuthority() or ''}{found.getRawPath()}".rstrip("/") + "/"

    def below(self, path: Column, name: str = "") -> Column:
        """The part of a file's path, as Spark gives it, after this folder's (and ``name``'s)."""
        fs, own = self._at(name)
        prefix = fs.makeQualified(own).toUri().getPath().rstrip("/") + "/"
        bare = F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
        return F.substring(bare, F.lit(len(prefix) + 1), F.length(bare))


def decoded(path: Column) -> Column:
    """A path of the hidden column _metadata as it is written; there, characters are escaped, but a plus is a plus."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


class UriDataset:
    """An event dataset at a URI: shards anywhere below ``data``, splits and codes under ``metadata``.

    The schema is the union of the shards' footers, which Spark reads in a job; names with a leading dot or underscore are
    not seen.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)
        self.root = self.folder.uri
        if not self.folder.exists("data"):
            raise NotADatasetError(f"{root} has no shards under data/")

    @cached_property
    def schema(self) -> T.StructType:
        try:
            return read_rows(self.spark, f"{self.root}/data").schema
        except Exception as e:
            if "UNABLE_TO_INFER_SCHEMA" in str(e):
                raise NotADatasetError(f"{self.root} has no shards under data/") from None
            raise

    def _shard(self) -> Column:
        raw = F.col("_metadata.file_path")
        return below(raw, self.folder.prefix("data"), F.regexp_replace(self.folder.below(decoded(raw), "data"), r"\.parquet$", ""))

    def events(self, places: bool = False) -> DataFrame:
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(literal(f"{self.root}/data"))
        extra = [F.col("_metadata.row_index").alias("_row")] if places else []
        return rows.select(*[F.col(f"`{n}`") for n in self.schema.names], self._shard().alias("shard"), *extra)

    def sized_events(self) -> DataFrame:
        """The columns that sizes depend on, of shards of any width."""
        pinned = ", ".join(f"{n} {kind}" for n, kind in SIZED.items())
        rows = self.spark.read.schema(pinned).option("recursiveFileLookup", True).parquet(literal(f"{self.root}/data"))
        return rows.select(*SIZED, self._shard().alias("shard"))

    def subject_shards(self) -> DataFrame:
        return self.sized_events().select(F.col("subject_id").cast("long"), "shard").distinct()

    def files(self) -> DataFrame:
        """(shard, n_bytes) of every shard."""
        shard = F.regexp_replace(F.regexp_replace("name", "^data/", ""), r"\.parquet$", "")
        return self.listing().where(F.col("name").startswith("data/")).select(shard.alias("shard"), "n_bytes")

    def listing(self) -> DataFrame:
        """(name, n_bytes, modified) of shards, splits and codes; executors list folders, no file is opened."""
        beside = [f"{self.root}/{n}" for n in (SPLITS_FILE, CODES_FILE) if self.folder.exists(n)]
        listed = lambda *paths: self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load([literal(p) for p in paths])
        found = listed(f"{self.root}/data")
        found = found.unionByName(listed(*beside)) if beside else found
        return found.select(self.folder.below(F.col("path")).alias("name"), F.col("length").alias("n_bytes"), F.unix_micros("modificationTime").alias("modified"))

    def fingerprint(self) -> str:
        """A digest of names, sizes and times."""
        line = F.concat_ws("\x1f", "name", F.col("n_bytes").cast("string"), F.col("modified").cast("string"))
        return folded_whole(self.listing(), line).first()[0]

    def splits(self) -> DataFrame:
        if self.folder.exists(SPLITS_FILE):
            found = self.spark.read.parquet(literal(f"{self.root}/{SPLITS_FILE}"))
            return found.select(F.col("subject_id").cast("long"), F.col("split").cast("string")).distinct()
        found = self.subject_shards()
        if not found.where(~F.col("shard").contains("/")).isEmpty():
            raise NotADatasetError(f"{self.root} has no splits file, and flat shard names")
        return found.select("subject_id", F.split_part("shard", F.lit("/"), F.lit(1)).alias("split")).distinct()

    def codes(self) -> DataFrame | None:
        return self.spark.read.parquet(literal(f"{self.root}/{CODES_FILE}")) if self.folder.exists(CODES_FILE) else None


def open_dataset(spark: SparkSession, place: str | Path) -> EventDataset | UriDataset:
    """The event dataset of a folder, or at a URI."""
    return UriDataset(spark, str(place)) if is_uri(place) else EventDataset(spark, place)
