"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch of changes is a table of inserts (a new count), deletes (an old count) and revisions (an old count, and
a new one, maybe of another tokenizer version).  It is aggregated into signed deltas and committed by its name;
a batch that is committed already changes nothing, so a repeated or restarted job is
harmless.  Totals are the sums of all committed deltas; ``compact`` folds them into one folder that names the
batches it holds.

Defined results: null sources, languages and versions are groups of their own; a null count counts as zero
tokens of one document; groups whose documents and tokens both came to zero are left out of the totals.  Ids are whole numbers, or texts of
them: others raise.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, frugal, remove, shared_path, slices, small_batches
from .tokenizing import encoder

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, documents bigint, tokens bigint"


@frugal
def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    made = encoder(path, None)
    for batch in slices(batches, "_text", 1 << 22):
        n = [len(x) // 4 for x in made.ids(batch.column("_text"))]
        rest = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(n, pa.int64())], [*(batch.schema.names[i] for i in rest), "tokens"])


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, source, lang, text_hash, tokens) of every document."""
    small_batches(docs.sparkSession)
    made = docs.select(F.col(key).cast("long").alias("id"), "source", "lang", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_hash"), F.col(text).alias("_text"))
    return made.mapInArrow(lambda it: _count(it, tokenizer), "id bigint, source string, lang string, text_hash string, tokens bigint")


def inserts(counts: DataFrame, version: str) -> DataFrame:
    return _signed(counts.withColumn("version", F.lit(version)), 1)


def deletes(counts: DataFrame, version: str) -> DataFrame:
    return _signed(counts.withColumn("version", F.lit(version)), -1)


def revisions(counts: DataFrame, old: str, new: str, revised: str = "revised") -> DataFrame:
    """From the column tokens under ``old`` to the column ``revised`` under ``new``."""
    return deletes(counts, old).unionByName(inserts(counts.withColumn("tokens", F.col(revised)), new))


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("documents"), (F.coalesce("tokens", F.lit(0)) * sign).cast("long").alias("tokens"))


class Rollup:
    """A rollup in a folder of the shared file system.

    ``data`` has a folder for each attempt at a batch, ``batches`` a small file for each committed batch that names
    the folder that counts, ``compactions`` the same for compactions.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        made = jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    def _publish(self, name: str, value: str) -> bool:
        """Puts the file ``name`` with ``value`` in place by a rename; says no if it is there, which a rename onto a file is too."""
        fs, target = self._hadoop(f"{self.folder}/{name}")
        _, aside = self._hadoop(f"{self.folder}/attempts/{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(aside, False)
        out.write(bytearray(value.encode()))
        out.close()
        if fs.getUri().getScheme() == "file":  # there, a rename would replace a file that another attempt has just put in place
            done = self._linked(aside, target)
        else:
            done = not fs.exists(target) and fs.rename(aside, target)
        if fs.exists(aside):
            fs.delete(aside, False)
        return done and self._value(name) == value

    def _linked(self, aside, target) -> bool:
        try:
            os.link(aside.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        return True

    def _value(self, name: str) -> str:
        fs, path = self._hadoop(f"{self.folder}/{name}")
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _names(self, kind: str) -> list[str]:
        fs, path = self._hadoop(f"{self.folder}/{kind}")
        if not fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith("."))

    def committed(self, batch: str) -> bool:
        return batch in self._names("batches") or batch in self._compacted()[1]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the batch unless it is there; says whether it was added.

        The deltas are written first, to a folder of this attempt; the batch counts once its file names that folder, as
        a whole or not at all, and of two attempts at once one counts.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch name: {batch!r}")
        if self.committed(batch):
            return False
        deltas = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        data = f"data/{batch}-{uuid.uuid4().hex}"
        deltas.write.parquet(f"{self.folder}/{data}")
        if self._publish(f"batches/{batch}", data):
            return True
        remove(self.spark, [f"{self.folder}/{data}"])
        return False

    def _compacted(self) -> tuple[str | None, set[str]]:
        """The newest compaction and the batches that it holds."""
        found = self._names("compactions")
        if not found:
            return None, set()
        data = self._value(f"compactions/{found[-1]}")
        names = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/{data}/batches").collect()}
        return data, names

    def totals(self) -> DataFrame:
        return self._summed(self._names("batches"), *self._compacted())

    def _summed(self, batches: list[str], newest: str | None, held: set[str]) -> DataFrame:
        """The totals of a compaction that holds the batches ``held``, and of those of ``batches`` that it doesn't hold."""
        paths = [f"{self.folder}/{self._value(f'batches/{x}')}" for x in batches if x not in held]
        if newest:
            paths.append(f"{self.folder}/{newest}/totals")
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        summed = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.where((F.col("documents") != 0) | (F.col("tokens") != 0))

    def compact(self) -> None:
        """Folds all batches into one table of totals; the batches' folders stay until they are removed by hand.

        The batches are listed once: those that are committed meanwhile are neither in the totals nor among its batches.
        """
        number = len(self._names("compactions"))
        found, (newest, held) = self._names("batches"), self._compacted()
        batches = held.union(found)
        data = f"data/compaction-{uuid.uuid4().hex}"
        self._summed(found, newest, held).write.parquet(f"{self.folder}/{data}/totals")
        self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch string").write.parquet(f"{self.folder}/{data}/batches")
        if not self._publish(f"compactions/{number:06d}", data):
            remove(self.spark, [f"{self.folder}/{data}"])
            raise RuntimeError("another compaction came first")


def count_corpus(docs: DataFrame, tokenizer: str, first: str, second: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The totals after three batches over all of ``docs``, each committed twice.

    All documents are inserted under version ``first``; exact copies (all but the least id of equal texts, of
    equal rows all but one) are deleted there and inserted under ``first``/copies; the others are revised to
    ``second``, which counts an end token as well.  So the totals are those of all documents.

    Copies are counted by text, source and language before texts are compared, so that a text's many copies
    are a row for each of its sources and languages.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.stored(token_counts(docs, tokenizer, text, key), "counts")
    rollup = Rollup(docs.sparkSession, shared_path(docs.sparkSession, "rollup"))
    low = F.min(F.struct("id", "source", "lang")).alias("low")
    named = counts.groupBy("text_hash", "source", "lang").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"), low)
    least = named.groupBy("text_hash").agg(F.min("low").alias("least"))
    joined = scratch.stored(named.join(least, "text_hash").withColumn("first", F.col("low").eqNullSafe(F.col("least"))), "copies")
    copies = joined.withColumn("gone", F.col("n") - F.col("first").cast("int")).where("gone > 0")
    moved = [
        copies.select("source", "lang", F.lit(version).alias("version"), (F.col("gone") * sign).alias("documents"), (F.col("tokens") * F.col("gone") * sign).alias("tokens"))
        for version, sign in ((first, -1), (f"{first}/copies", 1))
    ]
    kept = joined.where("first").withColumn("revised", F.col("tokens") + 1)
    for _ in range(2):
        rollup.commit("insert", inserts(counts, first))
        rollup.commit("move-copies", moved[0].unionByName(moved[1]))
        rollup.commit("revise", revisions(kept, first, second))
    scratch.release()
    return rollup.totals()
