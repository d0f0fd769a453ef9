"""Subject tables kept by source file, so that of a parent's shards only the changed ones are read again.

    subjects-<attempt>/key=<file's key>/...   the table of the subjects of a file
    subjects-<attempt>.json                   the keys that the attempt holds: its commit

A file's key comes from its name, size and time and from the dataset's columns, which canonical rows name.
"""

from __future__ import annotations

import json
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.framing import PREFIX, text_digest
from .operators import digests, selection
from .sources.dataset import EventDataset, literal, read_shards, shard_name
from .sources.sinks import write_json

_SCHEMA = "subject_id bigint, digest string, events bigint, measurements bigint, statics bigint, codes array<string>, key string"


def file_keys(dataset: EventDataset) -> dict[str, str]:
    """{shard: key}."""
    columns = dataset.events().schema.json()
    out = {}
    for path in dataset.paths:
        name, stat = shard_name(dataset.data, path), path.stat()
        out[name] = text_digest([name, str(stat.st_size), str(stat.st_mtime_ns), columns]).removeprefix(PREFIX)[:32]
    return out


def _attempts(folder: Path) -> dict[str, list[str]]:
    found = sorted(folder.glob("subjects-*.json")) if folder.is_dir() else []
    return {p.stem: json.loads(p.read_text(encoding="utf-8")) for p in found}


def cached_subjects(dataset: EventDataset, folder: Path) -> DataFrame:
    """``digests.subject_table`` of the dataset: from ``folder`` for files that it knows, which then is made to know all.

    Tables of files go together only where every subject lies in one file; elsewhere all rows are read.
    """
    spark, keys = dataset.spark, file_keys(dataset)
    held = {key: name for name, own in _attempts(folder).items() for key in own}
    missing = {shard: key for shard, key in keys.items() if key not in held}
    if missing:
        _add(dataset, folder, missing)
        held = {key: name for name, own in _attempts(folder).items() for key in own}
    _prune(folder, set(keys.values()))
    paths = [p for key in keys.values() if (p := folder / held[key] / f"key={key}").is_dir()]
    if not paths:
        return spark.createDataFrame([], _SCHEMA).drop("key")
    found = spark.read.schema(_SCHEMA.rsplit(",", 1)[0]).parquet(*[literal(p) for p in paths])
    if selection.repeated(found).isEmpty():
        return found
    return digests.subject_table(dataset.events().drop("shard"))


def _add(dataset: EventDataset, folder: Path, missing: dict[str, str]) -> None:
    spark, attempt = dataset.spark, f"subjects-{uuid.uuid4().hex}"
    columns = {f.name: f.dataType.simpleString() for f in dataset.events().schema if f.name != "shard"}
    paths = [p for p in dataset.paths if shard_name(dataset.data, p) in missing]
    rows = read_shards(spark, dataset.data, paths, columns)
    named = spark.createDataFrame(list(missing.items()), "shard string, key string")
    table = digests.subject_table(rows, "shard").join(F.broadcast(named), "shard").drop("shard")  # a row a file
    table.repartition("key").write.partitionBy("key").parquet(str(folder / attempt))
    write_json(folder / f"{attempt}.json", sorted(missing.values()))


def _prune(folder: Path, keys: set[str]) -> None:
    """Removes attempts that hold no file that is left, and what attempts without a commit have left."""
    known = _attempts(folder)
    for path in folder.glob("subjects-*"):
        name = path.name.removesuffix(".json")
        if not keys & set(known.get(name, [])):
            path.unlink() if path.is_file() else shutil.rmtree(path, ignore_errors=True)
