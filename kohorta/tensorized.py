"""Families of nested subsets of tensor cohorts: the same selection and shards, over ragged tensors."""

from __future__ import annotations

import shutil
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .build import FAMILY, MANIFEST, STORE, check_record, check_unmoved, codes_digest, computed_plan, disk, require_pool
from .config import SubsetConfig
from .functions.framing import text_digest
from .operators import digests, selection
from .reports import tensor_report
from .sources.dataset import CODES_FILE, NotADatasetError
from .sources.sinks import ShardStore, place, prune, publish, write_json, write_text
from .sources.tensors import DATA, SCHEMAS, SUFFIX, Slice, TensorCohort, open_tensors, write_slices


def _fingerprint(cohort: TensorCohort) -> str:
    files = [p for shard in cohort.shards for p in (cohort.schema_path(shard), cohort.tensor_path(shard))] + [cohort.root / CODES_FILE]
    stats = [(p.relative_to(cohort.root).as_posix(), p.stat()) for p in files]
    return text_digest(f"{name}\x1f{stat.st_size}\x1f{stat.st_mtime_ns}" for name, stat in stats)


def slice_shards(plan: DataFrame, cohort: TensorCohort, store: ShardStore) -> None:
    """Writes schema and tensors of every ``stored`` of rows (stored, shard, row_index): a task an output shard, in the order of (shard, row).

    A task holds the places of its shard's subjects, one row group of a source's schema, and a few megabytes of a tensor: the
    ranges of bytes that belong to subjects are copied from the sources' files one tensor after the other.  Schema
    rows are taken as Arrow holds them, so that the schemas keep their types, unsigned ones too.
    """
    root, target = cohort.root, store.root

    def write(key, frame):
        chosen = [(shard, rows["row_index"].to_numpy(dtype=np.int64)) for shard, rows in frame.sort_values(["shard", "row_index"]).groupby("shard", sort=True)]
        slices = [Slice(open_tensors(root / DATA / f"{shard}{SUFFIX}"), places) for shard, places in chosen]
        publish(lambda aside: write_slices(aside, slices), target / f"{key[0]}{SUFFIX}")
        publish(lambda aside: _write_schema(aside, [(root / SCHEMAS / f"{shard}.parquet", places) for shard, places in chosen]), target / f"{key[0]}.parquet")
        return frame[["stored"]].head(1)

    plan.select("stored", "shard", "row_index").groupBy("stored").applyInPandas(write, "stored string").count()


def _write_schema(path: Path, chosen: list[tuple[Path, np.ndarray]]) -> None:
    """The chosen rows (ascending) of schemas, a row group at a time, at the union of their columns."""
    whole = pa.unify_schemas([pq.read_schema(p) for p, _ in chosen], promote_options="default")
    with pq.ParquetWriter(path, whole) as out:
        for source, places in chosen:
            opened, before = pq.ParquetFile(source), 0
            for group in range(opened.num_row_groups):
                size = opened.metadata.row_group(group).num_rows
                own = places[np.searchsorted(places, before) : np.searchsorted(places, before + size)] - before
                before += size
                if len(own):
                    rows = opened.read_row_group(group).take(own)
                    out.write_table(pa.concat_tables([whole.empty_table(), rows], promote_options="default"))


def build_tensorized_family(spark: SparkSession, parent: str | Path, output: str | Path, config: SubsetConfig, overwrite: bool = False) -> dict:
    """Every member in ``output``, as ``build_family`` makes them of event cohorts; the vocabulary is the parent's."""
    if config.code_metadata != "copy":
        raise ValueError("a tensor cohort's vocabulary must be copied: pruning would change the indices that its tensors hold")
    cohort, output = TensorCohort(spark, parent), Path(output)
    store = ShardStore(output / STORE)
    codes_id = codes_digest(cohort.codes())
    located = cohort.locations().persist()
    try:
        splits = cohort.splits()
        split_sizes = {r["split"]: r["n"] for r in splits.groupBy("split").agg(F.count("*").alias("n")).collect()}
        if config.train_split not in split_sizes:
            raise NotADatasetError(f"{parent} has no split {config.train_split!r}; its splits are {sorted(split_sizes)}")
        require_pool(config, split_sizes)
        train = splits.where(F.col("split") == config.train_split)
        known = {"path": str(parent), "subject_set_id": digests.subject_set_digest(located).first()[0], "fingerprint": _fingerprint(cohort), "train_subject_set_id": digests.subject_set_digest(train).first()[0], "codes_id": codes_id}
        check_record(output, store, known, overwrite)
        plan = computed_plan(splits, split_sizes, config).persist()
        placed = plan.select("member", "shard", "stored").distinct().collect()  # a row a file
        keys = {r["stored"] for r in placed}
        has = lambda k: store.has(k) and (store.root / f"{k}{SUFFIX}").is_file()
        if missing := [k for k in keys if not has(k)]:
            wanted = spark.createDataFrame([(k,) for k in missing], "stored string")
            chosen = plan.select("stored", "subject_id").distinct().join(F.broadcast(wanted), "stored", "left_semi").join(located, "subject_id")  # a key a file
            slice_shards(chosen, cohort, store)
        passed = []
        if config.non_train_policy == selection.PASSTHROUGH:
            passed = [s for s in cohort.shards if s.rsplit("/", 1)[0] != config.train_split]
            for shard in passed:
                store.put(f"passthrough/{shard}", lambda aside, shard=shard: shutil.copy2(cohort.schema_path(shard).resolve(), aside) and None)
                tensors = store.root / f"passthrough/{shard}{SUFFIX}"
                if not tensors.is_file():
                    place(cohort.tensor_path(shard), tensors, "copy")
        check_unmoved(store, known["fingerprint"], _fingerprint(TensorCohort(spark, parent)))
        report = {}
        for n in config.n_subjects:
            root = output / config.subset_name(n)
            files = {r["shard"]: r["stored"] for r in placed if r["member"] == n} | {s: f"passthrough/{s}" for s in passed}
            member = root / SCHEMAS
            for shard, stored in files.items():
                place(store.path(stored), member / f"{shard}.parquet", config.link_mode)
                place(store.root / f"{stored}{SUFFIX}", root / DATA / f"{shard}{SUFFIX}", config.link_mode)
            prune(member, set(files))
            prune(root / DATA, set(files), SUFFIX)
            place(cohort.root / CODES_FILE, root / CODES_FILE, "copy")
            made = TensorCohort(spark, root)
            own = plan.where((F.col("member") == n) & (F.col("split") == config.train_split))
            total = tensor_report(made)
            report[root.name] = {
                "name": root.name, "root": str(root), "n_subjects": n, "subject_set_id": digests.subject_set_digest(made.rows()).first()[0], "train_subject_set_id": digests.subject_set_digest(own).first()[0],
                "shards": dict(sorted(files.items())), "sizes": [r.asDict() for r in total.drop("source", "kind").orderBy("split").collect()],
            }
            write_json(root / MANIFEST, report[root.name])
        plan.unpersist()
    finally:
        located.unpersist()
    out = {"parent": known, "config": config.to_dict(), "members": report, "disk": disk(output, store)}
    write_json(output / FAMILY, out)
    return out


def pinned_pipeline(subset: str | Path, output: str | Path, parent: str | Path) -> dict:
    """The pipeline that makes tensors of a subset with its parent's vocabulary and statistics: neither is fitted anew."""
    stages = [{"fit_vocabulary_indices": {"metadata_input_dir": str(Path(parent) / "metadata")}}, "normalization", "tokenization", "tensorization"]
    return {"input_dir": str(subset), "output_dir": str(output), "etl_metadata": {"pipeline_name": "tensorization"}, "stages": stages}


def write_pinned_pipeline(path: str | Path, subset: str | Path, output: str | Path, parent: str | Path) -> Path:
    import yaml

    note = "# Keeps the parent's vocabulary and statistics; fitting them on the subset would permute the vocabulary between members.\n"
    write_text(Path(path), note + yaml.safe_dump(pinned_pipeline(subset, output, parent), sort_keys=False))
    return Path(path)
