"""The subject filter as a pipeline stage: settings in, a function of DataFrames out, the same over every shard."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT_SALT
from .operators import selection
from .sources.dataset import read_shards, read_splits, shard_paths


def train_subjects(spark: SparkSession, data: str | Path | None, metadata: str | Path | None, train: str) -> DataFrame:
    """The whole cohort's train subjects: from the splits file, or else from the shards under the split's folder."""
    path = Path(metadata) / "subject_splits.parquet" if metadata is not None else None
    if path is not None and path.is_file():
        found = read_splits(spark, path).where(F.col("split") == train).select("subject_id").distinct()
        if not found.isEmpty():
            return found
    folder = Path(data) / train if data is not None else None
    paths = shard_paths(folder) if folder is not None else []
    if paths:
        found = read_shards(spark, folder, paths, {"subject_id": "bigint"}).select("subject_id").distinct()
        if not found.isEmpty():
            return found
    raise ValueError(f"no {train!r} subjects to rank: neither rows of subject_splits.parquet in {metadata} nor shards in {data}/{train}; list subject_ids instead")


def subset_subjects(spark: SparkSession, settings: Mapping[str, Any]) -> Callable[[DataFrame], DataFrame]:
    """The filter of a stage: ``subject_ids`` keeps those listed; ``n_subjects`` the first by rank of the train split.

    With ``n_subjects``, rows of subjects outside the split stay.
    """
    listed = settings.get("subject_ids")
    if listed is not None:
        keep = spark.createDataFrame([(int(i),) for i in listed], "subject_id long")
        return lambda rows: selection.filter_subjects(rows, keep)
    n = settings.get("n_subjects")
    if n is None:
        raise ValueError("the stage needs n_subjects or subject_ids")
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError(f"n_subjects must be an integer; got {n!r}")
    cohort = train_subjects(spark, settings.get("data_input_dir"), settings.get("metadata_input_dir"), settings.get("train_split") or "train")
    chosen = selection.select_nested(cohort, n, settings.get("salt") or DEFAULT_SALT).select("subject_id")
    return lambda rows: selection.filter_cohort(rows, cohort, chosen)
