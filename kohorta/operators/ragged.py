"""Cohorts of ragged arrays, one row a subject, kept in shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def locations(rows: DataFrame) -> DataFrame:
    """(subject_id, shard, row_index) of rows read with their places: the row of the shard's file is the subject's place in its tensors."""
    return rows.select("subject_id", "shard", F.col("_row").alias("row_index"))


def require_one_shard(found: DataFrame) -> None:
    twice = found.groupBy("subject_id").agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"subjects in several places: {[r['subject_id'] for r in twice]}")


def sliced(cohort: DataFrame, found: DataFrame, keep: DataFrame) -> DataFrame:
    """The kept subjects' rows with their places."""
    chosen = found.join(keep.select("subject_id").distinct(), "subject_id", "left_semi")
    return cohort.drop("shard").join(chosen, "subject_id")
