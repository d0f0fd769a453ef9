"""Exact size reports of event tables and of ragged arrays."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.framing import digest
from ..functions.windows import projected

# Fixed labels.
ALL, UNKNOWN, TOTAL = "__all__", "__unknown__", "__total__"
ADDITIVE = ("n_subjects", "n_events", "n_measurements", "n_dynamic", "n_static", "n_subjects_with_static")


def listed_splits(spark: SparkSession, splits: Mapping[int, str]) -> DataFrame:
    """(subject_id, split) of an assignment that the caller holds."""
    return spark.createDataFrame([(int(k), str(v)) for k, v in splits.items()], "subject_id long, split string")


def with_split(rows: DataFrame, splits: DataFrame | Mapping[int, str] | None) -> DataFrame:
    """Rows with their subject's split, ``__unknown__`` where none is listed, ``__all__`` where there are no splits."""
    if splits is None:
        return rows.withColumn("split", F.lit(ALL))
    if isinstance(splits, Mapping):
        splits = listed_splits(rows.sparkSession, splits)
    return rows.drop("split").join(splits.select("subject_id", "split"), "subject_id", "left").withColumn("split", F.coalesce("split", F.lit(UNKNOWN)))


def size_report(events: DataFrame, splits: DataFrame | Mapping[int, str] | None, code_ids: bool = False) -> DataFrame:
    """One row a split: subjects, events, measurements, static and dynamic ones, codes; all counts exact.

    Rows are counted by subject first, so that splits are joined to subjects and not to rows.
    """
    each = with_split(subject_counts(events, codes=True), splits)
    statics = F.col("statics") > 0
    sums = each.groupBy("split").agg(
        F.count("subject_id").alias("n_subjects"),
        F.sum("events").alias("n_events"),
        F.sum(F.col("measurements") + F.col("statics")).alias("n_measurements"),
        F.sum("measurements").alias("n_dynamic"),
        F.sum("statics").alias("n_static"),
        F.sum((statics & F.col("subject_id").isNotNull()).cast("long")).alias("n_subjects_with_static"),
    )
    found = each.select("split", F.explode_outer("codes").alias("code")).groupBy("split").agg(F.collect_set("code").alias("codes"))  # a vocabulary a split
    aggs = [F.size("codes").cast("long").alias("n_codes_observed")]
    if code_ids:
        aggs.append(digest(F.sort_array("codes")).alias("observed_code_set_id"))
    return sums.join(found.select("split", *aggs), "split")


def with_total(report: DataFrame, events: DataFrame) -> DataFrame:
    """The report and its total row: counts are summed over the splits, codes counted anew."""
    sums = report.agg(*[F.sum(c).alias(c) for c in ADDITIVE]).withColumn("split", F.lit(TOTAL))
    codes = events.agg(F.countDistinct("code").alias("n_codes_observed"))  # one row
    total = sums.join(F.broadcast(codes)).select("split", *ADDITIVE, "n_codes_observed")
    return report.select(*total.columns).unionByName(total)


def list_length(column: Column) -> Column:
    return F.when(column.isNull(), 0).otherwise(F.size(column))


def ragged_size(cohort: DataFrame) -> DataFrame:
    """Sizes by split of rows (split, static_code, time_delta_days, code): one a subject, arrays per event."""
    statics, dynamic = list_length(F.col("static_code")), F.aggregate(F.coalesce("code", F.array().cast("array<array<bigint>>")), F.lit(0), lambda a, x: a + F.coalesce(F.size(x), F.lit(0)))
    rows = cohort.select("split", statics.cast("long").alias("s"), list_length(F.col("time_delta_days")).cast("long").alias("e"), dynamic.cast("long").alias("d"))
    return rows.groupBy("split").agg(
        F.count("*").alias("n_subjects"),
        F.sum("e").alias("n_events"),
        F.sum(F.col("s") + F.col("d")).alias("n_measurements"),
        F.sum("d").alias("n_dynamic"),
        F.sum("s").alias("n_static"),
        F.sum((F.col("s") > 0).cast("long")).alias("n_subjects_with_static"),
    )


def subject_counts(events: DataFrame, codes: bool = False) -> DataFrame:
    """(subject_id, events, measurements, statics) of every subject: timed measurements and static ones; ``codes``: and its codes."""
    own = [F.collect_set("code").alias("codes")] if codes else []
    return events.groupBy("subject_id").agg(
        F.countDistinct("time").alias("events"), F.count("time").alias("measurements"), F.sum(F.when(F.col("time").isNull(), 1).otherwise(0)).cast("long").alias("statics"), *own
    )


def token_projection(counts: DataFrame, width: int, batch_mode: str = "SM", static_mode: str = "INCLUDE", stride: int | None = None) -> DataFrame:
    """One row: how many tokens an epoch over all subjects trains on."""
    made = projected(F.col("events"), F.col("measurements"), F.col("statics"), width, batch_mode, static_mode, stride)
    each = counts.select(*[c.alias(n) for n, c in made.items()])
    return each.agg(F.count("*").alias("n_subjects"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in made])
