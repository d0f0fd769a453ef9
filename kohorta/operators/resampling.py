"""Deterministic bootstrap and subsample draws, and labels repeated for each draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import LIMIT, cutoff, draw_value, rank_digest, replicate_salt
from .selection import numbered, ranges, ranked_by, require_unique

#: Draws made beyond those asked for, as some may be rejected (each with a chance below 2**-40); more if that isn't enough.
SPARE = 64
# The columns of labels that are kept, in this order.
LABEL_COLUMNS = ("subject_id", "prediction_time", "boolean_value", "integer_value", "float_value", "categorical_value")
#: Counters that one task numbers.
COUNTERS = 1 << 20


def _numbers(replicates: range | int) -> range:
    return range(replicates, replicates + 1) if isinstance(replicates, int) else replicates


def eligible_pool(splits: DataFrame, source: str, excluded: DataFrame | None = None, allow_overlap: bool = False) -> DataFrame:
    pool = splits.where(F.col("split") == source).select("subject_id").distinct()
    return pool if excluded is None or allow_overlap else pool.join(excluded.select("subject_id").distinct(), "subject_id", "left_anti")


def with_replacement(pool: DataFrame, n_draws: int, salt: str, replicates: range | int, _cutoff: int | None = None) -> DataFrame:
    """(replicate, draw_index, subject_id) of all replicates: their counter streams' draws as places in the sorted pool."""
    if n_draws < 0:
        raise ValueError(f"the number of draws must be >= 0, not {n_draws}")
    spark, replicates = pool.sparkSession, _numbers(replicates)
    n = require_unique(pool).count()
    if n_draws and not n:
        raise ValueError(f"an empty pool has no subjects for {n_draws} draws")
    limit, spare = _cutoff or cutoff(max(n, 1)), SPARE
    while True:
        width = n_draws + spare if n_draws else 0
        counted = spark.range(width * len(replicates)).select(F.expr(f"{replicates.start} + id div {max(width, 1)}").alias("replicate"), (F.col("id") % max(width, 1)).alias("counter"))
        stream = counted.withColumn("u", draw_value(F.col("counter"), salt, F.col("replicate")))
        good = stream.where(F.col("u") < F.lit(str(limit)).cast("decimal(20,0)"))
        if limit == LIMIT or not n_draws or good.groupBy("replicate").agg(F.count("*").alias("n")).where(F.col("n") >= n_draws).count() == len(replicates):
            break
        spare = 2 * spare + n_draws
    drawn = numbered(good.withColumn("part", F.floor(F.col("counter") / COUNTERS)), "part", ["counter"], "draw_index", "replicate").where(F.col("draw_index") < n_draws)
    place = F.pmod(F.col("u"), F.lit(max(n, 1)).cast("decimal(20,0)")).cast("long")
    places = numbered(ranges(pool.select("subject_id"), "subject_id"), "_part", ["subject_id"], "place").select("subject_id", "place")
    return drawn.select("replicate", "draw_index", place.alias("place")).join(places, "place").select("replicate", "draw_index", "subject_id")


def without_replacement(pool: DataFrame, n_draws: int, salt: str, replicates: range | int) -> DataFrame:
    """(replicate, draw_index, subject_id) of all replicates: the first subjects by rank under each one's salt."""
    if n_draws < 0:
        raise ValueError(f"the number of draws must be >= 0, not {n_draws}")
    if n_draws > (size := require_unique(pool).count()):
        raise ValueError(f"a pool of {size} has no {n_draws} different subjects")
    replicates = _numbers(replicates)
    if not len(replicates):
        return pool.limit(0).select(F.lit(0).cast("long").alias("replicate"), F.lit(0).cast("long").alias("draw_index"), "subject_id")
    each = pool.select("subject_id", F.explode(F.sequence(F.lit(replicates.start).cast("long"), F.lit(replicates.stop - 1).cast("long"))).alias("replicate"))
    made = ranked_by(each, rank_digest(F.col("subject_id"), replicate_salt(salt, F.col("replicate"))), "replicate")
    return made.where(F.col("rank") < n_draws).select("replicate", F.col("rank").alias("draw_index"), "subject_id")


def repeat_labels(labels: DataFrame, draws: DataFrame) -> DataFrame:
    """Every label row once for each draw of its subject, with the draws' other columns."""
    return labels.join(draws, "subject_id")


def replicate_stats(draws: DataFrame) -> DataFrame:
    """(replicate, n_draws, n_distinct)."""
    return draws.groupBy("replicate").agg(F.count("*").alias("n_draws"), F.countDistinct("subject_id").alias("n_distinct"))
