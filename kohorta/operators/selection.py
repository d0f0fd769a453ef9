"""Nested selection by salted rank, rank-bucketed shards, members of a family, cohort filters and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import rank_digest, shard_key

PASSTHROUGH, SUBSET, DROP = "passthrough", "subset", "drop"


def require_unique(subjects: DataFrame, subject: str = "subject_id") -> DataFrame:
    found = repeated(subjects, subject).limit(1).collect()
    if found:
        raise ValueError(f"repeated subject {found[0][0]}")
    return subjects


def repeated(subjects: DataFrame, subject: str = "subject_id") -> DataFrame:
    """(subject, n) of subjects in several rows."""
    return subjects.groupBy(subject).agg(F.count("*").alias("n")).where("n > 1")


def ranked(subjects: DataFrame, salt: str, by: str | None = None) -> DataFrame:
    """Subjects with ``rank``, from zero, in the order of (digest, id); within each ``by``, if given.

    Ranks are offsets of ranges of digests plus places in them, so no task orders all subjects.
    """
    return ranked_by(subjects, rank_digest(F.col("subject_id"), salt), by)


def ranked_by(subjects: DataFrame, key: Column, by: str | None = None) -> DataFrame:
    """As ``ranked``, by the uniform hex digest ``key``."""
    keyed = subjects.withColumn("_digest", key).withColumn("_part", F.conv(F.substring("_digest", 1, 2), 16, 10).cast("int"))
    return numbered(keyed, "_part", ["_digest", "subject_id"], "rank", by).drop("_digest", "_part")


def numbered(rows: DataFrame, part: str, order: list[str], into: str, by: str | None = None) -> DataFrame:
    """``rows`` with their places ``into`` from zero, in the order of (``part``, ``order``), within each ``by``.

    ``part``: small numbers of ranges; each range of each ``by`` is ordered by itself.
    """
    own = [by] if by else []
    sizes = rows.groupBy(*own, part).agg(F.count("*").alias("_n"))  # a row a range (of each ``by``)
    before = F.sum("_n").over(Window.partitionBy(*own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in (*own, part)], F.coalesce(before, F.lit(0)).alias("_before"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*own, part).orderBy(*order)) - 1)
    same = F.lit(True)
    for c in (*own, part):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    joined = placed.join(offsets, same)
    return joined.withColumn(into, (F.col("_place") + F.col("_before")).cast("long")).drop("_place", "_before", *[f"_of_{c}" for c in (*own, part)])


def ranges(rows: DataFrame, column: str, parts: int = 64, into: str = "_part") -> DataFrame:
    """``rows`` with the number of the range of ``column`` that they lie in; bounds are approximate quantiles."""
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx(column, shares, 1000)).first()[0] or []))  # ``parts`` values
    return rows.withColumn(into, sum((F.col(column) >= b).cast("int") for b in bounds) if bounds else F.lit(0))


def select_nested(subjects: DataFrame, n: int, salt: str) -> DataFrame:
    """The first ``n`` subjects by rank."""
    if n < 0:
        raise ValueError(f"n must not be negative; got {n}")
    if n > (size := subjects.count()):
        raise ValueError(f"cannot select {n} subjects from {size}")
    return ranked(subjects, salt).where(F.col("rank") < n)


def assign_shards(chosen: DataFrame, n: int, size: int) -> DataFrame:
    """Chosen subjects (with rank) of a member of ``n`` subjects, with their shard's key."""
    if size < 1:
        raise ValueError(f"the shard size must be positive; got {size}")
    return chosen.where(F.col("rank") < n).withColumn("shard", shard_key(F.col("rank"), size, F.lit(n)))


def family_members(ranks: DataFrame, sizes: list[int], shard_size: int) -> DataFrame:
    """(member, subject_id, rank, shard) of all members at once."""
    spark = ranks.sparkSession
    members = spark.createDataFrame([(int(n),) for n in sizes], "member long")  # a handful
    joined = ranks.join(F.broadcast(members), F.col("rank") < F.col("member"))
    return joined.select("member", "subject_id", "rank", shard_key(F.col("rank"), shard_size, F.col("member")).alias("shard"))


def shared_shards(members: DataFrame) -> DataFrame:
    """(shard, n_members) of shards that several members hold."""
    return members.select("member", "shard").distinct().groupBy("shard").agg(F.count("*").alias("n_members")).where("n_members > 1")


def member_splits(splits: DataFrame, n: int, salt: str, policy: str, train: str = "train") -> DataFrame:
    """(subject_id, split) of the member of ``n`` train subjects under a policy for the other splits."""
    if policy not in (PASSTHROUGH, SUBSET, DROP):
        raise ValueError(f"unknown policy {policy!r}")
    made = ranked(splits, salt, "split")
    own = (F.col("split") == train) & (F.col("rank") < n)
    other = F.col("split") != train
    keep = {DROP: own, PASSTHROUGH: own | other, SUBSET: own | (other & (F.col("rank") < n))}[policy]
    return made.where(keep).select("subject_id", "split")


def routed(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows with every shard that their subject is assigned to."""
    return rows.join(assignment.select("subject_id", "shard"), "subject_id")


def filter_subjects(rows: DataFrame, subjects: DataFrame) -> DataFrame:
    return rows.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")


def filter_cohort(rows: DataFrame, cohort: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of kept subjects and of those outside the cohort; rows without a subject go."""
    gone = cohort.select("subject_id").distinct().join(keep.select("subject_id").distinct(), "subject_id", "left_anti")
    return rows.where(F.col("subject_id").isNotNull()).join(gone, "subject_id", "left_anti")


def mixed_shards(rows: DataFrame, splits: DataFrame, train: str = "train") -> DataFrame:
    """Shards that hold both train and other subjects."""
    kinds = rows.select("subject_id", "shard").distinct().join(splits, "subject_id")
    grouped = kinds.groupBy("shard").agg(F.bool_or(F.col("split") == train).alias("has_train"), F.bool_or(F.col("split") != train).alias("has_other"))
    return grouped.where("has_train and has_other").select("shard")


def observed_codes(rows: DataFrame) -> DataFrame:
    return rows.select("code").where(F.col("code").isNotNull()).distinct()


def pruned_codes(codes: DataFrame, rows: DataFrame) -> DataFrame:
    """The code table's rows whose codes occur."""
    return codes.join(observed_codes(rows), "code", "left_semi")


def output_order(*ties: str) -> list[Column]:
    """The order of rows in a shard: subject, time and what settles ties, nulls first."""
    return [F.col(c).asc_nulls_first() for c in ("subject_id", "time", *ties)]


def sorted_for_output(rows: DataFrame, *ties: str, shard: str = "shard") -> DataFrame:
    """Rows clustered by shard, in a shard in the output order."""
    return rows.repartition(F.col(shard)).sortWithinPartitions(F.col(shard), *output_order(*ties))
