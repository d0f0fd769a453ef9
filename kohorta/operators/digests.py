"""Content ids that depend on rows only, not on their order or files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.framing import SEPARATOR, by_digest, canonical_row, combined, digest, folded, folded_by, folded_whole
from .selection import ranges


def pinned(rows: DataFrame, schema: T.StructType | None) -> DataFrame:
    """``rows`` with the columns of ``schema``: missing ones null; others than those are refused, as an id would leave them out."""
    if schema is None:
        return rows
    if extra := sorted(set(rows.columns) - set(schema.names)):
        raise ValueError(f"columns {extra} are not in the schema that rows are rendered at")
    return rows.select(*[F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def canonical_rows(rows: DataFrame, subject: str = "subject_id", schema: T.StructType | None = None) -> DataFrame:
    """(subject, canonical row), of the columns of ``schema`` if given; rendered before any grouping, which would lose -0.0."""
    rows = pinned(rows, schema)
    if subject not in rows.columns:
        raise KeyError(subject)
    return rows.select(F.col(subject), canonical_row(rows.schema).alias("canonical"))


def subject_digests(rows: DataFrame, subject: str = "subject_id", schema: T.StructType | None = None) -> DataFrame:
    """(subject, digest) over each subject's sorted rows, which are sorted with spilling and streamed, whatever their number."""
    return folded_by(canonical_rows(rows, subject, schema), subject, "canonical")


def subject_table(rows: DataFrame, held: str | None = None) -> DataFrame:
    """(subject_id, digest, events, measurements, statics, codes) of every subject, in every ``held`` (a file, say) if that is given.

    Rows go to two aggregations: canonical texts are sorted and streamed, three columns are counted.
    """
    names = ["subject_id"] if held is None else [held, "subject_id"]
    key = F.concat_ws(SEPARATOR, *[F.col(n).cast("string") for n in names]).alias("_key")
    own = rows.where(F.col("subject_id").isNotNull())
    found = folded_by(own.select(key, canonical_row(rows.drop(held).schema if held else rows.schema).alias("canonical")), "_key", "canonical")
    counts = own.groupBy(key, *names).agg(
        F.countDistinct("time").alias("events"), F.count("*").alias("measurements"), F.sum(F.col("time").isNull().cast("long")).alias("statics"), F.collect_set("code").alias("codes")
    )
    return counts.join(found, "_key").select(*names, "digest", "events", "measurements", "statics", "codes")


def tagged(subject: Column, value: Column) -> Column:
    return digest(F.array(subject.cast("string"), value))


def content_ids(rows: DataFrame, splits: DataFrame, subject: str = "subject_id") -> DataFrame:
    """(split, content_id) of the subjects that have rows."""
    return content_ids_of(subject_digests(rows, subject).join(splits.select(subject, "split"), subject), "split", subject)


def content_ids_of(each: DataFrame, by: str, subject: str = "subject_id") -> DataFrame:
    """(``by``, content_id) of rows (``by``, subject, digest)."""
    named = each.select(F.col(by), tagged(F.col(subject), F.col("digest")).alias("tag"))
    return folded(named, F.col(by), F.col("tag"), into="content_id", part=by_digest(F.col("tag"))).withColumnRenamed("group", by)


def frame_digest(rows: DataFrame) -> DataFrame:
    """One row: the digest of the table as a multiset of rows."""
    return folded_whole(rows.select(digest(F.array(canonical_row(rows.schema))).alias("d")), F.col("d"), into="frame_digest", part=by_digest(F.col("d")))


def subject_set_digest(subjects: DataFrame, subject: str = "subject_id", keep_repeats: bool = False) -> DataFrame:
    """One row: the digest of the ids in numeric order, as a set or as a multiset."""
    ids = subjects.select(F.col(subject).alias("id")).where("id IS NOT NULL")
    placed = ranges(ids if keep_repeats else ids.distinct(), "id", into="range")
    return folded_whole(placed, F.col("id").cast("string"), F.col("id"), "subject_digest", F.col("range"))


def subject_set_digests(subjects: DataFrame, by: str, subject: str = "subject_id") -> DataFrame:
    """(group, digest): for each ``by`` the digest of its ids, repeats and all, in numeric order."""
    placed = ranges(subjects.select(F.col(by), F.col(subject).alias("id")).where("id IS NOT NULL"), "id", into="range")
    return folded(placed, F.col(by), F.col("id").cast("string"), F.col("id"), part=F.col("range"))


def dataset_id(ids: DataFrame, codes_id: DataFrame) -> DataFrame:
    """One row, from (split, content_id) rows and the one-row digest of the code table."""
    parts = ids.select(F.concat(F.lit("data/"), "split", F.lit("="), "content_id").alias("part"))
    codes = codes_id.select(F.concat(F.lit("metadata/codes.parquet="), F.col(codes_id.columns[0])).alias("part"))
    return parts.unionByName(codes).agg(combined(F.col("part")).alias("dataset_id"))

