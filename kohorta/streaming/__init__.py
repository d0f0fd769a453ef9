"""Incremental digests of appended rows.

The data model has no unbounded streams; this keeps subjects' digests up to date while rows are appended, a
subject's over several micro-batches too:

    _rows/batch=<n>/bucket=<b>/...   the batch's rows, as they came
    batch=<n>/...                    the digests of the batch's subjects, over their rows of this and earlier batches

Only rows of a batch's own subjects are read again, from the buckets that they lie in.  A batch's rows are laid out by ranges
of bucket, subject and row, so that it writes about as many files as it has tasks and buckets, and a subject with most of the rows
is several tasks' in that write, if they differ; the digest itself is one task's.  To choose the ranges the batch is read once more.
A batch that is run again replaces what it wrote.

Rows are stored and dealt to tasks as they came, and rendered where they are sorted: their canonical texts are several times
as long.  They are dealt by subject once, for the join with the batch's subjects and for the digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.framing import folded_by
from ..operators.digests import canonical_rows

BUCKETS = 64


def keep_subject_digests(events: DataFrame, path: str, checkpoint: str, subject: str = "subject_id") -> StreamingQuery:
    """A query that adds each micro-batch's rows and writes its subjects' digests; the stream's columns are the digests' columns."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(subject), F.lit(BUCKETS)).cast("int")
        own = f"{path}/_rows/batch={number}"
        rows = batch.select(F.col(subject).alias("_subject"), F.struct("*").alias("row"), bucket.alias("bucket"))
        rows.repartitionByRange("bucket", "_subject", "row").write.mode("overwrite").partitionBy("bucket").parquet(own)
        written = T.StructType([*rows.select("_subject", "row").schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        touched = spark.read.schema(written).parquet(own).select("_subject", "bucket").distinct()
        held = spark.read.schema(written).parquet(f"{path}/_rows").where(F.col("batch") <= number)
        used = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # ``BUCKETS`` at most
        dealt = held.where(F.col("bucket").isin(used)).select("_subject", "row").repartition("_subject")
        some = dealt.join(touched.select("_subject").repartition("_subject"), "_subject", "left_semi")
        folded_by(canonical_rows(some.select("row.*"), subject), subject, "canonical", dealt=True).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_digests(spark: SparkSession, path: str, subject: str = "subject_id") -> DataFrame:
    """(subject, digest) as of the last batch that had rows of the subject."""
    return spark.read.parquet(path).groupBy(subject).agg(F.max_by("digest", "batch").alias("digest"))
