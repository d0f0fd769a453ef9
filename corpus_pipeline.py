"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which ``run`` writes as Parquet to the shared folder
and reads again as the next stage's documents.  A document that a stage rejects is gone for the later ones.

Defined results: null and empty texts have no words, so the first stage rejects them; of rows with equal ids each
is judged by itself, and of equal rows one stays; null ids are kept; documents of which no passage is left go; an
empty table gives an empty table; columns beside doc_id and text pass through (n_chars, where there is one, counts
what is left of the text), whatever their names, and the last stage returns the pieces of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.llm import decontamination, near_duplicates, packing, quality_rules, repeats
from kohorta.llm.common import stored
from kohorta.llm.queries import _tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from the labelled ones."""
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.kept_documents(docs, rules)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_duplicates.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that occur anywhere else; those of which nothing is left go."""
    cut = repeats.without_repeats(docs, length=repeats.WORDS, gram=repeats.WORD_GRAM, unit=repeats.WORD_UNIT)
    left = cut.where(F.length(F.trim("text")) > 0)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens and their places in training sequences."""
    return packing.packed(docs, _tokenizer())


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicate),
    ("repeated passages", repeated_passages),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Learning, tokenizing and packing can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
