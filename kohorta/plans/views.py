"""The benchmark tables as an event table with splits, in Spark and in SQL."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import uniform_score
from ..sources.dataset import CODES_FILE, SPLITS_FILE
from ..sources.sinks import ROW_GROUP, concatenated, publish, write_one_file, write_partitioned
from ..sources.tensors import DATA, EVENT_BOUNDS, MEASUREMENT_BOUNDS, SCHEMAS, SUFFIX, Slice, open_tensors, write_slices, write_tensors
from ..sources.uris import shared_folder

SPLIT_SALT, SALT = "split", "kohorta"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are static rows, orders and their line items timed ones at the order's date."""
    row = lambda subject, time, code, value: [F.col(subject).alias("subject_id"), time.alias("time"), code.alias("code"), value.cast("float").alias("numeric_value")]
    customers = table(spark, sf_dir, "customer").select(row("c_custkey", F.lit(None).cast("timestamp_ntz"), F.concat(F.lit("SEG//"), "c_mktsegment"), F.lit(None)))
    orders = table(spark, sf_dir, "orders")
    placed = orders.select(row("o_custkey", F.col("o_orderdate"), F.concat(F.lit("ORDER//"), "o_orderpriority"), F.col("o_totalprice")))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity").join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return customers.unionByName(placed).unionByName(items.select(row("o_custkey", F.col("o_orderdate"), F.concat(F.lit("ITEM//"), "l_returnflag"), F.col("l_quantity"))))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, split); about a fiftieth of the customers has none."""
    scored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), uniform_score(F.col("c_custkey"), SPLIT_SALT).alias("u"))
    name = F.when(F.col("u") < 0.8, "train").when(F.col("u") < 0.9, "tuning").when(F.col("u") < 0.98, "held_out")
    return scored.withColumn("split", name).where(F.col("split").isNotNull()).select("subject_id", "split")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("label_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("prediction_time"), (F.col("o_totalprice") > 100000).alias("boolean_value"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code table: every segment, flag and priority, and some codes that no row has."""
    made = events(spark, sf_dir).select("code").distinct()
    extra = table(spark, sf_dir, "part").select(F.concat(F.lit("PART//"), "p_brand").alias("code")).distinct()
    return made.unionByName(extra).withColumn("description", F.concat(F.lit("about "), "code"))


_kept: dict[tuple[str, str], Path] = {}
_folders: list[tempfile.TemporaryDirectory] = []
SHARDS_PER_SPLIT = 3


def once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[Path], object]) -> Path:
    """A folder that ``write`` has filled, in the folder that all machines share; made once a process, gone with it."""
    if (sf_dir, name) not in _kept:
        shared = urlparse(shared_folder(spark))
        if shared.scheme != "file":
            raise ValueError(f"dataset folders with links need a mounted file system; spark.checkpoint.dir is {shared.geturl()}")
        Path(shared.path).mkdir(parents=True, exist_ok=True)
        made = tempfile.TemporaryDirectory(prefix=f"kohorta-{name}-", dir=shared.path, ignore_cleanup_errors=True)
        write(Path(made.name))
        _folders.append(made)
        _kept[sf_dir, name] = Path(made.name)
    return _kept[sf_dir, name]


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of listed subjects with the shard that a dataset folder has them in."""
    return events(spark, sf_dir).join(splits(spark, sf_dir), "subject_id").withColumn("shard", _shard())


def _shard() -> Column:
    return F.concat("split", F.lit("/"), F.pmod("subject_id", F.lit(SHARDS_PER_SPLIT)).cast("string"))


def folder(spark: SparkSession, sf_dir: str) -> Path:
    """The view of listed subjects as a dataset folder, and its labels under ``labels/orders``."""

    def write(root: Path) -> None:
        rows = filed(spark, sf_dir)
        keys = [r["shard"] for r in splits(spark, sf_dir).select(_shard().alias("shard")).distinct().collect()]  # every listed subject has a row
        order = [F.col("subject_id"), F.col("time").asc_nulls_first()]
        write_partitioned(rows, "shard", keys, lambda k: root / "data" / f"{k}.parquet", root, ["subject_id", "time", "code", "numeric_value"], order)
        write_one_file(splits(spark, sf_dir), root / SPLITS_FILE)
        write_one_file(codes(spark, sf_dir), root / CODES_FILE)
        write_one_file(labels(spark, sf_dir).orderBy("label_id").select("subject_id", "prediction_time", "boolean_value"), root / "labels/orders/0.parquet")

    return once(spark, sf_dir, "view", write)


def appended(spark: SparkSession, sf_dir: str) -> Path:
    """The view's rows in files by ranges of time, rows without one first: a subject's rows lie in many of them."""
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    write = lambda root: events(spark, sf_dir).repartitionByRange(n, F.col("time").asc_nulls_first(), "subject_id").write.parquet(f"file://{root}/rows")
    return once(spark, sf_dir, "appended", write) / "rows"


#: Rows that a piece of a tensor file is made of, about.
PIECE = 1 << 18


def _pieces(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[str, pa.Table]]:
    """(shard, rows) of whole subjects, about ``PIECE`` rows at a time, of rows that come in the order of shard and subject."""
    held: list[pa.RecordBatch] = []

    def cut(rows: pa.Table) -> Iterator[tuple[str, pa.Table]]:
        shards = rows.column("shard").combine_chunks().dictionary_encode()
        codes = shards.indices.to_numpy()
        edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
        for first, end in zip(edges, edges[1:], strict=False):
            if end > first:
                yield rows.column("shard")[first].as_py(), rows.slice(first, end - first)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch.select(columns))
        if sum(b.num_rows for b in held) < PIECE:
            continue
        rows = pa.Table.from_batches(held)
        last = rows.num_rows - 1
        ids, shards = rows.column("subject_id").to_numpy(), rows.column("shard")
        other = np.flatnonzero((ids != ids[last]) | pc.not_equal(shards, shards[last]).to_numpy(zero_copy_only=False))
        whole = int(other[-1]) + 1 if len(other) else 0
        yield from cut(rows.slice(0, whole))
        held = rows.slice(whole).to_batches()  # the last subject may go on
    if held:
        yield from cut(pa.Table.from_batches(held))


def _piece(table: pa.Table, path: Path) -> None:
    """Writes the tensors of some subjects' rows, and their schema beside them."""
    frame = table.to_pandas().sort_values(["subject_id", "time", "code", "numeric_value"], na_position="first")
    ids = np.unique(frame["subject_id"].to_numpy())
    static, timed = frame[frame["time"].isna()], frame[frame["time"].notna()]
    statics = static.groupby("subject_id")["code"].agg(list).reindex(ids)
    each = timed.groupby(["subject_id", "time"]).size()
    events_of = each.groupby("subject_id").size().reindex(ids, fill_value=0)
    made = {
        EVENT_BOUNDS: events_of.to_numpy().cumsum().astype("<i8"), "dim1/time_delta_days": np.ones(len(each), "<f4"), MEASUREMENT_BOUNDS: each.to_numpy().cumsum().astype("<i8"),
        "dim2/code": timed["code"].to_numpy().astype("<i8"), "dim2/numeric_value": timed["numeric_value"].to_numpy().astype("<f4"),
    }
    schema = pa.table({"subject_id": pa.array(ids), "static_code": pa.array([x if isinstance(x, list) else None for x in statics], pa.list_(pa.uint8()))})
    publish(lambda aside: write_tensors(aside, made), Path(f"{path}{SUFFIX}"))
    publish(lambda aside: pq.write_table(schema, aside, row_group_size=ROW_GROUP), Path(f"{path}.parquet"))


def tensors(spark: SparkSession, sf_dir: str) -> Path:
    """The view as a tensor cohort: a code's number is its length; subjects lie by id, events by time, measurements by code and value.

    Tasks write pieces of bounded numbers of rows; a task a shard then copies its pieces into one file, a few megabytes at a time.
    """

    def write(root: Path) -> None:
        columns = ["shard", "subject_id", "time", "code", "numeric_value"]
        rows = filed(spark, sf_dir).select("shard", "subject_id", "time", F.length("code").cast("long").alias("code"), "numeric_value")
        aside = root / ".pieces"

        def cut(batches):
            for shard, table in _pieces(batches, columns):
                first, name = table.column("subject_id")[0].as_py(), uuid.uuid4().hex
                _piece(table.select(columns[1:]), aside / name)
                yield pa.RecordBatch.from_pylist([{"shard": shard, "first": first, "name": name}])

        def join(key, frame):
            own = [aside / x for x in frame.sort_values("first")["name"]]
            slices = [Slice(found, np.arange(len(found[EVENT_BOUNDS]))) for found in (open_tensors(f"{p}{SUFFIX}") for p in own)]
            publish(lambda to: write_slices(to, slices), root / DATA / f"{key[0]}{SUFFIX}")
            publish(lambda to: concatenated([f"{p}.parquet" for p in own], to), root / SCHEMAS / f"{key[0]}.parquet")
            return frame[["shard"]].head(1)

        ranged = rows.repartitionByRange("shard", "subject_id").sortWithinPartitions("shard", "subject_id")
        made = ranged.mapInArrow(cut, "shard string, first bigint, name string").collect()  # a row a piece
        listed = spark.createDataFrame(made, "shard string, first bigint, name string")
        listed.groupBy("shard").applyInPandas(join, "shard string").count()
        shutil.rmtree(aside, ignore_errors=True)
        write_one_file(codes(spark, sf_dir), root / CODES_FILE)

    return once(spark, sf_dir, "tensors", write)


# The same in DuckDB's SQL.
U64 = "CAST('0x' || substr({h}, 1, 16) AS UBIGINT)"
EVENTS = """ev AS (
  SELECT c_custkey AS subject_id, CAST(NULL AS TIMESTAMP) AS time, 'SEG//' || c_mktsegment AS code, CAST(NULL AS FLOAT) AS numeric_value FROM customer
  UNION ALL SELECT o_custkey, o_orderdate, 'ORDER//' || o_orderpriority, CAST(o_totalprice AS FLOAT) FROM orders
  UNION ALL SELECT o_custkey, o_orderdate, 'ITEM//' || l_returnflag, CAST(l_quantity AS FLOAT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def rank_sql(subject: str, salt: str) -> str:
    return f"sha256('{salt}' || chr(31) || CAST({subject} AS VARCHAR))"


def score_sql(subject: str, salt: str) -> str:
    return f"(CAST({U64.format(h=rank_sql(subject, salt))} >> 11 AS DOUBLE) / 9007199254740992.0)"


SPLITS = f"""sp AS (
  SELECT subject_id, split FROM (
    SELECT c_custkey AS subject_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'tuning' WHEN u < 0.98 THEN 'held_out' END AS split
    FROM (SELECT c_custkey, {score_sql("c_custkey", SPLIT_SALT)} AS u FROM customer)) WHERE split IS NOT NULL)"""
LABELS = "lb AS (SELECT o_orderkey AS label_id, o_custkey AS subject_id, o_orderdate AS prediction_time, o_totalprice > 100000 AS boolean_value FROM orders)"
CODES = """cd AS (SELECT code, 'about ' || code AS description FROM (
  SELECT DISTINCT code FROM ev UNION ALL SELECT DISTINCT 'PART//' || p_brand FROM part))"""
