"""What keeps a task's work bounded when a shard, a file or a batch is large."""

import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kohorta import catalog
from kohorta.catalog import Catalog
from kohorta.config import SubsetConfig
from kohorta.plans import views
from kohorta.sources import sinks, tensors
from kohorta.sources.dataset import EventDataset, below
from kohorta.sources.sinks import write_one_file, write_partitioned
from kohorta.sources.tensors import open_tensors, ragged_batches, read_tensors, write_tensors
from kohorta.sources.uris import Folder, UriDataset


@pytest.fixture
def uncoalesced(spark):
    """Small data is dealt as large data is."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_large_shard_is_sorted_by_several_tasks(spark, tmp_path, monkeypatch, uncoalesced):
    seen = {}
    whole = sinks.concatenate
    monkeypatch.setattr(sinks, "concatenate", lambda s, wanted: seen.update({p.stem: len(x) for p, x in wanted.items()}) or whole(s, wanted))
    rows = spark.range(4000, numPartitions=3).selectExpr("if(id % 50 = 0, 'b/1', 'a') AS key", "if(id % 7 = 0, null, id * 7919 % 4001) AS x", "timestamp_micros(id) AS at", "timestamp_ntz '2020-01-01' AS flat")
    write_partitioned(rows, "key", ["a", "b/1", "none"], lambda k: tmp_path / f"{k}.parquet", tmp_path, ["x", "at", "flat"], [F.col("x").asc_nulls_first(), F.col("at")])
    assert seen["a"] > 1
    for key in ("a", "b/1"):
        want = rows.where(F.col("key") == key).orderBy(F.col("x").asc_nulls_first(), "at").drop("key").collect()
        assert spark.read.parquet(str(tmp_path / f"{key}.parquet")).dtypes == rows.drop("key").dtypes
        assert [tuple(r) for r in spark.read.parquet(str(tmp_path / f"{key}.parquet")).collect()] == [tuple(r) for r in want]
    assert spark.read.parquet(str(tmp_path / "none.parquet")).count() == 0
    write_one_file(rows.orderBy("at"), tmp_path / "one.parquet")
    assert seen["one"] > 1 and [r.at for r in spark.read.parquet(str(tmp_path / "one.parquet")).collect()] == [r.at for r in rows.orderBy("at").collect()]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.parquet", "b", "none.parquet", "one.parquet"]


def test_a_large_shard_at_a_uri_is_several_files(spark, tmp_path, monkeypatch, uncoalesced):
    root = tmp_path / "parent"
    rows = spark.range(6000).selectExpr("id % 300 AS subject_id", "timestamp_ntz '2020-01-01' + make_dt_interval(0, 0, id) AS time", "concat('c', id % 9) AS code", "cast(id AS float) AS numeric_value")
    write_one_file(rows, root / "data/train/0.parquet")
    write_one_file(spark.range(300).selectExpr("id AS subject_id", "'train' AS split"), root / "metadata/subject_splits.parquet")
    own = Catalog(spark, f"file://{tmp_path}/tables")
    own.build(UriDataset(spark, f"file://{root}"), SubsetConfig((100, 300), n_subjects_per_shard=300), labels=rows.select("subject_id", F.col("time").alias("prediction_time")))
    assert own.files().groupBy("kind", "stored").count().agg(F.max("count")).first()[0] > 1
    assert sorted(map(tuple, own.events(300).drop("shard").collect())) == sorted(map(tuple, rows.collect()))
    assert own.labels(300).count() == 6000 and own.labels(100).count() == 2000
    report = {r.member: r for r in own.report().collect()}
    assert (report[300].n_shards, report[300].n_measurements, report[100].n_measurements) == (1, 6000, 2000)
    monkeypatch.setattr(catalog, "decoded", lambda path: F.raise_error(F.lit("decoded")).cast("string"))  # names are known by file, not read from each row's path
    assert {r.shard for r in own.events(300).select("shard").collect()} == {"train/0"}


def test_names_of_shards_are_cut_from_plain_paths(spark, tmp_path):
    write_one_file(spark.range(3).withColumnRenamed("id", "subject_id"), tmp_path / "data/train/0.parquet")
    raw, never = F.col("_metadata.file_path"), F.raise_error(F.lit("decoded")).cast("string")
    rows = spark.read.parquet(str(tmp_path / "data/train/0.parquet"))
    for prefix in ((tmp_path / "data").as_uri() + "/", Folder(spark, f"file://{tmp_path}").prefix("data")):
        assert {r[0] for r in rows.select(below(raw, prefix, never)).collect()} == {"train/0"}
    assert {r[0] for r in EventDataset(spark, tmp_path).events().select("shard").collect()} == {"train/0"}


def test_tensors_are_written_and_read_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(views, "PIECE", 20)
    ids = np.sort(np.random.default_rng(1).integers(0, 25, 200))
    table = pa.table({"shard": ["a" if i < 13 else "b" for i in ids], "subject_id": ids, "x": np.arange(200)})
    pieces = list(views._pieces(iter(table.to_batches(max_chunksize=7)), ["shard", "subject_id", "x"]))
    assert pa.concat_tables([t for _, t in pieces]).equals(table) and len(pieces) > 6
    assert max(t.num_rows for _, t in pieces) <= 20 + 7 + max(np.bincount(ids))
    owners = [(name, i) for name, t in pieces for i in set(t["subject_id"].to_pylist())]
    assert len(owners) == len(set(owners)) == len(set(ids.tolist()))  # a subject is one piece's
    made = {"dim1/bounds": np.arange(1, 41) * 2, "dim1/v": np.arange(80, dtype="<f4"), "dim2/bounds": np.arange(1, 81) * 3, "dim2/code": np.arange(240)}
    write_tensors(tmp_path / "x.nrt", made)
    monkeypatch.setattr(tensors.Stored, "STEP", 24)
    stored, whole = open_tensors(tmp_path / "x.nrt"), read_tensors(tmp_path / "x.nrt")
    places = np.array([39, 0, 7, 7, 21])
    assert all(np.array_equal(stored[n][3:9], whole[n][3:9]) and np.array_equal(stored[n][places], whole[n][places]) for n in made)
    types = {"dim1/v": "float", "dim2/code": "bigint"}
    parts = [r for first in range(0, 40, 13) for b in ragged_batches(tmp_path / "x.nrt", types, 8, (first, first + 13)) for r in b.to_pylist()]
    assert parts == [r for b in ragged_batches(tmp_path / "x.nrt", types) for r in b.to_pylist()] and len(parts) == 40


def test_streamed_rows_are_kept_as_they_came(spark, tmp_path):
    from kohorta.operators import digests
    from kohorta.streaming import keep_subject_digests, kept_digests

    rows = spark.createDataFrame([(i % 5, float(i), f"c{i}", datetime.datetime(2020, 1, 1), i % 3) for i in range(40)], "subject_id long, bucket double, code string, time timestamp_ntz, batch int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    keep_subject_digests(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    kept = pq.read_schema(next((tmp_path / "out").glob("_rows/batch=0/*/*.parquet")))
    assert kept.names == ["_subject", "row"] and [f.name for f in kept.field("row").type] == rows.columns
    assert {r.subject_id: r.digest for r in kept_digests(spark, str(tmp_path / "out")).collect()} == {r.subject_id: r.digest for r in digests.subject_digests(rows).collect()}
