import pyarrow as pa
from pyspark.sql import functions as F

from kohorta.functions import framing
from kohorta.functions.framing import by_digest, folded, text_digest
from kohorta.operators import digests


def test_a_subject_over_several_batches_has_one_digest(spark, tmp_path):
    from kohorta.streaming import keep_subject_digests, kept_digests

    rows = spark.createDataFrame([(i % 7, f"c{i % 11}", None if i % 4 else float(i)) for i in range(90)], "subject_id long, code string, numeric_value double")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    seen = rows.limit(0)
    for part in range(3):  # every subject has rows in every batch, but subject 6, which comes in the last one
        own = rows.where(f"pmod(xxhash64(code), 3) = {part} and (subject_id < 6 or {part} = 2)")
        own.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = seen.unionByName(own)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        keep_subject_digests(stream, out, checkpoint).awaitTermination(120)
        got = {r.subject_id: r.digest for r in kept_digests(spark, out).collect()}
        assert got == {r.subject_id: r.digest for r in digests.subject_digests(seen).collect()}
    assert len(got) == 7


def test_a_batch_writes_a_bounded_number_of_files(spark, tmp_path):
    from kohorta.streaming import BUCKETS, keep_subject_digests, kept_digests

    # half of the rows are one subject's, and all tasks have rows of all buckets
    rows = spark.range(6000, numPartitions=8).selectExpr("if(id % 2 = 0, -1, id) AS subject_id", "concat('c', id % 100) AS code")
    rows.write.parquet(str(tmp_path / "in"))
    out = tmp_path / "out"
    keep_subject_digests(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(out), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert len(list(out.glob("_rows/batch=0/*/*.parquet"))) <= BUCKETS + int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r.subject_id: r.digest for r in kept_digests(spark, str(out)).collect()}
    assert got == {r.subject_id: r.digest for r in digests.subject_digests(rows).collect()} and len(got) == 3001


def test_folds_by_ranges_give_the_same_ids(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice(["a", "b", None, "c/d"]), text_digest([str(r.random())])) for _ in range(4000)]
    table = spark.createDataFrame(rows, "g string, v string").repartition(5)
    want = {g: text_digest(sorted(v for k, v in rows if k == g)) for g in {k for k, _ in rows}}
    for part in (None, by_digest(F.col("v"))):
        assert {x.group: x.digest for x in folded(table, F.col("g"), F.col("v"), part=part).collect()} == want
    ids = [r.randrange(-(2**62), 2**62) for _ in range(1000)] + [5, 5, -7, None]
    table = spark.createDataFrame([(i,) for i in ids], "subject_id long")
    plain = sorted(i for i in ids if i is not None)
    assert digests.subject_set_digest(table).first()[0] == text_digest(map(str, sorted(set(plain))))
    assert digests.subject_set_digest(table, keep_repeats=True).first()[0] == text_digest(map(str, plain))
    assert digests.subject_set_digest(table.limit(0)).first()[0] == text_digest([])
    texts = ["", "ab", "é" * 9, "x" * 5000] * 20
    batches = [pa.RecordBatch.from_pydict({"group": pa.array(["g"] * 40 + [None] * 40), "part": pa.array([0] * 20 + [1] * 60, pa.int32()), "text": texts})]
    blocks = [b.to_pylist()[0] for b in framing._pack(iter(batches), 6000)]
    assert [(b["group"], b["part"], b["place"]) for b in blocks][:4] == [("g", 0, 0), ("g", 1, 0), (None, 1, 0)][: len(blocks)]
    assert b"".join(b["block"] for b in blocks) == b"".join(f"{len(t.encode())}:{t}".encode() for t in texts)


def test_large_and_null_subjects_are_streamed(spark):
    rows = [(1, f"c{i % 50}", float(i)) for i in range(20_000)] + [(None, "c", None), (2, None, -0.0), (2, "c", float("nan"))]
    table = spark.createDataFrame(rows, "subject_id long, code string, numeric_value double").repartition(4)
    canonical = digests.canonical_rows(table).collect()
    want = {s: text_digest(sorted(r.canonical for r in canonical if r.subject_id == s)) for s in (1, 2, None)}
    assert {r.subject_id: r.digest for r in digests.subject_digests(table).collect()} == want
