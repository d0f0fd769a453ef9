import datetime
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kohorta.functions.framing import canonical_row, combined, combined_ids, digest, folded, folded_whole, framed, short_id
from kohorta.functions.framing import text_digest as digest_of
from kohorta.functions.ranks import cutoff, rank_digest, uniform_score
from kohorta.operators import digests, resampling, selection, sizes


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "subject_id long")


def order(spark, values, salt):
    return [r.subject_id for r in selection.ranked(ids(spark, values), salt).orderBy("rank").collect()]


def text_digest(spark, items):
    return spark.createDataFrame([(items,)], "l array<string>").select(digest(F.col("l"))).first()[0].removeprefix("sha256:")


def test_ranks_and_scores(spark):
    assert ids(spark, [1]).select(rank_digest(F.col("subject_id"), "s")).first()[0] == "e2ce58fb211682f2bdd2d43c58c87d1313bff93e728a88d0ac901e1c0795ddcc"
    assert order(spark, range(101, 106), "demo") == [102, 105, 104, 103, 101]
    assert order(spark, range(101, 106), "other") == [104, 101, 105, 103, 102]
    scores = [round(r[0], 6) for r in ids(spark, [1, 2]).orderBy("subject_id").select(uniform_score(F.col("subject_id"), "s")).collect()]
    assert scores == [0.885961, 0.306495]


def test_shards(spark):
    made = selection.assign_shards(selection.ranked(ids(spark, range(100, 140)), "s"), 25, 10).orderBy("rank").collect()
    assert [r.subject_id for r in made][:10] == [109, 135, 111, 130, 113, 118, 102, 105, 133, 117]
    assert sorted({r.shard for r in made}) == ["r0000000000-0000000010", "r0000000010-0000000020", "r0000000020-0000000025"]
    members = selection.family_members(selection.ranked(ids(spark, range(100, 140)), "s"), [5, 12, 25, 40], 10)
    assert members.select("shard").distinct().count() == 7


def test_draws(spark):
    draw = lambda pool, n, r: [x.subject_id for x in resampling.with_replacement(ids(spark, pool), n, "s", r).orderBy("draw_index").collect()]
    assert draw([10, 20, 30, 40], 8, 0) == [20, 10, 30, 20, 30, 30, 40, 40]
    assert draw([10, 20, 30, 40], 8, 1) == [40, 10, 20, 40, 20, 10, 30, 40]
    own = lambda n, r: [x.subject_id for x in resampling.without_replacement(ids(spark, [10, 20, 30, 40]), n, "s", r).orderBy("draw_index").collect()]
    assert [own(3, r) for r in range(3)] == [[20, 30, 40], [10, 30, 40], [20, 40, 30]]
    boot = [x.subject_id for x in resampling.with_replacement(ids(spark, [68729, 239684, 814703, 1195293]), 4, "boot", 0).orderBy("draw_index").collect()]
    assert boot == [814703, 68729, 68729, 1195293]


def test_rejected_draws_are_passed_over(spark):
    limit = 2**63
    got = [x.subject_id for x in resampling.with_replacement(ids(spark, range(4)), 6, "s", 0, _cutoff=limit).orderBy("draw_index").collect()]
    stream = (int.from_bytes(hashlib.sha256(f"s|resample|0\x1f{c}".encode()).digest()[:8], "big") for c in range(200))
    assert got == [u % 4 for u in stream if u < limit][:6]
    assert cutoff(4) == 2**64 and cutoff(10) == 2**64 - 6


@pytest.mark.parametrize(("n", "pool", "message"), [(-1, [1], ">= 0"), (2, [], "empty pool has no subjects"), (1, [3, 3], "repeated subject 3")])
def test_draw_errors(spark, n, pool, message):
    with pytest.raises(ValueError, match=message):
        resampling.with_replacement(ids(spark, pool), n, "s", 0)


def test_digests(spark):
    want = {("a", "b"): "facdde7a", (): "e3b0c442", ("ab", "c"): "430fb1b4", ("a", "bc"): "5310a587", ("line1\nline2",): "7f148973", ("x\x1fy",): "79edb8cd"}
    for items, start in want.items():
        assert text_digest(spark, list(items)).startswith(start)
    short = spark.createDataFrame([(["a"],)], "l array<string>").select(short_id(digest(F.col("l")))).first()[0]
    assert short == "4162fddd39a3e422"
    assert digests.subject_set_digest(ids(spark, [1, 2, 2])).first()[0].startswith("sha256:c1a20b6b")
    with pytest.raises(Exception, match="not a digest"):
        spark.createDataFrame([("x",)], "d string").select(short_id(F.col("d"))).collect()


def test_canonical_values(spark):
    one = lambda value, kind: spark.createDataFrame([(value,)], f"x {kind}").select(canonical_row(spark.createDataFrame([(value,)], f"x {kind}").schema)).first()[0]
    assert one(None, "string") == "x=-1:" and one("", "string") == "x=0:" and one("é", "string") == "x=2:é"
    assert one(1.0, "double") == "x=19:4607182418800017408" and one(-0.0, "float") == "x=19:9223372036854775808" and one(None, "float") == "x=-1:"
    assert one(float("nan"), "double") == "x=19:9221120237041090560"
    assert one(datetime.datetime(2021, 1, 1), "timestamp_ntz") == "x=16:1609459200000000"
    assert one(datetime.date(2021, 1, 2), "date") == "x=10:2021-01-02" and one(True, "boolean") == "x=4:true"
    assert one(["a", None], "array<string>") == "x=6:1:a-1:" and one(None, "array<string>") == "x=-1:"
    with pytest.raises(TypeError, match="'x'"):
        one(bytearray(b"a"), "binary")
    with pytest.raises(ValueError, match="reserved"):
        canonical_row(spark.createDataFrame([(1,)], "`a=b` int").schema)
    assert spark.range(1).select(framed(F.lit(None).cast("string"))).first()[0] == "-1:"


def test_streamed_folds_equal_aggregates(spark):
    rows = spark.createDataFrame([(i, f"c{i % 3}") for i in range(50)], "subject_id long, code string")
    each = digests.subject_digests(rows)
    plain = sorted(r.digest for r in each.collect())
    assert each.agg(combined(F.col("digest"))).first()[0] == digest_of(plain) == folded_whole(each, F.col("digest")).first()[0]
    by = folded(each.repartition(7), F.col("subject_id") % 3, F.col("digest"), F.col("subject_id")).collect()
    own = {r.subject_id: r.digest for r in each.collect()}
    assert {r.group: r.digest for r in by} == {str(k): digest_of(own[i] for i in range(50) if i % 3 == k) for k in range(3)}
    assert folded_whole(each.limit(0), F.col("digest")).first()[0] == digest_of([])
    assert combined_ids({"b": "2", "a": "1"}) == digest_of(["a=1", "b=2"])


def test_content_id_ignores_order_and_partitions(spark):
    rows = [(i % 7, f"c{i}", float(i)) for i in range(60)] + [(1, "c1", -0.0), (1, "c1", -0.0), (2, None, None)]
    splits = spark.createDataFrame([(i, "train" if i % 2 else "held_out") for i in range(7)], "subject_id long, split string")
    make = lambda r, n: sorted(map(tuple, digests.content_ids(spark.createDataFrame(r, "subject_id long, code string, numeric_value float").repartition(n), splits).collect()))
    assert make(rows, 1) == make(rows[::-1], 5)
    assert make(rows, 1) != make(rows[:-1], 1)


def test_rows_rendered_at_a_pinned_schema(spark):
    narrow = spark.createDataFrame([(1, "a")], "subject_id long, code string")
    wide = spark.createDataFrame([(1, "a", None)], "subject_id long, code string, numeric_value float")
    own = lambda rows, schema: [r.digest for r in digests.subject_digests(rows, schema=schema).collect()]
    assert own(narrow, wide.schema) == own(wide, None) != own(narrow, None)
    with pytest.raises(ValueError, match="numeric_value"):
        digests.subject_digests(wide, schema=narrow.schema)
    with pytest.raises(KeyError):
        digests.subject_digests(narrow.drop("subject_id"))


def test_token_windows(spark):
    from kohorta.functions.windows import n_windows

    cases = [(100, 40, None, 1), (30, 40, 20, 1), (100, 40, 20, 4), (41, 40, 20, 2), (0, 40, 20, 1), (80, 40, 40, 2), (50, 40, 40, 2)]
    for length, width, stride, want in cases:
        assert spark.range(1).select(n_windows(F.lit(length), width, stride)).first()[0] == want
    counts = spark.createDataFrame([(3, 10, 2), (3, 20, 2)], "events long, measurements long, statics long")
    row = sizes.token_projection(counts, 100).first()
    assert (row.n_subjects, row.n_windows, row.n_corpus_tokens, row.n_trained_tokens) == (2, 2, 34, 34)
    with pytest.raises(ValueError, match="unknown mode"):
        sizes.token_projection(counts, 10, "XX")


def test_guards_and_filters(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (9, "d")], "subject_id long, code string")
    kept = selection.filter_cohort(rows, ids(spark, [1, 2]), ids(spark, [2])).collect()
    assert sorted(r.subject_id for r in kept) == [2, 9]
    with pytest.raises(ValueError, match="cannot select 5"):
        selection.select_nested(ids(spark, [1, 2]), 5, "s")
    with pytest.raises(ValueError, match="unknown policy"):
        selection.member_splits(spark.createDataFrame([(1, "train")], "subject_id long, split string"), 1, "s", "other")


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(-(2**62), 2**62), min_size=1, max_size=40), st.text(st.characters(codec="ascii", categories=["L", "N"]), min_size=1, max_size=8))
def test_nesting_and_order_independence(spark, pool, salt):
    pool = sorted(pool)
    want = sorted(pool, key=lambda i: (hashlib.sha256(f"{salt}\x1f{i}".encode()).hexdigest(), i))
    assert order(spark, pool, salt) == want == order(spark, pool[::-1], salt)


def test_entry_and_queries(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in ("routed_counts", "tensor_slice", "replicate_stats", "schema_union"):
        assert entry.queries()[name](spark, sf_dir).count() > 0


def test_incremental_digests(spark, tmp_path):
    from kohorta.streaming import keep_subject_digests

    rows = spark.createDataFrame([(i % 5, f"c{i}") for i in range(20)], "subject_id long, code string")
    rows.where("subject_id < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where("subject_id >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keep_subject_digests(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    got = {r.subject_id: r.digest for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.subject_id: r.digest for r in digests.subject_digests(rows).collect()}
