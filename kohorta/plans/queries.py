"""One query for each operator over the event view, and the SQL that checks it."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import reports
from ..build import FAMILY, build_family, build_resamples
from ..catalog import Catalog, Resamples
from ..config import ResampleConfig, SubsetConfig
from ..functions.framing import digest, short_id
from ..functions.ranks import uniform_score
from ..operators import digests, ragged, resampling, selection, sizes
from ..sources.dataset import EventDataset, read_excluded, read_labels, read_shards, shard_paths
from ..sources.tensors import TensorCohort
from ..sources.uris import UriDataset
from ..stage import subset_subjects
from ..streaming import keep_subject_digests, kept_digests
from ..tensorized import build_tensorized_family
from . import views
from .views import CODES, EVENTS, LABELS, SALT, SPLITS, U64, rank_sql, score_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
N, SHARD = 600, 100
#: Members of a family: these parts of the train split.
PARTS = (12, 5, 2, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _subjects(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"))


def _sizes(spark, sf_dir) -> list[int]:
    """The members' sizes; the last is the whole train split."""
    n = _train(spark, sf_dir).count()
    return [n // part for part in PARTS]


def _train(spark, sf_dir):
    return views.splits(spark, sf_dir).where("split = 'train'").select("subject_id")


_COUNTS = """count(DISTINCT subject_id) AS n_subjects, count(DISTINCT CASE WHEN time IS NOT NULL THEN struct_pack(a := subject_id, b := time) END) AS n_events,
  count(*) AS n_measurements, count(time) AS n_dynamic, CAST(count(*) - count(time) AS BIGINT) AS n_static,
  count(DISTINCT CASE WHEN time IS NULL THEN subject_id END) AS n_subjects_with_static, count(DISTINCT code) AS n_codes_observed"""
_ROWS = "rw AS (SELECT ev.*, coalesce(sp.split, '__unknown__') AS split FROM ev LEFT JOIN sp USING (subject_id))"
_REPORT = f"rp AS (SELECT split, {_COUNTS} FROM rw GROUP BY split)"
_BASE = f"WITH {EVENTS}, {SPLITS}, {_ROWS}"


@query(f"{_BASE}, {_REPORT} SELECT * FROM rp")
def size_by_split(spark, sf_dir):
    return sizes.size_report(views.events(spark, sf_dir), views.splits(spark, sf_dir))


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in sizes.ADDITIVE)


@query(f"{_BASE}, {_REPORT} SELECT * FROM rp UNION ALL SELECT '__total__', {_SUMS}, (SELECT count(DISTINCT code) FROM ev) FROM rp")
def size_total(spark, sf_dir):
    events = views.events(spark, sf_dir)
    return sizes.with_total(sizes.size_report(events, views.splits(spark, sf_dir)), events)


@query(f"{_BASE} SELECT split, {_COUNTS} FROM rw WHERE split = '__unknown__' GROUP BY split")
def size_unknown_split(spark, sf_dir):
    return size_by_split(spark, sf_dir).where("split = '__unknown__'")


@query(f"WITH {EVENTS} SELECT '__all__' AS split, {_COUNTS} FROM ev")
def size_all_split(spark, sf_dir):
    return sizes.size_report(views.events(spark, sf_dir), None)


@query(f"WITH {EVENTS} SELECT DISTINCT code FROM ev WHERE code IS NOT NULL")
def observed_codes(spark, sf_dir):
    return selection.observed_codes(views.events(spark, sf_dir))


def _fold(value: str, order: str) -> str:
    """SQL for the digest of the texts of a group."""
    return f"'sha256:' || sha256(coalesce(string_agg(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '' ORDER BY {order}), ''))"


@query(f"{_BASE} SELECT split, {_fold('code', 'code')} AS observed_code_set_id FROM (SELECT DISTINCT split, code FROM rw WHERE code IS NOT NULL) GROUP BY split")
def code_set_id(spark, sf_dir):
    return sizes.size_report(views.events(spark, sf_dir), views.splits(spark, sf_dir), code_ids=True).select("split", "observed_code_set_id")


_RANKS = f"rk AS (SELECT c_custkey AS subject_id, CAST(row_number() OVER (ORDER BY {rank_sql('c_custkey', SALT)}, c_custkey) - 1 AS BIGINT) AS rank FROM customer)"


@query(f"WITH {_RANKS} SELECT * FROM rk")
def rank_order(spark, sf_dir):
    return selection.ranked(_subjects(spark, sf_dir), SALT).select("subject_id", "rank")


@query(f"SELECT c_custkey AS subject_id, {score_sql('c_custkey', SALT)} AS score FROM customer")
def uniform_scores(spark, sf_dir):
    return _subjects(spark, sf_dir).withColumn("score", uniform_score(F.col("subject_id"), SALT))


_TRAIN = f"tr AS (SELECT subject_id FROM sp WHERE split = 'train'), tk AS (SELECT subject_id, CAST(row_number() OVER (ORDER BY {rank_sql('subject_id', SALT)}, subject_id) - 1 AS BIGINT) AS rank FROM tr), nn AS (SELECT count(*) AS n FROM tr)"
_SEL = f"WITH {SPLITS}, {_TRAIN}"


@query(f"{_SEL} SELECT subject_id, rank FROM tk WHERE rank < {N}")
def select_nested(spark, sf_dir):
    """The first subjects by rank: the limit is the feature (the whole split where it is smaller)."""
    train = _train(spark, sf_dir)
    return selection.select_nested(train, min(N, train.count()), SALT).select("subject_id", "rank")


@query(f"WITH {SPLITS} SELECT subject_id, split, CAST(row_number() OVER (PARTITION BY split ORDER BY {rank_sql('subject_id', SALT)}, subject_id) - 1 AS BIGINT) AS rank FROM sp")
def rank_per_split(spark, sf_dir):
    return selection.ranked(views.splits(spark, sf_dir), SALT, "split").select("subject_id", "split", "rank")


def _key_sql(n: str) -> str:
    first = f"(rank // {SHARD}) * {SHARD}"
    return f"'r' || lpad(CAST({first} AS VARCHAR), 10, '0') || '-' || lpad(CAST(least({first} + {SHARD}, {n}) AS VARCHAR), 10, '0')"


@query(f"{_SEL} SELECT subject_id, rank, {_key_sql('n')} AS shard FROM tk, nn WHERE rank < n")
def assign_shards(spark, sf_dir):
    train = _train(spark, sf_dir)
    return selection.assign_shards(selection.ranked(train, SALT), train.count(), SHARD).select("subject_id", "rank", "shard")


_PARTS = ", ".join(f"n // {p}" for p in PARTS)
_MEMBERS = f"mb AS (SELECT unnest([{_PARTS}]) AS member FROM nn), fm AS (SELECT CAST(member AS BIGINT) AS member, subject_id, rank, {_key_sql('member')} AS shard FROM tk, mb WHERE rank < member)"


@query(f"{_SEL}, {_MEMBERS} SELECT * FROM fm")
def family_members(spark, sf_dir):
    return selection.family_members(selection.ranked(_train(spark, sf_dir), SALT), _sizes(spark, sf_dir), SHARD)


@query(f"{_SEL}, {_MEMBERS} SELECT shard, n_members FROM (SELECT shard, count(DISTINCT member) AS n_members FROM fm GROUP BY shard) WHERE n_members > 1")
def shared_shards(spark, sf_dir):
    return selection.shared_shards(family_members(spark, sf_dir))


_PS = f"ps AS (SELECT subject_id, split, row_number() OVER (PARTITION BY split ORDER BY {rank_sql('subject_id', SALT)}, subject_id) - 1 AS rank FROM sp)"


@query(f"WITH {SPLITS}, {_PS} SELECT subject_id, split FROM ps WHERE split <> 'train' OR rank < 100")
def members_passthrough(spark, sf_dir):
    return selection.member_splits(views.splits(spark, sf_dir), 100, SALT, selection.PASSTHROUGH)


@query(f"WITH {SPLITS}, {_PS} SELECT subject_id, split FROM ps WHERE rank < 100")
def members_subset(spark, sf_dir):
    return selection.member_splits(views.splits(spark, sf_dir), 100, SALT, selection.SUBSET)


@query(f"WITH {SPLITS}, {_PS} SELECT subject_id, split FROM ps WHERE split = 'train' AND rank < 100")
def members_drop(spark, sf_dir):
    return selection.member_splits(views.splits(spark, sf_dir), 100, SALT, selection.DROP)


_FAM = f"WITH {EVENTS}, {SPLITS}, {_TRAIN}, {_MEMBERS}"
_ASSIGN = "sa AS (SELECT DISTINCT subject_id, shard FROM fm)"


@query(f"{_FAM}, {_ASSIGN} SELECT shard, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects FROM ev JOIN sa USING (subject_id) GROUP BY shard")
def routed_counts(spark, sf_dir):
    assignment = family_members(spark, sf_dir).select("subject_id", "shard").distinct()
    return selection.routed(views.events(spark, sf_dir), assignment).groupBy("shard").agg(F.count("*").alias("n_rows"), F.countDistinct("subject_id").alias("n_subjects"))


@query(
    f"WITH {EVENTS}, {SPLITS}, {_TRAIN}, x AS (SELECT ev.subject_id, code, time, numeric_value, {_key_sql('n')} AS shard FROM ev JOIN tk USING (subject_id), nn WHERE rank < n) "
    "SELECT shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY subject_id, time NULLS FIRST, code, numeric_value NULLS FIRST) - 1 AS BIGINT) AS place, "
    "subject_id, epoch_us(time) AS time_us, code, CAST(numeric_value AS DOUBLE) AS value FROM x"
)
def sorted_shard_rows(spark, sf_dir):
    """The rows as they lie in their shards: places are counted on the sorted partitions, not ordered anew."""
    rows = selection.sorted_for_output(selection.routed(views.events(spark, sf_dir), assign_shards(spark, sf_dir)), "code", "numeric_value")
    lying = rows.withColumn("at", F.monotonically_increasing_id())
    place = F.col("at") - F.min("at").over(Window.partitionBy("shard"))
    micros = F.unix_micros(F.col("time").cast("timestamp")).alias("time_us")
    return lying.select("shard", place.alias("place"), "subject_id", micros, "code", F.col("numeric_value").cast("double").alias("value"))


_GROUPED = "SELECT subject_id, count(*) AS n_rows FROM ev"


@query(f"WITH {EVENTS}, {SPLITS}, {_TRAIN} {_GROUPED} WHERE subject_id IN (SELECT subject_id FROM tk WHERE rank < 50) GROUP BY subject_id")
def filter_subjects(spark, sf_dir):
    keep = selection.ranked(_train(spark, sf_dir), SALT).where("rank < 50")
    return selection.filter_subjects(views.events(spark, sf_dir), keep).groupBy("subject_id").agg(F.count("*").alias("n_rows"))


@query(f"WITH {EVENTS}, {SPLITS}, {_TRAIN} {_GROUPED} WHERE subject_id NOT IN (SELECT subject_id FROM tk WHERE rank >= 50) GROUP BY subject_id")
def filter_cohort(spark, sf_dir):
    cohort = selection.ranked(_train(spark, sf_dir), SALT)
    return selection.filter_cohort(views.events(spark, sf_dir), cohort, cohort.where("rank < 50")).groupBy("subject_id").agg(F.count("*").alias("n_rows"))


@query(f"{_BASE}, x AS (SELECT DISTINCT subject_id, subject_id % 97 AS shard FROM ev), y AS (SELECT shard, bool_or(split = 'train') AS a, bool_or(split <> 'train') AS b FROM x JOIN sp USING (subject_id) GROUP BY shard) SELECT shard FROM y WHERE a AND b")
def mixed_shard_guard(spark, sf_dir):
    rows = views.events(spark, sf_dir).withColumn("shard", F.col("subject_id") % 97)
    return selection.mixed_shards(rows, views.splits(spark, sf_dir))


@query("SELECT o_custkey AS subject_id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_guard(spark, sf_dir):
    return selection.repeated(views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id")))


def _framed(v: str) -> str:
    return f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-1:')"


_BITS = "CAST(CAST(CAST(numeric_value AS DOUBLE) AS BIT) AS UBIGINT)"
_CANON = (
    f"'code=' || {_framed('code')} || chr(31) || 'numeric_value=' || {_framed(f'CAST({_BITS} AS VARCHAR)')} || chr(31) || "
    f"'subject_id=' || {_framed('CAST(subject_id AS VARCHAR)')} || chr(31) || 'time=' || {_framed('CAST(epoch_us(time) AS VARCHAR)')}"
)
_CR = f"cr AS (SELECT subject_id, {_CANON} AS canonical FROM ev)"
_SD = f"sd AS (SELECT subject_id, {_fold('canonical', 'canonical')} AS digest FROM cr GROUP BY subject_id)"
_ID = "CAST(subject_id AS VARCHAR)"
_TAG = f"tg AS (SELECT split, 'sha256:' || sha256({_framed(_ID)} || {_framed('digest')}) AS t FROM sd JOIN sp USING (subject_id))"
_CID = f"ci AS (SELECT split, {_fold('t', 't')} AS content_id FROM tg GROUP BY split)"


@query(f"WITH {EVENTS}, {_CR} SELECT canonical, count(*) AS n FROM cr GROUP BY canonical")
def canonical_rows(spark, sf_dir):
    return digests.canonical_rows(views.events(spark, sf_dir)).groupBy("canonical").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS}, {_CR}, {_SD} SELECT * FROM sd")
def subject_digests(spark, sf_dir):
    return digests.subject_digests(views.events(spark, sf_dir))


#: Micro-batches that the appended files come in.
BATCHES = 4


@query(f"WITH {EVENTS}, {_CR}, {_SD} SELECT * FROM sd")
def streamed_digests(spark, sf_dir):
    """The same, kept up to date while the rows come in micro-batches, a subject's over several of them."""
    source = views.appended(spark, sf_dir)
    rows = f"file://{source}"
    each = -(-len(list(source.glob("*.parquet"))) // BATCHES)

    def follow(to: Path) -> None:
        stream = spark.readStream.schema(spark.read.parquet(rows).schema).option("maxFilesPerTrigger", each).parquet(rows)
        keep_subject_digests(stream, f"file://{to}/digests", f"file://{to}/checkpoint").awaitTermination()

    return kept_digests(spark, f"file://{views.once(spark, sf_dir, 'streamed', follow)}/digests")


@query(f"WITH {EVENTS}, {SPLITS}, {_CR}, {_SD}, {_TAG}, {_CID} SELECT * FROM ci")
def content_ids(spark, sf_dir):
    return digests.content_ids(views.events(spark, sf_dir), views.splits(spark, sf_dir))


_CROW = f"'code=' || {_framed('code')} || chr(31) || 'description=' || {_framed('description')}"
_FD = f"fd AS (SELECT 'sha256:' || sha256({_framed('c')}) AS d FROM (SELECT {_CROW} AS c FROM cd)), fi AS (SELECT {_fold('d', 'd')} AS frame_digest FROM fd)"


@query(f"WITH {EVENTS}, {CODES}, {_FD} SELECT * FROM fi")
def frame_digest_codes(spark, sf_dir):
    return digests.frame_digest(views.codes(spark, sf_dir))


@query(f"SELECT {_fold(_ID, 'subject_id')} AS subject_digest FROM (SELECT DISTINCT o_custkey AS subject_id FROM orders)")
def subject_set_id(spark, sf_dir):
    return digests.subject_set_digest(views.labels(spark, sf_dir))


@query(f"SELECT {_fold(_ID, 'subject_id')} AS subject_digest FROM (SELECT o_custkey AS subject_id FROM orders)")
def subject_multiset_id(spark, sf_dir):
    return digests.subject_set_digest(views.labels(spark, sf_dir), keep_repeats=True)


@query(f"WITH {EVENTS}, {SPLITS}, {CODES}, {_CR}, {_SD}, {_TAG}, {_CID}, {_FD}, pt AS (SELECT 'data/' || split || '=' || content_id AS p FROM ci UNION ALL SELECT 'metadata/codes.parquet=' || frame_digest FROM fi) SELECT {_fold('p', 'p')} AS dataset_id FROM pt")
def dataset_id(spark, sf_dir):
    return digests.dataset_id(content_ids(spark, sf_dir), frame_digest_codes(spark, sf_dir))


@query(f"WITH {EVENTS}, {_CR}, {_SD} SELECT subject_id, substr(digest, 8, 12) AS short FROM sd")
def short_ids(spark, sf_dir):
    return subject_digests(spark, sf_dir).select("subject_id", short_id(F.col("digest"), 12).alias("short"))


@query(f"SELECT o_custkey AS subject_id, {_fold('s', 's')} AS list_digest FROM (SELECT DISTINCT o_custkey, o_orderstatus AS s FROM orders) GROUP BY o_custkey")
def list_framing(spark, sf_dir):
    lists = views.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject_id")).agg(F.sort_array(F.collect_set("o_orderstatus")).alias("l"))
    return lists.select("subject_id", digest(F.col("l")).alias("list_digest"))


@query(f"WITH {EVENTS}, {CODES} SELECT * FROM cd WHERE code IN (SELECT code FROM ev WHERE numeric_value > 40)")
def pruned_codes(spark, sf_dir):
    return selection.pruned_codes(views.codes(spark, sf_dir), views.events(spark, sf_dir).where("numeric_value > 40")).select("code", "description")


@query(f"WITH {SPLITS}, {_TRAIN}, {LABELS} SELECT {_key_sql('n')} AS shard, label_id, lb.subject_id, boolean_value FROM lb JOIN tk ON lb.subject_id = tk.subject_id, nn WHERE rank < n")
def index_slice(spark, sf_dir):
    return selection.routed(views.labels(spark, sf_dir), assign_shards(spark, sf_dir)).select("shard", "label_id", "subject_id", "boolean_value")


_EXCLUDED = f"SELECT subject_id FROM tk WHERE rank < 100"


@query(f"{_SEL} SELECT subject_id FROM tr WHERE subject_id NOT IN ({_EXCLUDED})")
def eligible_pool(spark, sf_dir):
    excluded = selection.ranked(_train(spark, sf_dir), SALT).where("rank < 100")
    return resampling.eligible_pool(views.splits(spark, sf_dir), "train", excluded)


DRAWS = 500
_U = U64.format(h=f"sha256('{SALT}|resample|' || CAST(replicate AS VARCHAR) || chr(31) || CAST(c AS VARCHAR))")
_DRAW = (
    f"po AS (SELECT subject_id, row_number() OVER (ORDER BY subject_id) - 1 AS place, count(*) OVER () AS n FROM tr), "
    f"us AS (SELECT replicate, c, {_U} AS u FROM (SELECT unnest(range(3)) AS replicate), (SELECT unnest(range({DRAWS})) AS c)), "
    "dr AS (SELECT CAST(replicate AS BIGINT) AS replicate, CAST(c AS BIGINT) AS draw_index, subject_id FROM us JOIN po ON place = CAST(u % CAST(n AS UBIGINT) AS BIGINT))"
)


@query(f"{_SEL}, {_DRAW} SELECT * FROM dr")
def draw_with_replacement(spark, sf_dir):
    return resampling.with_replacement(_train(spark, sf_dir), DRAWS, SALT, range(3))


@query(f"{_SEL}, x AS (SELECT subject_id, CAST(row_number() OVER (ORDER BY {rank_sql('subject_id', SALT + '|resample|1')}, subject_id) - 1 AS BIGINT) AS draw_index FROM tr) SELECT draw_index, subject_id FROM x WHERE draw_index < 60")
def draw_without_replacement(spark, sf_dir):
    return resampling.without_replacement(_train(spark, sf_dir), 60, SALT, 1).select("draw_index", "subject_id")


@query(f"{_SEL}, {_DRAW} SELECT replicate, count(*) AS n_draws, count(DISTINCT subject_id) AS n_distinct FROM dr GROUP BY replicate")
def replicate_stats(spark, sf_dir):
    return resampling.replicate_stats(draw_with_replacement(spark, sf_dir))


@query(f"WITH {SPLITS}, {_TRAIN}, {LABELS}, {_DRAW} SELECT draw_index, label_id, lb.subject_id, boolean_value FROM dr JOIN lb ON dr.subject_id = lb.subject_id WHERE replicate = 0")
def repeat_labels(spark, sf_dir):
    draws = draw_with_replacement(spark, sf_dir).where("replicate = 0")
    return resampling.repeat_labels(views.labels(spark, sf_dir), draws).select("draw_index", "label_id", "subject_id", "boolean_value")


def _projection_sql(width: int, mode: str, static: str, stride: int | None) -> str:
    head = {"SM": "s", "SEM": "1"}[mode] if static == "PREPEND" else "0"
    base = "m" if mode == "SM" else "e"
    windows = f"CASE WHEN len <= {width} THEN 1 ELSE 1 + (len - {width} + {(stride or 1) - 1}) // {stride or 1} END" if stride else "1"
    statics = {"INCLUDE": "w * s", "PREPEND": "least(s, used)" if mode == "SM" else "s", "OMIT": "0"}[static]
    if mode == "SM":
        trained = "w * used" + (" + w * s" if static == "INCLUDE" else "")
    else:
        units = f"(w * used - {int(static == 'PREPEND')})"
        trained = f"(CASE WHEN e > 0 THEN ({units} * m + e // 2) // greatest(e, 1) ELSE 0 END) + {statics}"
    return (
        f"WITH {EVENTS}, c AS (SELECT subject_id, count(DISTINCT time) AS e, count(time) AS m, count(*) - count(time) AS s FROM ev GROUP BY subject_id), "
        f"l AS (SELECT *, {base} + {head} AS len FROM c), w AS (SELECT *, least(len, {width}) AS used, {windows} AS w FROM l), "
        f"t AS (SELECT *, {'m' if static == 'OMIT' else 'm + s'} AS corpus, {trained} AS trained, {statics} AS stat FROM w) "
        "SELECT count(*) AS n_subjects, CAST(sum(w) AS BIGINT) AS n_windows, CAST(sum(corpus) AS BIGINT) AS n_corpus_tokens, CAST(sum(trained) AS BIGINT) AS n_trained_tokens, "
        "CAST(sum(stat) AS BIGINT) AS n_static_tokens, CAST(sum(greatest(corpus - trained, 0)) AS BIGINT) AS n_dropped_tokens, CAST(sum(greatest(trained - corpus, 0)) AS BIGINT) AS n_repeated_tokens FROM t"
    )


def _projections() -> None:
    for mode, width in (("SM", 30), ("SEM", 8)):
        for static in ("OMIT", "INCLUDE", "PREPEND"):
            for stride in (None, 7):
                name = f"tokens_{mode.lower()}_{static.lower()}" + ("_stepped" if stride else "")

                def f(spark, sf_dir, _a=(width, mode, static, stride)):
                    return sizes.token_projection(sizes.subject_counts(views.events(spark, sf_dir)), *_a)

                f.__name__ = name
                query(_projection_sql(width, mode, static, stride))(f)


_projections()


def _ragged(spark, sf_dir):
    """The cohort as ragged arrays: one row a subject, one inner array an event."""
    events = views.events(spark, sf_dir)
    timed = events.where(F.col("time").isNotNull()).groupBy("subject_id", "time").agg(F.collect_list(F.length("code").cast("long")).alias("c"))
    each = timed.groupBy("subject_id").agg(F.collect_list("c").alias("code"), F.collect_list(F.lit(1.0).cast("float")).alias("time_delta_days"))
    static = events.where(F.col("time").isNull()).groupBy("subject_id").agg(F.collect_list(F.length("code")).alias("static_code"))
    joined = views.splits(spark, sf_dir).join(each, "subject_id", "left").join(static, "subject_id", "left")
    return joined.withColumn("shard", F.concat_ws("/", "split", (F.col("subject_id") % 4).cast("string")))


@query(f"{_BASE} SELECT * EXCLUDE (n_codes_observed) FROM (SELECT split, {_COUNTS} FROM rw WHERE split <> '__unknown__' GROUP BY split)")
def tensor_size(spark, sf_dir):
    return sizes.ragged_size(_ragged(spark, sf_dir))


_LOC = "ld AS (SELECT c_custkey AS subject_id, 'customer' AS shard, CAST(row_number() OVER () - 1 AS BIGINT) AS row_index FROM customer)"


def _located(spark, sf_dir):
    """The customers' file as a shard of a cohort: a subject's place is its row in the file."""
    folder = Path(sf_dir)
    rows = read_shards(spark, folder, [folder / "customer.parquet"], {"c_custkey": "bigint"}, places=True)
    return ragged.locations(rows.withColumnRenamed("c_custkey", "subject_id"))


@query(f"WITH {_LOC} SELECT * FROM ld")
def tensor_locations(spark, sf_dir):
    return _located(spark, sf_dir)


@query(f"WITH {EVENTS}, {SPLITS}, {_TRAIN}, {_LOC}, ns AS (SELECT subject_id, count(DISTINCT time) AS n_events FROM ev GROUP BY subject_id) SELECT ld.subject_id, shard, row_index, coalesce(n_events, 0) AS n_events FROM ld JOIN tk USING (subject_id) LEFT JOIN ns USING (subject_id) WHERE rank < 50")
def tensor_slice(spark, sf_dir):
    keep = selection.ranked(_train(spark, sf_dir), SALT).where("rank < 50")
    rows = ragged.sliced(_ragged(spark, sf_dir), _located(spark, sf_dir), keep)
    return rows.select("subject_id", "shard", "row_index", sizes.list_length(F.col("time_delta_days")).cast("long").alias("n_events"))


@query("SELECT *, 'customer' AS shard FROM customer UNION ALL BY NAME SELECT *, 'supplier' AS shard FROM supplier")
def schema_union(spark, sf_dir):
    folder = Path(sf_dir)
    return read_shards(spark, folder, [folder / "customer.parquet", folder / "supplier.parquet"])


@query("SELECT CAST(l_linenumber AS BIGINT) AS number, CAST(l_shipdate AS TIMESTAMP) AS time, NULL AS code, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT NULL, NULL, n_name, count(*) FROM nation GROUP BY n_name")
def widened_scan(spark, sf_dir):
    """Files of different columns and widths, read as the pinned types: missing columns are null, others ignored."""
    folder = Path(sf_dir)
    pinned = {"l_linenumber": "bigint", "l_shipdate": "timestamp_ntz", "n_name": "string"}
    rows = read_shards(spark, folder, [folder / "lineitem.parquet", folder / "nation.parquet"], pinned)
    return rows.groupBy(F.col("l_linenumber").alias("number"), F.col("l_shipdate").alias("time"), F.col("n_name").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey AS subject_id, 'orders' AS shard FROM orders UNION SELECT c_custkey, 'customer' FROM customer")
def subject_file_map(spark, sf_dir):
    folder = Path(sf_dir)
    rows = read_shards(spark, folder, [folder / "orders.parquet", folder / "customer.parquet"], {"o_custkey": "bigint", "c_custkey": "bigint"})
    return rows.select(F.coalesce("o_custkey", "c_custkey").alias("subject_id"), "shard").distinct()


# Queries over files: the view is written as a dataset folder first.
_MEMBERS_OF = (
    f"{_PS}, nt AS (SELECT count(*) AS n FROM sp WHERE split = 'train'), mm AS (SELECT CAST(unnest([n // 12, n // 2]) AS BIGINT) AS member FROM nt), "
    "mp AS (SELECT member, subject_id, split FROM ps, mm WHERE split <> 'train' OR rank < member)"
)
_SHARDED = (
    f"mq AS (SELECT member, subject_id, split, CASE WHEN split = 'train' THEN 'train/' || CAST(rank // greatest(n // 12, 1) AS VARCHAR) "
    f"ELSE split || '/' || CAST(subject_id % {views.SHARDS_PER_SPLIT} AS VARCHAR) END AS shard FROM ps, mm, nt WHERE split <> 'train' OR rank < member)"
)


def _config(spark, sf_dir, **more) -> SubsetConfig:
    """Two members, of a twelfth and half of the train split."""
    n = _train(spark, sf_dir).count()
    return SubsetConfig((n // 12, n // 2), salt=SALT, n_subjects_per_shard=max(1, n // 12), **more)


def _family(spark, sf_dir) -> dict:
    """What a built family's record says; the family itself stays."""
    root = views.folder(spark, sf_dir)
    out = views.once(spark, sf_dir, "family", lambda to: build_family(spark, root, to, _config(spark, sf_dir), labels=root / "labels/orders"))
    return json.loads((out / FAMILY).read_text())


def _catalog(spark, sf_dir) -> Catalog:
    """The same family at a URI."""
    root = views.folder(spark, sf_dir)

    def build(to: Path) -> None:
        labels = views.labels(spark, sf_dir).select("subject_id", "prediction_time", "boolean_value")
        Catalog(spark, f"file://{to}").build(UriDataset(spark, f"file://{root}"), _config(spark, sf_dir), labels=labels)

    return Catalog(spark, f"file://{views.once(spark, sf_dir, 'catalog', build)}")


def _of_members(spark, sf_dir, read: Callable[[int], DataFrame]) -> DataFrame:
    out = None
    for n in _config(spark, sf_dir).n_subjects:
        made = read(n).withColumn("member", F.lit(n).cast("long"))
        out = made if out is None else out.unionByName(made)
    return out


@query(
    f"WITH {EVENTS}, {SPLITS}, {_CR}, {_SD}, {_MEMBERS_OF}, mt AS (SELECT member, split, 'sha256:' || sha256({_framed(_ID)} || {_framed('digest')}) AS t FROM mp JOIN sd USING (subject_id)), "
    f"mc AS (SELECT member, split, {_fold('t', 't')} AS content_id FROM mt GROUP BY member, split), mr AS (SELECT * FROM mp JOIN ev USING (subject_id)), "
    f"mn AS (SELECT member, split, {_COUNTS} FROM mr GROUP BY member, split) SELECT * FROM mn JOIN mc USING (member, split)"
)
def family_report(spark, sf_dir):
    """Counts and content ids of a built family's members, from the files that they hold."""
    roots = {m["n_subjects"]: m["root"] for m in _family(spark, sf_dir)["members"].values()}

    def read(n: int) -> DataFrame:
        own = EventDataset(spark, roots[n])
        counts = reports.event_report(own).where(F.col("split") != sizes.TOTAL).drop("source", "kind", "observed_code_set_id", "n_shards", "n_bytes")
        counts = counts.withColumnsRenamed({"n_dynamic_measurements": "n_dynamic", "n_static_measurements": "n_static"})
        return counts.join(digests.content_ids(own.events().drop("shard"), own.splits()), "split")

    return _of_members(spark, sf_dir, read)


_LROW = f"'boolean_value=' || {_framed('CAST(boolean_value AS VARCHAR)')} || chr(31) || 'prediction_time=' || {_framed('CAST(epoch_us(prediction_time) AS VARCHAR)')} || chr(31) || 'subject_id=' || {_framed(_ID)}"


@query(
    f"WITH {SPLITS}, {LABELS}, {_MEMBERS_OF}, ml AS (SELECT member, 'sha256:' || sha256({_framed('c')}) AS d FROM (SELECT member, {_LROW} AS c FROM mp JOIN lb USING (subject_id))) "
    f"SELECT member, count(*) AS n_index_rows, {_fold('d', 'd')} AS index_id FROM ml GROUP BY member"
)
def family_labels(spark, sf_dir):
    """The ids and numbers of the members' label rows, read from their files."""
    return spark.createDataFrame([(m["n_subjects"], m["n_index_rows"], m["index_id"]) for m in _family(spark, sf_dir)["members"].values()], "member long, n_index_rows long, index_id string")


@query(f"WITH {SPLITS}, {LABELS}, {_MEMBERS_OF}, {_SHARDED} SELECT member, shard, subject_id, prediction_time, boolean_value FROM mq JOIN lb USING (subject_id)")
def family_label_rows(spark, sf_dir):
    """The members' label rows with their shards, from the files themselves."""
    roots = {m["n_subjects"]: Path(m["root"]) / "tasks" / m["task"] for m in _family(spark, sf_dir)["members"].values()}
    return _of_members(spark, sf_dir, lambda n: read_labels(spark, roots[n])).select("member", "shard", "subject_id", "prediction_time", "boolean_value")


@query(f"WITH {SPLITS}, {_MEMBERS_OF} SELECT member, member AS n_subjects, {_fold(_ID, 'subject_id')} AS subject_set_id FROM (SELECT DISTINCT member, subject_id FROM mp) GROUP BY member")
def family_blocks(spark, sf_dir):
    """What the dataset.json files of a built family's members say of them."""
    roots = {m["n_subjects"]: m["root"] for m in _family(spark, sf_dir)["members"].values()}
    read = lambda n: spark.read.schema("subset_of struct<n_subjects:bigint,subject_set_id:string>").json(f"{roots[n]}/metadata/dataset.json", multiLine=True)
    return _of_members(spark, sf_dir, read).select("member", "subset_of.n_subjects", "subset_of.subject_set_id")


@query(f"WITH {SPLITS}, {_MEMBERS_OF} SELECT member, subject_id, split FROM mp")
def family_splits(spark, sf_dir):
    """The splits files of a built family's members."""
    roots = {m["n_subjects"]: m["root"] for m in _family(spark, sf_dir)["members"].values()}
    return _of_members(spark, sf_dir, lambda n: EventDataset(spark, roots[n]).splits())


@query(
    f"WITH {EVENTS}, {SPLITS}, {_MEMBERS_OF}, {_SHARDED} SELECT member, shard, subject_id, count(*) AS n_rows, count(time) AS n_timed, count(DISTINCT code) AS n_codes, "
    "min(numeric_value) AS least, max(numeric_value) AS most FROM mq JOIN ev USING (subject_id) GROUP BY ALL"
)
def catalog_rows(spark, sf_dir):
    """The rows of a family that was built at a URI, read by its record."""
    rows = _of_members(spark, sf_dir, _catalog(spark, sf_dir).events)
    return rows.groupBy("member", "shard", "subject_id").agg(
        F.count("*").alias("n_rows"), F.count("time").alias("n_timed"), F.countDistinct("code").alias("n_codes"), F.min("numeric_value").alias("least"), F.max("numeric_value").alias("most")
    )


@query(
    f"WITH {EVENTS}, {SPLITS}, {_CR}, {_SD}, {_MEMBERS_OF}, {_SHARDED}, mt AS (SELECT member, split, 'sha256:' || sha256({_framed(_ID)} || {_framed('digest')}) AS t FROM mp JOIN sd USING (subject_id)), "
    f"mc AS (SELECT member, split, {_fold('t', 't')} AS content_id FROM mt GROUP BY member, split), mr AS (SELECT * FROM mq JOIN ev USING (subject_id)), "
    f"mn AS (SELECT member, split, {_COUNTS}, count(DISTINCT shard) AS n_shards FROM mr GROUP BY member, split) SELECT * FROM mn JOIN mc USING (member, split)"
)
def catalog_report(spark, sf_dir):
    return _catalog(spark, sf_dir).report().drop("n_bytes")


@query(f"WITH {SPLITS}, {LABELS}, {_MEMBERS_OF}, {_SHARDED} SELECT member, shard, subject_id, prediction_time, boolean_value FROM mq JOIN lb USING (subject_id)")
def catalog_labels(spark, sf_dir):
    return _of_members(spark, sf_dir, _catalog(spark, sf_dir).labels)


@query(f"WITH {EVENTS}, {SPLITS}, {CODES}, {_MEMBERS_OF} SELECT DISTINCT member, code, description FROM cd JOIN (SELECT DISTINCT member, code FROM mp JOIN ev USING (subject_id)) USING (code)")
def catalog_codes(spark, sf_dir):
    return _of_members(spark, sf_dir, _catalog(spark, sf_dir).codes)


_VALUES = "count(DISTINCT time) AS n_events, count(time) AS n_measurements, CAST(sum(CASE WHEN time IS NOT NULL THEN length(code) ELSE 0 END) AS BIGINT) AS codes, max(CASE WHEN time IS NOT NULL THEN numeric_value END) AS most"


def _values(rows: DataFrame, *names: str) -> DataFrame:
    """What a subject's tensors hold: events, measurements, the sum of codes and the greatest value."""
    flat = F.flatten("code")
    return rows.select(
        *names, F.size("time_delta_days").cast("long").alias("n_events"), F.size(flat).cast("long").alias("n_measurements"),
        F.aggregate(flat, F.lit(0).cast("long"), lambda a, x: a + x).alias("codes"), F.array_max(F.flatten("numeric_value")).alias("most"),
    )


_PLACED = f"pl AS (SELECT subject_id, split || '/' || CAST(subject_id % {views.SHARDS_PER_SPLIT} AS VARCHAR) AS shard FROM sp)"


@query(
    f"WITH {EVENTS}, {SPLITS}, {_PLACED}, vs AS (SELECT subject_id, {_VALUES} FROM ev GROUP BY subject_id) "
    "SELECT subject_id, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY subject_id) - 1 AS BIGINT) AS row_index, n_events, n_measurements, codes, most FROM pl JOIN vs USING (subject_id)"
)
def tensor_files(spark, sf_dir):
    """Every subject's place in a cohort's files, and what its tensors hold there."""
    cohort = TensorCohort(spark, views.tensors(spark, sf_dir))
    return _values(cohort.locations().join(cohort.tensors(), ["shard", "row_index"]), "subject_id", "shard", "row_index")


@query(
    f"WITH {EVENTS}, {SPLITS}, {_PLACED}, fr AS (SELECT ev.*, split, shard FROM ev JOIN sp USING (subject_id) JOIN pl USING (subject_id)), {CODES}, "
    f"rp AS (SELECT split, {_COUNTS.rsplit(',', 1)[0]}, count(DISTINCT shard) AS n_shards FROM fr GROUP BY split), nc AS (SELECT count(*) AS n_codes_observed FROM cd) "
    f"SELECT * FROM rp, nc UNION ALL BY NAME SELECT '__total__' AS split, {_SUMS}, CAST(sum(n_shards) AS BIGINT) AS n_shards, (SELECT n_codes_observed FROM nc) AS n_codes_observed FROM rp"
)
def tensor_file_sizes(spark, sf_dir):
    """The report of a tensor cohort, from its schemas and its tensors' headers."""
    report = reports.size_of(spark, views.tensors(spark, sf_dir)).drop("source", "kind", "n_bytes", "observed_code_set_id")
    return report.withColumnsRenamed({"n_dynamic_measurements": "n_dynamic", "n_static_measurements": "n_static"})


@query(f"WITH {EVENTS}, {SPLITS}, {_MEMBERS_OF}, {_SHARDED}, vs AS (SELECT subject_id, {_VALUES} FROM ev GROUP BY subject_id) SELECT member, shard, subject_id, n_events, n_measurements, codes, most FROM mq JOIN vs USING (subject_id)")
def tensor_family(spark, sf_dir):
    """What the tensors of a built family's members hold, read from their files."""
    parent, config = views.tensors(spark, sf_dir), _config(spark, sf_dir, code_metadata="copy")
    out = views.once(spark, sf_dir, "tensor-family", lambda to: build_tensorized_family(spark, parent, to, config))

    def read(n: int) -> DataFrame:
        own = TensorCohort(spark, out / config.subset_name(n))
        return _values(own.locations().join(own.tensors(), ["shard", "row_index"]), "subject_id", "shard")

    return _of_members(spark, sf_dir, read)


def _resamples(spark, sf_dir) -> Path:
    root = views.folder(spark, sf_dir)
    return views.once(spark, sf_dir, "resamples", lambda to: build_resamples(spark, root, to, ResampleConfig(2, DRAWS, salt=SALT), root / "labels/orders")) / "resamples"


@query(f"{_SEL}, {_DRAW} SELECT replicate, count(*) AS n_draws, count(DISTINCT subject_id) AS n_distinct, {_fold(_ID, 'subject_id')} AS subject_multiset_id FROM dr WHERE replicate < 2 GROUP BY replicate")
def resample_report(spark, sf_dir):
    """What the manifests of built resamples say."""
    made = json.loads((_resamples(spark, sf_dir) / FAMILY).read_text())["resamples"]
    rows = [(r["replicate"], r["n_draws"], r["n_distinct"], r["subject_multiset_id"]) for r in made.values()]
    return spark.createDataFrame(rows, "replicate long, n_draws long, n_distinct long, subject_multiset_id string")


@query(f"WITH {SPLITS}, {_TRAIN}, {LABELS}, {_DRAW} SELECT replicate, lb.subject_id, prediction_time, boolean_value FROM dr JOIN lb ON dr.subject_id = lb.subject_id WHERE replicate < 2")
def resample_labels(spark, sf_dir):
    """The label rows of built resamples, read from their files."""
    root = _resamples(spark, sf_dir)
    rows = read_shards(spark, root, [p for p in shard_paths(root) if "labels" in p.parts])
    return rows.select(F.regexp_extract("shard", "^boot_0*([0-9]+)/", 1).cast("long").alias("replicate"), "subject_id", "prediction_time", "boolean_value")


@query(
    f"WITH {SPLITS}, {_TRAIN}, {LABELS}, {_DRAW}, dl AS (SELECT replicate, 'sha256:' || sha256({_framed('c')}) AS d FROM (SELECT replicate, {_LROW.replace(_ID, 'CAST(lb.subject_id AS VARCHAR)')} AS c FROM dr JOIN lb ON dr.subject_id = lb.subject_id WHERE replicate < 2)) "
    f"SELECT replicate, {_fold('d', 'd')} AS index_id FROM dl GROUP BY replicate"
)
def resample_label_ids(spark, sf_dir):
    """The ids of the label rows in the manifests of built resamples."""
    made = json.loads((_resamples(spark, sf_dir) / FAMILY).read_text())["resamples"]
    return spark.createDataFrame([(r["replicate"], r["index_id"]) for r in made.values()], "replicate long, index_id string")


@query(
    f"WITH {SPLITS}, {_TRAIN}, {LABELS}, {_DRAW} SELECT replicate, row_number() OVER (PARTITION BY replicate ORDER BY draw_index, label_id) - 1 AS place, lb.subject_id, prediction_time "
    "FROM dr JOIN lb ON dr.subject_id = lb.subject_id WHERE replicate < 2"
)
def resample_label_order(spark, sf_dir):
    """The places of the label rows in the files of built resamples."""
    root = _resamples(spark, sf_dir)
    rows = read_shards(spark, root, [p for p in shard_paths(root) if "labels" in p.parts], places=True)
    return rows.select(F.regexp_extract("shard", "^boot_0*([0-9]+)/", 1).cast("long").alias("replicate"), F.col("_row").alias("place"), "subject_id", "prediction_time")


def _resamples_at(spark, sf_dir) -> Resamples:
    """The same draws at a URI."""
    root, labels = views.folder(spark, sf_dir), views.labels(spark, sf_dir).drop("label_id")
    build = lambda to: Resamples(spark, f"file://{to}").build(UriDataset(spark, f"file://{root}"), ResampleConfig(2, DRAWS, salt=SALT), labels)
    return Resamples(spark, f"file://{views.once(spark, sf_dir, 'resamples-at', build)}")


@query(
    f"WITH {SPLITS}, {_TRAIN}, {LABELS}, {_DRAW}, dl AS (SELECT replicate, 'sha256:' || sha256({_framed('c')}) AS d FROM (SELECT replicate, {_LROW.replace(_ID, 'CAST(lb.subject_id AS VARCHAR)')} AS c FROM dr JOIN lb ON dr.subject_id = lb.subject_id)), "
    f"li AS (SELECT replicate, {_fold('d', 'd')} AS index_id FROM dl GROUP BY replicate), rs AS (SELECT replicate, count(*) AS n_draws, count(DISTINCT subject_id) AS n_distinct, {_fold(_ID, 'subject_id')} AS subject_multiset_id FROM dr GROUP BY replicate) "
    "SELECT * FROM rs JOIN li USING (replicate) WHERE replicate < 2"
)
def catalog_resamples(spark, sf_dir):
    """Counts and ids of resamples that were drawn at a URI, from the written rows."""
    return _resamples_at(spark, sf_dir).report().drop("subject_set_id")


@query(f"WITH {SPLITS}, {_TRAIN}, {LABELS}, {_DRAW} SELECT replicate, draw_index, lb.subject_id, prediction_time, boolean_value FROM dr JOIN lb ON dr.subject_id = lb.subject_id WHERE replicate < 2")
def catalog_resample_labels(spark, sf_dir):
    return _resamples_at(spark, sf_dir).labels().withColumn("replicate", F.col("replicate").cast("long"))


@query(f"WITH {EVENTS}, {SPLITS}, {CODES}, {_MEMBERS_OF} SELECT DISTINCT member, code, description FROM cd JOIN (SELECT DISTINCT member, code FROM mp JOIN ev USING (subject_id)) USING (code)")
def family_codes(spark, sf_dir):
    """The code tables of a built family's members."""
    roots = {m["n_subjects"]: m["root"] for m in _family(spark, sf_dir)["members"].values()}
    return _of_members(spark, sf_dir, lambda n: EventDataset(spark, roots[n]).codes())


@query(f"WITH {EVENTS} SELECT subject_id, {_CANON} AS canonical FROM ev WHERE time IS NULL")
def pinned_rows(spark, sf_dir):
    """Rows without a column, rendered at the schema of the whole table."""
    events = views.events(spark, sf_dir)
    return digests.canonical_rows(events.where(F.col("time").isNull()).drop("numeric_value"), schema=events.schema)


@query(f"WITH {SPLITS} SELECT subject_id FROM sp")
def excluded_subjects(spark, sf_dir):
    """All subjects of a dataset folder's splits file, as a resample leaves them out."""
    return read_excluded(spark, views.folder(spark, sf_dir))


@query(f"WITH {SPLITS} SELECT subject_id, split FROM sp")
def splits_of_shard_names(spark, sf_dir):
    """Splits of a folder without a splits file: the first part of the shards' names."""
    root = views.folder(spark, sf_dir)
    return EventDataset(spark, views.once(spark, sf_dir, "bare", lambda to: (to / "data").symlink_to(root / "data"))).splits()


_FILED = f"fr AS (SELECT ev.*, split, split || '/' || CAST(subject_id % {views.SHARDS_PER_SPLIT} AS VARCHAR) AS shard FROM ev JOIN sp USING (subject_id))"
_CODESET = "'sha256:' || sha256(string_agg(CAST(strlen(code) AS VARCHAR) || ':' || code, '' ORDER BY code))"


_SIZES_OF_FILES = (
    f"WITH {EVENTS}, {SPLITS}, {_FILED}, cs AS (SELECT split, {_CODESET} AS observed_code_set_id FROM (SELECT DISTINCT split, code FROM fr) GROUP BY split), "
    f"rp AS (SELECT split, {_COUNTS}, count(DISTINCT shard) AS n_shards FROM fr GROUP BY split), "
    f"al AS (SELECT '__total__' AS split, {_CODESET} AS observed_code_set_id, count(*) AS n FROM (SELECT DISTINCT code FROM fr)) "
    f"SELECT rp.*, observed_code_set_id FROM rp JOIN cs USING (split) UNION ALL BY NAME SELECT '__total__' AS split, {_SUMS}, (SELECT n FROM al) AS n_codes_observed, CAST(sum(n_shards) AS BIGINT) AS n_shards, (SELECT observed_code_set_id FROM al) AS observed_code_set_id FROM rp"
)


@query(_SIZES_OF_FILES)
def size_of_files(spark, sf_dir):
    """The report of a dataset folder, with its shards."""
    report = reports.size_of(spark, views.folder(spark, sf_dir))
    return report.drop("source", "kind", "n_bytes").withColumnsRenamed({"n_dynamic_measurements": "n_dynamic", "n_static_measurements": "n_static"})


@query(_SIZES_OF_FILES)
def size_report_file(spark, sf_dir):
    """The report's own Parquet file."""
    root = views.folder(spark, sf_dir)
    made = views.once(spark, sf_dir, "report", lambda to: reports.write_report([reports.size_of(spark, root)], to / "sizes.parquet", None)) / "sizes.parquet"
    report = spark.read.parquet(str(made)).drop("source", "kind", "n_bytes")
    return report.withColumnsRenamed({"n_dynamic_measurements": "n_dynamic", "n_static_measurements": "n_static"})


@query(_SIZES_OF_FILES)
def size_at_uri(spark, sf_dir):
    """The same of a dataset at a URI."""
    report = reports.size_of(spark, f"file://{views.folder(spark, sf_dir)}")
    return report.drop("source", "kind", "n_bytes").withColumnsRenamed({"n_dynamic_measurements": "n_dynamic", "n_static_measurements": "n_static"})


@query(f"WITH {EVENTS}, {SPLITS}, {_TRAIN}, {_FILED} SELECT shard, subject_id, count(*) AS n_rows FROM fr WHERE subject_id NOT IN (SELECT subject_id FROM tk WHERE rank >= 50) GROUP BY shard, subject_id")
def stage_filter(spark, sf_dir):
    """The pipeline stage over a dataset folder's shards."""
    root = views.folder(spark, sf_dir)
    keep = subset_subjects(spark, {"n_subjects": 50, "salt": SALT, "data_input_dir": root / "data", "metadata_input_dir": root / "metadata"})
    return keep(EventDataset(spark, root).events()).groupBy("shard", "subject_id").agg(F.count("*").alias("n_rows"))
