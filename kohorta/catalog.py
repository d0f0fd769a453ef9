"""Families of nested subsets, and resamples, as tables on any file system: a record names the files that count.

``build_family`` links files into members' folders, which takes a file system with links and renames.  Here a family
is a folder of

    shards/<attempt>/stored=<shard>/...   rows; what an attempt wrote never changes
    labels/<attempt>/stored=<shard>/...   label rows of the shard's subjects
    tables/<attempt>/plan, files, codes   who is in which member; which files hold a shard; members' code tables
    records/<number>-<attempt>.json       the commit: the newest record names the attempts and tables that count

Task outputs become part of the family by being named in ``files``, which is read back from what a job has committed;
nothing is renamed or linked.  A build that is killed leaves files that no record names, so nothing of it is ever
taken for another parent's rows; ``vacuum`` removes them.  Members share shards because their plans name the
same ones.

Rows of shards are in the order of subject, time and place; shards that are passed through keep their file's order.
"""

from __future__ import annotations

import json
import logging
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .build import check_pool, check_splits, computed_plan, require_pool
from .config import ResampleConfig, SubsetConfig
from .functions.framing import by_digest, digest, folded, text_digest
from .operators import digests, resampling, selection, sizes
from .sources.dataset import NotADatasetError, literal
from .sources.sinks import ROW_GROUP
from .sources.uris import Folder, UriDataset, decoded

log = logging.getLogger(__name__)
PASSED = "passthrough/"
_FILES = "kind string, stored string, path string, n_rows bigint, n_bytes bigint"


class _Recorded:
    """Tables at a URI, of which the newest record names those that count."""

    WHAT = "table was written"

    def __init__(self, spark: SparkSession, uri: str, record: dict | None = None):
        """``record``: one to read by, instead of the newest."""
        self.spark, self.folder, self._given = spark, Folder(spark, uri), record

    def record(self) -> dict | None:
        """What the newest build committed."""
        found = self.folder.names("records")
        return json.loads(self.folder.read(f"records/{found[-1]}")) if found else None

    def _commit(self, record: dict, attempt: str) -> dict:
        found = self.folder.names("records")
        number = int(found[-1].split("-")[0]) + 1 if found else 0  # not how many there are: vacuum removes some
        self.folder.put(f"records/{number:06d}-{attempt}.json", json.dumps(record, indent=2, sort_keys=True) + "\n")
        return record

    def _committed(self) -> dict:
        found = self._given or self.record()
        if found is None:
            raise NotADatasetError(f"no {self.WHAT} at {self.folder.uri}")
        return found

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(f"{self._committed()['tables']}/{name}"))

    def _at(self, name: str) -> str:
        return literal(f"{self.folder.uri}/{name}")

    def _drop(self, kinds: tuple[str, ...], keep: set[str]) -> list[str]:
        gone = [f"{kind}/{x}" for kind in kinds for x in self.folder.names(kind) if f"{kind}/{x}" not in keep]
        gone += [f"records/{x}" for x in self.folder.names("records")[:-1]]
        for name in gone:
            self.folder.delete(name)
        return gone


class Catalog(_Recorded):
    """A family at a URI."""

    WHAT = "family was built"

    def plan(self) -> DataFrame:
        """(member, split, shard, stored, subject_id); shard and stored are null for subjects without rows in a shard that is passed through."""
        return self._table("plan")

    def files(self) -> DataFrame:
        """(kind, stored, path, n_rows, n_bytes): the files that count, ``kind`` being data or labels; no path for shards without rows."""
        return self._table("files")

    # reading

    def _rows(self, kind: str, stored: DataFrame | None = None) -> DataFrame:
        """Rows with ``stored`` of all files of a kind, or of the shards of ``stored`` alone; a path a file comes to the driver."""
        schema = T.StructType.fromJson(self._committed()["schemas"][kind])
        files = self.files().where((F.col("kind") == kind) & F.col("path").isNotNull())
        if stored is not None:
            files = files.join(stored, "stored", "left_semi")
        paths = [literal(r["path"]) for r in files.select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("stored", T.StringType())]))
        rows = self.spark.read.schema(schema).parquet(*paths)
        listed = {p: unquote(unquote(p.rsplit("/", 2)[1].partition("=")[2])) for p in rows.inputFiles()}  # escaped by Spark as a name, and as a path
        listed |= {p.replace(":///", ":/", 1): name for p, name in listed.items()}  # an empty authority is written or left out
        names = self.spark.createDataFrame(list(listed.items()), "_path string, _name string")
        slow = F.regexp_extract(decoded(F.col("_path")), r"/stored=([^/]*)/[^/]*$", 1)
        slow = F.url_decode(F.replace(slow, F.lit("+"), F.lit("%2B")))
        found = rows.select("*", F.col("_metadata.file_path").alias("_path")).join(F.broadcast(names), "_path", "left")  # a row a file
        return found.select(*[F.col(f"`{c}`") for c in schema.names], F.coalesce("_name", slow).alias("stored"))

    def _member(self, n: int) -> DataFrame:
        """(shard, stored) of a member's shards."""
        made = self._committed()
        if n not in made["config"]["n_subjects"]:
            raise ValueError(f"the family at {self.folder.uri} has members of {made['config']['n_subjects']} subjects, not {n}")
        return self.plan().where((F.col("member") == n) & F.col("shard").isNotNull()).select("shard", "stored").distinct()

    def _of_member(self, kind: str, n: int) -> DataFrame:
        shards = self._member(n)
        rows = self._rows(kind, shards)
        return rows.join(F.broadcast(shards), "stored").drop("stored")  # a row a shard

    def events(self, n: int) -> DataFrame:
        """The rows of the member of ``n`` subjects, with their shard."""
        return self._of_member("data", n)

    def labels(self, n: int) -> DataFrame:
        """The label rows of the member's subjects, with their shard."""
        if "labels" not in self._committed()["schemas"]:
            raise ValueError(f"the family at {self.folder.uri} was built without labels")
        own = self.plan().where((F.col("member") == n) & F.col("shard").isNotNull()).select("subject_id").distinct()
        return self._of_member("labels", n).join(own, "subject_id", "left_semi")

    def splits(self, n: int) -> DataFrame:
        return self.plan().where(F.col("member") == n).select("subject_id", "split").distinct()

    def codes(self, n: int) -> DataFrame:
        if not self._committed()["codes"]:
            raise ValueError(f"the parent of {self.folder.uri} has no code table")
        return self._table("codes").where(F.col("_member") == n).drop("_member")

    def subjects(self) -> DataFrame:
        """(stored, subject_id, digest, events, measurements, statics, codes), counted from the written rows."""
        return digests.subject_table(self._rows("data"), "stored")

    def report(self) -> DataFrame:
        """One row a member and split: counts, content id, files and bytes, all read from the files that count."""
        each = self.plan().where("stored IS NOT NULL").select("member", "split", "stored", "subject_id").distinct()
        found = each.join(self.subjects(), ["stored", "subject_id"])
        sums = found.groupBy("member", "split").agg(
            F.count("*").alias("n_subjects"), F.sum("events").alias("n_events"), F.sum("measurements").alias("n_measurements"),
            F.sum(F.col("measurements") - F.col("statics")).alias("n_dynamic"), F.sum("statics").alias("n_static"), F.sum((F.col("statics") > 0).cast("long")).alias("n_subjects_with_static"),
        )
        codes = found.select("member", "split", F.explode("codes").alias("code")).groupBy("member", "split").agg(F.countDistinct("code").alias("n_codes_observed"))
        name = F.concat_ws("/", F.col("member").cast("string"), "split")
        ids = digests.content_ids_of(found.select(name.alias("name"), "subject_id", "digest"), "name")
        ids = ids.select(F.split_part("name", F.lit("/"), F.lit(1)).cast("long").alias("member"), F.regexp_replace("name", "^[^/]*/", "").alias("split"), "content_id")
        held = each.select("member", "split", "stored").distinct().join(self.files().where("kind = 'data'"), "stored")
        bytes_ = held.groupBy("member", "split").agg(F.countDistinct("stored").alias("n_shards"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))
        listed = self.plan().select("member", "split").distinct()
        out = listed.join(sums, ["member", "split"], "left").join(codes, ["member", "split"], "left").join(bytes_, ["member", "split"], "left").join(ids, ["member", "split"], "left")
        zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*sizes.ADDITIVE, "n_codes_observed", "n_shards", "n_bytes")]
        return out.select("member", "split", *zero, "content_id")

    # writing

    def build(self, parent: UriDataset, config: SubsetConfig, overwrite: bool = False, labels: DataFrame | None = None) -> dict:
        """Writes the shards that no recorded attempt holds, in one job, and commits; returns the record.

        A build that finds its parent and settings recorded reads no rows.  ``labels``: rows with subject_id, of which each
        shard gets those of its subjects.
        """
        before = parent.fingerprint()
        known = self.record()
        if known is not None and known["parent"]["fingerprint"] != before:
            if not overwrite:
                raise ValueError(f"the parent of {self.folder.uri} has changed (fingerprint); its shards don't go with this one: pass overwrite to rebuild")
            log.warning("%s: another parent; the stored shards are discarded", self.folder.uri)
            known = None
        settings = json.loads(json.dumps(config.to_dict()))
        if known is not None and known["config"] == settings and labels is None and "labels" not in known["schemas"]:
            return known
        splits = selection.require_unique(parent.splits())
        split_sizes = {r["split"]: r["n"] for r in splits.groupBy("split").agg(F.count("*").alias("n")).collect()}
        require_pool(config, split_sizes)
        attempt = uuid.uuid4().hex
        tables = f"tables/{attempt}"
        self._plan(parent, splits, split_sizes, config).write.parquet(self._at(f"{tables}/plan"))
        plan = self.spark.read.parquet(self._at(f"{tables}/plan"))
        wanted = plan.where("stored IS NOT NULL").select("stored").distinct()

        events = parent.events(places=True).withColumnRenamed("shard", "_shard")
        columns = [c for c in events.columns if c not in ("_shard", "_row")]
        schemas = {"data": events.select(*[F.col(f"`{c}`") for c in columns]).schema.jsonValue()}
        held = self._held(known, schemas)
        missing = wanted.join(held.where("kind = 'data'").select("stored"), "stored", "left_anti") if held is not None else wanted
        routed = self._routed(events, plan, missing)
        order = [F.col("_shard"), F.col("_row")]
        first = [F.when(~F.col("stored").startswith(PASSED), F.col(c)).asc_nulls_first() for c in ("subject_id", "time")]
        self._write(routed, columns, [*first, *order], f"shards/{attempt}")
        made = [self._inventory("data", f"shards/{attempt}", missing)]
        if held is not None:
            made.append(held.where("kind = 'data'").join(wanted, "stored", "left_semi").select(*made[0].columns))
        if labels is not None:
            schemas["labels"] = labels.schema.jsonValue()
            placed = plan.where("stored IS NOT NULL").select("subject_id", "stored").distinct()
            self._write(labels.join(placed, "subject_id"), labels.columns, [F.col("subject_id")], f"labels/{attempt}")
            made.append(self._inventory("labels", f"labels/{attempt}", wanted))
        files = made[0]
        for more in made[1:]:
            files = files.unionByName(more)
        files.write.parquet(self._at(f"{tables}/files"))
        if parent.fingerprint() != before:
            raise ValueError("the parent changed while the family was built; nothing is committed: build again")
        codes = parent.codes()
        record = {
            "parent": {"path": parent.root, "fingerprint": before, "subject_set_id": digests.subject_set_digest(splits).first()[0]}, "config": settings,
            "tables": tables, "schemas": schemas, "codes": codes is not None,
        }
        if codes is not None:
            self._codes(codes, config, plan, record).write.parquet(self._at(f"{tables}/codes"))
        return self._commit(record, attempt)

    def _plan(self, parent: UriDataset, splits: DataFrame, split_sizes: dict[str, int], config: SubsetConfig) -> DataFrame:
        made = computed_plan(splits, split_sizes, config)
        if config.non_train_policy != selection.PASSTHROUGH:
            return made
        held = parent.subject_shards()
        check_splits(held, splits, made, config.train_split)
        members = self.spark.createDataFrame([(int(n),) for n in config.n_subjects], "member long")
        other = splits.where(F.col("split") != config.train_split).join(held, "subject_id", "left").crossJoin(F.broadcast(members))  # members are a handful
        return made.unionByName(other.select("member", "split", "shard", F.concat(F.lit(PASSED), "shard").alias("stored"), "subject_id"))

    @staticmethod
    def _routed(events: DataFrame, plan: DataFrame, missing: DataFrame) -> DataFrame:
        """Rows with the missing shards that hold them: by subject, or, where a shard is passed through, by the file they came from."""
        placed = plan.select("stored", "subject_id", "shard").join(missing, "stored", "left_semi")
        computed = placed.where(~F.col("stored").startswith(PASSED)).select("stored", "subject_id").distinct()
        passed = placed.where(F.col("stored").startswith(PASSED)).select("stored", F.col("shard").alias("_shard")).distinct()
        by_subject = events.join(computed, "subject_id")
        by_file = events.join(passed, "_shard")
        return by_subject.unionByName(by_file)

    def _write(self, rows: DataFrame, columns: list[str], order: list, name: str) -> None:
        """Files of ranges of a shard's rows in its order, one where the shard is small: no task sorts a large shard's rows."""
        ready = rows.repartitionByRange(F.col("stored"), *order).sortWithinPartitions("stored", *order).select(*[F.col(f"`{c}`") for c in columns], "stored")
        made = ready.write.option("parquet.block.row.count.limit", ROW_GROUP).option("maxRecordsPerFile", 0)
        made.partitionBy("stored").parquet(self._at(name))

    def _inventory(self, kind: str, name: str, wanted: DataFrame) -> DataFrame:
        """The files that a job has committed, from their footers; shards without rows have none."""
        if not any(x.startswith("stored=") for x in self.folder.names(name)):
            found = self.spark.createDataFrame([], "stored string, path string, n_rows bigint, n_bytes bigint")
        else:
            rows = self.spark.read.option("recursiveFileLookup", True).parquet(self._at(name))
            own = decoded(F.col("_metadata.file_path"))
            found = rows.groupBy(own.alias("path"), F.col("_metadata.file_size").alias("n_bytes")).agg(F.count("*").alias("n_rows"))
            name_ = F.url_decode(F.replace(F.regexp_extract("path", r"/stored=([^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))
            found = found.select(name_.alias("stored"), "path", "n_rows", "n_bytes")
        full = wanted.join(found, "stored", "left")
        return full.select(F.lit(kind).alias("kind"), "stored", "path", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))

    def _held(self, known: dict | None, schemas: dict) -> DataFrame | None:
        if known is None or known["schemas"]["data"] != schemas["data"]:
            return None
        return self.spark.read.schema(_FILES).parquet(self._at(f"{known['tables']}/files"))

    def _codes(self, codes: DataFrame, config: SubsetConfig, plan: DataFrame, record: dict) -> DataFrame:
        """(_member, the code table's columns): all codes, or those that the member's files hold."""
        members = self.spark.createDataFrame([(int(n),) for n in config.n_subjects], "_member long")
        if config.code_metadata == "copy":
            return codes.crossJoin(F.broadcast(members))  # members are a handful
        rows = Catalog(self.spark, self.folder.uri, record)._rows("data").select("stored", "code").distinct()
        shards = plan.where("stored IS NOT NULL").select(F.col("member").alias("_member"), "stored").distinct()
        observed = rows.join(shards, "stored").select("_member", "code").distinct()
        return codes.join(observed, "code").select("_member", *codes.columns)

    def vacuum(self) -> list[str]:
        """Removes what the newest record doesn't name: earlier attempts, and those of builds that were killed.  Not to be run beside a build."""
        named = F.regexp_extract("path", r"/((?:shards|labels)/[^/]*)/stored=[^/]*/[^/]*$", 1).alias("path")
        used = {r["path"] for r in self.files().where("path IS NOT NULL").select(named).distinct().collect()}  # a row an attempt
        return self._drop(("shards", "labels", "tables"), used | {self._committed()["tables"]})


class Resamples(_Recorded):
    """Resamples at a URI: the draws of all replicates, and label rows once for each draw of their subject.

    tables/<attempt>/draws and tables/<attempt>/labels are partitioned by replicate; records as in a family.
    """

    WHAT = "resample was drawn"

    def draws(self) -> DataFrame:
        """(draw_index, subject_id, replicate)."""
        return self._table("draws")

    def labels(self) -> DataFrame:
        """The label rows with draw_index and replicate."""
        if not self._committed()["labels"]:
            raise ValueError(f"the resamples at {self.folder.uri} were drawn without labels")
        return self._table("labels")

    def build(self, parent: UriDataset, config: ResampleConfig, labels: DataFrame | None = None, excluded: DataFrame | None = None) -> dict:
        """Draws, writes and commits; returns the record."""
        splits, attempt = parent.splits(), uuid.uuid4().hex
        own = splits.where(F.col("split") == config.source_split).select("subject_id").distinct()
        pool = resampling.eligible_pool(splits, config.source_split, excluded, config.allow_overlap).persist()
        try:
            n_own, size = own.count(), pool.count()
            check_pool(parent.root, splits, config, n_own, size)
            draw = resampling.with_replacement if config.replace else resampling.without_replacement
            made = draw(pool, config.size, config.salt, range(config.n_resamples))
            self._write(made.select("draw_index", "subject_id", "replicate"), f"tables/{attempt}/draws", "draw_index")
            pool_id = digests.subject_set_digest(pool).first()[0]
        finally:
            pool.unpersist()
        if labels is not None:
            columns = [c for c in resampling.LABEL_COLUMNS if c in labels.columns]
            repeated = resampling.repeat_labels(labels.select(*columns), self.spark.read.parquet(self._at(f"tables/{attempt}/draws")))
            self._write(repeated.select(*columns, "draw_index", "replicate"), f"tables/{attempt}/labels", "draw_index", *columns[1:])
        record = {
            "tables": f"tables/{attempt}", "config": json.loads(json.dumps(config.to_dict())), "labels": labels is not None, "pool_size": size, "n_excluded": n_own - size,
            "parent": {"path": parent.root, "fingerprint": parent.fingerprint(), "source_subject_set_id": digests.subject_set_digest(own).first()[0]}, "pool_subject_set_id": pool_id,
        }
        return self._commit(record, attempt)

    def _write(self, rows: DataFrame, name: str, *order: str) -> None:
        """Partitioned by replicate and by ranges of draws in it, so that no task holds a whole replicate."""
        rows.repartitionByRange("replicate", *order[:1]).sortWithinPartitions("replicate", *order).write.partitionBy("replicate").parquet(self._at(name))

    def report(self) -> DataFrame:
        """(replicate, n_draws, n_distinct, subject_multiset_id, subject_set_id, index_id), from the written rows."""
        draws = self.draws().select(F.col("replicate").cast("long"), "subject_id")
        ids = lambda rows, into: digests.subject_set_digests(rows, "replicate").select(F.col("group").cast("long").alias("replicate"), F.col("digest").alias(into))
        out = resampling.replicate_stats(draws).join(ids(draws, "subject_multiset_id"), "replicate").join(ids(draws.distinct(), "subject_set_id"), "replicate")
        if not self._committed()["labels"]:
            return out.withColumn("index_id", F.lit(None).cast("string"))
        rows = self.labels()
        bare = rows.drop("replicate", "draw_index")
        each = rows.select("replicate", digest(F.array(digests.canonical_row(bare.schema))).alias("d"))
        found = folded(each, F.col("replicate"), F.col("d"), into="index_id", part=by_digest(F.col("d")))
        return out.join(found.select(F.col("group").cast("long").alias("replicate"), "index_id"), "replicate", "left").withColumn("index_id", F.coalesce("index_id", F.lit(text_digest([]))))

    def vacuum(self) -> list[str]:
        """Removes what the newest record doesn't name.  Not to be run beside a build."""
        return self._drop(("tables",), {self._committed()["tables"]})
