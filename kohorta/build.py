"""Building families of nested subsets, and resamples, on a file system."""

from __future__ import annotations

import json
import logging
import shutil
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import cached_subjects
from .config import ResampleConfig, SubsetConfig
from .functions.framing import PREFIX, by_digest, combined_ids, folded, text_digest
from .functions.ranks import shard_key
from .operators import digests, resampling, selection, sizes
from .sources.dataset import CODES_FILE, DATASET_FILE, SPLITS_FILE, EventDataset, bytes_below, literal, read_labels, read_shards, shard_name, shard_paths
from .sources.sinks import ShardStore, is_placed, place, prune, write_json, write_one_file, write_partitioned

STORE, CACHE, FAMILY, MANIFEST, TASKS = ".shard_store", ".cache", "family.json", "manifest.json", "tasks"
#: Key of a member's dataset.json that says what it is a subset of.
SUBSET_OF = "subset_of"
log = logging.getLogger(__name__)


def fingerprint(dataset: EventDataset) -> dict[str, str]:
    """The splits' content ids, the code table's digest and the dataset's id."""
    ids = digests.content_ids(dataset.events().drop("shard"), dataset.splits())
    found = {r["split"]: r["content_id"] for r in ids.collect()}
    codes_id = codes_digest(dataset.codes())
    return found | {"codes": codes_id, "dataset": dataset_id(found, codes_id)}


def codes_digest(codes: DataFrame | None) -> str:
    """The code table's digest; that of nothing where there is none."""
    return text_digest([]) if codes is None else digests.frame_digest(codes).first()[0]


def dataset_id(content_ids: dict[str, str], codes_id: str) -> str:
    return combined_ids({f"data/{split}": value for split, value in content_ids.items()} | {"metadata/codes.parquet": codes_id})


def label_fingerprint(spark: SparkSession, folder: Path) -> dict[str, object]:
    """The id of the label rows of a folder, whatever their files, and their number."""
    rows = read_labels(spark, Path(folder)).drop("shard")
    return {"path": str(folder), "index_id": digests.frame_digest(rows).first()[0], "n_index_rows": rows.count()}


def salt_id(salt: str) -> str:
    return text_digest([salt]).removeprefix(PREFIX)[:8]


def computed_plan(splits: DataFrame, split_sizes: dict[str, int], config: SubsetConfig) -> DataFrame:
    """(member, split, shard, stored, subject_id) of the splits that members are selected from."""
    ranked_splits = splits if config.non_train_policy == selection.SUBSET else splits.where(F.col("split") == config.train_split)
    ranks = selection.ranked(ranked_splits, config.salt, "split")
    rows = [(int(n), split, int(min(n, size))) for n in config.n_subjects for split, size in split_sizes.items()]
    limits = splits.sparkSession.createDataFrame(rows, "member long, split string, n long")  # members times splits
    own = ranks.join(F.broadcast(limits), "split").where(F.col("rank") < F.col("n"))
    size = config.n_subjects_per_shard
    shard = F.concat("split", F.lit("/"), F.floor(F.col("rank") / size).cast("string"))
    key = F.concat("split", F.lit(f"/{salt_id(config.salt)}/"), shard_key(F.col("rank"), size, F.col("n")))
    return own.select("member", "split", shard.alias("shard"), key.alias("stored"), "subject_id")


def require_pool(config: SubsetConfig, split_sizes: dict[str, int]) -> None:
    """Every member's size is checked before anything is written."""
    pool = split_sizes.get(config.train_split, 0)
    for n in config.n_subjects:
        if n > pool:
            raise ValueError(f"cannot build a subset of {n} subjects: the {config.train_split!r} split has {pool}")


def check_splits(held: DataFrame, splits: DataFrame, made: DataFrame, train: str) -> None:
    """Refuses to pass shards (of ``held``) through that mix splits, or that have the names of computed ones."""
    mixed = selection.mixed_shards(held, splits, train).limit(5).collect()
    if mixed:
        raise ValueError(f"shards {[r['shard'] for r in mixed]} of the parent mix {train!r} and other subjects; use another policy than passthrough")
    clash = held.join(splits.where(F.col("split") != train), "subject_id").select("shard").distinct().join(made.select("shard").distinct(), "shard").limit(5).collect()
    if clash:
        raise ValueError(f"shards {[r['shard'] for r in clash]} of the parent have the names of computed ones; use another policy than passthrough")


def check_record(output: Path, store: ShardStore, parent: dict, overwrite: bool) -> None:
    """Refuses another parent than the recorded ones: the store's shards are not its rows.  Or starts anew, if told to.

    The store names its parent before it gets its first shard, so shards of a build that was killed are known too; the
    family's record comes last.
    """
    record = output / FAMILY
    known = [x for x in (store.parent(), json.loads(record.read_text(encoding="utf-8"))["parent"] if record.is_file() else None) if x is not None]
    moved = [name for name in ("subject_set_id", "fingerprint") if any(x.get(name) != parent[name] for x in known)]
    if not known and store.size()[0]:
        moved = ["no record says whose its shards are"]
    if moved and not overwrite:
        raise ValueError(f"the parent of {output} has changed ({moved[0]}); its shards don't go with this one: pass overwrite to rebuild")
    if moved:
        log.warning("%s: another parent; the stored shards are discarded", output)
        store.discard()
        record.unlink(missing_ok=True)
    store.own(parent)


def check_unmoved(store: ShardStore, before: str, after: str) -> None:
    """Refuses, and discards, what was read from a parent that changed meanwhile."""
    if before != after:
        store.discard()
        raise ValueError("the parent changed while the family was built; its shards are discarded: build again")


class Family:
    """One build: the parent, its splits, and the tables that all members are made from."""

    def __init__(self, spark: SparkSession, parent: str | Path, output: str | Path, config: SubsetConfig):
        self.spark, self.config, self.output = spark, config, Path(output)
        self.dataset = EventDataset(spark, parent)
        self.splits = selection.require_unique(self.dataset.splits())
        self.store = ShardStore(self.output / STORE)
        self.parent = {
            "path": str(parent),
            "subject_set_id": digests.subject_set_digest(self.splits).first()[0],
            "fingerprint": self.dataset.fingerprint(),
        }
        found = self.splits.groupBy("split").agg(F.count("*").alias("n")).collect()
        self.split_sizes = {r["split"]: r["n"] for r in found}

    def check(self, overwrite: bool) -> None:
        require_pool(self.config, self.split_sizes)
        check_record(self.output, self.store, self.parent, overwrite)
        if self.config.code_metadata == "prune" and len(self.config.n_subjects) > 1:
            log.warning("the members' code tables are pruned, so their vocabularies differ; copy the code metadata to share the parent's")

    def plan(self) -> DataFrame:
        """(member, split, shard, stored, subject_id) of every subject of every member.

        ``shard`` names the member's file, ``stored`` the store's: a rank range of the salt, or a shard of the parent.
        """
        config, splits = self.config, self.splits
        made = computed_plan(splits, self.split_sizes, config)
        if config.non_train_policy != selection.PASSTHROUGH:
            return made
        held = self.dataset.subject_shards()
        check_splits(held, splits, made, config.train_split)
        members = self.spark.createDataFrame([(int(n),) for n in config.n_subjects], "member long")
        other = splits.where(F.col("split") != config.train_split).join(held, "subject_id", "left").crossJoin(F.broadcast(members))  # members are a handful
        passed = other.select("member", "split", "shard", F.concat(F.lit("passthrough/"), "shard").alias("stored"), "subject_id")
        return made.unionByName(passed)

    def subjects(self) -> DataFrame:
        """(subject_id, digest, events, measurements, statics, codes) of every subject with rows, kept by the parent's files."""
        return cached_subjects(self.dataset, self.output / CACHE)


def build_family(
    spark: SparkSession, parent: str | Path, output: str | Path, config: SubsetConfig, overwrite: bool = False, labels: str | Path | None = None, task: str | None = None
) -> dict:
    """Every member in ``output``: shards are written once and linked into all members that hold them.

    ``labels``: a folder of label files, whose rows each member gets under ``tasks/<task>``, one file a data shard.
    """
    if labels is None and task is not None:
        raise ValueError(f"a task name needs labels; got {task!r}")
    if (made := unchanged(Path(output), EventDataset(spark, parent), config, labels, task)) is not None:
        return made
    family = Family(spark, parent, output, config)
    family.check(overwrite)
    output, dataset, store = family.output, family.dataset, family.store
    plan = family.plan().persist()
    try:
        placed = plan.select("member", "split", "shard", "stored").where("shard IS NOT NULL").distinct().collect()  # a row a file
        computed = {r["stored"] for r in placed if not r["stored"].startswith("passthrough/")}
        events = dataset.events(places=True)
        columns = [c for c in events.columns if c not in ("shard", "_row")]
        routed = selection.routed(events.withColumnRenamed("shard", "_shard"), plan.select("subject_id", F.col("stored").alias("shard")).distinct()).withColumnRenamed("shard", "stored")
        store.put_partitioned(routed, computed, columns, selection.output_order("_shard", "_row"))
        for key in {r["stored"] for r in placed} - computed:
            source = dataset.data / f"{key.removeprefix('passthrough/')}.parquet"
            store.put(key, lambda aside, source=source: shutil.copy2(source.resolve(), aside) and None)
        check_unmoved(store, family.parent["fingerprint"], EventDataset(spark, parent).fingerprint())
        report = _members(family, plan, placed)
        if labels is not None:
            _labels(family, plan, placed, report, Path(labels), task or Path(labels).name)
    finally:
        plan.unpersist()
    for made in report.values():
        write_json(output / made["name"] / MANIFEST, {"parent": family.parent, "config": config.to_dict(), "member": made})
    made = {"parent": family.parent, "config": config.to_dict(), "labels": labels_stamp(labels), "members": {m["name"]: m for m in report.values()}, "disk": disk(output, store)}
    write_json(output / FAMILY, made)
    return made


def labels_stamp(labels: str | Path | None) -> str | None:
    """A digest of the label files' names, sizes and times."""
    if labels is None:
        return None
    stats = [(shard_name(Path(labels), p), p.stat()) for p in shard_paths(Path(labels))]
    return text_digest(f"{name}\x1f{stat.st_size}\x1f{stat.st_mtime_ns}" for name, stat in stats)


def unchanged(output: Path, parent: EventDataset, config: SubsetConfig, labels: str | Path | None, task: str | None) -> dict | None:
    """The family's record, if a build with these settings would change no file: then no job is run.

    The parent's files, the settings and the labels are those of the record, and every member's tree is what the record
    plans: its data files are the store's, and no other is there.
    """
    record = output / FAMILY
    if not record.is_file():
        return None
    made = json.loads(record.read_text(encoding="utf-8"))
    store = ShardStore(output / STORE)
    same = made["parent"]["fingerprint"] == parent.fingerprint() and made["config"] == json.loads(json.dumps(config.to_dict())) and made.get("labels") == labels_stamp(labels)
    if not same or (store.parent() or {}).get("fingerprint") != made["parent"]["fingerprint"]:
        return None
    name = (task or Path(labels).name) if labels is not None else None
    for m in made["members"].values():
        root = output / m["name"]
        files = {shard: store.root / stored for shard, stored in m["shards"].items()}
        if m["task"] != name or not all((root / x).is_file() for x in (SPLITS_FILE, DATASET_FILE, MANIFEST)):
            return None
        there = {shard_name(root / "data", p) for p in shard_paths(root / "data")}
        if there != set(files) or not all(store.has(stored.removesuffix(".parquet")) for stored in m["shards"].values()):
            return None
        if not all(is_placed(stored, root / "data" / f"{shard}.parquet", config.link_mode) for shard, stored in files.items()):
            return None
        if (parent.root / CODES_FILE).is_file() != (root / CODES_FILE).is_file():
            return None
        if name is not None and {shard_name(root / TASKS / name, p) for p in shard_paths(root / TASKS / name)} != set(files):
            return None
    return made


def _members(family: Family, plan: DataFrame, placed: list) -> dict[int, dict]:
    """Places every member's files; ids and sizes of all members come from the subjects' table at once."""
    config, output, store, dataset, spark = family.config, family.output, family.store, family.dataset, family.spark
    each = plan.select("member", "split", "subject_id").distinct()
    found = each.join(family.subjects(), "subject_id")
    name = F.concat(F.col("member").cast("string"), F.lit("/"), "split").alias("name")
    ids = {r["name"]: r["content_id"] for r in digests.content_ids_of(found.select(name, "subject_id", "digest"), "name").collect()}
    sums = found.groupBy("member", "split").agg(
        F.count("*").alias("n_subjects"), F.sum("events").alias("n_events"), F.sum("measurements").alias("n_measurements"),
        F.sum(F.col("measurements") - F.col("statics")).alias("n_dynamic"), F.sum("statics").alias("n_static"), F.sum((F.col("statics") > 0).cast("long")).alias("n_subjects_with_static"),
    )
    counted = {(r["member"], r["split"]): r.asDict() for r in sums.collect()}
    codes = found.select("member", "split", F.explode("codes").alias("code")).distinct().persist()
    by_split = codes.groupBy("member", "split").agg(F.count("*").alias("n"), digests.digest(F.sort_array(F.collect_list("code"))).alias("id")).collect()
    observed = {(r["member"], r["split"]): (r["n"], r["id"]) for r in by_split}
    whole = codes.select("member", "code").distinct().groupBy("member").agg(F.count("*").alias("n"), digests.digest(F.sort_array(F.collect_list("code"))).alias("id"))
    of_member = {r["member"]: (r["n"], r["id"]) for r in whole.collect()}
    listed = each.select("member", "split").distinct().collect()  # members times splits
    sets = {r["group"]: r["digest"] for r in digests.subject_set_digests(each.select("member", "subject_id").distinct(), "member").collect()}
    codes_ids: dict[str, str] = {}
    out = {}
    for n in config.n_subjects:
        own = [r for r in placed if r["member"] == n]
        root, files = output / config.subset_name(n), {r["shard"]: r["stored"] for r in own}
        for shard, stored in files.items():
            place(store.path(stored), root / "data" / f"{shard}.parquet", config.link_mode)
        prune(root / "data", set(files))
        kept = each.where(F.col("member") == n).select("subject_id", "split")
        write_one_file(kept.orderBy("split", "subject_id"), root / SPLITS_FILE)
        n_codes, code_set = of_member.get(n, (0, text_digest([])))
        codes_id = _codes(family, root, codes.where(F.col("member") == n).select("code").distinct(), code_set, codes_ids)
        splits = sorted(r["split"] for r in listed if r["member"] == n)
        content = {s: ids.get(f"{n}/{s}", text_digest([])) for s in splits}
        table = []
        for s in splits:
            paths = [store.path(r["stored"]) for r in own if r["split"] == s]
            counts = counted.get((n, s)) or dict.fromkeys(sizes.ADDITIVE, 0)
            k, set_id = observed.get((n, s), (0, text_digest([])))
            table.append({"split": s, **{c: counts[c] for c in sizes.ADDITIVE}, "n_codes_observed": k, "observed_code_set_id": set_id, "n_shards": len(set(paths)), "n_bytes": sum(p.stat().st_size for p in set(paths))})
        total = {c: sum(r[c] for r in table) for c in sizes.ADDITIVE}
        total |= {"split": sizes.TOTAL, "n_codes_observed": n_codes, "observed_code_set_id": code_set, "n_shards": len(files), "n_bytes": sum(store.path(x).stat().st_size for x in set(files.values()))}
        subject_set = sets[str(n)]
        made = {
            "name": root.name, "root": str(root), "n_subjects": n, "subject_set_id": subject_set, "train_set_id": content.get(config.train_split, text_digest([])), "content_ids": content,
            "dataset_id": dataset_id(content, codes_id), "codes_id": codes_id, "observed_code_set_id": code_set, "shards": {k: f"{v}.parquet" for k, v in sorted(files.items())}, "sizes": [*table, total],
            "index_id": None, "n_index_rows": None, "task": None,
        }
        _dataset_json(family, root, {"parent": family.parent["path"], "parent_subject_set_id": family.parent["subject_set_id"], "parent_fingerprint": family.parent["fingerprint"], "subset_id": made["dataset_id"], "subject_set_id": subject_set, "n_subjects": n, "tool": "kohorta"})
        out[n] = made
    codes.unpersist()
    return out


def _codes(family: Family, root: Path, observed: DataFrame, code_set: str, known: dict[str, str]) -> str:
    """Places the member's code table and gives its digest; members with the same observed codes share a pruned one."""
    source = family.dataset.root / CODES_FILE
    if not source.is_file():
        return text_digest([])
    if family.config.code_metadata == "copy":
        key = "metadata/codes/parent"
        stored = family.store.put(key, lambda aside: shutil.copy2(source.resolve(), aside) and None)
    else:
        key = f"metadata/codes/{code_set.removeprefix(PREFIX)[:16]}"
        codes = family.dataset.codes()
        if not family.store.has(key):
            write_one_file(codes.join(observed, "code", "left_semi").select(*codes.columns).orderBy("code"), family.store.path(key))
        stored = family.store.path(key)
    place(stored, root / CODES_FILE, family.config.link_mode)
    if key not in known:
        known[key] = codes_digest(family.spark.read.parquet(literal(stored)))
    return known[key]


def _dataset_json(family: Family, root: Path, block: dict) -> None:
    source = family.dataset.root / DATASET_FILE
    found = json.loads(source.read_text(encoding="utf-8")) if source.is_file() else {}
    if not isinstance(found, dict):
        raise ValueError(f"{source} holds no JSON object")
    write_json(root / DATASET_FILE, found | {SUBSET_OF: block})


def _labels(family: Family, plan: DataFrame, placed: list, report: dict[int, dict], folder: Path, task: str) -> None:
    """Every member's label rows, one file a data shard, in one job; the columns are taken as they are found."""
    labels = read_labels(family.spark, folder, places=True).withColumnRenamed("shard", "_shard")
    columns = [c for c in labels.columns if c not in ("_shard", "_row")]
    target = F.concat(F.col("member").cast("string"), F.lit("/"), "shard").alias("target")
    rows = labels.join(plan.where("shard IS NOT NULL").select("subject_id", target), "subject_id")
    names = {f"{r['member']}/{r['shard']}" for r in placed}
    root_of = lambda n: family.output / family.config.subset_name(int(n)) / TASKS / task

    def path_of(key: str) -> Path:
        n, _, shard = key.partition("/")
        return root_of(n) / f"{shard}.parquet"

    write_partitioned(rows, "target", names, path_of, family.output, columns, [F.col("_shard"), F.col("_row")])
    for n, made in report.items():
        prune(root_of(n), {r["shard"] for r in placed if r["member"] == n})
        found = label_fingerprint(family.spark, root_of(n))
        made |= {"index_id": found["index_id"], "n_index_rows": found["n_index_rows"], "task": task}


def disk(output: Path, store: ShardStore) -> dict[str, int]:
    """What the family takes, but for its record, and what its members would take as copies of their own."""
    record = output / FAMILY
    own = record.stat().st_size if record.is_file() else 0
    members = [p for p in output.iterdir() if p.is_dir() and not p.name.startswith(".")]
    on_disk, copies = bytes_below(output)[1] - own, sum(bytes_below(m)[0] for m in members)
    files, size = store.size()
    return {"n_bytes_on_disk": on_disk, "n_bytes_independent_copies": copies, "n_bytes_saved": copies - on_disk, "n_store_files": files, "n_store_bytes": size, "n_bytes_cache": bytes_below(output / CACHE)[1]}


def check_pool(parent: str | Path, splits: DataFrame, config: ResampleConfig, n_own: int, size: int) -> None:
    """Refuses a split without subjects (of ``n_own``), and a pool (of ``size``) that can't give the draws."""
    if not n_own:
        raise ValueError(f"the split {config.source_split!r} of {parent} has no subjects; its splits are {sorted(r['split'] for r in splits.select('split').distinct().collect())}")
    if not size:
        raise ValueError(f"no subjects left to draw from in split {config.source_split!r}")
    if not config.replace and config.size > size:
        raise ValueError(f"cannot draw {config.size} distinct subjects from {size}")


def build_resamples(spark: SparkSession, parent: str | Path, output: str | Path, config: ResampleConfig, labels: str | Path | None = None, excluded: DataFrame | Iterable[int] | None = None, task: str | None = None) -> dict:
    """``resamples/<name>``: the draws, and the labels once for each draw of their subject, in files as the labels' own.

    ``excluded``: subjects not to draw, unless the configuration allows an overlap.
    """
    if labels is None and task is not None:
        raise ValueError(f"a task name needs labels; got {task!r}")
    dataset, root = EventDataset(spark, parent), Path(output) / "resamples"
    if excluded is not None and not isinstance(excluded, DataFrame):
        excluded = spark.createDataFrame([(int(i),) for i in excluded], "subject_id long")
    splits = dataset.splits()
    own = splits.where(F.col("split") == config.source_split).select("subject_id").distinct()
    n_own = own.count()
    pool = resampling.eligible_pool(splits, config.source_split, excluded, config.allow_overlap).cache()
    size = pool.count()
    check_pool(parent, splits, config, n_own, size)
    shared = {
        "parent": str(parent), "parent_subject_set_id": digests.subject_set_digest(own).first()[0], "pool_subject_set_id": digests.subject_set_digest(pool).first()[0], "pool_size": size,
        "n_excluded": n_own - size, "excluded_set_id": None if excluded is None else digests.subject_set_digest(excluded).first()[0], "task": task or (Path(labels).name if labels is not None else None),
    }
    names = [config.resample_name(i) for i in range(config.n_resamples)]
    _prune_resamples(root, names)
    draw = resampling.with_replacement if config.replace else resampling.without_replacement
    named = F.element_at(F.array(*map(F.lit, names)), (F.col("replicate") + 1).cast("int")).alias("name")  # a name a replicate
    draws = draw(pool, config.size, config.salt, range(config.n_resamples)).select("replicate", named, "draw_index", "subject_id").persist()
    try:
        write_partitioned(draws, "name", names, lambda name: root / name / "subjects.parquet", root, ["subject_id", "draw_index"], [F.col("draw_index")])
        index_ids = {}
        if labels is not None:
            rows = read_labels(spark, Path(labels), places=True).withColumnRenamed("shard", "_shard")
            columns = [c for c in resampling.LABEL_COLUMNS if c in rows.columns]
            files = [p.relative_to(labels).as_posix().removesuffix(".parquet") for p in shard_paths(Path(labels))]
            repeated = resampling.repeat_labels(rows, draws).withColumn("target", F.concat_ws("/labels/", "name", "_shard"))
            targets = [f"{name}/labels/{f}" for name in names for f in files]
            write_partitioned(repeated, "target", targets, lambda t: root / f"{t}.parquet", root, columns, [F.col("draw_index"), F.col("_row")])
            index_ids = _index_ids(spark, root, [root / f"{t}.parquet" for t in targets])
        stats = {r["replicate"]: r for r in resampling.replicate_stats(draws).collect()}
        by_name = lambda rows: {r["group"]: r["digest"] for r in digests.subject_set_digests(rows, "name").collect()}
        multisets, sets = by_name(draws.select("name", "subject_id")), by_name(draws.select("name", "subject_id").distinct())
    finally:
        draws.unpersist()
        pool.unpersist()
    report = {}
    for i, name in enumerate(names):
        report[name] = {
            "replicate": i, "n_draws": stats[i]["n_draws"], "n_distinct": stats[i]["n_distinct"], "subject_multiset_id": multisets[name], "subject_set_id": sets[name],
            "index_id": index_ids.get(name, text_digest([])) if labels is not None else None,
        }
        write_json(root / name / MANIFEST, report[name] | shared | {"config": config.to_dict()})
    made = shared | {"config": config.to_dict(), "resamples": report}
    write_json(root / FAMILY, made)
    return made


def _index_ids(spark: SparkSession, root: Path, paths: list[Path]) -> dict[str, str]:
    """{replicate's name: the id of its label rows}, read from their files in one job."""
    rows = read_shards(spark, root, paths)
    name = F.split_part("shard", F.lit("/labels/"), F.lit(1)).alias("name")
    each = rows.select(name, digests.digest(F.array(digests.canonical_row(rows.drop("shard").schema))).alias("digest"))
    return {r["group"]: r["digest"] for r in folded(each, F.col("name"), F.col("digest"), part=by_digest(F.col("digest"))).collect()}


def _prune_resamples(root: Path, names: list[str]) -> None:
    """Removes the labels of replicates that are built anew, and replicates of an earlier build that this one doesn't name."""
    for old in sorted(root.iterdir()) if root.is_dir() else []:
        if old.is_symlink() or not old.is_dir():
            continue
        if old.name not in names and (old / MANIFEST).is_file():
            shutil.rmtree(old)
        elif old.name in names and (old / "labels").is_dir():
            shutil.rmtree(old / "labels")
