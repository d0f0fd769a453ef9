"""Size reports of dataset folders: counts by split with the files that hold them, and the report's outputs."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.framing import PREFIX, folded_whole
from .operators import sizes
from .sources.dataset import EventDataset, is_tensorized, split_label
from .sources.sinks import write_json, write_one_file
from .sources.tensors import TensorCohort
from .sources.uris import UriDataset, is_uri, open_dataset

# The columns of a report.
COUNTS = ("n_subjects", "n_events", "n_measurements", "n_dynamic_measurements", "n_static_measurements", "n_subjects_with_static")
COLUMNS = ("source", "kind", "split", *COUNTS, "n_codes_observed", "observed_code_set_id", "n_shards", "n_bytes")
SHOWN = ("split", "n_subjects", "n_events", "n_measurements", "n_shards", "n_bytes")
KINDS = ("auto", "meds", "tensorized")


def event_report(dataset: EventDataset | UriDataset, splits: DataFrame | Mapping[int, str] | None = None) -> DataFrame:
    """One row a split and the total: counts, codes and files of an event dataset; ``splits`` goes before the folder's own.

    A shard belongs to every split that it holds rows of; the total counts each once.
    """
    events = dataset.sized_events()
    if splits is None:
        try:
            splits = dataset.splits()
        except ValueError:  # neither a file nor names tell
            splits = None
    counts = sizes.size_report(events, splits, code_ids=True).withColumnsRenamed({"n_dynamic": "n_dynamic_measurements", "n_static": "n_static_measurements"})
    held = sizes.with_split(dataset.subject_shards(), splits).select("split", "shard").distinct().join(dataset.files(), "shard")
    report = counts.join(held.groupBy("split").agg(F.count("*").alias("n_shards"), F.sum("n_bytes").alias("n_bytes")), "split", "left").na.fill(0, ["n_shards", "n_bytes"])
    codes = events.select("code").where("code IS NOT NULL").distinct()
    return _with_total(report, codes, dataset.files(), str(dataset.root), "meds")


def tensor_report(cohort: TensorCohort) -> DataFrame:
    """The same of a tensor cohort: statics from the schemas, events and measurements from the tensors' headers, codes from the vocabulary."""
    rows = cohort.rows()
    statics = sizes.list_length(F.col("static_code")).cast("long")
    own = rows.groupBy("shard").agg(F.count("*").alias("n_subjects"), F.sum(statics).alias("n_static_measurements"), F.sum((statics > 0).cast("long")).alias("n_subjects_with_static"))
    each = cohort.headers().join(own, "shard", "left").na.fill(0)
    split = F.when(F.instr("shard", "/") > 0, split_label(F.col("shard"))).otherwise(F.lit(sizes.ALL))
    report = each.groupBy(split.alias("split")).agg(
        F.sum("n_subjects").alias("n_subjects"), F.sum("n_events").alias("n_events"), F.sum(F.col("n_dynamic") + F.col("n_static_measurements")).alias("n_measurements"),
        F.sum("n_dynamic").alias("n_dynamic_measurements"), F.sum("n_static_measurements").alias("n_static_measurements"), F.sum("n_subjects_with_static").alias("n_subjects_with_static"),
        F.count("*").alias("n_shards"), F.sum("n_bytes").alias("n_bytes"),
    )
    codes = cohort.codes().select("code").where("code IS NOT NULL").distinct()
    whole = _code_set(codes)
    return _with_total(report.join(F.broadcast(whole)), codes, cohort.headers().select("shard", "n_bytes"), str(cohort.root), "tensorized")


def _code_set(codes: DataFrame) -> DataFrame:
    """One row: how many codes, and their id."""
    return codes.agg(F.count("*").alias("n_codes_observed")).join(F.broadcast(folded_whole(codes, F.col("code"), into="observed_code_set_id")))


def _with_total(report: DataFrame, codes: DataFrame, files: DataFrame, source: str, kind: str) -> DataFrame:
    sums = report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]).withColumn("split", F.lit(sizes.TOTAL))
    once = files.agg(F.count("*").alias("n_shards"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))  # one row
    total = sums.join(F.broadcast(_code_set(codes))).join(F.broadcast(once))
    names = [c for c in COLUMNS if c not in ("source", "kind")]
    return report.select(*names).unionByName(total.select(*names)).select(F.lit(source).alias("source"), F.lit(kind).alias("kind"), *names)


def size_of(spark, root: str | Path, kind: str = "auto") -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"the kind must be one of {', '.join(KINDS)}; got {kind!r}")
    if is_uri(root):
        if kind == "tensorized":
            raise ValueError(f"a tensor cohort must be a folder; got {root}")
        return event_report(open_dataset(spark, root))
    tensors = is_tensorized(Path(root)) if kind == "auto" else kind == "tensorized"
    return tensor_report(TensorCohort(spark, root)) if tensors else event_report(EventDataset(spark, root))


def ordered(report: DataFrame) -> DataFrame:
    """Splits by name, the total last, in the order in which sources come."""
    return report.orderBy("source", (F.col("split") == sizes.TOTAL).cast("int"), "split")


def sidecar(output: Path | None, beside: Path | None) -> Path | None:
    """Where the JSON goes: beside the table unless named, and never over it."""
    path = beside or (output.with_suffix(".json") if output else None)
    if path is not None and output is not None and path.resolve() == output.resolve():
        raise ValueError(f"the table and the JSON would both be written to {path}; name another path for the JSON")
    return path


def as_dict(report: DataFrame) -> dict:
    """The JSON form of one report."""
    rows = [r.asDict() for r in ordered(report).collect()]
    total = rows[-1]
    shared = ("source", "kind", "n_codes_observed", "observed_code_set_id", "n_shards", "n_bytes")
    bare = lambda r: {k: v for k, v in r.items() if k not in ("source", "kind")}
    return {k: total[k] for k in shared} | {"splits": [bare(r) for r in rows[:-1]], "total": bare(total)}


def write_report(reports: list[DataFrame], output: Path | None, beside: Path | None) -> list[dict]:
    path = sidecar(output, beside)
    made = [as_dict(r) for r in reports]
    if output is not None:
        whole = reports[0]
        for r in reports[1:]:
            whole = whole.unionByName(r)
        write_one_file(ordered(whole), output)
    if path is not None:
        write_json(path, {"datasets": made})
    return made


def as_text(made: dict) -> str:
    """A small table of one report."""
    rows = [*made["splits"], made["total"]]
    width = {c: max(len(c), *(len(str(r[c])) for r in rows)) for c in SHOWN}
    line = lambda r: "  " + "  ".join(str(r[c]).ljust(width[c]) if c == "split" else str(r[c]).rjust(width[c]) for c in SHOWN)
    codes = f"  n_codes_observed={made['n_codes_observed']}  observed_code_set_id={made['observed_code_set_id'].removeprefix(PREFIX)[:16]}"
    return "\n".join([f"{made['source']} ({made['kind']})", line({c: c for c in SHOWN}), *map(line, rows), codes])


def family_text(made: dict, output: str | Path) -> str:
    """What a build made, in a few lines."""
    members = made["members"].values()
    lines = [f"Built {len(members)} member{'' if len(members) == 1 else 's'} from {made['parent']['path']} into {output}"]
    for m in members:
        own = m.get("train_set_id") or m["train_subject_set_id"]
        lines.append(f"  {m['name']}  n_subjects={m['n_subjects']}  shards={len(m['shards'])}  train_set_id={own.removeprefix(PREFIX)[:16]}")
    d = made["disk"]
    lines.append(f"  disk: {d['n_bytes_on_disk']} bytes, {d['n_bytes_independent_copies']} as copies of their own (saved {d['n_bytes_saved']}); store {d['n_store_files']} files, cache {d['n_bytes_cache']} bytes")
    return "\n".join(lines)


def catalog_text(made: dict, report: list[dict], output: str) -> str:
    """What a build at a URI made, in a few lines."""
    lines = [f"Built members of {', '.join(map(str, made['config']['n_subjects']))} subjects from {made['parent']['path']} into {output}"]
    lines += [f"  {r['member']} {r['split']}  n_subjects={r['n_subjects']}  n_measurements={r['n_measurements']}  shards={r['n_shards']}  content_id={(r['content_id'] or '').removeprefix(PREFIX)[:16]}" for r in report]
    return "\n".join(lines)


def resamples_text(made: dict, output: str | Path) -> str:
    lines = [f"Drew {len(made['resamples'])} resamples from {made['pool_size']} subjects of {made['parent']} ({made['n_excluded']} excluded) into {output}"]
    lines += [f"  {name}  n_draws={r['n_draws']}  n_distinct={r['n_distinct']}  multiset={r['subject_multiset_id'].removeprefix(PREFIX)[:16]}" for name, r in made["resamples"].items()]
    return "\n".join(lines)
