"""``python -m kohorta subset|size|fingerprint|resample|pipeline``; exit codes: 0 done, 2 usage, 3 bad input."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .config import CODE_POLICIES, LINKS, SPLIT_POLICIES, ResampleConfig, SubsetConfig, load_mapping
from .sources.uris import as_uri, is_uri

UNSET = argparse.SUPPRESS  # a flag that is not given leaves the file's or the default's value


def _place(text: str) -> str | Path:
    """A URI as it is, or a path."""
    return text if is_uri(text) else Path(text)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kohorta")
    verbs = top.add_subparsers(dest="verb", required=True)

    subset = verbs.add_parser("subset", help="build nested subsets of an event or tensor cohort")
    subset.add_argument("parent", type=_place, help="a folder, or, for an output at a URI, a folder or a URI")
    subset.add_argument("output", type=_place, help="a folder for members with links, or a URI of any file system for a family as tables")
    subset.add_argument("--kind", choices=("auto", "meds", "tensorized"), default="auto")
    subset.add_argument("-n", "--n-subjects", type=int, nargs="+", default=UNSET)
    subset.add_argument("--n-subjects-per-shard", type=int, default=UNSET)
    for name, values in (("link-mode", LINKS), ("code-metadata", CODE_POLICIES), ("non-train-policy", SPLIT_POLICIES)):
        subset.add_argument(f"--{name}", choices=values, default=UNSET)
    for name in ("salt", "train-split", "name-template"):
        subset.add_argument(f"--{name}", default=UNSET)
    subset.add_argument("--index-dir", type=_place, help="label files, which members get their rows of")
    subset.add_argument("--task-name", help="folder of the members' labels (default: the name of --index-dir)")
    subset.add_argument("--force", "--overwrite", dest="force", action="store_true", help="discard what was built from another parent")

    resample = verbs.add_parser("resample", help="draw bootstrap or subsample sets")
    resample.add_argument("parent", type=_place)
    resample.add_argument("output", type=_place, help="a folder, or a URI of any file system for resamples as tables")
    for name in ("n-resamples", "size"):
        resample.add_argument(f"--{name}", type=int, default=UNSET)
    for name in ("salt", "source-split", "name-template"):
        resample.add_argument(f"--{name}", default=UNSET)
    resample.add_argument("--without-replacement", dest="replace", action="store_false", default=UNSET)
    resample.add_argument("--allow-overlap", action="store_true", default=UNSET)
    resample.add_argument("--exclude", type=_place, help="a dataset or splits file whose subjects are not drawn")
    resample.add_argument("--index-dir", "--labels", dest="index_dir", type=_place)
    resample.add_argument("--task-name")
    for verb in (subset, resample):
        verb.add_argument("-c", "--config", type=Path, help="a YAML file; flags that are given win")
        verb.add_argument("--json", action="store_true", help="print the manifest instead of a summary")

    size = verbs.add_parser("size", help="exact counts by split")
    size.add_argument("datasets", type=_place, nargs="+")
    size.add_argument("--kind", choices=("auto", "meds", "tensorized"), default="auto")
    size.add_argument("-o", "--output", type=Path, help="a Parquet file of all reports")
    size.add_argument("--json", dest="json_output", type=Path, help="a JSON file (default: beside --output)")

    fingerprint = verbs.add_parser("fingerprint", help="ids of rows, whatever their order and files")
    fingerprint.add_argument("dataset", type=_place, nargs="?")
    fingerprint.add_argument("--index-dir", type=Path, help="label files")
    fingerprint.add_argument("--train-split", default="train")
    fingerprint.add_argument("-o", "--output", type=Path)

    pipeline = verbs.add_parser("pipeline", help="write the pipeline that makes tensors of a subset with its parent's vocabulary")
    for name in ("path", "subset", "output", "parent"):
        pipeline.add_argument(name, type=Path)
    return top


def _subset(spark, args: dict, settings: dict) -> str:
    from . import build, reports, tensorized
    from .sources.dataset import is_tensorized

    parent, output, kind, force, labels, task, as_json = (args.pop(k) for k in ("parent", "output", "kind", "force", "index_dir", "task_name", "json"))
    config = SubsetConfig.from_dict(settings | args)
    if is_uri(output):
        return _catalog(spark, parent, output, config, kind, force, labels, task, as_json)
    if is_uri(parent) or (labels is not None and is_uri(labels)):
        raise ValueError(f"a parent or labels at a URI need an output at a URI; got {output}")
    if kind == "tensorized" or (kind == "auto" and is_tensorized(parent)):
        if labels is not None or task is not None:
            raise ValueError("a tensor cohort has no label files")
        made = tensorized.build_tensorized_family(spark, parent, output, config, force)
    else:
        made = build.build_family(spark, parent, output, config, force, labels, task)
    return json.dumps(made, indent=2, sort_keys=True) if as_json else reports.family_text(made, output)


def _catalog(spark, parent, output: str, config: SubsetConfig, kind: str, force: bool, labels, task: str | None, as_json: bool) -> str:
    """A family as tables at a URI."""
    from . import reports
    from .catalog import Catalog
    from .sources.uris import UriDataset, read_rows

    if kind == "tensorized" or task is not None:
        raise ValueError("a family at a URI is one of event cohorts, and its labels have no task name")
    own = Catalog(spark, output)
    made = own.build(UriDataset(spark, as_uri(parent)), config, force, None if labels is None else read_rows(spark, as_uri(labels)))
    report = [r.asDict() for r in own.report().orderBy("member", "split").collect()]  # a row a member and split
    return json.dumps(made | {"sizes": report}, indent=2, sort_keys=True) if as_json else reports.catalog_text(made, report, output)


def _resample(spark, args: dict, settings: dict) -> str:
    from . import build, reports
    from .sources.dataset import read_excluded

    parent, output, exclude, labels, task, as_json = (args.pop(k) for k in ("parent", "output", "exclude", "index_dir", "task_name", "json"))
    if is_uri(output):
        if task is not None:
            raise ValueError("the labels of resamples at a URI have no task name")
        return _resample_at(spark, parent, output, ResampleConfig.from_dict(settings | args), labels, exclude, as_json)
    if any(x is not None and is_uri(x) for x in (parent, labels, exclude)):
        raise ValueError(f"a parent, labels or exclusions at a URI need an output at a URI; got {output}")
    excluded = read_excluded(spark, exclude) if exclude is not None else None
    made = build.build_resamples(spark, parent, output, ResampleConfig.from_dict(settings | args), labels, excluded, task)
    return json.dumps(made, indent=2, sort_keys=True) if as_json else reports.resamples_text(made, output)


def _resample_at(spark, parent, output: str, config: ResampleConfig, labels, exclude, as_json: bool) -> str:
    """Resamples as tables at a URI."""
    from . import reports
    from .catalog import Resamples
    from .sources.uris import UriDataset, read_rows

    excluded = UriDataset(spark, as_uri(exclude)).splits().select("subject_id") if exclude is not None else None
    own = Resamples(spark, output)
    made = own.build(UriDataset(spark, as_uri(parent)), config, None if labels is None else read_rows(spark, as_uri(labels)), excluded)
    report = {config.resample_name(r["replicate"]): r.asDict() for r in own.report().orderBy("replicate").collect()}  # a row a replicate
    made = made | {"resamples": report}
    return json.dumps(made, indent=2, sort_keys=True) if as_json else reports.resamples_text(made | {"parent": made["parent"]["path"]}, output)


def _size(spark, args: dict) -> str:
    from . import reports

    reports.sidecar(args["output"], args["json_output"])  # before anything is counted
    made = reports.write_report([reports.size_of(spark, d, args["kind"]) for d in args["datasets"]], args["output"], args["json_output"])
    return "\n".join(map(reports.as_text, made))


def _fingerprint(spark, args: dict) -> str:
    from . import build
    from .sources.sinks import write_text
    from .sources.uris import open_dataset

    if args["dataset"] is None and args["index_dir"] is None:
        raise ValueError("name a dataset, --index-dir or both")
    out: dict = {}
    if args["dataset"] is not None:
        ids = build.fingerprint(open_dataset(spark, args["dataset"]))
        out["dataset"] = {"path": str(args["dataset"]), "dataset_id": ids.pop("dataset"), "codes_id": ids.pop("codes"), "content_ids": ids, "train_set_id": ids.get(args["train_split"])}
    if args["index_dir"] is not None:
        out["index"] = build.label_fingerprint(spark, args["index_dir"])
    text = json.dumps(out, indent=2, sort_keys=True)
    if args["output"] is None:
        return text
    write_text(args["output"], text + "\n")
    return str(args["output"])


def main(argv: list[str] | None = None, spark=None) -> int:
    args = vars(_parser().parse_args(argv))
    verb, config = args.pop("verb"), args.pop("config", None)
    try:
        if verb == "pipeline":
            from .tensorized import write_pinned_pipeline

            print(write_pinned_pipeline(**args))
            return 0
        from pyspark.sql import SparkSession

        spark = spark or SparkSession.builder.appName("kohorta").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if verb in ("subset", "resample"):
            out = (_subset if verb == "subset" else _resample)(spark, args, load_mapping(config) if config else {})
        else:
            out = (_size if verb == "size" else _fingerprint)(spark, args)
    except (ValueError, TypeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 3
    print(out)
    return 0
