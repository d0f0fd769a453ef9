import json
import shutil

import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kohorta.build import build_family, build_resamples, fingerprint
from kohorta.catalog import Catalog, Resamples
from kohorta.config import ResampleConfig, SubsetConfig
from kohorta.plans import views
from kohorta.sources.dataset import EventDataset, NotADatasetError
from kohorta.sources.sinks import write_one_file
from kohorta.sources.uris import UriDataset, is_uri


@pytest.fixture(scope="module")
def parent(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("cohort[1] a+b%")
    splits = views.splits(spark, sf_dir)
    rows = views.events(spark, sf_dir).join(splits, "subject_id")
    for split in ("train", "tuning", "held_out"):
        own = rows.where(F.col("split") == split).drop("split")
        write_one_file(own.repartition(1), root / "data" / split / "0.parquet")
    write_one_file(splits, root / "metadata" / "subject_splits.parquet")
    write_one_file(views.codes(spark, sf_dir), root / "metadata" / "codes.parquet")
    return root


def uri(path):
    return f"file://{path}"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_family_at_a_uri_holds_the_rows_of_a_linked_one(spark, parent, sf_dir, tmp_path):
    config = SubsetConfig((20, 45, 60), n_subjects_per_shard=20)
    linked = build_family(spark, parent, tmp_path / "linked", config)
    own = Catalog(spark, uri(tmp_path / "tables"))
    labels = views.labels(spark, sf_dir).drop("label_id")
    made = own.build(UriDataset(spark, uri(parent)), config, labels=labels)
    assert made["parent"]["subject_set_id"] == linked["parent"]["subject_set_id"]
    report = {(r.member, r.split): r for r in own.report().collect()}
    for m in linked["members"].values():
        n, files = m["n_subjects"], EventDataset(spark, m["root"])
        assert rows_of(own.events(n).select("subject_id", "time", "code", "numeric_value", "shard")) == rows_of(files.events())
        assert rows_of(own.splits(n)) == rows_of(files.splits().select("subject_id", "split"))
        assert rows_of(own.codes(n)) == rows_of(files.codes())
        for r in m["sizes"][:-1]:
            got = report[n, r["split"]]
            assert got.content_id == m["content_ids"][r["split"]] and got.n_bytes > 0
            assert all(got[c] == r[c] for c in ("n_subjects", "n_events", "n_measurements", "n_dynamic", "n_static", "n_codes_observed", "n_shards"))
        held = own.plan().where(F.col("member") == n).where("shard IS NOT NULL").select("subject_id")
        want = labels.join(held, "subject_id", "left_semi")
        assert rows_of(own.labels(n).select(*labels.columns)) == rows_of(want)
    shared = own.plan().where("stored LIKE 'train/%'").select("member", "stored").distinct().groupBy("stored").count().collect()
    assert sorted(r["count"] for r in shared) == [1, 1, 2, 3]
    files = own.files().where("kind = 'data'").collect()
    assert len(files) == len({r.stored for r in files}) and {"passthrough/tuning/0", "passthrough/held_out/0"} < {r.stored for r in files}
    computed = next(r for r in files if r.stored.startswith("train/") and "r0000000000-0000000020" in r.stored)
    table = pq.read_table(computed.path.removeprefix("file:").replace("///", "/"), partitioning=None).to_pylist()
    assert [(r["subject_id"], r["time"] is not None, r["time"]) for r in table] == sorted(((r["subject_id"], r["time"] is not None, r["time"]) for r in table), key=lambda x: (x[0], x[1], str(x[2])))
    passed = next(r for r in files if r.stored == "passthrough/tuning/0")
    copy = pq.read_table(passed.path.removeprefix("file:").replace("///", "/"), partitioning=None)
    assert copy.to_pylist() == pq.read_table(parent / "data" / "tuning" / "0.parquet").to_pylist()  # the file's own order


def test_rebuilds_write_what_is_missing_and_nothing_else(spark, parent, tmp_path):
    own, source = Catalog(spark, uri(tmp_path)), UriDataset(spark, uri(parent))
    own.build(source, SubsetConfig((20, 40), n_subjects_per_shard=20))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()}
    first = own.record()

    def no_rows(*_, **__):
        raise AssertionError("rows are read")

    source.events, kept = no_rows, source.events
    assert own.build(source, SubsetConfig((20, 40), n_subjects_per_shard=20)) == first
    assert before == {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()}
    source.events = kept
    own.build(source, SubsetConfig((20, 40, 60), n_subjects_per_shard=20))
    attempts = {r.stored: r.path.split("/shards/")[1].split("/")[0] for r in own.files().where("path IS NOT NULL").collect()}
    new = {k for k, v in attempts.items() if v not in first["tables"]}
    assert {k.rsplit("/", 1)[1] for k in new} == {"r0000000040-0000000060"}
    want = rows_of(own.events(60))
    gone = own.vacuum()
    assert first["tables"] in gone and rows_of(own.events(60)) == want and own.vacuum() == []
    assert own.build(source, SubsetConfig((20,), n_subjects_per_shard=20, non_train_policy="drop", code_metadata="copy"))["codes"]
    assert {r.split for r in own.report().collect()} == {"train"} and own.codes(20).count() == source.codes().count()
    with pytest.raises(ValueError, match="has members of"):
        own.events(40)
    with pytest.raises(ValueError, match="without labels"):
        own.labels(20)


def test_killed_builds_and_other_parents(spark, parent, tmp_path, monkeypatch):
    root, own = tmp_path / "parent", Catalog(spark, uri(tmp_path / "out"))
    shutil.copytree(parent, root)
    config = SubsetConfig((30,), n_subjects_per_shard=10)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr("kohorta.sources.uris.Folder.put", killed)
    with pytest.raises(KeyboardInterrupt):
        own.build(UriDataset(spark, uri(root)), config)
    monkeypatch.undo()
    with pytest.raises(NotADatasetError, match="no family was built"):
        own.events(30)
    path = root / "data" / "train" / "0.parquet"
    table = pq.read_table(path)
    values = pc.add(table["numeric_value"], 1).cast(table.schema.field("numeric_value").type)
    pq.write_table(table.set_column(table.schema.get_field_index("numeric_value"), "numeric_value", values), path)
    own.build(UriDataset(spark, uri(root)), config)  # nothing of the killed build is taken
    want = build_family(spark, root, tmp_path / "linked", config)["members"]["N0000030"]["content_ids"]
    assert {r.split: r.content_id for r in own.report().collect()} == want
    assert len(own.vacuum()) == 2
    pq.write_table(table, path)
    with pytest.raises(ValueError, match="has changed .fingerprint"):
        own.build(UriDataset(spark, uri(root)), config)
    own.build(UriDataset(spark, uri(root)), config, overwrite=True)
    assert {r.split: r.content_id for r in own.report().collect() if r.split == "train"} == {"train": fingerprint_of(spark, own, 30)["train"]} != {"train": want["train"]}


def fingerprint_of(spark, own, n):
    from kohorta.operators import digests

    return {r["split"]: r["content_id"] for r in digests.content_ids(own.events(n).drop("shard"), own.splits(n)).collect()}


def test_datasets_at_uris(spark, parent, tmp_path):
    own, local = UriDataset(spark, uri(parent)), EventDataset(spark, parent)
    assert rows_of(own.events()) == rows_of(local.events().select(*own.events().columns))
    assert fingerprint(own) == fingerprint(local)
    assert rows_of(own.subject_shards()) == rows_of(local.subject_shards())
    assert rows_of(own.files()) == rows_of(local.files())
    assert {r.name for r in own.listing().collect()} == {"data/train/0.parquet", "data/tuning/0.parquet", "data/held_out/0.parquet", "metadata/codes.parquet", "metadata/subject_splits.parquet"}
    root = tmp_path / "no splits"
    shutil.copytree(parent / "data", root / "data")
    bare = UriDataset(spark, uri(root))
    assert rows_of(bare.splits()) == rows_of(EventDataset(spark, root).splits()) and bare.codes() is None
    (tmp_path / "none" / "data").mkdir(parents=True)
    with pytest.raises(NotADatasetError):
        UriDataset(spark, uri(tmp_path / "none")).events()
    with pytest.raises(NotADatasetError):
        UriDataset(spark, uri(tmp_path / "nowhere"))
    assert is_uri("hdfs://h/x") and is_uri("file:///x") and not is_uri("/x") and not is_uri("a/b")
    assert json.loads(json.dumps({"fingerprint": own.fingerprint()}))["fingerprint"] == own.fingerprint()


def test_command_line_at_uris(spark, parent, sf_dir, tmp_path, capsys):
    from kohorta.cli import main

    out, flags = uri(tmp_path / "out"), ["-n", "20", "40", "--n-subjects-per-shard", "20"]
    views.labels(spark, sf_dir).drop("label_id").write.parquet(f"{tmp_path}/labels")
    assert main(["subset", str(parent), out, *flags, "--index-dir", f"{tmp_path}/labels"], spark) == 0
    shown = capsys.readouterr().out
    assert "members of 20, 40 subjects" in shown and "40 train  n_subjects=40" in shown
    assert Catalog(spark, out).labels(40).count() > Catalog(spark, out).labels(20).count() > 0
    assert main(["subset", str(parent), out, *flags, "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["config"]["n_subjects"] == [20, 40]
    for bad in (["--task-name", "t"], ["--kind", "tensorized"]):
        assert main(["subset", str(parent), out, *flags, *bad], spark) == 3
    assert main(["subset", out, str(tmp_path / "x"), *flags], spark) == 3 and "need an output at a URI" in capsys.readouterr().err


def test_resamples_at_a_uri_are_those_of_files(spark, parent, sf_dir, tmp_path):
    labels = views.labels(spark, sf_dir).drop("label_id")
    write_one_file(labels.repartition(1), tmp_path / "labels" / "a.parquet")
    source, own = UriDataset(spark, uri(parent)), Resamples(spark, uri(tmp_path / "out"))
    for config in (ResampleConfig(3, 40), ResampleConfig(2, 15, replace=False, salt="other")):
        want = build_resamples(spark, parent, tmp_path / "files", config, tmp_path / "labels")
        made = own.build(source, config, labels)
        assert made["pool_size"] == want["pool_size"] and made["pool_subject_set_id"] == want["pool_subject_set_id"] and made["n_excluded"] == 0
        names = ("n_draws", "n_distinct", "subject_multiset_id", "subject_set_id", "index_id")
        assert {r.replicate: tuple(r[n] for n in names) for r in own.report().collect()} == {r["replicate"]: tuple(r[n] for n in names) for r in want["resamples"].values()}
        first = pq.read_table(tmp_path / "files/resamples/boot_000/subjects.parquet").to_pylist()
        got = own.draws().where("replicate = 0").orderBy("draw_index").select("subject_id", "draw_index")
        assert [r.asDict() for r in got.collect()] == first
    gone = spark.createDataFrame([(r["subject_id"],) for r in first], "subject_id long")
    made = own.build(source, ResampleConfig(1, 30), excluded=gone)
    assert made["n_excluded"] == len({r["subject_id"] for r in first}) and own.draws().join(gone, "subject_id").isEmpty()
    assert {r.index_id for r in own.report().collect()} == {None}
    assert len(own.vacuum()) == 4 and own.draws().count() == 30
    with pytest.raises(ValueError, match="without labels"):
        own.labels()
    with pytest.raises(ValueError, match="cannot draw 100000"):
        own.build(source, ResampleConfig(1, 100000, replace=False))
    with pytest.raises(ValueError, match="has no subjects"):
        own.build(source, ResampleConfig(1, 3, source_split="none"))


def test_sizes_ids_and_resamples_at_uris_on_the_command_line(spark, parent, sf_dir, tmp_path, capsys):
    from kohorta.cli import main

    at, flags = uri(parent), ["--n-resamples", "2", "--size", "20"]
    assert main(["size", at], spark) == 0
    by_uri = capsys.readouterr().out
    assert main(["size", str(parent)], spark) == 0 and capsys.readouterr().out.splitlines()[1:] == by_uri.splitlines()[1:]
    ids = []
    for place in (at, str(parent)):
        assert main(["fingerprint", place], spark) == 0
        ids.append({k: v for k, v in json.loads(capsys.readouterr().out)["dataset"].items() if k != "path"})
    assert ids[0] == ids[1]
    assert main(["resample", str(parent), uri(tmp_path / "r"), *flags, "--exclude", at], spark) == 3  # nobody is left
    assert "no subjects left" in capsys.readouterr().err
    assert main(["resample", at, uri(tmp_path / "r"), *flags], spark) == 0 and "boot_001  n_draws=20" in capsys.readouterr().out
    assert main(["resample", at, str(tmp_path / "x"), *flags], spark) == 3 and main(["size", at, "--kind", "tensorized"], spark) == 3
