import datetime
import json
import shutil
import struct
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kohorta import build, cache, reports
from kohorta.build import build_family, build_resamples, fingerprint, label_fingerprint, salt_id
from kohorta.cli import main
from kohorta.config import ResampleConfig, SubsetConfig
from kohorta.operators import digests, selection
from kohorta.plans import views
from kohorta.sources import dataset
from kohorta.sources.dataset import SIZED, EventDataset, NotADatasetError, read_labels, read_shards, shard_name, shard_paths
from kohorta.sources.sinks import ShardStore, is_placed, place, write_one_file
from kohorta.sources.tensors import Slice, TensorCohort, ragged_batches, read_tensors, sliced, tensor_header, tensor_length, write_slices, write_tensors
from kohorta.stage import subset_subjects
from kohorta.tensorized import build_tensorized_family


@pytest.fixture(scope="module")
def parent(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("cohort[1]")
    splits = views.splits(spark, sf_dir)
    rows = views.events(spark, sf_dir).join(splits, "subject_id")
    for split in ("train", "tuning", "held_out"):
        own = rows.where(F.col("split") == split).drop("split")
        write_one_file(own.repartition(1), root / "data" / split / "0.parquet")
    write_one_file(splits, root / "metadata" / "subject_splits.parquet")
    write_one_file(views.codes(spark, sf_dir), root / "metadata" / "codes.parquet")
    return root


@pytest.fixture(scope="module")
def labels_dir(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("labels") / "big_orders"
    rows = views.labels(spark, sf_dir).drop("label_id")
    write_one_file(rows.where("subject_id % 2 = 0").repartition(1), folder / "a.parquet.parquet")
    write_one_file(rows.where("subject_id % 2 = 1").withColumn("integer_value", F.lit(1)).repartition(1), folder / "b.parquet")
    return folder


def copied(parent, folder):
    shutil.copytree(parent, folder)
    return folder


def test_family_is_nested_shared_and_rebuilt_for_free(spark, parent, tmp_path):
    config = SubsetConfig((20, 45, 60), n_subjects_per_shard=20)
    made = build_family(spark, parent, tmp_path / "out", config)
    members = made["members"]
    sizes = {m["name"]: {r["split"]: r for r in m["sizes"]} for m in members.values()}
    assert sizes["N0000060"]["train"]["n_subjects"] == 60
    sets = [{r.subject_id for r in EventDataset(spark, tmp_path / "out" / n).events().where(F.col("shard").startswith("train/")).collect()} for n in sorted(members)]
    assert sets[0] < sets[1] < sets[2] and [len(s) for s in sets] == [20, 45, 60]
    first = tmp_path / "out" / "N0000020" / "data" / "train" / "0.parquet"
    assert first.is_symlink() and first.resolve() == (tmp_path / "out" / "N0000060" / "data" / "train" / "0.parquet").resolve()
    assert members["N0000020"]["shards"]["train/0"] == f"train/{salt_id('kohorta')}/r0000000000-0000000020.parquet"
    assert (tmp_path / "out" / "N0000020" / "data" / "tuning" / "0.parquet").resolve() == tmp_path / "out" / ".shard_store" / "passthrough" / "tuning" / "0.parquet"
    whole = fingerprint(EventDataset(spark, parent))
    assert members["N0000020"]["content_ids"]["tuning"] == whole["tuning"]
    for name, m in members.items():  # the ids and counts of the manifest are those of the files
        own = EventDataset(spark, tmp_path / "out" / name)
        found = fingerprint(own)
        assert found == m["content_ids"] | {"codes": m["codes_id"], "dataset": m["dataset_id"]}
        report = {r.split: r.asDict() for r in reports.event_report(own).collect()}
        assert {s: (r["n_subjects"], r["n_events"], r["n_measurements"], r["n_codes_observed"], r["observed_code_set_id"], r["n_shards"], r["n_bytes"]) for s, r in report.items()} == {
            s: (r["n_subjects"], r["n_events"], r["n_measurements"], r["n_codes_observed"], r["observed_code_set_id"], r["n_shards"], r["n_bytes"]) for s, r in sizes[name].items()
        }
        assert json.loads((tmp_path / "out" / name / "metadata" / "dataset.json").read_text())["subset_of"]["subset_id"] == m["dataset_id"]
        assert {r.code for r in own.codes().collect()} == {r.code for r in own.events().select("code").distinct().collect()}
    before = {p: p.lstat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet") if ".shard_store" in str(p) or p.is_symlink()}
    again = build_family(spark, parent, tmp_path / "out", config)
    assert again == made and before == {p: p.lstat().st_mtime_ns for p in before}
    assert not list((tmp_path / "out").rglob("*.tmp")) and not list((tmp_path / "out").rglob(".attempt-*"))
    with pytest.raises(ValueError, match="cannot build a subset of 100000"):
        build_family(spark, parent, tmp_path / "other", SubsetConfig((100000,)))
    assert not (tmp_path / "other").exists()


def test_rows_are_sorted_with_their_place_as_the_last_key(spark, parent, tmp_path):
    build_family(spark, parent, tmp_path, SubsetConfig((50,), n_subjects_per_shard=25))
    whole = [r for p in EventDataset(spark, parent).paths for r in pq.read_table(p).to_pylist()]
    key = lambda r: (r["subject_id"], r["time"] is not None, r["time"] or datetime.datetime.min)
    for k in (0, 1):
        rows = pq.read_table(tmp_path / "N0000050" / "data" / "train" / f"{k}.parquet").to_pylist()
        own = {r["subject_id"] for r in rows}
        assert len(own) == 25 and rows == sorted((r for r in whole if r["subject_id"] in own), key=key)  # ties stay as they lie


def test_each_salt_has_its_own_subjects(spark, parent, tmp_path):
    for salt in ("kohorta-v1", "kohorta-v2"):
        build_family(spark, parent, tmp_path, SubsetConfig((30,), salt=salt))
        splits = EventDataset(spark, tmp_path / "N0000030").splits()
        want = selection.select_nested(EventDataset(spark, parent).splits().where("split = 'train'").select("subject_id"), 30, salt)
        data = EventDataset(spark, tmp_path / "N0000030").events().where("shard = 'train/0'").select("subject_id").distinct()
        ids = {r.subject_id for r in want.collect()}
        assert ids == {r.subject_id for r in splits.where("split = 'train'").collect()} == {r.subject_id for r in data.collect()}


def test_another_parent_is_refused_or_starts_anew(spark, parent, tmp_path):
    root, out, config = copied(parent, tmp_path / "parent"), tmp_path / "out", SubsetConfig((30,), link_mode="copy")
    before = build_family(spark, root, out, config)["members"]["N0000030"]
    path = root / "data" / "train" / "0.parquet"
    table = pq.read_table(path)
    values = pc.add(table["numeric_value"], 1).cast(table.schema.field("numeric_value").type)
    pq.write_table(table.set_column(table.schema.get_field_index("numeric_value"), "numeric_value", values), path)
    with pytest.raises(ValueError, match="has changed .fingerprint"):
        build_family(spark, root, out, config)
    after = build_family(spark, root, out, config, overwrite=True)["members"]["N0000030"]
    assert after["train_set_id"] != before["train_set_id"]
    assert after["content_ids"]["train"] == fingerprint(EventDataset(spark, out / "N0000030"))["train"]
    splits = root / "metadata" / "subject_splits.parquet"
    table = pq.read_table(splits)
    pq.write_table(table.set_column(1, "split", table["split"].take(list(range(1, len(table))) + [0])), splits)
    with pytest.raises(ValueError, match="has changed .fingerprint"):
        build_family(spark, root, out, config)
    pq.write_table(table.slice(1), splits)
    with pytest.raises(ValueError, match="has changed .subject_set_id"):
        build_family(spark, root, out, config)


def shifted(path):
    table = pq.read_table(path)
    values = pc.add(table["numeric_value"], 1).cast(table.schema.field("numeric_value").type)
    pq.write_table(table.set_column(table.schema.get_field_index("numeric_value"), "numeric_value", values), path)


def test_a_killed_build_leaves_no_shards_of_another_parent(spark, parent, tmp_path, monkeypatch):
    root, out, config = copied(parent, tmp_path / "parent"), tmp_path / "out", SubsetConfig((30,), link_mode="copy")

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(build, "_members", killed)
    with pytest.raises(KeyboardInterrupt):
        build_family(spark, root, out, config)
    monkeypatch.undo()
    stored = {p: p.stat().st_mtime_ns for p in (out / ".shard_store").rglob("*.parquet")}
    assert stored and not (out / "family.json").exists()
    same = build_family(spark, root, out, config)["members"]["N0000030"]  # the same parent goes on where the build stopped
    assert {p: p.stat().st_mtime_ns for p in stored} == stored
    (out / "family.json").unlink()
    shifted(root / "data" / "train" / "0.parquet")
    with pytest.raises(ValueError, match="has changed .fingerprint"):
        build_family(spark, root, out, config)
    after = build_family(spark, root, out, config, overwrite=True)["members"]["N0000030"]
    found = fingerprint(EventDataset(spark, out / "N0000030"))
    assert after["content_ids"]["train"] == found["train"] != same["content_ids"]["train"]
    (out / ".shard_store" / "parent.json").unlink()
    (out / "family.json").unlink()
    with pytest.raises(ValueError, match="no record says"):
        build_family(spark, root, out, config)


def test_a_parent_that_changes_meanwhile_is_refused(spark, parent, tmp_path, monkeypatch):
    root, out, config = copied(parent, tmp_path / "parent"), tmp_path / "out", SubsetConfig((30,), link_mode="copy")
    real = ShardStore.put_partitioned

    def moved(*args, **options):
        made = real(*args, **options)
        shifted(root / "data" / "train" / "0.parquet")
        return made

    monkeypatch.setattr(ShardStore, "put_partitioned", moved)
    with pytest.raises(ValueError, match="changed while"):
        build_family(spark, root, out, config)
    monkeypatch.undo()
    assert not list((out / ".shard_store").rglob("*")) and not (out / "family.json").exists()
    made = build_family(spark, root, out, config)["members"]["N0000030"]
    assert made["content_ids"]["train"] == fingerprint(EventDataset(spark, out / "N0000030"))["train"]


def test_of_many_files_only_the_changed_one_is_read_again(spark, parent, tmp_path, monkeypatch):
    root, out = tmp_path / "parent", tmp_path / "cache"
    rows = EventDataset(spark, parent).events().withColumn("shard", F.concat(F.split_part("shard", F.lit("/"), F.lit(1)), F.lit("/"), (F.col("subject_id") % 4).cast("string")))
    shards = [r.shard for r in rows.select("shard").distinct().collect()]
    for s in shards:
        write_one_file(rows.where(F.col("shard") == s).drop("shard").repartition(1), root / "data" / f"{s}.parquet")
    read = []
    real = cache.read_shards
    monkeypatch.setattr(cache, "read_shards", lambda spark, folder, paths, columns: read.append([shard_name(folder, p) for p in paths]) or real(spark, folder, paths, columns))
    table = lambda: {r.subject_id: tuple(sorted(map(str, r))) for r in cache.cached_subjects(EventDataset(spark, root), out).withColumn("codes", F.sort_array("codes")).collect()}
    plain = lambda: {r.subject_id: tuple(sorted(map(str, r))) for r in digests.subject_table(EventDataset(spark, root).events().drop("shard")).withColumn("codes", F.sort_array("codes")).collect()}
    first = table()
    assert first == plain() and sorted(read.pop()) == sorted(shards) and table() == first and not read
    shifted(root / "data" / "train/1.parquet")
    again = table()
    assert again == plain() != first and read == [["train/1"]]
    (root / "data" / "train/2.parquet").unlink()
    assert table() == plain() and read == [["train/1"]]
    (out / "subjects-killed").mkdir()
    shutil.copy(root / "data" / "train/3.parquet", root / "data" / "train/again.parquet")  # subjects in two files: all rows are read
    assert table() == plain() and not (out / "subjects-killed").exists()


def test_a_build_that_changes_nothing_runs_no_job(spark, parent, labels_dir, tmp_path, monkeypatch):
    out, config = tmp_path / "out", SubsetConfig((20, 40), n_subjects_per_shard=20)
    made = build_family(spark, parent, out, config, labels=labels_dir)
    files = {p: p.lstat().st_mtime_ns for p in out.rglob("*") if not p.is_dir()}

    def no_job(*_):
        raise AssertionError("a job is run")

    monkeypatch.setattr(build, "Family", no_job)
    assert build_family(spark, parent, out, config, labels=labels_dir) == json.loads(json.dumps(made))
    assert {p: p.lstat().st_mtime_ns for p in out.rglob("*") if not p.is_dir()} == files
    member = out / "N0000020"
    for other in (SubsetConfig((20,), n_subjects_per_shard=20), SubsetConfig((20, 40), n_subjects_per_shard=20, link_mode="copy")):
        with pytest.raises(AssertionError):
            build_family(spark, parent, out, other, labels=labels_dir)
    with pytest.raises(AssertionError):
        build_family(spark, parent, out, config)
    monkeypatch.undo()
    (member / "data/train/0.parquet").unlink()
    (member / "data/train/stale.parquet").write_bytes(b"PAR1")
    build_family(spark, parent, out, config, labels=labels_dir)
    assert (member / "data/train/0.parquet").exists() and not (member / "data/train/stale.parquet").exists()
    monkeypatch.setattr(build, "Family", no_job)
    assert build_family(spark, parent, out, config, labels=labels_dir)["members"] == made["members"]


def test_footers_of_many_files_are_read_in_a_job(spark, tmp_path, monkeypatch):
    for i in range(9):
        table = pa.table({"subject_id": pa.array([i], pa.int64()), "code": [f"c{i}"], ("x" if i % 3 else "none"): pa.array([None], pa.int32() if i % 3 else pa.null())})
        pq.write_table(table, tmp_path / f"{i}.parquet")
    paths = shard_paths(tmp_path)
    monkeypatch.setattr(dataset, "DRIVER_FOOTERS", 4)
    by_driver = [pq.read_schema(p) for p in paths]
    monkeypatch.setattr(dataset.pq, "read_schema", None)  # the driver reads none
    found = dataset.footers(paths, spark)
    assert [s.names for s in found] == [[n for n in s.names if n != "none"] for s in by_driver]
    assert dataset.footers(paths) == found  # known by now
    monkeypatch.undo()
    assert read_shards(spark, tmp_path, paths).count() == 9
    for name in "yz":
        pq.write_table(pa.table({"time": pa.array([1], pa.timestamp("ns"))}), tmp_path / f"{name}.parquet")
    monkeypatch.setattr(dataset, "DRIVER_FOOTERS", 1)
    with pytest.raises(ValueError, match="nanoseconds"):
        dataset.footers(shard_paths(tmp_path), spark)


def test_policies_and_stale_shards(spark, parent, tmp_path):
    for policy, want in (("passthrough", {"train/0", "train/1", "tuning/0", "held_out/0"}), ("subset", {"train/0", "train/1", "tuning/0", "held_out/0"}), ("drop", {"train/0", "train/1"})):
        made = build_family(spark, parent, tmp_path, SubsetConfig((6,), n_subjects_per_shard=4, non_train_policy=policy))
        shards = set(made["members"]["N0000006"]["shards"])
        if policy == "subset":
            want = {s for s in shards if s.split("/")[0] in ("train", "tuning", "held_out")}
            assert {r["n_subjects"] for r in made["members"]["N0000006"]["sizes"] if r["split"] == "tuning"} == {min(6, EventDataset(spark, parent).splits().where("split = 'tuning'").count())}
        assert shards == want == {shard_name(tmp_path / "N0000006" / "data", p) for p in shard_paths(tmp_path / "N0000006" / "data")}
    with pytest.raises(ValueError, match="mix"):
        build_family(spark, mixed_parent(spark, parent, tmp_path / "mixed"), tmp_path / "out", SubsetConfig((6,)))


def mixed_parent(spark, parent, root):
    copied(parent, root)
    a, b = root / "data" / "train" / "0.parquet", root / "data" / "tuning" / "0.parquet"
    pq.write_table(pa.concat_tables([pq.read_table(a), pq.read_table(b)]), a)
    b.unlink()
    return root


def test_members_get_their_labels(spark, parent, labels_dir, tmp_path):
    made = build_family(spark, parent, tmp_path, SubsetConfig((10, 60), n_subjects_per_shard=30), labels=labels_dir)
    labels = read_labels(spark, labels_dir).drop("shard")
    for name, m in made["members"].items():
        tasks, data = tmp_path / name / "tasks" / "big_orders", tmp_path / name / "data"
        assert [shard_name(tasks, p) for p in shard_paths(tasks)] == [shard_name(data, p) for p in shard_paths(data)]
        own = EventDataset(spark, tmp_path / name).splits()
        want = labels.join(own, "subject_id", "left_semi")
        assert m["n_index_rows"] == want.count() and m["index_id"] == digests.frame_digest(want).first()[0] and m["task"] == "big_orders"
        held = {shard: {r.subject_id for r in rows} for shard, rows in groupby(sorted(EventDataset(spark, tmp_path / name).subject_shards().collect(), key=lambda r: r.shard), key=lambda r: r.shard)}
        for p in shard_paths(tasks):
            assert set(pq.read_table(p)["subject_id"].to_pylist()) <= held[shard_name(tasks, p)]
    with pytest.raises(ValueError, match="needs labels"):
        build_family(spark, parent, tmp_path / "x", SubsetConfig((10,)), task="t")


def test_resamples(spark, parent, labels_dir, tmp_path):
    made = build_resamples(spark, parent, tmp_path, ResampleConfig(2, 30), labels_dir)
    assert [r["n_draws"] for r in made["resamples"].values()] == [30, 30]
    folder = tmp_path / "resamples" / "boot_001"
    draws = pq.read_table(folder / "subjects.parquet").to_pylist()
    assert [r["draw_index"] for r in draws] == list(range(30))
    plain = [r for p in shard_paths(labels_dir) for r in pq.read_table(p).to_pylist()]
    for p in shard_paths(labels_dir):
        rows = pq.read_table(folder / "labels" / p.relative_to(labels_dir))
        own = pq.read_table(p).to_pylist()
        want = [(r["subject_id"], r["prediction_time"], r["boolean_value"]) for d in draws for r in own if r["subject_id"] == d["subject_id"]]
        assert list(zip(*(rows[c].to_pylist() for c in ("subject_id", "prediction_time", "boolean_value")))) == want
        assert rows.schema.names == ["subject_id", "prediction_time", "boolean_value", "integer_value"]
    assert plain and made["resamples"]["boot_001"]["index_id"] == label_fingerprint(spark, folder / "labels")["index_id"]
    again = build_resamples(spark, parent, tmp_path, ResampleConfig(1, 30))
    assert not folder.exists() and not (tmp_path / "resamples" / "boot_000" / "labels").exists()
    assert again["resamples"]["boot_000"]["subject_multiset_id"] == made["resamples"]["boot_000"]["subject_multiset_id"]
    gone = [r["subject_id"] for r in draws]
    other = build_resamples(spark, parent, tmp_path / "b", ResampleConfig(1, 30), excluded=gone)
    assert other["n_excluded"] == len(set(gone)) and not set(gone) & set(pq.read_table(tmp_path / "b" / "resamples" / "boot_000" / "subjects.parquet")["subject_id"].to_pylist())
    assert build_resamples(spark, parent, tmp_path / "b", ResampleConfig(1, 30, allow_overlap=True), excluded=gone)["n_excluded"] == 0
    with pytest.raises(ValueError, match="its splits are .*'train'"):
        build_resamples(spark, parent, tmp_path, ResampleConfig(1, 3, source_split="none"))


def test_command_line(spark, parent, labels_dir, tmp_path, capsys):
    table = tmp_path / "sizes.parquet"
    assert main(["size", str(parent), "-o", str(table)], spark) == 0
    shown = capsys.readouterr().out
    assert "__total__" in shown and "observed_code_set_id=" in shown and f"{parent} (meds)" in shown
    rows = pq.read_table(table).to_pylist()
    assert {r["split"] for r in rows} == {"train", "tuning", "held_out", "__total__"} and list(rows[0]) == list(reports.COLUMNS) and rows[-1]["n_shards"] == 3
    found = json.loads((tmp_path / "sizes.json").read_text())["datasets"][0]
    assert found["total"]["n_bytes"] == sum(p.stat().st_size for p in shard_paths(parent / "data"))
    assert main(["size", str(parent), "-o", str(tmp_path / "x.json")], spark) == 3
    assert "name another path" in capsys.readouterr().err
    assert main(["size", str(parent), "--kind", "tensorized"], spark) == 3 and "error: no schemas of tensors" in capsys.readouterr().err
    assert main(["fingerprint", str(tmp_path)], spark) == 3 and main(["fingerprint"], spark) == 3
    assert "error: " in capsys.readouterr().err
    assert main(["fingerprint", str(parent), "--index-dir", str(labels_dir)], spark) == 0
    ids = json.loads(capsys.readouterr().out)
    assert ids["dataset"]["train_set_id"] == ids["dataset"]["content_ids"]["train"] and ids["index"]["n_index_rows"] > 0
    (tmp_path / "c.yaml").write_text("n_subjects: [5]\nlink_mode: copy\n")
    assert main(["subset", str(parent), str(tmp_path / "o"), "--config", str(tmp_path / "c.yaml"), "-n", "7", "--json"], spark) == 0
    made = json.loads(capsys.readouterr().out)
    assert list(made["members"]) == ["N0000007"] and made["config"]["link_mode"] == "copy"
    assert main(["subset", str(parent), str(tmp_path / "o"), "-n", "7", "--link-mode", "copy"], spark) == 0
    assert "Built 1 member from" in capsys.readouterr().out
    assert main(["resample", str(parent), str(tmp_path / "r"), "--n-resamples", "1", "--size", "9", "--exclude", str(tmp_path / "o" / "N0000007")], spark) == 0
    assert "Drew 1 resamples" in capsys.readouterr().out
    assert main(["pipeline", str(tmp_path / "p.yaml"), "a", "b", "c"]) == 0
    assert "fit_normalization" not in (tmp_path / "p.yaml").read_text() and "c/metadata" in (tmp_path / "p.yaml").read_text()
    with pytest.raises(SystemExit) as e:
        main(["nothing"], spark)
    assert e.value.code == 2


def test_stage(spark, parent, sf_dir):
    rows, splits = EventDataset(spark, parent).events(), EventDataset(spark, parent).splits()
    train = {r.subject_id for r in splits.where("split = 'train'").collect()}
    ids = lambda df: {r.subject_id for r in df.select("subject_id").distinct().collect()}
    settings = {"n_subjects": 12, "data_input_dir": parent / "data", "metadata_input_dir": parent / "metadata"}
    kept = ids(subset_subjects(spark, settings)(rows))
    assert len(kept & train) == 12 and kept - train == ids(rows) - train
    assert ids(subset_subjects(spark, settings | {"metadata_input_dir": None})(rows)) == kept
    some = sorted(train)[:3]
    assert ids(subset_subjects(spark, {"subject_ids": some})(rows)) == set(some)
    for bad, kind, message in (({}, ValueError, "needs n_subjects"), ({"n_subjects": "9"}, TypeError, "integer"), ({"n_subjects": 9}, ValueError, "no 'train' subjects"), (settings | {"n_subjects": 10**6}, ValueError, "cannot select")):
        with pytest.raises(kind, match=message):
            subset_subjects(spark, bad)


def test_scans_of_unlike_files(spark, tmp_path):
    time = pa.array([datetime.datetime(2020, 1, 1), None])
    pq.write_table(pa.table({"subject_id": pa.array([1, 2], pa.int32()), "time": time.cast(pa.timestamp("ms")), "code": pa.array(["a", "b"]).dictionary_encode()}), tmp_path / "0.parquet")
    pq.write_table(pa.table({"subject_id": pa.array([3], pa.int64()), "code": ["c"], "extra": [1.5], "none": pa.nulls(1)}), tmp_path / "_1.parquet")
    (tmp_path / "sub").mkdir()
    pq.write_table(pa.table({"subject_id": pa.array([4], pa.int64()), "none": ["x"]}), tmp_path / "sub" / "2.parquet")
    paths = shard_paths(tmp_path)
    assert [shard_name(tmp_path, p) for p in paths] == ["0", "_1", "sub/2"]
    rows = read_shards(spark, tmp_path, paths, SIZED, places=True).orderBy("subject_id").collect()
    when = datetime.datetime(2020, 1, 1)
    assert [tuple(r) for r in rows] == [(1, when, "a", "0", 0), (2, None, "b", "0", 1), (3, None, "c", "_1", 0), (4, None, None, "sub/2", 0)]
    with pytest.raises(ValueError, match="subject_id.* is int64, and int32"):
        read_shards(spark, tmp_path, paths)
    union = read_shards(spark, tmp_path, paths[1:])
    assert union.columns == ["subject_id", "code", "extra", "none", "shard"] and union.count() == 2
    pq.write_table(pa.table({"time": pa.array([1], pa.timestamp("ns"))}), tmp_path / "3.parquet")
    with pytest.raises(ValueError, match="nanoseconds"):
        read_shards(spark, tmp_path, shard_paths(tmp_path))


def tensor_cohort(root, shards):
    """A cohort of shards {name: ids}; subject i of a shard has 2 + i % 3 events of one or two measurements."""
    for shard, ids in shards.items():
        statics = [[1, 2] if i % 2 else None for i in ids]
        (root / "tokenization/schemas" / shard).parent.mkdir(parents=True, exist_ok=True)
        (root / "data" / shard).parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"subject_id": pa.array(ids, pa.int64()), "static_code": pa.array(statics, pa.list_(pa.uint8()))}), root / "tokenization/schemas" / f"{shard}.parquet")
        events = [2 + i % 3 for i in range(len(ids))]
        each = [1 + e % 2 for n in events for e in range(n)]
        code = [1000 * i + 10 * e + m for i, n in zip(ids, events) for e in range(n) for m in range(1 + e % 2)]
        tensors = {
            "dim1/bounds": np.cumsum(events), "dim1/time_delta_days": np.array([e for n in events for e in range(n)], dtype="<f4"),
            "dim2/bounds": np.cumsum(each), "dim2/code": np.array(code, dtype="<i8"), "dim2/numeric_value": np.array(code, dtype="<f4"),
        }
        write_tensors(root / "data" / f"{shard}.nrt", tensors)
    (root / "metadata").mkdir(exist_ok=True)
    pq.write_table(pa.table({"code": [f"C{i}" for i in range(15)], "code/vocab_index": list(range(15))}), root / "metadata/codes.parquet")
    return root


def subject_tensors(root):
    """What each subject's tensors hold."""
    out = {}
    for p in shard_paths(root / "tokenization/schemas"):
        t = read_tensors(root / "data" / p.relative_to(root / "tokenization/schemas").with_suffix(".nrt"))
        ids = pq.read_table(p)["subject_id"].to_pylist()
        b1, b2 = np.r_[0, t["dim1/bounds"]], np.r_[0, t["dim2/bounds"]]
        for i, s in enumerate(ids):
            out[s] = [(float(t["dim1/time_delta_days"][e]), t["dim2/code"][b2[e] : b2[e + 1]].tolist()) for e in range(b1[i], b1[i + 1])]
    return out


SHARDS = {"train/0": [7, 3, 11], "train/1": [5, 2, 13, 4], "tuning/0": [20, 19], "held/out/0": [30]}


def test_tensor_families(spark, tmp_path):
    root = tensor_cohort(tmp_path / "cohort", SHARDS)
    cohort, whole = TensorCohort(spark, root), subject_tensors(root)
    assert {r.subject_id: (r.shard, r.row_index) for r in cohort.locations().collect()} == {s: (name, i) for name, ids in SHARDS.items() for i, s in enumerate(ids)}
    assert {r.split for r in cohort.splits().select("split").distinct().collect()} == {"train", "tuning", "held/out"}
    report = {r.split: r for r in reports.size_of(spark, root).collect()}
    assert (report["train"].n_subjects, report["train"].n_events, report["train"].n_static_measurements, report["train"].n_codes_observed) == (7, 9 + 2 + 9, 10, 15)
    assert report["train"].n_measurements == sum(len(m) for s in SHARDS["train/0"] + SHARDS["train/1"] for _, m in whole[s]) + 10
    with pytest.raises(ValueError, match="must be copied"):
        build_tensorized_family(spark, root, tmp_path / "out", SubsetConfig((2,)))
    config = SubsetConfig((2, 4, 5), n_subjects_per_shard=2, code_metadata="copy")
    made = build_tensorized_family(spark, root, tmp_path / "out", config)
    order = [r.subject_id for r in selection.ranked(cohort.splits().where("split = 'train'").select("subject_id"), config.salt).orderBy("rank").collect()]
    for n, name in ((2, "N0000002"), (4, "N0000004"), (5, "N0000005")):
        own = subject_tensors(tmp_path / "out" / name)
        assert own == {s: whole[s] for s in [*order[:n], 20, 19, 30]}
        assert {r["split"]: r["n_subjects"] for r in made["members"][name]["sizes"]} == {"train": n, "tuning": 2, "held/out": 1, "__total__": n + 3}
    files = [(tmp_path / "out" / n / "data/train/0.nrt").resolve() for n in ("N0000002", "N0000005")]
    assert files[0] == files[1] and files[0].is_relative_to((tmp_path / "out" / ".shard_store").resolve())
    assert build_tensorized_family(spark, root, tmp_path / "out", config) == made
    subset = build_tensorized_family(spark, root, tmp_path / "sub", SubsetConfig((1,), code_metadata="copy", non_train_policy="subset"))
    assert {r["split"]: r["n_subjects"] for r in subset["members"]["N0000001"]["sizes"]} == {"train": 1, "tuning": 1, "held/out": 1, "__total__": 3}
    tensor_cohort(root, SHARDS | {"tuning/0": [20, 21]})
    with pytest.raises(ValueError, match="has changed"):
        build_tensorized_family(spark, root, tmp_path / "out", config)
    assert 21 in subject_tensors(tmp_path / "out" / build_tensorized_family(spark, root, tmp_path / "out", config, overwrite=True)["members"]["N0000002"]["name"])


def test_slices_copy_ranges_in_bounded_steps(spark, tmp_path, monkeypatch):
    root = tensor_cohort(tmp_path / "cohort", SHARDS)
    sources = [(read_tensors(root / "data" / f"{s}.nrt"), np.array(rows)) for s, rows in (("train/1", [0, 1, 3]), ("train/0", [2]), ("tuning/0", []), ("held/out/0", [0]))]
    monkeypatch.setattr(Slice, "STEP", 16)  # two values
    sizes = [len(p) for t, rows in sources for p in Slice(t, rows).parts("dim2/code", 0)]
    assert max(sizes) == 2 and len(sizes) > 10
    write_slices(tmp_path / "x.nrt", [Slice(t, rows) for t, rows in sources])
    got, whole = read_tensors(tmp_path / "x.nrt"), subject_tensors(root)
    b1, b2 = np.r_[0, got["dim1/bounds"]], np.r_[0, got["dim2/bounds"]]
    rows = [[(float(got["dim1/time_delta_days"][e]), got["dim2/code"][b2[e] : b2[e + 1]].tolist()) for e in range(b1[i], b1[i + 1])] for i in range(len(b1) - 1)]
    assert rows == [whole[s] for s in (5, 2, 4, 11, 30)]
    with pytest.raises(ValueError, match="differ in names or types"):
        write_slices(tmp_path / "y.nrt", [Slice(t, r) for t, r in sources[:1]] + [Slice({n: v for n, v in sources[1][0].items() if n != "dim2/code"}, np.array([0]))])


def test_tensors_are_rows_of_ragged_arrays(spark, tmp_path):
    root = tensor_cohort(tmp_path / "cohort", SHARDS)
    cohort, whole = TensorCohort(spark, root), subject_tensors(root)
    rows = cohort.locations().join(cohort.tensors(), ["shard", "row_index"]).collect()
    assert {r.subject_id: list(zip(r.time_delta_days, r.code, strict=True)) for r in rows} == whole
    assert {r.subject_id: r.numeric_value for r in rows} == {s: [[float(x) for x in codes] for _, codes in v] for s, v in whole.items()}
    path = root / "data" / "train/1.nrt"
    types = {"dim1/time_delta_days": "float", "dim2/code": "bigint"}
    small = [b.num_rows for b in ragged_batches(path, types, limit=4)]
    assert small == [1, 1, 1, 1]
    assert [r for b in ragged_batches(path, types, limit=4) for r in b.to_pylist()] == next(ragged_batches(path, types)).to_pylist()


def test_damaged_tensor_cohorts_are_refused(spark, tmp_path):
    root = tensor_cohort(tmp_path / "a", {"train/0": [1, 2]})
    path = root / "tokenization/schemas/train/0.parquet"
    pq.write_table(pq.read_table(path).slice(1), path)
    with pytest.raises(NotADatasetError, match="differ in height: train/0 .1 and 2"):
        TensorCohort(spark, root).locations()
    with pytest.raises(NotADatasetError, match=r"several places: \[1\]"):
        TensorCohort(spark, tensor_cohort(tmp_path / "b", {"train/0": [1, 2], "train/1": [1]})).locations()
    with pytest.raises(NotADatasetError, match="name no split"):
        TensorCohort(spark, tensor_cohort(tmp_path / "c", {"0": [1]})).splits()
    (tmp_path / "c" / "data" / "0.nrt").unlink()
    with pytest.raises(FileNotFoundError, match="no tensors at"):
        TensorCohort(spark, tmp_path / "c").headers()
    with pytest.raises(NotADatasetError, match="no schemas"):
        TensorCohort(spark, tmp_path / "none")


def test_sliced_tensors_of_any_rows():
    r = np.random.default_rng(1)
    events, each = r.integers(0, 4, 9), None
    each = r.integers(0, 3, events.sum())
    t = {"dim1/bounds": np.cumsum(events), "dim1/x": np.arange(events.sum()), "dim2/bounds": np.cumsum(each), "dim2/y": np.arange(each.sum())}
    b1, b2 = np.r_[0, t["dim1/bounds"]], np.r_[0, t["dim2/bounds"]]
    for rows in ([], [8, 0, 3], list(range(9))):
        got = sliced(t, np.array(rows, dtype=np.int64))
        e = [i for s in rows for i in range(b1[s], b1[s + 1])]
        assert got["dim1/x"].tolist() == e and got["dim2/y"].tolist() == [m for i in e for m in range(b2[i], b2[i + 1])]
        assert got["dim1/bounds"].tolist() == np.cumsum(events[rows]).tolist() and got["dim2/bounds"].tolist() == np.cumsum(each[e]).tolist()


def test_listing(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.parquet").write_bytes(b"")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "y.parquet").write_bytes(b"")
    assert [p.name for p in shard_paths(tmp_path)] == ["x.parquet"]
    (tmp_path / "z.parquet").symlink_to(tmp_path / "gone")
    with pytest.raises(FileNotFoundError, match="dangling"):
        shard_paths(tmp_path)
    with pytest.raises(NotADatasetError):
        EventDataset(None, tmp_path / "none")


def test_tensor_header(tmp_path):
    path = tmp_path / "x.nrt"
    body = json.dumps({"dim2/code": {"shape": [7]}, "__metadata__": {}}).encode()
    path.write_bytes(struct.pack("<Q", len(body)) + body)
    assert tensor_length(tensor_header(path), "dim2/code") == 7 and tensor_length(tensor_header(path), "none") == 0
    for data, message in ((b"123", "3 bytes"), (struct.pack("<Q", 99) + b"{}", "truncated"), (struct.pack("<Q", 2) + b"{!", "not JSON"), (struct.pack("<Q", 2) + b"[]", "not an object")):
        path.write_bytes(data)
        with pytest.raises(ValueError, match=message):
            tensor_header(path)


@pytest.mark.parametrize(
    "bad", [{"n_subjects": (0,)}, {"n_subjects": (True,)}, {"n_subjects": ()}, {"n_subjects": (1,), "link_mode": "x"}, {"n_subjects": (1,), "name_template": "same"}, {"n_subjects": (1,), "salt": ""}, {"n_subjects": (1,), "other": 1}]
)
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        SubsetConfig.from_dict(bad)


def test_store_refuses_traversal_and_damaged_files(tmp_path):
    store = ShardStore(tmp_path)
    with pytest.raises(ValueError, match="bad key"):
        store.path("../x")
    store.path("a").write_bytes(b"PAR1" + b"0" * 20)
    assert not store.has("a")


def test_placements_know_themselves(tmp_path):
    (tmp_path / "a.parquet").write_text("a")
    target = tmp_path / "b.parquet"
    for mode, seen in (("symlink", [True, False, False]), ("hardlink", [False, True, True]), ("copy", [False, False, True])):
        assert not is_placed(tmp_path / "a.parquet", target, mode) or mode == "copy"
        target.unlink(missing_ok=True)
        place(tmp_path / "a.parquet", target, mode)
        assert [is_placed(tmp_path / "a.parquet", target, m) for m in ("symlink", "hardlink", "copy")] == seen
        place(tmp_path / "a.parquet", target, mode)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.parquet", "b.parquet"]
    with pytest.raises(ValueError, match="on itself"):
        place(target, target, "symlink")


def test_settings_round_trip(tmp_path):
    config = SubsetConfig((5, 2), salt="x", non_train_policy="drop")
    config.to_yaml(tmp_path / "c.yaml")
    assert SubsetConfig.from_yaml(tmp_path / "c.yaml") == config
    (tmp_path / "d.yaml").write_text("- 1\n")
    with pytest.raises(ValueError, match="one mapping"):
        SubsetConfig.from_yaml(tmp_path / "d.yaml")
    (tmp_path / "e.yaml").write_text("")
    with pytest.raises(TypeError):
        SubsetConfig.from_yaml(tmp_path / "e.yaml")
    (tmp_path / "f.yaml").write_text("a: [")
    with pytest.raises(ValueError, match="not YAML"):
        SubsetConfig.from_yaml(tmp_path / "f.yaml")
