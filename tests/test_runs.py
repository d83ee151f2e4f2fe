import json
import os

from pyspark.sql import functions as F

from sievelake import cli, notify
from sievelake.operators import content, report
from sievelake.plans import dry_run
from sievelake.plans.dry_run import Config, run, run_all
from sievelake.sources import state, tree
from sievelake.streaming import incremental as stream

from .test_dataflow import make_tree


def failures_of(spark, result, n, err="open /secret/x: no space left"):
    rows = [(r["dst"], err) for r in result.actions.orderBy("dst").limit(n).collect()]
    return spark.createDataFrame([*rows, ("/nowhere", "not planned")], "path string, err string")


def test_failed_files_count_and_their_sizes_stay_open(spark, tmp_path):
    make_tree(tmp_path / "t")
    base = dict(root=str(tmp_path / "t"), min_size=0, cache_dir=str(tmp_path / "c"))
    planned = run(spark, Config(**base))
    assert planned.stats.errors == 0 and planned.errors is None and planned.files_before is None
    failed = failures_of(spark, planned, 1)
    result = run(spark, Config(**base, commit=True, failures=failed))
    assert result.stats.errors == 1 and result.stats.files_deduped == planned.stats.files_deduped - 1 and result.files_before == 13
    size = result.errors.first()["size"]
    assert result.stats.bytes_saved == planned.stats.bytes_saved - size and result.reported == 1
    log = open(state.report_path(str(tmp_path / "c"), os.path.realpath(tmp_path / "t"))).read()
    assert "secret" not in log and "<path>" in log
    again = run(spark, Config(**base, commit=True, failures=failed))
    assert [r["size"] for r in again.targets.collect()] == [size] and again.reported == 0
    assert run(spark, Config(**base)).skipped == 2


def test_unreadable_files_keep_their_size_open(spark, tmp_path, monkeypatch):
    make_tree(tmp_path / "t")
    place = state.cache_path(str(tmp_path / "c"), os.path.realpath(tmp_path / "t"))
    whole = tree.hash_files
    monkeypatch.setattr(tree, "hash_files", lambda files: whole(files).withColumn("sha", F.when(F.col("name") != "groupD_1a.bin", F.col("sha"))))
    result = run(spark, Config(str(tmp_path / "t"), min_size=0, cache_dir=str(tmp_path / "c"), commit=True))
    assert result.unreadable == 1 and {r["size"] for r in state.load(spark, place).collect()} == {1024, 2048}


def test_deadline(spark, tmp_path, monkeypatch):
    make_tree(tmp_path / "t")
    config = Config(str(tmp_path / "t"), min_size=0, cache_dir=str(tmp_path / "c"), commit=True, max_time=0)
    late = run(spark, config)
    assert late.late and late.stats == notify.Stats() and late.targets.count() == 3
    config.max_time = 1000
    monkeypatch.setattr(dry_run, "CHUNK", 1)
    whole = run(spark, config)
    assert not whole.late and whole.stats == notify.Stats(bytes_saved=5120, files_deduped=5)
    assert run(spark, config).targets.count() == 0


def test_several_roots(spark, tmp_path):
    make_tree(tmp_path / "a")
    make_tree(tmp_path / "b")
    results, total = run_all(spark, [Config(str(tmp_path / x), min_size=0) for x in "ab"])
    assert len(results) == 2 and total == notify.Stats(bytes_saved=10240, files_deduped=10)


def test_extents(spark, tmp_path):
    e = lambda *places: [(0, p, n, 0) for p, n in places]
    rows = [("/a", "x", 1, e((10, 2))), ("/bb", "x", 1, e((10, 2))), ("/cc", "x", 1, e((11, 2))), ("/dd", "x", 1, None), ("/e", "y", 1, None), ("/ff", "y", 1, None)]
    files = content.hashed(spark.createDataFrame(rows, f"path string, content string, size bigint, extents {tree.EXTENTS}"))
    assert {r["path"]: r["action"] for r in content.judged(files).collect()} == {
        "/a": "reference", "/bb": "already", "/cc": "dedup", "/dd": "dedup", "/e": "reference", "/ff": "dedup",
    }
    (tmp_path / "f").write_bytes(b"z" * 5000)
    found = tree.extents_of(str(tmp_path / "f"))
    assert found is None or sum(x[2] for x in found) >= 5000
    assert tree.extents_of(str(tmp_path / "nothing")) is None
    one = spark.createDataFrame([(str(tmp_path / "f"),)], "path string")
    assert tree.add_extents(one).schema["extents"].dataType.simpleString() == tree.EXTENTS


def test_wide_trees_are_cut(tmp_path, monkeypatch):
    for i in range(6):
        for j in range(5):
            os.makedirs(tmp_path / f"one/d{i}/e{j}/f")
    parts = tree.TreeReader({"path": str(tmp_path)}).partitions()
    assert len(parts) == 1 + 1 + 6 + 30 + 30 and not any(p.deep for p in parts)
    monkeypatch.setattr(tree, "PARTS", 20)
    parts = tree.TreeReader({"path": str(tmp_path)}).partitions()
    assert sum(p.deep for p in parts) == 30 and len({p.folder for p in parts}) == 1 + 1 + 6 + 30


def test_replayed_batches_count_once(spark, tmp_path):
    place = str(tmp_path / "s")
    merge = stream.merge_batch(place)
    batches = [spark.createDataFrame([(5,), (7,)], "size bigint"), spark.createDataFrame([(7,)], "size bigint")]
    for number in (0, 0, 1, 0, 1):
        merge(batches[number], number)
    assert {r["size"]: r["count"] for r in state.load(spark, place, stream.SCHEMA).collect()} == {5: 1, 7: 2}


def test_a_broken_version_is_not_the_state(spark, tmp_path):
    place = str(tmp_path / "s")
    one = spark.createDataFrame([(1, 2)], "size bigint, count bigint")
    state.save(one, place)
    os.makedirs(f"{place}/v-{2:020d}")  # a writer that ended early
    assert state.version(spark, place) == 1 and state.load(spark, place, stream.SCHEMA).count() == 1
    state.save(one.limit(0), place)
    state.save(state.load(spark, place, stream.SCHEMA).unionByName(one), place)
    assert state.version(spark, place) == 3 and state.load(spark, place, stream.SCHEMA).count() == 1
    assert sorted(n for n in os.listdir(place)) == [f"v-{i:020d}" for i in (2, 3)]


def test_kinds_are_the_first_of_each_key(spark):
    rows = [(3, "reflink", "open /a/b: no", "/s/a.x", "/t"), (1, "hardlink", "open /c/dd: no", "/z/q.x", "/u"), (2, "reflink", "other", "/s/a", "/t")]
    errors = spark.createDataFrame(rows, "size bigint, mode string, err string, src_path string, dst_path string")
    kinds = {r["err"]: (r["errors"], r["size"], r["mode"]) for r in report.kinds(errors).collect()}
    assert kinds == {"open <path>: no": (2, 1, "hardlink"), "other": (1, 2, "reflink")}
    assert {r["key"] for r in report.kinds(errors).collect()} == {r["key"] for r in report.keyed(errors).collect()}
    first = report.new_entries(report.keyed(errors), spark.createDataFrame([], "key string"), ["size", "src", "dst"])
    assert {(r["key"], r["size"]) for r in first.collect()} == {(r["key"], r["size"]) for r in report.kinds(errors).collect()}
    assert report.kinds(errors.limit(0)).count() == 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    make_tree(tmp_path / "t")
    sent = []
    monkeypatch.setattr(notify, "send", lambda url, text: sent.append((url, text)))
    base = ["--min-size", "0", "--cache-dir", str(tmp_path / "c")]
    assert cli.main([*base, "-v", "--raw-sizes", "--max-time", "1h", "--webhook", "w", str(tmp_path / "t"), str(tmp_path / "t")]) == 0
    out = capsys.readouterr()
    assert out.out.count("[dry-run] dedup: ") == 10 and out.err.count("    /") == 10 and "total  13 files, 9728" in out.out
    assert len(sent) == 2 and sent[0][1].startswith("[dry-run]")
    dst = out.err.strip().splitlines()[-1].split(" -> ")[0].strip()
    (tmp_path / "failed.json").write_text(json.dumps({"path": dst, "err": "no space"}))
    assert cli.main([*base, "-q", "--failures", str(tmp_path / "failed.json"), "--alerts", "a", str(tmp_path / "t")]) == 1
    assert sent[-1][0] == "a" and "1 errors" in sent[-1][1]
    assert cli.main([*base, str(tmp_path / "missing")]) == 1
    assert cli.main([*base, "--max-time", "soon", str(tmp_path / "t")]) == 1
