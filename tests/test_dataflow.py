import os

import pytest
from pyspark.sql import functions as F

from sievelake import notify
from sievelake.operators import content, incremental, report, survey
from sievelake.plans.dry_run import Config, parse_duration, run
from sievelake.sources import state, tree


def make_tree(root):
    def put(name, data):
        os.makedirs(os.path.dirname(f"{root}/{name}") or root, exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)

    k = 1024
    for i in (1, 2, 3):
        put(f"groupA_{i}.bin", b"A" * k)
        put(f"sub/groupC_{i}.bin", bytes([i]) * k)
    for i in (1, 2):
        put(f"deep/er/est/groupB_{i}.bin", b"B" * 2 * k)
    for i, c in (("1a", b"x"), ("1b", b"x"), ("2a", b"y"), ("2b", b"y")):
        put(f"groupD_{i}.bin", c * (k // 2))
    put("groupE_lone.bin", b"E" * k)


def test_tree_plan(spark, tmp_path):
    make_tree(tmp_path)
    result = run(spark, Config(str(tmp_path), min_size=0))
    assert [tuple(r) for r in result.targets.select("size", "count", "savings").collect()] == [(1024, 7, 6144), (2048, 2, 2048), (512, 4, 1536)]
    assert result.stats == notify.Stats(bytes_saved=5120, files_deduped=5)
    actions = result.actions.collect()
    assert len({r["dst"] for r in actions}) == 5 and not {r["dst"] for r in actions} & {r["src"] for r in actions}


def test_second_run_has_no_targets(spark, tmp_path):
    make_tree(tmp_path / "t")
    config = Config(str(tmp_path / "t"), min_size=0, cache_dir=str(tmp_path / "cache"), commit=True)
    assert run(spark, config).targets.count() == 3
    again = run(spark, config)
    assert again.targets.count() == 0 and again.skipped == 3
    (tmp_path / "t" / "groupD_new.bin").write_bytes(b"z" * 512)
    assert [r["size"] for r in run(spark, config).targets.collect()] == [512]


def test_tree_scan_rules(spark, tmp_path):
    for name in ("a/f1", "a/.hidden", "b/_odd", "b/.snapshots/old", "c/d/e/f/deep"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "small").write_bytes(b"1")
    os.symlink(tmp_path / "a/f1", tmp_path / "link")
    os.symlink(tmp_path / "a", tmp_path / "linked")
    os.link(tmp_path / "a/f1", tmp_path / "hard")
    os.mkfifo(tmp_path / "pipe")
    rows = {os.path.relpath(r["path"], os.path.realpath(tmp_path)): r for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/f1", "a/.hidden", "b/_odd", "c/d/e/f/deep", "small", "hard"}
    assert rows["hard"]["ino"] == rows["a/f1"]["ino"]
    big = tree.read_tree(spark, str(tmp_path), snapshots=True).where("size >= 2")
    assert {os.path.basename(r["path"]) for r in big.collect()} == {"f1", ".hidden", "_odd", "old", "deep", "hard"}
    with pytest.raises(Exception, match="nowhere"):
        tree.read_tree(spark, str(tmp_path / "nowhere")).count()


@pytest.mark.parametrize(
    "texts, deduped, saved",
    [(["data"], 0, 0), (["duplicate content here"] * 2, 1, 22), (["triple content"] * 3, 2, 28), (["aaaaa", "bbbbb"], 0, 0), (["same!", "same!", "diff!"], 1, 5), ([], 0, 0)],
)
def test_groups(spark, texts, deduped, saved):
    files = spark.createDataFrame([(f"/d/{i}", t, len(t)) for i, t in enumerate(texts)], "path string, content string, size bigint")
    row = content.stats(content.hashed(files)).first()
    assert (row["files_deduped"], row["bytes_saved"], row["errors"]) == (deduped, saved, 0)


def test_shared_inodes_are_already_done(spark):
    rows = [("/a", "x", 1, 1), ("/b", "x", 1, 1), ("/cc", "x", 1, 2), ("/d", "y", 1, 3)]
    files = content.hashed(spark.createDataFrame(rows, "path string, content string, size bigint, ino bigint"))
    assert {r["path"]: r["action"] for r in content.judged(files).collect()} == {"/a": "reference", "/b": "already", "/cc": "dedup"}


def test_limit_comes_after_the_cache(spark):
    sizes = spark.createDataFrame([(10, 5, 40), (20, 2, 20), (30, 1, 0), (5, 2, 5)], "size bigint, count bigint, savings bigint")
    prints = sizes.select("size", F.lit(1).cast("decimal(20,0)").alias("fp"))
    cache = spark.createDataFrame([(10,), (99,)], "size bigint").withColumn("fp", F.lit(1).cast("decimal(20,0)"))
    assert [r["size"] for r in incremental.next_targets(sizes, prints, cache, 1).collect()] == [20]
    assert incremental.skipped(sizes, prints, cache).first()[0] == 1
    assert [r["size"] for r in incremental.pruned(cache, sizes).collect()] == [10]
    done = spark.createDataFrame([(10,), (7,)], "size bigint").withColumn("fp", F.lit(2).cast("decimal(20,0)"))
    assert {r["size"]: int(r["fp"]) for r in incremental.merged(cache, done).collect()} == {10: 2, 99: 1, 7: 2}
    assert survey.top(sizes, 0).count() == 0


def test_state(spark, tmp_path):
    place = str(tmp_path / "deep" / "abc.gob")
    assert state.load(spark, place).count() == 0
    one = spark.createDataFrame([(100, 42), (200, 99)], "size bigint, fp bigint").select("size", F.col("fp").cast("decimal(20,0)").alias("fp"))
    state.save(one, place)
    assert {r["size"]: int(r["fp"]) for r in state.load(spark, place).collect()} == {100: 42, 200: 99}
    state.save(state.load(spark, place).where("size = 100"), place)  # rows of the old state
    assert state.load(spark, place).count() == 1 and os.listdir(tmp_path / "deep") == ["abc.gob"]
    (tmp_path / "bad.gob").write_bytes(b"junk")
    assert state.load(spark, str(tmp_path / "bad.gob")).count() == 0
    assert state.meta_path("/cache/abc123.gob") == "/cache/abc123.meta" and state.meta_path("/cache/a.b.c.gob") == "/cache/a.b.c.meta"


def test_lock(tmp_path):
    with state.locked(str(tmp_path), "/one"):
        with state.locked(str(tmp_path), "/two"):
            pass
        with pytest.raises(BlockingIOError), state.locked(str(tmp_path), "/one"):
            pass
    with state.locked(str(tmp_path), "/one"):
        pass


def test_report_log(spark, tmp_path):
    path = str(tmp_path / "r" / "report.log")
    schema = "size bigint, mode string, err string, src_path string, dst_path string"
    errors = spark.createDataFrame(
        [(1, "reflink", "open /secret/data.txt: permission denied", "/s/a", "/s/b"), (2, "reflink", "open /other/x.txt: permission denied", "/t/a", "/t/b"), (3, "hardlink", "too many links", "/s/a", "/s/b")], schema
    )
    stamp = F.lit("2024-05-01 10:00:00").cast("timestamp")
    assert report.append(spark, spark.createDataFrame([], schema), path, "1", stamp) == 0 and not os.path.exists(path)
    assert report.append(spark, errors, path, "1", stamp) == 2
    assert report.append(spark, errors, path, "1", stamp) == 0
    text = open(path).read()
    assert "secret" not in text and "<path>" in text and "2024-05-01T10:00:00Z" in text and len(text.splitlines()) == 5
    lines = spark.createDataFrame([("# no",), ("short",), ("0123456789abcdef x",), ("fedcba9876543210 y",), ("0123456789abcdef z",)], "value string")
    assert report.known_keys(lines).count() == 2


def test_messages():
    assert "No changes" in notify.update_text(notify.Stats(already_deduped=100), "/r", 1)
    text = notify.update_text(notify.Stats(1 << 20, 10, 5, 2), "/r", 1, dry_run=True, host="h")
    assert text.startswith("[dry-run]") and "/r" in text and "| 10 |" in text
    assert notify.alert_text(notify.Stats(), "/r") is None and "5 errors need investigation" in notify.alert_text(notify.Stats(errors=5), "/r", "h")
    assert notify.summary_lines(notify.Stats(), 1, quiet=True) == []


@pytest.mark.parametrize("status, fails", [(200, False), (299, False), (400, True), (500, True)])
def test_webhook(status, fails):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(status)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    if fails:
        with pytest.raises(OSError):
            notify.send(url, "x")
    else:
        notify.send(url, "x")
    server.shutdown()
    assert seen == [{"text": "x"}]


def test_durations():
    assert [parse_duration(x) for x in ("30m", "1h30m", "1.5s", "250ms")] == [1800, 5400, 1.5, 0.25]
    with pytest.raises(ValueError):
        parse_duration("soon")


def test_stream_keeps_a_survey(spark, tmp_path):
    from sievelake.streaming import incremental as stream

    src = str(tmp_path / "in")
    spark.createDataFrame([(5,), (5,), (7,)], "size bigint").write.parquet(src)
    place, mark = str(tmp_path / "state"), str(tmp_path / "mark")
    for _ in range(2):
        stream.start(spark.readStream.schema("size bigint").parquet(src), place, mark).awaitTermination()
        spark.createDataFrame([(7,)], "size bigint").write.mode("append").parquet(src)
    assert {r["size"]: r["count"] for r in state.load(spark, place, stream.SCHEMA).collect()} == {5: 2, 7: 2}
