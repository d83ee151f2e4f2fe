import pytest
from pyspark.sql import functions as F

from sievelake.functions import scalars as S


def values(spark, column, *rows):
    """The column for each row (a, b, c); one job for all."""
    schema = ", ".join(f"{name} {'string' if isinstance(v, str) else 'bigint'}" for name, v in zip("abc", rows[0], strict=False))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column.alias("x")).collect()]


def test_format_size(spark):
    cases = {0: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1.0 KiB", 1536: "1.5 KiB", 1 << 20: "1.0 MiB", 1610612736: "1.5 GiB", 1 << 30: "1.0 GiB",
             1 << 40: "1.0 TiB", 5 << 40: "5.0 TiB", 1280: "1.2 KiB", -5: "-5 B"}
    assert values(spark, S.format_size("a"), *[(k,) for k in cases]) == list(cases.values())
    assert values(spark, S.format_size("a", raw=True), (0,), (1 << 20,)) == ["0", "1048576"]


def test_format_count(spark):
    cases = {0: "0", 5: "5", 999: "999", 1000: "1,000", 123456: "123,456", 1234567890: "1,234,567,890", -5: "-5", -1000: "-1,000", -1234567: "-1,234,567",
             9223372036854775807: "9,223,372,036,854,775,807"}
    assert values(spark, S.format_count("a"), *[(k,) for k in cases]) == list(cases.values())


def test_format_eta(spark):
    cases = {(10, 50, 100): "~10s", (60, 25, 100): "~3.0m", (540, 90, 100): "~1.0m", (7200, 50, 100): "~2.0h", (1, 0, 100): "", (1, 50, 0): "",
             (1, 101, 100): "", (1, 100, 100): "~0s", (10, 5 * 10**9, 10**10): "~10s"}
    assert values(spark, S.format_eta("a", "b", "c"), *cases) == list(cases.values())


def test_char_classes(spark):
    cases = {"": "", "abc": "a", "ABC": "A", "123": "0", " ": "SP", ".": ".", "-": "-", "_": "_", "///": "", "\\": "", "café": "a~", "日本語": "~",
             "/home/user/file.txt": "a.", "foo[1](2)": "a0?", "aA0 .-_!日/": "aA0SP.-_?~"}
    assert values(spark, S.char_classes("a"), *[(k,) for k in cases]) == list(cases.values())


def test_path_pattern(spark):
    cases = {"/home/user/doc.txt": "d=3,l=18,ext=.txt,c=a.,segs=0.4.4.7", "/": "d=1,l=1,ext=,c=,segs=0.0", "file.txt": "d=0,l=8,ext=.txt,c=a.,segs=8", "": "d=0,l=0,ext=,c=,segs=0",
             "/data/archive.tar.gz": "d=2,l=20,ext=.gz,c=a.,segs=0.4.14", "/home/user/.bashrc": "d=3,l=18,ext=.bashrc,c=a.,segs=0.4.4.7"}
    assert values(spark, S.path_pattern("a"), *[(k,) for k in cases]) == list(cases.values())
    a, b = values(spark, S.path_pattern("a"), ("/aaa/bbb.txt",), ("/xxx/yyy.txt",))
    assert a == b


def test_sanitize_error(spark):
    cases = {"permission denied": "permission denied", "/usr/bin/foo: error": "<path>: error", "open /tmp/secret.txt: no such file": "open <path>: no such file",
             "error:/etc/passwd": "error:<path>", "link /src/a to /dst/b failed": "link <path> to <path> failed", "a/b/c": "a/b/c", "": "", "/": "/",
             "error /tmp/x": "error <path>", "/tmp/a\nmore": "<path>\nmore"}
    assert values(spark, S.sanitize_error("a"), *[(k,) for k in cases]) == list(cases.values())


def test_fnv1a64(spark):
    cases = {"": 14695981039346656037, "a.txt": 9139354734180416858, "b.txt": 133413252347079971, "日本.bin": 8187671867287576758, "groupA_1.bin": 891152527581110412}
    assert [int(x) for x in values(spark, S.fnv1a64("a"), *[(k,) for k in cases])] == list(cases.values())
    assert values(spark, S.hex16(S.fnv1a64("a")), ("",)) == values(spark, S.fnv1a64_hex("a"), ("",)) == ["cbf29ce484222325"]


def test_fingerprint_wraps_and_ignores_order(spark):
    df = spark.createDataFrame([(n,) for n in ("a.txt", "b.txt", "a.txt", "", "")], "name string")
    want = (2 * 9139354734180416858 + 133413252347079971 + 2 * 14695981039346656037) % (1 << 64)
    for some in (df, df.orderBy(F.desc("name"))):
        assert int(some.agg(S.wrapped_sum(S.fnv1a64("name")).alias("x")).first()[0]) == want


def test_report_key_keeps_shape_only(spark):
    rows = [("open /a/b: denied", "/a/b.txt", "/c/d.txt"), ("open /x/yy: denied", "/q/w.txt", "/e/r.txt"), ("open /a/b: other", "/a/b.txt", "/c/d.txt"), ("open /a/b: denied", "/aa/b.txt", "/c/d.txt")]
    one, same, other, shape = values(spark, S.report_key("a", "b", "c"), *rows)
    assert one == same and len({one, other, shape}) == 3 and len(one) == 16


@pytest.mark.parametrize(
    "a, b, want",
    [(None, None, True), ([], None, True), ([(1, 2)], None, False), ([(100, 200)], [(100, 200)], True), ([(1, 2)], [(1, 2), (3, 4)], False), ([(1, 2)], [(9, 2)], False), ([(1, 2)], [(1, 9)], False)],
)
def test_same_extents(spark, a, b, want):
    rows = spark.createDataFrame([(a, b)], "a array<struct<physical:bigint,length:bigint>>, b array<struct<physical:bigint,length:bigint>>")
    assert rows.select(S.same_extents("a", "b")).first()[0] is want
