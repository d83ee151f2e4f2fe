from pyspark.sql import functions as F

from sievelake.functions import scalars as S
from sievelake.operators import report


def some_errors(spark):
    path = F.concat(F.lit("/s/"), F.col("id").cast("string"), F.lit(".txt"))
    message = F.concat(F.lit("open "), path, F.lit(": permission denied"))
    return spark.range(2000).select(F.lit(1).alias("size"), F.lit("reflink").alias("mode"), message.alias("err"), path.alias("src_path"), path.alias("dst_path"))


def hashing(df):
    """Nodes of the optimized plan that work out keys."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line.lstrip(" :+-").split()[0] for line in lines if "aggregate(" in line]


def test_keys_are_hashed_for_kinds_not_for_rows(spark):
    kinds = report.kinds(some_errors(spark))
    keys = {r["key"] for r in kinds.collect()}
    assert len(keys) == 4 and sum(r["errors"] for r in kinds.collect()) == 2000
    known = report.known_keys(kinds.select(F.concat("key", F.lit(" 2024-01-01T00:00:00Z")).alias("value")))
    assert hashing(known) == ["Project"] and {r["key"] for r in known.collect()} == keys
    few = spark.createDataFrame([(k,) for k in sorted(keys)[:3]], "key string")
    new = kinds.join(F.broadcast(few), "key", "left_anti")
    assert hashing(new) == ["Project"] and {r["key"] for r in new.collect()} == {max(keys)}
    one = kinds.where(F.col("key") == max(keys))
    assert hashing(one) == ["Project"] and one.count() == 1


def test_hashed_text_is_worked_out_once(spark):
    assert str(S.fnv1a64_halves(F.upper("text"))).count("upper(") == 1
    rows = spark.createDataFrame([("",), (None,), ("é/𝄞a",)], "text string").select(S.fnv1a64_hex("text").alias("h"))
    assert [r["h"] for r in rows.collect()] == ["cbf29ce484222325", None, "60232b7dfc7269be"]
