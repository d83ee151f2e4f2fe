"""The corpus pipeline: toxic documents go, repeated lines go, one document of each
near-duplicate group stays, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.

Defined results: stages judge rows, whatever other rows share their doc_id; a null
doc_id is allowed, comes last among near duplicates and is kept in the pieces; a
null or empty text isn't toxic, has no lines to lose, is no one's near duplicate
and is packed as its end id; an empty table gives an empty table of the same
columns; further columns of any name pass through all stages but the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import lines, near_dup, packing, toxicity
from sievelake.llm.common import columns, default_tokenizer, free_names, remove, scratch, stored, table

TOXIC_FROM = 0.5
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM.  The model learns from the labels of the documents it is given."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = free_names(docs, "__score")
    return toxicity.score(docs, model, score).where(F.col(score) < TOXIC_FROM).select(*columns(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in three documents or more, but for the one that keeps each.
    A document that had text and has none left goes; n_chars follows the text."""
    n_lines, n_dropped = free_names(docs, "__n_lines", "__n_dropped")
    kept = lines.dedup_lines(docs, counts=(n_lines, n_dropped))
    rest = kept.where((F.col(n_dropped) == 0) | (F.length("text") > 0))
    n_chars = F.when(F.col(n_dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rest.withColumn("n_chars", n_chars).select(*columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, null last; of those with
    the same doc_id, the one with the smallest MD5 of its text, then with the smallest other columns.  Rows
    are judged by doc_id and text, so others with their doc_id don't matter.  Texts without words all stay."""
    seal, row = free_names(docs, "__seal", "__row")
    sealed = docs.withColumn(seal, F.md5(F.coalesce("text", F.lit(""))))
    judged = near_dup.judged_rows(sealed, SHINGLE_WORDS, SIMILAR_PERCENT, (seal,))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(seal).alias("seal"))
    keys, keys_path = stored(judged.where("n > 0").groupBy("label", key.alias("key")).agg(F.count("*").alias("rows")), "judged-keys")
    first = keys.groupBy("label").agg(F.min("key").alias("first"))
    marked = keys.join(first, "label").select(F.col("key.doc_id").alias("id"), F.col("key.seal").alias("seal"), (F.col("key") == F.col("first")).alias("stays"), "rows")
    marked, _ = stored(marked.where("not stays or rows > 1"), "judged")
    remove(spark, keys_path)
    same = sealed.doc_id.eqNullSafe(marked.id) & (sealed[seal] == marked.seal)
    rest = sealed.join(marked, same, "left_anti").select(*columns(docs))
    repeated = marked.where("stays")
    if repeated.isEmpty():
        return rest
    again = sealed.join(repeated, same, "left_semi")
    one = again.groupBy("doc_id", seal).agg(F.min(F.struct(*columns(docs))).alias(row))
    return rest.unionByName(one.select(*(F.col(row).getField(c).alias(c) for c in docs.columns)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids."""
    pieces = packing.pack(docs, default_tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dup", drop_near_duplicates),
    ("packing", pack),
]

#: The first stage learns a model and the last one asks a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
