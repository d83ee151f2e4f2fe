"""The registered queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest, lines, media, near_dup, packing, piece_counts, records, toxicity, url_filter, word_shuffle
from .common import default_tokenizer, table

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"


def op1_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH l AS (
  SELECT doc_id, n, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), k AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT l.doc_id, l.n, l.line, k.key IS NOT NULL AND l.doc_id <> k.keeper AS gone FROM l LEFT JOIN k ON l.key = k.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""


def op3_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), default_tokenizer(BYTE_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    docs = table(spark, sf_dir, "documents")
    return word_shuffle.encode(docs, default_tokenizer(MULTI_BPE), PATTERN, word_shuffle._digest, word_shuffle.DIGEST)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents"), default_tokenizer(BYTE_BPE))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_tokens(table(spark, sf_dir, "documents"), default_tokenizer(PIECES))


URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


OP8_SQL = r"""
WITH r(host, path, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path,
         row_number() OVER () AS n
  FROM pages
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict AS v,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
) WHERE k = 1
"""


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles
  FROM w
), e AS (SELECT r, len(shingles) AS n, hash(unnest(shingles)) AS h FROM s), x AS (
  SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.h = b.h AND a.r <> b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), c AS (SELECT r AS a, r AS b FROM s UNION SELECT c.a, x.b FROM c JOIN x ON c.b = x.a),
m AS (SELECT c.a AS r, min(s.doc_id) AS component_id FROM c JOIN s ON c.b = s.r GROUP BY c.a)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id,
       s.doc_id IS NOT DISTINCT FROM coalesce(component_id, s.doc_id) AS kept
FROM s JOIN m ON s.r = m.r
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(toxicity.FOLDS))
    # a row without a doc_id has no label to hold out
    return scored.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict:
    return {
        "op1_webp_media": op1_webp_media,
        "op2_line_dedup": op2_line_dedup,
        "op3_embedding_near_dup": op3_embedding_near_dup,
        "op4_packing": op4_packing,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_token_records": op6_token_records,
        "op7_token_counts": op7_token_counts,
        "op8_url_filter": op8_url_filter,
        "op9_minhash_near_dup": op9_minhash_near_dup,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_embedding_near_dup": OP3_SQL, "op8_url_filter": OP8_SQL, "op9_minhash_near_dup": OP9_SQL}
