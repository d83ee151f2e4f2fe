"""Queries over the tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import notify
from .functions import scalars as S
from .operators import content, incremental, report, survey
from .sources.tables import documents_as_files, with_shared_extents, with_shared_inode

MIN_SIZE = 1024
TOP = 10_000


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.not_below(documents_as_files(spark, sf_dir), MIN_SIZE)


def _survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.size_survey(_files(spark, sf_dir))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.top(_survey(spark, sf_dir), TOP)


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of candidate sizes with their hash: sizes that occur once are never hashed."""
    files = _files(spark, sf_dir)
    return content.hashed(content.candidate_files(files, survey.candidates(survey.size_survey(files))))


def _outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan as carried out on a machine where every source is a device of its own: what would have to share
    data with another source fails."""
    judged = content.judged(_hashed(spark, sf_dir))
    apart = judged.where((F.col("action") == "dedup") & (F.col("source") != F.split("src", "/")[1]))
    err = F.concat(F.lit("link "), "src", F.lit(" to "), "path", F.lit(": invalid cross-device link"))
    return content.with_failures(judged, apart.select("path", err.alias("err")))


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.fingerprints(_files(spark, sf_dir))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run would have remembered: fingerprints of the same files, where those of sizes
    divisible by 3 have since changed, and of sizes that no longer occur."""
    prints = _prints(spark, sf_dir)
    old = prints.select("size", F.when(F.col("size") % 3 == 0, F.lit(0).cast("decimal(20,0)")).otherwise(F.col("fp")).alias("fp"))
    gone = prints.groupBy().agg(F.max("size").alias("size")).select((F.col("size") + 1).alias("size"), F.lit(1).cast("decimal(20,0)").alias("fp"))
    return old.unionByName(gone)


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    message = F.concat(F.lit("open "), "path", F.lit(": permission denied"))
    return files.select("size", F.lit("reflink").alias("mode"), message.alias("err"), F.col("path").alias("src_path"), F.concat("path", F.lit(".bak")).alias("dst_path"), "doc_id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def _extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    part = F.array(F.struct(F.col("label").cast("long").alias("physical"), F.size("embedding").cast("long").alias("length")))
    other = F.array(F.struct((F.col("vec_id") % 7).alias("physical"), F.size("embedding").cast("long").alias("length")))
    return v.select("vec_id", S.same_extents(part, F.when(F.col("vec_id") % 5 != 0, other)).alias("same"))


def _report_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of errors of a run whose files can't be opened and can't be shared, after one that couldn't open them."""
    before = _errors(spark, sf_dir).drop("doc_id")
    lines = report.kinds(before).select(F.concat("key", F.lit(" 2024-01-01T00:00:00Z")).alias("value"))
    now = report.kinds(before.unionByName(content.errors_of(_outcome(spark, sf_dir))))
    return now.join(report.known_keys(lines), "key", "left_anti")


def _stamp():
    return F.lit("2024-05-01 10:00:00").cast("timestamp")


def _payload(spark: SparkSession, text: str | None) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string").select(F.to_json(F.struct("text")).alias("payload"))


def _message(spark: SparkSession, sf_dir: str, outcome: DataFrame, alert: bool = False) -> DataFrame:
    """A message's payload; its one row of statistics comes to the driver, as in a run."""
    row = content.outcome_stats(outcome).first()
    stats = notify.Stats(*(row[k] for k in ("bytes_saved", "files_deduped", "already_deduped", "errors")))
    return _payload(spark, notify.alert_text(stats, "/data", "host") if alert else notify.update_text(stats, "/data", 0, dry_run=True, host="host"))


def queries() -> dict:
    q = {
        "scan_filter_min_size": lambda s, d: _files(s, d).select("path", "dir", "name", "size"),
        "snapshot_exclusion": lambda s, d: survey.without_folder(documents_as_files(s, d), "src1").select("path", "size"),
        "scan_totals": lambda s, d: survey.totals(_files(s, d)),
        "size_survey": _survey,
        "top_sizes": lambda s, d: survey.ranked(_targets(s, d)),
        "top_sizes_display": lambda s, d: survey.display(_targets(s, d)),
        "target_totals": lambda s, d: survey.target_totals(_targets(s, d)),
        "bounded_survey": lambda s, d: survey.bounded(_survey(s, d), 200),
        "candidate_files": lambda s, d: content.candidate_files(_files(s, d), _targets(s, d)).select("path", "size"),
        "candidate_paths": lambda s, d: content.candidate_paths(_files(s, d), _targets(s, d)),
        "content_groups": lambda s, d: content.content_groups(_hashed(s, d)),
        "duplicate_pairs": lambda s, d: content.pairs(_hashed(s, d)),
        "dedup_plan": lambda s, d: content.plan(_hashed(s, d)),
        "dry_run_lines": lambda s, d: content.plan_lines(content.plan(_hashed(s, d))),
        "dedup_stats": lambda s, d: content.stats(_hashed(s, d)),
        "group_stats": lambda s, d: content.group_stats(_hashed(s, d)),
        "idle_groups": lambda s, d: content.idle_groups(_hashed(s, d)),
        "already_shared": lambda s, d: content.stats(with_shared_inode(_hashed(s, d))),
        "already_by_extents": lambda s, d: content.stats(with_shared_extents(_hashed(s, d))),
        "run_errors": lambda s, d: content.errors_of(_outcome(s, d)),
        "error_sizes": lambda s, d: content.error_sizes(_outcome(s, d)),
        "error_stats": lambda s, d: content.outcome_stats(_outcome(s, d)),
        "error_groups": lambda s, d: content.outcome_group_stats(_outcome(s, d)),
        "hardlink_plan": lambda s, d: content.plan(_hashed(s, d), "hardlink"),
        "verbose_lines": lambda s, d: content.verbose_lines(content.plan(_hashed(s, d))),
        "sizes_not_shown": lambda s, d: survey.remainder(_targets(s, d)),
        "costliest_size": lambda s, d: survey.costliest(_files(s, d)),
        "scan_rate": lambda s, d: survey.totals(_files(s, d)).select("files", S.rate("files", F.lit(7)).alias("per_second"), S.rate("files", F.lit(0)).alias("at_once")),
        "path_parts": lambda s, d: _pages(s, d).select("page_id", S.base_name("url").alias("base"), S.dir_name("url").alias("dir")),
        "report_lines": lambda s, d: report.lines_of(report.kinds(content.errors_of(_outcome(s, d))), "1", _stamp()),
        "alert_message": lambda s, d: _message(s, d, _outcome(s, d), alert=True),
        "same_extents": _extents,
        "verify_plan": lambda s, d: content.verify(content.plan(_hashed(s, d)), _hashed(s, d)),
        "savings_gap": lambda s, d: content.savings_gap(_hashed(s, d)),
        "progress_timeline": lambda s, d: survey.progress(_targets(s, d)),
        "memory_cost": lambda s, d: survey.memory_cost(_files(s, d)),
        "fnv1a64": lambda s, d: documents_as_files(s, d).select("doc_id", S.hex16(S.fnv1a64("name")).alias("h"), S.fnv1a64_hex("path").alias("p")),
        "fingerprints": lambda s, d: _prints(s, d).select("size", F.col("fp").cast("string").alias("fp")),
        "changed_sizes": lambda s, d: incremental.next_targets(_survey(s, d), _prints(s, d), _cache(s, d), 500).select("size", "count", "savings"),
        "skipped_cached": lambda s, d: incremental.skipped(survey.candidates(_survey(s, d)), _prints(s, d), _cache(s, d)),
        "cache_prune": lambda s, d: incremental.pruned(_cache(s, d), _survey(s, d)).select("size", F.col("fp").cast("string").alias("fp")),
        "cache_merge": lambda s, d: incremental.merged(_cache(s, d), _prints(s, d)).select("size", F.col("fp").cast("string").alias("fp")),
        "format_size": lambda s, d: documents_as_files(s, d).select("doc_id", S.format_size(F.col("size") * F.col("size")).alias("text"), S.format_size("size", raw=True).alias("raw")),
        "format_count": lambda s, d: documents_as_files(s, d).select("doc_id", S.format_count((F.col("size") - 3000) * 1001).alias("text")),
        "format_eta": lambda s, d: documents_as_files(s, d).select("doc_id", S.format_eta(F.lit(60), F.col("doc_id"), F.lit(4096)).alias("text")),
        "path_pattern": lambda s, d: _pages(s, d).select("page_id", S.path_pattern("url").alias("pattern")),
        "char_classes": lambda s, d: _pages(s, d).select("page_id", S.char_classes("url").alias("classes")),
        "sanitize_error": lambda s, d: _files(s, d).select("doc_id", S.sanitize_error(F.concat("path", F.lit(":"), "path", F.lit(" /"), "content")).alias("err")),
        "report_keys": lambda s, d: report.kinds(_errors(s, d)).select("key", "errors"),
        "report_new_entries": _report_new,
        "webhook_message": lambda s, d: _message(s, d, content.judged(_hashed(s, d))),
    }
    return q


# --- SQL ---------------------------------------------------------------------

_F = f"""f0 AS (
  SELECT doc_id, source, lang, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, '/' || source || '/' || lang AS dir,
         doc_id || '.txt' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS size, text AS content FROM documents
), f AS (SELECT * FROM f0 WHERE size > 0 AND size >= {MIN_SIZE}),
sv AS (SELECT size, count(*) AS count, size * (count(*) - 1) AS savings FROM f GROUP BY size),
tg AS (SELECT * FROM sv WHERE count >= 2 ORDER BY savings DESC, size DESC LIMIT {TOP}),
rk AS (SELECT *, row_number() OVER (ORDER BY savings DESC, size DESC) AS rank FROM tg)"""
_C = f"""{_F}, h AS (SELECT doc_id, source, lang, path, name, size, sha256(content) AS sha FROM f WHERE size IN (SELECT size FROM sv WHERE count >= 2)),
w AS (SELECT *, row_number() OVER (PARTITION BY size, sha ORDER BY octet_length(encode(path)), path) AS rn,
             first_value(path) OVER (PARTITION BY size, sha ORDER BY octet_length(encode(path)), path) AS src FROM h)"""


def _size(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 1099511627776 THEN printf('%.1f TiB', {x} / 1099511627776.0::DOUBLE) WHEN {x} >= 1073741824 THEN printf('%.1f GiB', {x} / 1073741824.0::DOUBLE) "
        f"WHEN {x} >= 1048576 THEN printf('%.1f MiB', {x} / 1048576.0::DOUBLE) WHEN {x} >= 1024 THEN printf('%.1f KiB', {x} / 1024.0::DOUBLE) ELSE {x} || ' B' END"
    )


def _fnv(x: str) -> str:
    """FNV-1a as UBIGINT, in HUGEINT steps."""
    octets = f"list_transform(range(1, CAST(octet_length(encode({x})) AS BIGINT) + 1), lambda i: ('0x' || substr(hex(encode({x})), 2 * i - 1, 2))::INT::HUGEINT)"
    step = "((h - h % 256) + xor((h % 256)::INT, b::INT)::HUGEINT) * 1099511628211 % 18446744073709551616"
    return f"list_reduce(list_prepend(14695981039346656037::HUGEINT, {octets}), lambda h, b: {step})::UBIGINT"


def _hex16(x: str) -> str:
    return f"lower(lpad(hex({x}), 16, '0'))"


def _classes(x: str) -> str:
    patterns = [("a", "[a-z]"), ("A", "[A-Z]"), ("0", "[0-9]"), ("SP", " "), (".", r"\."), ("-", "-"), ("_", "_"), ("?", r"[\x00-\x1F!-,:-@\[\]^`{-\x7F]"), ("~", r"[^\x00-\x7F]")]
    return " || ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{s}' ELSE '' END" for s, p in patterns)


def _pattern(x: str) -> str:
    return (
        f"'d=' || (length({x}) - length(replace({x}, '/', ''))) || ',l=' || octet_length(encode({x})) || ',ext=' || regexp_extract({x}, '(\\.[^./]*)$', 1) || ',c=' || {_classes(x)}"
        f" || ',segs=' || array_to_string(list_transform(string_split({x}, '/'), lambda s: octet_length(encode(s))::VARCHAR), '.')"
    )


_SANITIZED = r"regexp_replace(err, '(^|[ :])/[^ :\n\t]+', '\1<path>', 'g')"
_E = f"""{_F}, e AS (SELECT doc_id, size, 'open ' || path || ': permission denied' AS err, path AS src_path, path || '.bak' AS dst_path FROM f),
ek AS (SELECT doc_id, size, {_hex16(_fnv('k'))} AS key, src, dst FROM (
  SELECT doc_id, size, {_SANITIZED} || chr(0) || {_pattern('src_path')} || chr(0) || {_pattern('dst_path')} AS k, {_pattern('src_path')} AS src, {_pattern('dst_path')} AS dst FROM e))"""
_O = f"""{_C}, o AS (SELECT *, source <> split_part(src, '/', 2) AS failed, 'link ' || src || ' to ' || path || ': invalid cross-device link' AS err FROM w WHERE rn > 1)"""
_OUTCOME = """CAST(coalesce(sum(size) FILTER (NOT failed), 0) AS BIGINT) AS bytes_saved, CAST(count(*) FILTER (NOT failed) AS BIGINT) AS files_deduped,
    CAST(0 AS BIGINT) AS already_deduped, CAST(count(*) FILTER (failed) AS BIGINT) AS errors"""


def _kinds(errors: str, name: str, src: str, dst: str) -> str:
    """A table of kinds of errors, of which nth = 1 is the first row."""
    return f"""{name}_shapes AS (SELECT size, {_SANITIZED} AS err, {_pattern(src)} AS src, {_pattern(dst)} AS dst FROM ({errors})),
        {name}_keys AS (SELECT *, {_hex16(_fnv('(err || chr(0) || src || chr(0) || dst)'))} AS key FROM {name}_shapes),
        {name} AS (SELECT *, CAST(count(*) OVER (PARTITION BY key) AS BIGINT) AS errors, row_number() OVER (PARTITION BY key ORDER BY size, src, dst, err) AS nth FROM {name}_keys)"""


_P = f"""{_F}, pr AS (SELECT size, (sum(x::HUGEINT) % 18446744073709551616)::HUGEINT AS fp FROM (SELECT size, {_fnv("name")} AS x FROM f) GROUP BY size),
ca AS (SELECT size, CASE WHEN size % 3 = 0 THEN 0 ELSE fp END AS fp FROM pr UNION ALL SELECT max(size) + 1, 1 FROM pr)"""


def oracle_sql() -> dict[str, str]:
    n = "CAST(count(*) AS BIGINT)"
    return {
        "scan_filter_min_size": f"WITH {_F} SELECT path, dir, name, size FROM f",
        "snapshot_exclusion": f"WITH {_F} SELECT path, size FROM f0 WHERE source <> 'src1'",
        "scan_totals": f"WITH {_F} SELECT {n} AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(DISTINCT size) AS distinct_sizes FROM f",
        "size_survey": f"WITH {_F} SELECT * FROM sv",
        "top_sizes": f"WITH {_F} SELECT * FROM rk",
        "top_sizes_display": f"WITH {_F} SELECT rank, {_size('size')} AS size_text, format('{{:,}}', count) AS count_text, {_size('savings')} AS savings_text FROM rk WHERE rank <= 20",
        "target_totals": f"WITH {_F} SELECT {n} AS targets, CAST(coalesce(sum(count), 0) AS BIGINT) AS expected_files, CAST(coalesce(sum(savings), 0) AS BIGINT) AS expected_savings FROM tg",
        "bounded_survey": f"WITH {_F} SELECT * FROM sv ORDER BY savings DESC, size DESC LIMIT 200",
        "candidate_files": f"WITH {_F} SELECT path, size FROM f WHERE size IN (SELECT size FROM tg)",
        "candidate_paths": f"""WITH {_F} SELECT size, part, {n} AS files, string_agg(path, ',' ORDER BY path) AS paths FROM (
            SELECT f.size, path, ('0x' || substr(md5(path), 1, 8))::BIGINT % CAST(ceil(tg.count / 1000) AS BIGINT) AS part FROM f JOIN tg ON f.size = tg.size) GROUP BY size, part""",
        "content_groups": f"WITH {_C} SELECT size, count(DISTINCT sha) AS contents, {n} AS files, count(*) - count(DISTINCT sha) AS copies FROM h GROUP BY size",
        "duplicate_pairs": f"WITH {_C} SELECT size, src AS path_a, path AS path_b FROM w WHERE rn > 1",
        "dedup_plan": f"WITH {_C} SELECT src, path AS dst, size, 'reflink' AS mode FROM w WHERE rn > 1",
        "dry_run_lines": f"WITH {_C} SELECT '[dry-run] dedup: ' || path || ' -> ' || src || ' (' || {_size('size')} || ')' AS line FROM w WHERE rn > 1",
        "dedup_stats": f"WITH {_C} SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_saved, {n} AS files_deduped, CAST(0 AS BIGINT) AS already_deduped, CAST(0 AS BIGINT) AS errors FROM w WHERE rn > 1",
        "group_stats": f"WITH {_C} SELECT size, CAST(sum(size) AS BIGINT) AS bytes_saved, {n} AS files_deduped, CAST(0 AS BIGINT) AS already_deduped, CAST(0 AS BIGINT) AS errors FROM w WHERE rn > 1 GROUP BY size",
        "idle_groups": f"WITH {_C} SELECT CAST(count(*) FILTER (c = n) AS BIGINT) AS idle_groups, {n} AS groups FROM (SELECT count(DISTINCT sha) AS c, count(*) AS n FROM h GROUP BY size)",
        "already_shared": f"""WITH {_C}, i AS (SELECT *, min(doc_id) OVER (PARTITION BY source, sha) AS ino FROM w),
            r AS (SELECT *, first_value(ino) OVER (PARTITION BY size, sha ORDER BY rn) AS ref FROM i)
            SELECT CAST(coalesce(sum(size) FILTER (ino <> ref), 0) AS BIGINT) AS bytes_saved, CAST(count(*) FILTER (ino <> ref) AS BIGINT) AS files_deduped,
                   CAST(count(*) FILTER (ino = ref) AS BIGINT) AS already_deduped, CAST(0 AS BIGINT) AS errors FROM r WHERE rn > 1""",
        "already_by_extents": f"""WITH {_C}, i AS (SELECT *, CASE WHEN source <> (SELECT min(source) FROM h) THEN min(doc_id) OVER (PARTITION BY lang, sha) END AS place FROM w),
            r AS (SELECT *, first_value(place) OVER (PARTITION BY size, sha ORDER BY rn) AS ref FROM i), j AS (SELECT *, coalesce(place = ref, false) AS already FROM r WHERE rn > 1)
            SELECT CAST(coalesce(sum(size) FILTER (NOT already), 0) AS BIGINT) AS bytes_saved, CAST(count(*) FILTER (NOT already) AS BIGINT) AS files_deduped,
                   CAST(count(*) FILTER (already) AS BIGINT) AS already_deduped, CAST(0 AS BIGINT) AS errors FROM j""",
        "run_errors": f"WITH {_O} SELECT size, 'reflink' AS mode, err, src AS src_path, path AS dst_path FROM o WHERE failed",
        "error_sizes": f"WITH {_O} SELECT DISTINCT size FROM o WHERE failed",
        "error_stats": f"WITH {_O} SELECT {_OUTCOME} FROM o",
        "error_groups": f"WITH {_O} SELECT size, {_OUTCOME} FROM o GROUP BY size",
        "hardlink_plan": f"WITH {_C} SELECT src, path AS dst, size, 'hardlink' AS mode FROM w WHERE rn > 1",
        "verbose_lines": f"WITH {_C} SELECT '    ' || path || ' -> ' || src AS line FROM w WHERE rn > 1",
        "sizes_not_shown": f"WITH {_F} SELECT CAST(greatest(count(*) - 20, 0) AS BIGINT) AS more, CAST(coalesce(sum(count), 0) AS BIGINT) AS files, {_size('coalesce(sum(savings), 0)')} AS savings_text FROM tg",
        "costliest_size": f"""WITH {_F}, m AS (SELECT size, {n} AS files, CAST(sum(32 + octet_length(encode(name))) + (SELECT sum(64 + octet_length(encode(dir))) FROM (SELECT DISTINCT size, dir FROM f) x WHERE x.size = f.size) AS BIGINT) AS bytes
            FROM f GROUP BY size) SELECT * FROM m ORDER BY bytes DESC, size DESC LIMIT 1""",
        "scan_rate": f"WITH {_F} SELECT {n} AS files, CAST(count(*) // 7 AS BIGINT) AS per_second, CAST(NULL AS BIGINT) AS at_once FROM f",
        "path_parts": "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(url, '/[^/]*$', '') AS dir FROM pages",
        "report_lines": f"""WITH {_O}, {_kinds('SELECT * FROM o WHERE failed', 'k', 'src', 'path')}
            SELECT key || ' 2024-05-01T10:00:00Z v=1 size=' || size || ' mode=reflink err="' || err || '" src={{' || src || '}} dst={{' || dst || '}}' AS value FROM k WHERE nth = 1""",
        "alert_message": f"""WITH {_O} SELECT to_json({{'text': 'host: /data: ' || format('{{:,}}', count(*)) || ' errors need investigation'}})::VARCHAR AS payload FROM o WHERE failed""",
        "same_extents": "SELECT vec_id, vec_id % 5 <> 0 AND label = vec_id % 7 AS same FROM embeddings",
        "verify_plan": f"WITH {_C} SELECT {n} AS checked, CAST(count(*) FILTER (s.sha <> w.sha) AS BIGINT) AS mismatches FROM w JOIN h s ON s.path = w.src WHERE rn > 1",
        "savings_gap": f"WITH {_C} SELECT size, size * (count(*) - 1) AS promised, size * (count(*) - count(DISTINCT sha)) AS saved, size * (count(DISTINCT sha) - 1) AS gap FROM h GROUP BY size",
        "progress_timeline": f"""WITH {_F} SELECT rank, size, count, CAST(sum(count) OVER (ORDER BY rank) AS BIGINT) AS done,
            CAST(sum(count) OVER (ORDER BY rank) * 100 // sum(count) OVER () AS BIGINT) AS percent FROM rk""",
        "memory_cost": f"""WITH {_F} SELECT size, {n} AS files, CAST(sum(32 + octet_length(encode(name))) + (SELECT sum(64 + octet_length(encode(dir))) FROM (SELECT DISTINCT size, dir FROM f) x WHERE x.size = f.size) AS BIGINT) AS bytes
            FROM f GROUP BY size""",
        "fnv1a64": f"WITH {_F} SELECT doc_id, {_hex16(_fnv('name'))} AS h, {_hex16(_fnv('path'))} AS p FROM f0",
        "fingerprints": f"WITH {_P} SELECT size, fp::VARCHAR AS fp FROM pr",
        "changed_sizes": f"WITH {_P} SELECT size, count, savings FROM sv JOIN pr USING (size) WHERE count >= 2 AND (size, fp) NOT IN (SELECT (size, fp) FROM ca) ORDER BY savings DESC, size DESC LIMIT 500",
        "skipped_cached": f"WITH {_P} SELECT {n} AS skipped FROM sv JOIN pr USING (size) JOIN ca USING (size, fp) WHERE count >= 2",
        "cache_prune": f"WITH {_P} SELECT size, fp::VARCHAR AS fp FROM ca WHERE size IN (SELECT size FROM sv)",
        "cache_merge": f"WITH {_P} SELECT coalesce(ca.size, pr.size) AS size, CASE WHEN pr.size IS NOT NULL THEN pr.fp ELSE ca.fp END::VARCHAR AS fp FROM ca FULL JOIN pr ON ca.size = pr.size",
        "format_size": f"WITH {_F} SELECT doc_id, {_size('(size * size)')} AS text, size::VARCHAR AS raw FROM f0",
        "format_count": f"WITH {_F} SELECT doc_id, format('{{:,}}', (size - 3000) * 1001) AS text FROM f0",
        "format_eta": """SELECT doc_id, CASE WHEN doc_id <= 0 OR doc_id > 4096 THEN '' WHEN l < 60 THEN printf('~%.0fs', l) WHEN l < 3600 THEN printf('~%.1fm', l / 60) ELSE printf('~%.1fh', l / 3600) END AS text
            FROM (SELECT doc_id, (4096 - doc_id)::DOUBLE / (nullif(doc_id, 0)::DOUBLE / 60) AS l FROM documents)""",
        "path_pattern": f"SELECT page_id, {_pattern('url')} AS pattern FROM pages",
        "char_classes": f"SELECT page_id, {_classes('url')} AS classes FROM pages",
        "sanitize_error": f"WITH {_F} SELECT doc_id, {_SANITIZED} AS err FROM (SELECT doc_id, path || ':' || path || ' /' || content AS err FROM f)",
        "report_keys": f"WITH {_E} SELECT key, {n} AS errors FROM ek GROUP BY key",
        "report_new_entries": f"""WITH {_O}, {_E[len(_F) + 2:]}, {_kinds('SELECT * FROM o WHERE failed', 'k', 'src', 'path')}
            SELECT key, errors, size, 'reflink' AS mode, err, src, dst FROM k WHERE nth = 1 AND key NOT IN (SELECT key FROM ek)""",
        "webhook_message": f"""WITH {_C}, s AS (SELECT coalesce(sum(size), 0)::BIGINT AS b, count(*) AS n FROM w WHERE rn > 1), t AS (SELECT CASE WHEN n = 0 THEN '[dry-run] host: /data: No changes (0.000s)'
            ELSE concat_ws(chr(10), '[dry-run] host: /data', '', '| | |', '|-|-|', '| Deduplicated | ' || format('{{:,}}', n) || ' |', '| Saved | ' || {_size('b')} || ' |',
                           '| Already shared | 0 |', '| Errors | 0 |', '| Time | 0.000s |') END AS text FROM s)
            SELECT to_json({{'text': text}})::VARCHAR AS payload FROM t""",
    }
