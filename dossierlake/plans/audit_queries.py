"""Audit queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import redaction, text
from dossierlake.functions.lexicon import SECRET_MARKERS
from dossierlake.operators import claims, evidence, histories, inventory, profile, search, trust
from dossierlake.plans.driver import BASE, CLAIMS, EVIDENCE, KEY, LOW, NUMBERS, PROSE, TELLING, TRIM, driver_assets, driver_corpus, sql_any
from dossierlake.sources import formats
from dossierlake.workspace import materialize, spread_table, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.extract_claims(driver_corpus(spark, sf_dir), driver_assets(spark, sf_dir), PROSE)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = materialize(_claims(spark, sf_dir), "claims")  # 120 a project at most, and read twice
    return evidence.match_evidence(stated, driver_assets(spark, sf_dir), driver_corpus(spark, sf_dir), PROSE)


@query(f"WITH {BASE}, {CLAIMS} SELECT project_id, claim_id, claim_text, claim_type, path, line_no::INT AS line_no, confidence FROM claims")
def audit_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).drop("initial_risk")


@query(f"WITH {BASE}, {CLAIMS}, {EVIDENCE} SELECT * FROM evidence")
def audit_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _evidence(spark, sf_dir)
    return found.select("project_id", "claim_id", "status", F.array_join("evidence_files", ",").alias("files"))


COVERAGE_SQL = """coverage AS (
  SELECT project_id, count(*) AS claims,
         sum(CASE status WHEN 'SUPPORTED' THEN 1.0::DOUBLE WHEN 'PARTIAL' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) * 100.0::DOUBLE / count(*) AS evidence_coverage
  FROM evidence GROUP BY project_id)"""


@query(f"WITH {BASE}, {CLAIMS}, {EVIDENCE}, {COVERAGE_SQL} SELECT * FROM coverage")
def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.coverage(_evidence(spark, sf_dir))


@query(f"""WITH {BASE} SELECT project_id, CASE WHEN sensitive THEN 'SECRET_RISK' WHEN "generated" THEN 'GENERATED' WHEN vendored THEN 'VENDORED' ELSE role END AS role, count(*) AS n FROM assets GROUP BY 1, 2""")
def asset_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("sensitive"), "SECRET_RISK").when(F.col("generated"), "GENERATED").when(F.col("vendored"), "VENDORED").otherwise(F.col("role"))
    return inventory.role_counts(driver_assets(spark, sf_dir).withColumn("role", role))


@query(
    f"""WITH {BASE} SELECT project_id, count(*) AS files, count(*) FILTER ("generated" OR vendored) AS foreign_files,
count(*) FILTER ("generated" OR vendored) / count(*)::DOUBLE AS ratio FROM assets GROUP BY 1"""
)
def generated_vendored_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("generated"), "GENERATED").when(F.col("vendored"), "VENDORED").otherwise(F.col("role"))
    found = inventory.generated_ratio(driver_assets(spark, sf_dir).withColumn("role", role))
    return found.select("project_id", "files", F.col("foreign").alias("foreign_files"), "ratio")


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select(host.alias("project_id"), path.alias("path"), "page_id", "html")
    return pages.where("path <> ''")


PAGES = r"""pages_of AS (
  SELECT * FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS project_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path, page_id, html FROM pages)
  WHERE path <> ''),
named AS (
  SELECT *, string_split(path, '/')[-1] AS file_name,
         lower(regexp_extract(string_split(path, '/')[-1], '^.+(\.[^.]*)$', 1)) AS extension FROM pages_of)"""


@query(f"WITH {PAGES} SELECT page_id, extension, CASE WHEN extension IN ('.html', '.htm') THEN 'text' ELSE 'unknown' END AS kind, CASE WHEN extension IN ('.html', '.htm') THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM named")
def extension_dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = formats.with_format(_page_paths(spark, sf_dir))
    return known.select("page_id", "extension", "kind", "mime")


@query(
    f"""WITH {PAGES} SELECT project_id, path, page_id, entry FROM (
SELECT project_id, path, page_id, row_number() OVER (PARTITION BY project_id ORDER BY path, page_id)::INT AS entry FROM pages_of) WHERE entry <= 3"""
)
def topk_entries_per_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _page_paths(spark, sf_dir).withColumn("place", F.struct("path", "page_id"))
    return histories.smallest_entries(pages, ["project_id"], "place", 3).select("project_id", "path", "page_id", "entry")


@query(f"SELECT doc_id, {sql_any(LOW.format('substr(text, 1, 32768)'), SECRET_MARKERS)} AS sensitive FROM documents WHERE text IS NOT NULL")
def sensitive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", inventory.is_sensitive(F.format_string("%010d.md", "doc_id"), F.col("text")).alias("sensitive"))


@query(f"SELECT doc_id, {sql_any(LOW.format('text'), SECRET_MARKERS)} AS sensitive FROM documents WHERE text IS NOT NULL")
def sensitive_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    name = F.format_string("%010d.md", "doc_id")
    return docs.select("doc_id", inventory.is_sensitive(name, F.col("text"), sample=None).alias("sensitive"))


@query(f"WITH {BASE} SELECT project_id, count(*) FILTER (status <> 'EXTRACTED_TEXT') AS review, count(*) FILTER (status = 'EXTRACTED_TEXT') AS reliable FROM corpus GROUP BY 1")
def text_status_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status")
    return driver_corpus(spark, sf_dir).groupBy("project_id").agg(
        F.count_if(trust.needs_review(status)).alias("review"), F.count_if(trust.reliable(status)).alias("reliable")
    )


SEARCH_LINES = f"""found AS (
  SELECT c.project_id, c.path, t.pos AS line_no, {TRIM.format("t.line")} AS line
  FROM corpus c JOIN assets a USING (project_id, path), unnest(string_split(c.text, chr(10))) WITH ORDINALITY AS t(line, pos)
  WHERE NOT a.sensitive AND contains({LOW.format("t.line")}, 'licen'))"""


@query(
    f"""WITH {BASE}, {SEARCH_LINES} SELECT project_id, path, line_no::INT AS line_no, CASE WHEN length(line) > 240 THEN substr(line, 1, 240) || '...' ELSE line END AS line
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY path, line_no) AS n FROM found) WHERE n <= 20"""
)
def line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_lines(driver_corpus(spark, sf_dir), driver_assets(spark, sf_dir), "Licen", matches=20)


@query(
    f"""WITH {BASE}, {SEARCH_LINES}, hits AS (SELECT project_id, path, count(*) AS n FROM found GROUP BY 1, 2)
SELECT a.project_id, count(*) FILTER (NOT a.sensitive) AS scanned, count(*) FILTER (a.sensitive) AS omitted,
       count(h.n) AS matched_files, coalesce(sum(h.n), 0)::BIGINT AS matched_lines
FROM assets a LEFT JOIN hits h USING (project_id, path) GROUP BY 1"""
)
def line_search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_totals(driver_corpus(spark, sf_dir), driver_assets(spark, sf_dir), "licen")


@query(f"SELECT doc_id, array_to_string({TELLING.format('n')}, ',') AS numbers FROM (SELECT doc_id, {NUMBERS.format('text')} AS n FROM documents)")
def number_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(text.telling_numbers(text.numbers_in(F.col("text"))), ",").alias("numbers"))


@query(
    f"""SELECT doc_id, len(w)::INT AS n_words, md5(array_to_string(w, ' ')) AS words FROM (
SELECT doc_id, list_filter(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda x: {LOW.format('x')}))),
  lambda x: x NOT IN ('the', 'and', 'for', 'with', 'from', 'this', 'that', 'tam', 'sam', 'som')) AS w FROM documents)"""
)
def latin_word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.latin_words(F.col("text"), evidence.STOP_WORDS)
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    return docs.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ").cast("binary")).alias("words"))


@query(f"SELECT item_id, {KEY.format('text')} AS key, strlen({KEY.format('text')})::INT AS bytes FROM benchmark")
def claim_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.claim_key(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", key.alias("key"), text.byte_length(key).alias("bytes"))


@query(
    """WITH words AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS w FROM benchmark),
docs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS w FROM documents)
SELECT item_id, doc_id, count(*) AS shared FROM words JOIN docs USING (w) GROUP BY 1, 2 HAVING count(*) >= 3"""
)
def evidence_pair_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and documents that share words, by an equi-join on the words and not a test of every pair."""
    words = lambda name, key: table(spark, sf_dir, name).select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), F.lit(1)))).alias("w"))
    shared = words("documents", "doc_id").join(words("benchmark", "item_id"), "w").groupBy("item_id", "doc_id").agg(F.count("w").alias("shared"))
    return shared.where("shared >= 3")


REDACT_SQL = "text"
for _pattern, _stays in redaction.PATTERNS:
    REDACT_SQL = f"regexp_replace({REDACT_SQL}, '{_pattern.replace(chr(39), chr(39) * 2).replace(chr(10), chr(92) + 'n')}', '{_stays.replace('$1', chr(92) + '1')}', 'g')"


@query(f"SELECT doc_id, md5({REDACT_SQL}) AS digest, contains({REDACT_SQL}, '[REDACTED]') AS hidden FROM documents")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = redaction.redact(F.col("text"))
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", clean.alias("clean"))
    return docs.select("doc_id", F.md5(F.col("clean").cast("binary")).alias("digest"), F.col("clean").contains("[REDACTED]").alias("hidden"))


@query("SELECT doc_id, CAST((strlen(text) - strlen(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents")
def occurrence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.occurrences(F.col("text"), "the").alias("n"))


@query(
    """WITH b AS (SELECT source, doc_id, least(strlen(text), 2000) AS bytes FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, coalesce(sum(bytes + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)
SELECT source AS project_id, doc_id, least(bytes, 20000 - used)::BIGINT AS kept FROM p WHERE used < 20000"""
)
def text_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.format_string("%012d", "doc_id").alias("path")
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("project_id"), path, "text")
    kept = profile.bounded_texts(docs, each=2000, total=20000)
    return kept.select("project_id", F.col("path").cast("long").alias("doc_id"), F.col("kept_bytes").cast("long").alias("kept"))


@query(
    """WITH RECURSIVE f AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
g AS (SELECT source, doc_id, n_chars, n, n_chars <= 30000 AS kept, CASE WHEN n_chars <= 30000 THEN n_chars ELSE 0 END AS used FROM f WHERE n = 1
  UNION ALL SELECT f.source, f.doc_id, f.n_chars, f.n, g.used + f.n_chars <= 30000, g.used + CASE WHEN g.used + f.n_chars <= 30000 THEN f.n_chars ELSE 0 END
  FROM g JOIN f ON f.source = g.source AND f.n = g.n + 1)
SELECT source, doc_id, n_chars, kept FROM g"""
)
def copy_budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return histories.greedy_budget(docs, "source", "doc_id", "n_chars", 30000)


@query(
    """WITH m AS (SELECT conv_id, turn, role, least(strlen(text), 200)::BIGINT AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back,
  role = 'system' AND sum((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 1 AS pinned FROM conversations),
o AS (SELECT *, max((pinned AND back > 3)::INT) OVER (PARTITION BY conv_id) AS outside FROM m),
k AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY conv_id ORDER BY pinned DESC, back ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM o WHERE pinned OR back <= 3 - outside)
SELECT conv_id, turn, role, least(bytes, 450 - used)::BIGINT AS kept_bytes FROM k WHERE least(bytes, 450 - used) > 0"""
)
def message_budget_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = histories.message_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"), most=3, each=200, total=450)
    return kept.select("conv_id", "turn", "role", "kept_bytes")


@query(
    """WITH c AS (SELECT user_id, event_id, ts, event_type, event_type IS DISTINCT FROM lag(event_type) OVER w OR lag(1) OVER w IS NULL AS changed
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(changed::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM i)
SELECT event_id, user_id, event_type, run::INT AS run, CASE WHEN run >= 3 THEN 'abort' WHEN run = 2 THEN 'reject' ELSE 'run' END AS verdict FROM r"""
)
def consecutive_duplicate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = histories.repeated_calls(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"])
    return calls.select("event_id", "user_id", "event_type", "run", "verdict")


@query(
    """SELECT conv_id, turn, role, back::INT AS back FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
FROM conversations WHERE role IN ('user', 'assistant')) WHERE back <= 2"""
)
def compact_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histories.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role", "back")


@query(
    """SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY 1) l
ON l.conv_id = c.conv_id AND c.turn < l.last"""
)
def rewind_last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histories.rewind(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")
