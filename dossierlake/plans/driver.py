"""The driver's tables as projects: sources are projects, documents their files; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions.lexicon import PROFILE_LABELS, ClaimType, Lexicon
from dossierlake.functions.text import first_match
from dossierlake.workspace import spread_table, table

#: Words that the invented prose has, in place of the default lexicon's.
PROSE = Lexicon(
    claim_types=(
        ClaimType("Revenue", ("token", "licen"), ("version", "="), True, ("FINANCIAL_PLAN", "PROOF_MATERIAL"), ("version", "token", "release"), ("PROOF_MATERIAL",), ("licen", "password", "mail"), ("orders", "ledger")),
        ClaimType("MarketScale", ("with", "para", "pour", "und"), (), True, ("MARKET_RESEARCH",), ("that", "los", "les", "der"), ("MARKET_RESEARCH",), ("mail", "token", "released"), ("report",)),
        ClaimType("SocialImpact", ("from", "una", "dans", "mit"), ("!!", "|"), True, ("SOCIAL_PRACTICE_PROOF",), ("this", "del", "des", "ein"), ("SOCIAL_PRACTICE_PROOF",), ("and",), ("list",)),
        ClaimType("Unknown", (), (), False, ("PROOF_MATERIAL",), (), (), (), ("source",)),
    ),
    negations=("rights reserved",),
    contradictions=("worthless", "scum", "trash", "pathetic"),
    profile_labels=dict.fromkeys(PROFILE_LABELS, ("zzqq",)) | {"target_user": ("und ", "le "), "solution": ("the ",), "business_model": ("la ",), "market_analysis": ("der ", "los "), "financial_projection": ("en ",), "technical_route": ("de ",)},
)
ROLES = ("PROJECT_DECLARATION", "BUSINESS_PLAN", "MARKET_RESEARCH", "FINANCIAL_PLAN", "PROOF_MATERIAL", "SOCIAL_PRACTICE_PROOF", "RESEARCH_PAPER")


def driver_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project_id"))
    marks = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(marks, "doc_id", "left").select("project_id", F.format_string("%010d.md", "doc_id").alias("path"), *_asset_marks())


def _asset_marks() -> list[Column]:
    """role and flags of a row with doc_id and toxic."""
    role = first_match([(F.col("doc_id") % len(ROLES) == i, r) for i, r in enumerate(ROLES)], "UNKNOWN")
    return [
        role.alias("role"),
        F.lit(True).alias("auditable"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("sensitive"),
        (F.col("doc_id") % 17 == 3).alias("generated"),
        (F.col("doc_id") % 19 == 5).alias("vendored"),
    ]


def _status() -> Column:
    """The status of a row with quality."""
    bad = F.coalesce("quality", F.lit(1)) == 0
    return F.when(bad, "NEED_REVIEW_TEXT_TRUNCATED").otherwise("EXTRACTED_TEXT").alias("status")


def driver_files(spark: SparkSession, sf_dir: str, read: DataFrame) -> DataFrame:
    """project_id, path, the columns of driver_assets and driver_statuses, of read texts (doc_id, text_size): one join for both."""
    marks = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return read.select("doc_id", "project_id", "path", "text_size").join(marks, "doc_id", "left").select("project_id", "path", *_asset_marks(), _status(), "text_size")


def driver_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project_id"), "text")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(marks, "doc_id", "left").select(
        "project_id",
        F.format_string("%010d.md", "doc_id").alias("path"),
        _status(),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def driver_texts(spark: SparkSession, sf_dir: str, *own: str) -> DataFrame:
    """project_id, path, text and ``own`` columns of documents: read as they lie, joined with nothing."""
    docs = spread_table(spark, sf_dir, "documents")
    return docs.select(*own, F.col("source").alias("project_id"), F.format_string("%010d.md", "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def driver_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, path, status, text_size: the corpus without its texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project_id"), F.octet_length(F.coalesce("text", F.lit(""))).alias("text_size"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select(
        "project_id",
        F.format_string("%010d.md", "doc_id").alias("path"),
        _status(),
        "text_size",
    )


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join([f"contains({column}, {sql_text(w)})" for w in words] or ["FALSE"]) + ")"


def sql_rows(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]::VARCHAR[]"
        return sql_text(v) if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
NUMBERS = "list_sort(list_distinct(list_transform(regexp_extract_all({0}, '[0-9]+(?:[,.][0-9]+)*'), lambda x: replace(x, ',', ''))))"
TELLING = "CASE WHEN len({0}) > 1 THEN list_filter({0}, lambda x: NOT regexp_matches(x, '^(19|20)[0-9]{{2}}$')) ELSE {0} END"
KEY = "regexp_replace(" + LOW.format(TRIM) + r", '[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g')"
ROLE_CASE = "CASE d.doc_id % 7 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROLES)) + " END"
BASE = f"""
assets AS (
  SELECT d.source AS project_id, lpad(CAST(d.doc_id AS VARCHAR), 10, '0') || '.md' AS path, {ROLE_CASE} AS role,
         coalesce(l.toxic, 0) = 1 AS sensitive, d.doc_id % 17 = 3 AS "generated", d.doc_id % 19 = 5 AS vendored
  FROM documents d LEFT JOIN labels l USING (doc_id)),
corpus AS (
  SELECT d.source AS project_id, lpad(CAST(d.doc_id AS VARCHAR), 10, '0') || '.md' AS path,
         CASE WHEN coalesce(l.quality, 1) = 0 THEN 'NEED_REVIEW_TEXT_TRUNCATED' ELSE 'EXTRACTED_TEXT' END AS status,
         coalesce(d.text, '') AS text
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def sql_claim_type(line: str, lexicon: Lexicon = PROSE) -> str:
    cases = [f"WHEN {sql_any(line, lexicon.negations)} THEN NULL"]
    for k in lexicon.claim_types:
        if k.topics:
            signs = sql_any(line, k.signs) if "" not in k.signs else "TRUE"
            if k.digit:
                signs = f"({signs} OR regexp_matches({line}, '[0-9]'))"
            cases.append(f"WHEN {sql_any(line, k.topics)} AND {signs} THEN '{k.name}'")
    return "CASE " + " ".join(cases) + " END"


CLAIMS = f"""
lines AS (
  SELECT c.project_id, c.path, a.role, t.pos - 1 AS line_no, {TRIM.format("t.line")} AS line
  FROM corpus c JOIN assets a USING (project_id, path),
       unnest(string_split(c.text, chr(10))) WITH ORDINALITY AS t(line, pos)
  WHERE c.status = 'EXTRACTED_TEXT' AND NOT a.sensitive AND NOT a."generated" AND NOT a.vendored
    AND a.role IN ('PROJECT_DECLARATION', 'BUSINESS_PLAN', 'MARKET_RESEARCH', 'FINANCIAL_PLAN', 'SOCIAL_PRACTICE_PROOF', 'RESEARCH_PAPER')),
typed AS (
  SELECT *, {sql_claim_type(LOW.format("line"))} AS claim_type, {KEY.format("line")} AS key
  FROM lines WHERE strlen(line) BETWEEN 6 AND 360),
firsts AS (
  SELECT project_id, claim_type, key, min({{'path': path, 'line_no': line_no, 'line': line, 'role': role}}) AS f
  FROM typed WHERE claim_type IS NOT NULL AND strlen(key) + 2 >= 8 GROUP BY project_id, claim_type, key),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY f.path, f.line_no) AS n FROM firsts),
claims AS (
  SELECT project_id, 'CLM-' || lpad(CAST(n AS VARCHAR), 3, '0') AS claim_id, f.line AS claim_text, claim_type,
         f.path AS path, f.line_no AS line_no,
         CASE WHEN f.role IN ('PROJECT_DECLARATION', 'BUSINESS_PLAN') THEN 0.84::DOUBLE WHEN f.role = 'RESEARCH_PAPER' THEN 0.82::DOUBLE ELSE 0.76::DOUBLE END AS confidence
  FROM numbered WHERE n <= 120)"""
#: The same of all claims; their numbers may have more than three digits.
ALL_CLAIMS = CLAIMS.replace("lpad(CAST(n AS VARCHAR), 3, '0')", "printf('%03d', n)").replace(" WHERE n <= 120", "")
CANDIDATES = "candidates(claim_type, role, proves) AS (VALUES " + sql_rows([(k.name, r, r in k.proof_roles) for k in PROSE.claim_types for r in k.roles]) + ")"


def _marked(column: str, attribute: str) -> str:
    cases = " ".join(f"WHEN '{k.name}' THEN {sql_any(column, getattr(k, attribute))}" for k in PROSE.claim_types)
    return f"(CASE p.claim_type {cases} END)"


EVIDENCE = f"""
{CANDIDATES},
features AS (
  SELECT project_id, path, status, {LOW.format("text")} AS low, {TELLING.format("nums")} AS doc_numbers
  FROM (SELECT *, {NUMBERS.format("text")} AS nums FROM corpus)),
asking AS (
  SELECT project_id, claim_id, claim_type, path AS source, {TELLING.format("nums")} AS numbers
  FROM (SELECT *, {NUMBERS.format("claim_text")} AS nums FROM claims)),
paired AS (
  SELECT c.*, k.proves, a.path, f.status, f.low, f.doc_numbers
  FROM asking c JOIN candidates k USING (claim_type)
  JOIN assets a ON a.project_id = c.project_id AND a.role = k.role AND NOT a.sensitive AND NOT a."generated" AND NOT a.vendored
  LEFT JOIN features f ON f.project_id = a.project_id AND f.path = a.path),
tested AS (
  SELECT *, list_has_any(numbers, doc_numbers) AS shared, {_marked("p.low", "markers")} AS marked,
         {_marked("p.low", "proof_words")} AS proof, {sql_any("p.low", PROSE.contradictions)} AS denies
  FROM paired p),
judged AS (
  SELECT project_id, claim_id, path,
         CASE WHEN status IS NULL OR status <> 'EXTRACTED_TEXT' THEN 'review'
              WHEN marked AND denies AND (len(numbers) = 0 OR shared) THEN 'conflict'
              WHEN marked AND (len(numbers) = 0 OR shared) THEN 'relevant' END AS outcome,
         proves AND path <> source AND proof AND shared AS strong
  FROM tested),
found AS (
  SELECT project_id, claim_id,
         list_sort(list(path) FILTER (outcome = 'conflict')) AS conflicts,
         list_sort(list(path) FILTER (outcome = 'relevant')) AS relevant,
         list_sort(list(path) FILTER (outcome = 'review')) AS review,
         bool_or(outcome = 'relevant' AND strong) AS supported
  FROM judged WHERE outcome IS NOT NULL GROUP BY project_id, claim_id),
evidence AS (
  SELECT c.project_id, c.claim_id,
         CASE WHEN len(conflicts) > 0 THEN 'CONFLICTED' WHEN supported THEN 'SUPPORTED' WHEN len(relevant) > 0 THEN 'PARTIAL'
              WHEN len(review) > 0 THEN 'NEED_REVIEW' ELSE 'UNSUPPORTED' END AS status,
         array_to_string(coalesce(CASE WHEN len(conflicts) > 0 THEN conflicts[1:24]
              WHEN len(relevant) > 0 THEN relevant[1:24] WHEN len(review) > 0 THEN review[1:24] END, []), ',') AS files
  FROM claims c LEFT JOIN found f USING (project_id, claim_id))"""

