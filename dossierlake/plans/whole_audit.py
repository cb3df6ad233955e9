"""The whole audit over the driver's tables, from files to score, tasks and reports, and each stage in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions.lexicon import DIMENSIONS, PROFILE_LABELS
from dossierlake.operators import diff, report, search
from dossierlake.operators.profile import AFTER_LABEL, EMPTY_WORDS
from dossierlake.operators.rules import DEFAULT_PACKS, KEY_ROLES, TEXT_REVIEW, parse_pack
from dossierlake.operators.scoring import CLAIMS as CLAIMS_DIMENSION
from dossierlake.plans import reaudit
from dossierlake.plans.audit import AuditFrames, AuditOptions
from dossierlake.plans.driver import ALL_CLAIMS, BASE, CLAIMS, EVIDENCE, LOW, PROSE, TRIM, driver_assets, driver_files, driver_texts, sql_any, sql_rows, sql_text
from dossierlake.plans.fixture_queries import findings_sql
from dossierlake.workspace import materialize

QUERIES, ORACLE_SQL = {}, {}
TRACK = "ComprehensiveInnovation"
PACK = parse_pack(DEFAULT_PACKS)


def query(sql: str):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _with_flagged_roles(assets: DataFrame) -> DataFrame:
    role = F.when(F.col("sensitive"), "SECRET_RISK").when(F.col("generated"), "GENERATED").when(F.col("vendored"), "VENDORED")
    return assets.withColumn("role", role.otherwise(F.col("role")))


def driver_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's assets with the role that their flags ask for."""
    return _with_flagged_roles(driver_assets(spark, sf_dir))


def driver_audit(spark: SparkSession, sf_dir: str) -> AuditFrames:
    """From facts by file, so that texts are read once, as they lie, for all that the audit takes from them."""
    return _driver_audit(spark, sf_dir, AuditOptions(lexicon=PROSE, track=TRACK))


def whole_driver_audit(spark: SparkSession, sf_dir: str) -> AuditFrames:
    """driver_audit of all claims that projects have, not only of each one's first."""
    return _driver_audit(spark, sf_dir, AuditOptions(lexicon=PROSE, track=TRACK, most_claims=None))


def _driver_audit(spark: SparkSession, sf_dir: str, options: AuditOptions) -> AuditFrames:
    read = materialize(reaudit.read_texts(driver_texts(spark, sf_dir, "doc_id"), PROSE, "doc_id"), "read")
    files = materialize(_with_flagged_roles(driver_files(spark, sf_dir, read)), "files")  # small rows that every stage reads
    corpus = files.select("project_id", "path", "status", "text_size")
    facts = reaudit.facts_of_read(read.drop("doc_id"), corpus, PROSE)
    return reaudit.FactAudit(files.drop("status", "text_size"), facts, options, corpus=corpus)


_LABELS = [(field, label) for field, labels in PROSE.profile_labels.items() for label in labels]
_MARKED = " OR ".join(f"starts_with(rest, {sql_text(m)})" for m in AFTER_LABEL)
PROFILE = f"""
inventory AS (
  SELECT * REPLACE (CASE WHEN sensitive THEN 'SECRET_RISK' WHEN "generated" THEN 'GENERATED' WHEN vendored THEN 'VENDORED' ELSE role END AS role) FROM assets),
labels(field, label) AS (VALUES {sql_rows(_LABELS)}),
profile_lines AS (
  SELECT c.project_id, c.path, t.pos - 1 AS line_no, {TRIM.format("t.line")} AS head,
         {TRIM.format("regexp_replace(" + TRIM.format("t.line") + ", '^[" + chr(92) + "s#*>-]+', '')")} AS line
  FROM corpus c JOIN assets a USING (project_id, path), unnest(string_split(c.text, chr(10))) WITH ORDINALITY AS t(line, pos)
  WHERE c.status = 'EXTRACTED_TEXT' AND NOT a.sensitive AND NOT a."generated" AND NOT a.vendored
    AND a.role IN ({", ".join(map(sql_text, PROSE.narrative_roles))})),
labelled AS (
  SELECT *, {TRIM.format("substr(line, place + length(label))")} AS rest, strlen(substr(line, 1, place - 1)) AS ahead
  FROM (SELECT *, instr({LOW.format("line")}, label) AS place FROM profile_lines CROSS JOIN labels
        WHERE strlen(line) BETWEEN 4 AND 300 AND NOT {sql_any(LOW.format("line"), EMPTY_WORDS)}) WHERE place > 0),
fields AS (
  SELECT project_id, field, line FROM labelled WHERE ahead <= 12 AND rest <> '' AND (ahead = 0 OR {_MARKED})
  QUALIFY row_number() OVER (PARTITION BY project_id, field ORDER BY path, line_no) = 1),
titles AS (
  SELECT project_id, trim(substr(head, 3)) AS title FROM profile_lines
  WHERE starts_with(head, '# ') AND strlen(head) > 2 AND strlen(head) <= 120
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY path, line_no) = 1),
names AS (
  SELECT project_id, coalesce(min(replace(path, '.md', '')) FILTER (role IN ('PROJECT_DECLARATION', 'BUSINESS_PLAN', 'PITCH_DECK')), '未命名项目') AS name
  FROM inventory GROUP BY project_id),
profiles AS (
  SELECT n.project_id, CASE WHEN coalesce(t.title, '') <> '' THEN t.title ELSE n.name END AS project_name, coalesce(f.filled, []) AS filled
  FROM names n LEFT JOIN titles t USING (project_id)
  LEFT JOIN (SELECT project_id, list(field) AS filled FROM fields GROUP BY project_id) f USING (project_id))"""

ISSUES = """
role_sets AS (SELECT project_id, list(DISTINCT role) AS roles FROM inventory GROUP BY project_id),
stated AS (SELECT p.project_id, r.roles, list_contains(p.filled, 'market_analysis') AS market, list_contains(p.filled, 'target_user') AS target,
             EXISTS (SELECT 1 FROM claims c WHERE c.project_id = p.project_id AND c.claim_type = 'Revenue') AS revenue
           FROM profiles p JOIN role_sets r USING (project_id)),
open_issues AS (
  SELECT project_id, 0 AS seq, 'CONSISTENCY_SOFT_001' AS issue_id, 'SOURCE_CODE' AS role FROM stated
  WHERE list_contains(roles, 'SOURCE_CODE') AND NOT list_contains(roles, 'BUILD_SYSTEM') AND NOT list_contains(roles, 'DEPENDENCY_MANIFEST')
  UNION ALL SELECT project_id, 1, 'CONSISTENCY_BIZ_001', 'FINANCIAL_PLAN' FROM stated WHERE list_contains(roles, 'FINANCIAL_PLAN') AND NOT list_contains(roles, 'BUSINESS_PLAN')
  UNION ALL SELECT project_id, 2, 'CONSISTENCY_MARKET_001', 'MARKET_RESEARCH' FROM stated WHERE market AND NOT target
  UNION ALL SELECT project_id, 3, 'CONSISTENCY_REVENUE_001', NULL FROM stated WHERE revenue AND NOT list_contains(roles, 'FINANCIAL_PLAN') AND NOT list_contains(roles, 'PROOF_MATERIAL')),
issues AS (
  SELECT i.project_id, i.seq, i.issue_id,
         coalesce((SELECT string_agg(a.path, ',' ORDER BY a.path) FROM inventory a WHERE a.project_id = i.project_id AND a.role = i.role), '') AS files
  FROM open_issues i)"""

_TRUNCATED = next(row for row in TEXT_REVIEW if row[0] == "TRUNCATED")
_PACK_ROWS = sql_rows([(r.rule_id, r.name, r.fail_reason or r.description, r.fix_task) for r in PACK])
FINDINGS = f"""
type_sets AS (
  SELECT c.project_id, list(DISTINCT claim_type) AS claimed, list(DISTINCT claim_type) FILTER (status = 'SUPPORTED') AS proved,
         list(DISTINCT claim_type) FILTER (status <> 'SUPPORTED') AS unproved
  FROM claims c JOIN evidence e USING (project_id, claim_id) GROUP BY c.project_id),
facts AS (
  SELECT p.project_id, '{TRACK}' AS type, r.roles, n.assets, n.foreign_files, coalesce(i.issues, 0) AS issues, p.filled,
         coalesce(t.claimed, []) AS claimed, coalesce(t.proved, []) AS proved, coalesce(t.unproved, []) AS unproved
  FROM profiles p JOIN role_sets r USING (project_id)
  JOIN (SELECT project_id, count(*) AS assets, count(*) FILTER (role IN ('GENERATED', 'VENDORED')) AS foreign_files FROM inventory GROUP BY project_id) n USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) AS issues FROM issues GROUP BY project_id) i USING (project_id)
  LEFT JOIN type_sets t USING (project_id)),
{findings_sql("facts", "inventory")},
told(rule_id, title, reason, fix) AS (VALUES {_PACK_ROWS}),
unread AS (
  SELECT c.project_id, c.path, a.role, row_number() OVER (PARTITION BY c.project_id ORDER BY c.path) AS n
  FROM corpus c JOIN assets a USING (project_id, path)
  WHERE c.status <> 'EXTRACTED_TEXT' AND NOT a.sensitive AND NOT a."generated" AND NOT a.vendored),
findings AS (
  SELECT project_id, seq, rule_id, severity, missing, files, title, reason, fix FROM rule_findings JOIN told USING (rule_id)
  UNION ALL
  SELECT project_id, n + {len(PACK)} - 1, 'TEXT_EXTRACTION_REVIEW_' || n,
         CASE WHEN role IN ({", ".join(map(sql_text, KEY_ROLES))}) THEN 'BLOCKER' ELSE 'WARNING' END, '可完整读取的文本', path, '文本完整性复核',
         path || {sql_text(_TRUNCATED[1])}, {sql_text(_TRUNCATED[2])} FROM unread)"""

_CAPS = " ".join(f"WHEN {sql_text(d)} THEN {c}" for d, c in DIMENSIONS.items())
PENALTIES = f"""
entries AS (
  SELECT project_id, 0 AS part, seq, rule_id, CASE severity WHEN 'BLOCKER' THEN 10 WHEN 'WARNING' THEN 5 ELSE 2 END AS points,
         CASE WHEN contains(lower(rule_id), 'secret') THEN '成果真实性' WHEN contains(lower(rule_id), 'generated') OR contains(lower(rule_id), 'vendor') THEN '技术/商业/科研可行性'
              WHEN regexp_matches(lower(rule_id), '^(biz|soft|res|soc|ecom|ai|eng)_') THEN '赛道规则匹配度'
              WHEN contains(lower(rule_id), 'consistency') THEN '项目逻辑自洽性' ELSE '材料完整性' END AS dimension
  FROM findings WHERE rule_id <> 'COMMON_CONSISTENCY_001'
  UNION ALL
  SELECT project_id, 1, CAST(regexp_extract(claim_id, '([0-9]+)$', 1) AS BIGINT), 'EVIDENCE_' || claim_id,
         CASE status WHEN 'SUPPORTED' THEN 0 WHEN 'PARTIAL' THEN 2 WHEN 'NEED_REVIEW' THEN 2 WHEN 'UNSUPPORTED' THEN 4 ELSE 5 END, '声明-证据匹配度' FROM evidence
  UNION ALL SELECT project_id, 2, seq, issue_id, 5, '项目逻辑自洽性' FROM issues
  UNION ALL
  SELECT project_id, 3, 0, 'COMMON_GENERATED_RATIO_001', 5, '技术/商业/科研可行性' FROM facts f
  WHERE foreign_files / assets > 0.4 AND NOT EXISTS (SELECT 1 FROM findings x WHERE x.project_id = f.project_id AND x.rule_id = 'COMMON_GENERATED_RATIO_001')),
running AS (
  SELECT *, coalesce(sum(points) OVER (PARTITION BY project_id, dimension ORDER BY part, seq, rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM entries WHERE points > 0),
penalties AS (
  SELECT project_id, rule_id, points, dimension, least(points, greatest(CASE dimension {_CAPS} END - before, 0))::BIGINT AS actual FROM running),
scores AS (
  SELECT p.project_id, (100 - coalesce(sum(actual), 0))::BIGINT AS total_score, coalesce(sum(actual), 0)::BIGINT AS trust_debt,
         (20 - coalesce(sum(actual) FILTER (dimension = '声明-证据匹配度'), 0))::BIGINT AS evidence_left,
         (15 - coalesce(sum(actual) FILTER (dimension = '材料完整性'), 0))::BIGINT AS material_left,
         (15 - coalesce(sum(actual) FILTER (dimension = '项目逻辑自洽性'), 0))::BIGINT AS logic_left
  FROM (SELECT DISTINCT project_id FROM assets) p LEFT JOIN penalties USING (project_id) GROUP BY p.project_id)"""

TASKS = """
candidates_all AS (
  SELECT project_id, 0 AS part, seq, fix AS title, CASE severity WHEN 'BLOCKER' THEN 'P0' WHEN 'WARNING' THEN 'P1' ELSE 'P2' END AS priority,
         CASE WHEN missing = '' THEN lower(trim(fix)) ELSE replace(lower(missing), ',', '|') END AS key, rule_id FROM findings
  UNION ALL
  SELECT e.project_id, 1, CAST(regexp_extract(claim_id, '([0-9]+)$', 1) AS BIGINT), '为声明 ' || claim_id || ' 补充独立证据',
         CASE WHEN status IN ('UNSUPPORTED', 'CONFLICTED') THEN 'P0' ELSE 'P1' END,
         CASE claim_type WHEN 'Revenue' THEN 'ledger|orders' WHEN 'MarketScale' THEN 'report' ELSE 'list' END, 'EVIDENCE_' || claim_id
  FROM evidence e JOIN claims c USING (project_id, claim_id) WHERE status <> 'SUPPORTED'),
grouped AS (
  SELECT project_id, key, min({'part': part, 'seq': seq}) AS place, min(priority) AS priority,
         count(*) FILTER (starts_with(rule_id, 'EVIDENCE_')) AS proofs, string_agg(rule_id, ',' ORDER BY part, seq) AS rules,
         list(title ORDER BY part, seq)[1] AS first FROM candidates_all GROUP BY project_id, key),
tasks AS (
  SELECT project_id, 'FIX-' || lpad(CAST(row_number() OVER (PARTITION BY project_id ORDER BY priority, place) AS VARCHAR), 3, '0') AS task_id,
         CASE WHEN proofs > 1 THEN '为 ' || proofs || ' 条声明补充同类独立证据' ELSE first END AS title, priority, rules FROM grouped)"""

COVERED = """
covered AS (
  SELECT project_id, sum(CASE status WHEN 'SUPPORTED' THEN 1.0::DOUBLE WHEN 'PARTIAL' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) * 100.0::DOUBLE / count(*) AS coverage
  FROM evidence GROUP BY project_id),
metrics AS (
  SELECT s.*, coalesce(f.rule_blockers, 0) AS rule_blockers, coalesce(f.rule_warnings, 0) AS rule_warnings, coalesce(t.p0, 0) AS p0, coalesce(t.p1, 0) AS p1,
         coalesce(t.n, 0) AS fix_tasks, coalesce(c.coverage, 0.0::DOUBLE) AS coverage
  FROM scores s
  LEFT JOIN (SELECT project_id, count(*) FILTER (severity = 'BLOCKER') AS rule_blockers, count(*) FILTER (severity = 'WARNING') AS rule_warnings FROM findings GROUP BY 1) f USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) FILTER (priority = 'P0') AS p0, count(*) FILTER (priority = 'P1') AS p1, count(*) AS n FROM tasks GROUP BY 1) t USING (project_id)
  LEFT JOIN covered c USING (project_id))"""

#: Each stage of the audit over the one before.
STAGES = (BASE, CLAIMS, EVIDENCE, PROFILE, ISSUES, FINDINGS, PENALTIES, TASKS, COVERED)


def whole(upto: str, select: str) -> str:
    return "WITH " + ",".join(STAGES[: STAGES.index(upto) + 1]) + " " + select


@query(whole(PROFILE, "SELECT project_id, project_name, array_to_string(list_sort(filled), ',') AS filled FROM profiles"))
def audit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.array_compact(F.array(*[F.when(F.col(f) != "", F.lit(f)) for f in PROFILE_LABELS]))
    return driver_audit(spark, sf_dir).profile.select("project_id", "project_name", F.array_join(F.array_sort(filled), ",").alias("filled"))


@query(whole(ISSUES, "SELECT project_id, issue_id, md5(files) AS files FROM issues"))
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.md5(F.array_join("affected_files", ",").cast("binary"))
    return driver_audit(spark, sf_dir).issues.select("project_id", "issue_id", files.alias("files"))


@query(whole(FINDINGS, "SELECT project_id, seq::BIGINT AS seq, rule_id, severity, missing, md5(files) AS files, title, reason, fix FROM findings"))
def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_audit(spark, sf_dir).checked_findings().select(
        "project_id",
        F.col("seq").cast("long").alias("seq"),
        "rule_id",
        "severity",
        F.array_join("missing_evidence", ",").alias("missing"),
        F.md5(F.array_join("evidence", ",").cast("binary")).alias("files"),
        "title",
        "reason",
        F.col("fix_suggestion").alias("fix"),
    )


@query(whole(PENALTIES, "SELECT project_id, rule_id, points::BIGINT AS points, dimension, actual FROM penalties"))
def audit_penalty_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_audit(spark, sf_dir).penalties.select("project_id", "rule_id", "points", "dimension", "actual")


@query(whole(PENALTIES, "SELECT project_id, total_score, trust_debt, evidence_left FROM scores"))
def audit_trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = driver_audit(spark, sf_dir).checked()
    return scores.select("project_id", "total_score", "trust_debt", F.col("dimensions")[CLAIMS_DIMENSION].alias("evidence_left"))


@query(whole(TASKS, "SELECT project_id, task_id, title, priority, rules FROM tasks"))
def audit_fix_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = driver_audit(spark, sf_dir).tasks
    return tasks.select("project_id", "task_id", "title", "priority", F.array_join("affected_rules", ",").alias("rules"))


@query(whole(COVERED, "SELECT project_id, total_score AS score, trust_debt, greatest(rule_blockers, p0) AS blockers, greatest(rule_warnings, p1) AS warnings, coverage AS evidence_coverage, material_left AS material_completeness, logic_left AS consistency_score, fix_tasks AS fix_task_count FROM metrics"))
def audit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_audit(spark, sf_dir).metrics.where(diff.valid_metrics())


_SUMMARY = """SELECT m.project_id, p.project_name, a.n AS asset_count, m.total_score, m.rule_blockers AS rule_blocker_count, m.p1 AS p1_task_count,
  coalesce(r.n, 0) AS review_document_count, coverage AS evidence_coverage, fix_tasks AS fix_task_count
FROM metrics m JOIN profiles p USING (project_id) JOIN (SELECT project_id, count(*) AS n FROM assets GROUP BY 1) a USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM corpus WHERE status <> 'EXTRACTED_TEXT' GROUP BY 1) r USING (project_id)"""


@query(whole(COVERED, _SUMMARY))
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package's summary, read back from its JSON."""
    parts = driver_audit(spark, sf_dir).parts.where("section = 'summary'")
    value = lambda name, kind: F.get_json_object("json", f"$.{name}").cast(kind).alias(name)
    counts = ("asset_count", "total_score", "rule_blocker_count", "p1_task_count", "review_document_count", "fix_task_count")
    return parts.select("project_id", value("project_name", "string"), value("evidence_coverage", "double"), *[value(c, "long") for c in counts])


_SECTIONS = """SELECT project_id, 'inventory' AS section, count(*) AS n, min(path) AS first, max(path) AS last FROM inventory GROUP BY 1
UNION ALL SELECT project_id, 'text_corpus', count(*), min(path), max(path) FROM corpus GROUP BY 1
UNION ALL SELECT project_id, 'claims', count(*), min(claim_id), max(claim_id) FROM claims GROUP BY 1
UNION ALL SELECT project_id, 'evidence_matches', count(*), min(claim_id), max(claim_id) FROM evidence GROUP BY 1
UNION ALL SELECT project_id, 'consistency_issues', count(*), min(issue_id), max(issue_id) FROM issues GROUP BY 1
UNION ALL SELECT project_id, 'findings', count(*), min(rule_id), max(rule_id) FROM findings GROUP BY 1
UNION ALL SELECT project_id, 'fix_tasks', count(*), min(task_id), max(task_id) FROM tasks GROUP BY 1
UNION ALL SELECT project_id, 'penalties', count(*), min(rule_id), max(rule_id) FROM penalties WHERE actual > 0 GROUP BY 1
UNION ALL SELECT project_id, s, 1, NULL, NULL FROM profiles, (VALUES ('summary'), ('cpir'), ('trust_score'), ('context'), ('role_counts')) AS t(s)
UNION ALL SELECT project_id, 'repair_plan', 1, NULL, NULL FROM (SELECT DISTINCT project_id FROM tasks)"""


@query(whole(COVERED, _SECTIONS))
def audit_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit package by sections: how many items each has, and the first and last of their keys."""
    key = F.coalesce(*[F.get_json_object("json", f"$.{k}") for k in ("task_id", "issue_id", "rule_id", "claim_id", "path", "source_file")])
    parts = driver_audit(spark, sf_dir).parts
    return parts.groupBy("project_id", "section").agg(F.count("json").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))


_MARKDOWN = """SELECT p.project_id, md5(concat_ws(chr(10), '# 竞赛项目可信审计报告', '- 项目名称：' || p.project_name, '- 竞赛类型：ComprehensiveInnovation',
  '- 可信评分：' || s.total_score || '/100', '- 可信债务：' || s.trust_debt, '## 声明与证据', coalesce(c.lines, ''), '## 规则发现', coalesce(f.lines, ''), '## 修改任务', coalesce(t.lines, ''))) AS digest
FROM profiles p JOIN scores s USING (project_id)
LEFT JOIN (SELECT project_id, string_agg('- ' || claim_id || '（' || status || '）' || claim_text, chr(10) ORDER BY claim_id) AS lines FROM claims JOIN evidence USING (project_id, claim_id) GROUP BY 1) c USING (project_id)
LEFT JOIN (SELECT project_id, string_agg('- [' || severity || '] ' || title || '：' || reason, chr(10) ORDER BY seq) AS lines FROM findings GROUP BY 1) f USING (project_id)
LEFT JOIN (SELECT project_id, string_agg('- ' || task_id || ' [' || priority || '] ' || title, chr(10) ORDER BY task_id) AS lines FROM tasks GROUP BY 1) t USING (project_id)"""


@query(whole(COVERED, _MARKDOWN))
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = driver_audit(spark, sf_dir).markdown
    return found.select("project_id", F.md5(F.col("markdown").cast("binary")).alias("digest"))


_PLAN = """SELECT project_id, md5(string_agg('- [' || priority || '] ' || task_id || ' ' || title, chr(10) ORDER BY task_id)) AS listed,
  md5('--- /dev/null' || chr(10) || '+++ b/REPAIR_PLAN.md' || chr(10) || '@@ -0,0 +1,' || count(*) || ' @@' || chr(10)
      || string_agg('+- [' || priority || '] ' || task_id || ' ' || title, chr(10) ORDER BY task_id) || chr(10)) AS patch FROM tasks GROUP BY project_id"""


@query(whole(TASKS, _PLAN).replace(CLAIMS, ALL_CLAIMS))
def audit_repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for all claims of each project."""
    plan = whole_driver_audit(spark, sf_dir).plan
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return plan.select("project_id", digest("markdown").alias("listed"), digest("diff_text").alias("patch"))


_TOP = """top AS (SELECT project_id, seq, rule_id, severity, row_number() OVER (PARTITION BY project_id
  ORDER BY CASE severity WHEN 'BLOCKER' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, seq) AS n FROM findings),
shown AS (SELECT * FROM top WHERE n <= 6),
extra AS (
  SELECT t.project_id, t.task_id, row_number() OVER (PARTITION BY t.project_id ORDER BY t.task_id) AS n FROM tasks t
  WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.project_id = t.project_id AND list_contains(string_split(t.rules, ','), s.rule_id)))"""


@query(
    whole(COVERED, "").rstrip()
    + f", {_TOP} SELECT project_id, 'finding' AS kind, rule_id AS item FROM shown UNION ALL SELECT project_id, 'issue', issue_id FROM issues WHERE seq < 3"
    " UNION ALL SELECT project_id, 'task', task_id FROM extra WHERE n <= 3"
)
def audit_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summary shows of each project: 6 findings, 3 issues, and 3 tasks that no shown finding stands for."""
    audit = driver_audit(spark, sf_dir)
    shown = search.top_findings(audit.findings, 6)
    extra = search.uncovered_tasks(audit.tasks, shown, 3)
    return (
        shown.select("project_id", F.lit("finding").alias("kind"), F.col("rule_id").alias("item"))
        .unionByName(search.first_issues(audit.issues, 3).select("project_id", F.lit("issue").alias("kind"), F.col("issue_id").alias("item")))
        .unionByName(extra.select("project_id", F.lit("task").alias("kind"), F.col("task_id").alias("item")))
    )


def package_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole packages as JSON documents, for the tests of reading them back."""
    return report.package_documents(driver_audit(spark, sf_dir).parts)
