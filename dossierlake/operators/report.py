"""Reports: an audit package in JSON, by sections or as one document a project, and a Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.operators.evidence import coverage
from dossierlake.operators.scoring import LOGIC, MATERIAL


SCHEMA_VERSION = 2
#: Sections of a package that hold one object a project; the others hold a list.
SINGLE_SECTIONS = ("summary", "context", "role_counts", "cpir", "trust_score", "repair_plan", "audit_diff")
SECTIONS = ("summary", "context", "role_counts", "inventory", "text_corpus", "cpir", "claims", "evidence_matches", "consistency_issues", "findings", "penalties", "trust_score", "fix_tasks", "repair_plan", "audit_diff")


def _part(rows: DataFrame, section: str, seq: Column, columns: dict[str, str | Column]) -> DataFrame:
    """project_id, section, seq, json: one JSON object a row, its columns under the package's names."""
    body = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items() if not isinstance(c, str) or c in rows.columns])
    return rows.select("project_id", F.lit(section).alias("section"), seq.cast("string").alias("seq"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def _same(*names: str) -> dict[str, str | Column]:
    return {n: n for n in names}


def summary_rows(profile: DataFrame, assets: DataFrame, corpus: DataFrame, scores: DataFrame, findings: DataFrame, evidence: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row a project: what a package says of it first."""
    files = assets.groupBy("project_id").agg(F.count("path").alias("asset_count"))
    unread = corpus.groupBy("project_id").agg(F.count_if(F.col("status").startswith("NEED_REVIEW") | (F.col("status") == "EMPTY_OR_UNREADABLE")).alias("review_document_count"))
    found = findings.groupBy("project_id").agg(
        F.count_if(F.col("severity") == "BLOCKER").alias("rule_blocker_count"), F.count_if(F.col("severity") == "WARNING").alias("rule_warning_count")
    )
    todo = tasks.groupBy("project_id").agg(
        F.count_if(F.col("priority") == "P0").alias("p0_task_count"), F.count_if(F.col("priority") == "P1").alias("p1_task_count"), F.count("task_id").alias("fix_task_count")
    )
    wide = profile.select("project_id", "project_name", "type").join(scores, "project_id")
    for other in (files, unread, found, todo, coverage(evidence).drop("claims")):
        wide = wide.join(other, "project_id", "left")
    wide = wide.fillna(0)
    return wide.withColumns(
        {
            "blocker_count": F.greatest("rule_blocker_count", "p0_task_count"),
            "warning_count": F.greatest("rule_warning_count", "p1_task_count"),
            "material_completeness": F.coalesce(F.col("dimensions")[MATERIAL], F.lit(0)),
            "consistency_score": F.coalesce(F.col("dimensions")[LOGIC], F.lit(0)),
        }
    )


def package_parts(
    summary: DataFrame,
    assets: DataFrame,
    corpus: DataFrame,
    profile: DataFrame,
    claims: DataFrame,
    evidence: DataFrame,
    issues: DataFrame,
    findings: DataFrame,
    scores: DataFrame,
    penalties: DataFrame,
    tasks: DataFrame,
    plan: DataFrame,
    diff: DataFrame | None = None,
    deferred: DataFrame | None = None,
) -> DataFrame:
    """project_id, section, seq, json: the audit package, one row for each item of each section.

    Nothing is gathered into one row here, however many files a project has. Columns that a table doesn't have (such as
    mime where assets come without formats) are left out of its items.
    """
    counts = F.map_from_entries(F.collect_list(F.struct("role", "n")))
    roles = assets.groupBy("project_id", "role").agg(F.count("path").alias("n")).groupBy("project_id").agg(counts.alias("role_counts"))
    context = profile.select("project_id", F.col("project_name"))
    if deferred is not None:
        late = deferred.groupBy("project_id", "reason").agg(F.count("path").alias("n"))
        late = late.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("deferred_files"))
        context = context.join(late, "project_id", "left")
    one = F.lit("")
    taken = penalties.where("actual > 0")
    parts = [
        _part(summary, "summary", one, {"project_name": "project_name", "competition_type": "type"} | _same("asset_count", "total_score", "trust_debt", "blocker_count", "warning_count", "rule_blocker_count", "rule_warning_count", "p0_task_count", "p1_task_count", "review_document_count", "evidence_coverage", "material_completeness", "consistency_score", "fix_task_count")),
        _part(context, "context", one, _same("project_name", "deferred_files")),
        _part(roles, "role_counts", one, _same("role_counts")),
        _part(assets, "inventory", F.col("path"), _same("path", "file_name", "extension", "size_bytes", "format", "mime", "language", "role", "importance", "auditable", "generated", "sensitive", "risk_flags") | {"third_party": "vendored"}),
        _part(corpus, "text_corpus", F.col("path"), {"source_file": "path", "title": "title", "status": "status", "text_size": F.col("text_size") if "text_size" in corpus.columns else F.octet_length("text")}),
        _part(profile, "cpir", one, {"competition_type": "type", "competition_confidence": "confidence", "competition_reason": "reason"} | {c: c for c in profile.columns if c not in ("project_id", "type", "confidence", "reason")}),
        _part(claims, "claims", F.col("claim_id"), _same("claim_id", "claim_text", "claim_type", "confidence", "initial_risk") | {"source_file": "path"}),
        _part(evidence, "evidence_matches", F.col("claim_id"), _same("claim_id", "status", "evidence_files", "missing_evidence", "reason")),
        _part(issues, "consistency_issues", F.format_string("%06d", "seq"), _same("issue_id", "severity", "description", "affected_files", "fix_suggestion")),
        _part(findings, "findings", F.format_string("%06d", "seq"), _same("rule_id", "severity", "title", "reason", "evidence", "missing_evidence", "fix_suggestion")),
        _part(taken, "penalties", F.format_string("%d%09d", "part", "seq"), {"rule_id": "rule_id", "points": "actual", "dimension": "dimension", "reason": "reason"}),
        _part(scores, "trust_score", one, _same("total_score", "trust_debt", "dimensions")),
        _part(tasks, "fix_tasks", F.col("task_id"), _same("task_id", "title", "priority", "reason", "required_material", "affected_rules", "related_files")),
        _part(plan, "repair_plan", one, {"markdown": "markdown", "diff": "diff_text"}),
    ]
    if diff is not None:
        parts.append(_part(diff, "audit_diff", one, {c: c for c in diff.columns if c != "project_id"}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def package_documents(parts: DataFrame) -> DataFrame:
    """project_id, json: a package as one document. For projects within the import limits: a document is one value."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "json"))), lambda x: x.json)
    each = parts.groupBy("project_id", "section").agg(listed.alias("items"))
    body = F.when(F.col("section").isin(*SINGLE_SECTIONS), F.col("items")[0]).otherwise(F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")))
    pairs = each.select("project_id", "section", body.alias("body")).groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "body"))).alias("sections"))
    fields = [F.concat(F.lit(f'"{s}":'), F.coalesce(F.try_element_at("sections", F.lit(s)), F.lit("null" if s in SINGLE_SECTIONS else "[]"))) for s in SECTIONS]
    return pairs.select("project_id", F.concat(F.lit(f'{{"report_schema_version":{SCHEMA_VERSION},'), F.concat_ws(",", *fields), F.lit("}")).alias("json"))


def write_package(parts: DataFrame, folder: str) -> None:
    """The package as JSON lines, a folder a project and section."""
    lines = parts.sort("project_id", "section", "seq").select("project_id", "section", F.col("json").alias("value"))
    lines.write.mode("overwrite").partitionBy("project_id", "section").text(folder)


def metrics_of(documents: DataFrame) -> DataFrame:
    """project_id, and the metrics that ``diff.audit_diff`` takes, of package documents (project_id, json).

    What isn't JSON or has no summary gives nulls, which ``diff.valid_metrics`` turns away. A document is as long as its
    project, so it is parsed once: as rows that are generated, since Spark would repeat a function for each use of a metric.
    """
    names = {"score": "total_score", "trust_debt": "trust_debt", "blockers": "blocker_count", "warnings": "warning_count", "evidence_coverage": "evidence_coverage", "material_completeness": "material_completeness", "consistency_score": "consistency_score", "fix_task_count": "fix_task_count"}
    summaries = documents.select("project_id", F.json_tuple("json", "summary").alias("summary"))
    values = summaries.select("project_id", F.json_tuple("summary", *names.values()).alias(*names))
    return values.select("project_id", *[F.col(metric).cast("double").alias(metric) for metric in names])


def read_metrics(spark: SparkSession, paths: list[str], most: int = 64 << 20) -> DataFrame:
    """``metrics_of`` package files of at most ``most`` bytes; a project is called as its file is."""
    files = spark.read.format("binaryFile").load(paths).where(F.col("length") <= most)
    name = F.regexp_extract("path", r"([^/]+?)(\.json)?$", 1)
    return metrics_of(files.select(name.alias("project_id"), F.col("content").cast("string").alias("json")))


def report_markdown(profile: DataFrame, scores: DataFrame, claims: DataFrame, evidence: DataFrame, findings: DataFrame, tasks: DataFrame) -> DataFrame:
    """project_id, markdown."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def section(rows: DataFrame, order: str, line, name: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
        return rows.groupBy("project_id").agg(F.array_join(F.transform(listed, lambda x: x.l), "\n").alias(name))

    judged = claims.join(evidence.select("project_id", "claim_id", "status"), ["project_id", "claim_id"], "left")
    parts = (
        section(judged, "claim_id", F.concat(F.lit("- "), text("claim_id"), F.lit("（"), F.coalesce("status", F.lit("NEED_REVIEW")), F.lit("）"), text("claim_text")), "claims_md"),
        section(findings, "seq", F.concat(F.lit("- ["), text("severity"), F.lit("] "), text("title"), F.lit("："), text("reason")), "findings_md"),
        section(tasks, "task_id", F.concat(F.lit("- "), text("task_id"), F.lit(" ["), text("priority"), F.lit("] "), text("title")), "tasks_md"),
    )
    wide = profile.select("project_id", "project_name", "type").join(scores.select("project_id", "total_score", "trust_debt"), "project_id")
    for part in parts:
        wide = wide.join(part, "project_id", "left")
    body = F.concat_ws(
        "\n",
        F.lit("# 竞赛项目可信审计报告"),
        F.concat(F.lit("- 项目名称："), text("project_name")),
        F.concat(F.lit("- 竞赛类型："), text("type")),
        F.concat(F.lit("- 可信评分："), text("total_score"), F.lit("/100")),
        F.concat(F.lit("- 可信债务："), text("trust_debt")),
        F.lit("## 声明与证据"),
        text("claims_md"),
        F.lit("## 规则发现"),
        text("findings_md"),
        F.lit("## 修改任务"),
        text("tasks_md"),
    )
    return wide.select("project_id", body.alias("markdown"))


def finding_sums(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """project_id, role, severity, level, findings, rules: counts of findings and files, and their sums upwards.

    ``level`` tells what was summed over (4 project, 2 role, 1 severity), so that a null role, which is that of a finding
    without files, isn't taken for a sum. A finding counts once for each of its files. All levels come from one pass.
    """

    files = findings.select("project_id", "rule_id", "severity", F.explode_outer("evidence").alias("path"))
    roles = assets.select("project_id", "path", "role")
    rows = files.join(roles, ["project_id", "path"], "left")
    project, role, severity = (F.col(c) for c in ("project_id", "role", "severity"))
    sets = [[project, role, severity], [project, role], [role, severity], [project], [role], []]
    return rows.groupingSets(sets, project, role, severity).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("findings"), F.count_distinct("rule_id").alias("rules")
    )
