"""Two audits, or two states of a project's files, side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.operators.evidence import coverage
from dossierlake.operators.scoring import LOGIC, MATERIAL

METRICS = ("score", "trust_debt", "blockers", "warnings", "evidence_coverage", "material_completeness", "consistency_score", "fix_task_count")


def audit_metrics(scores: DataFrame, findings: DataFrame, evidence: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row a project. Blockers: the more of blocking findings and tasks of priority 0; warnings alike."""
    found = findings.groupBy("project_id").agg(
        F.count_if(F.col("severity") == "BLOCKER").alias("rule_blockers"), F.count_if(F.col("severity") == "WARNING").alias("rule_warnings")
    )
    todo = tasks.groupBy("project_id").agg(
        F.count_if(F.col("priority") == "P0").alias("p0"), F.count_if(F.col("priority") == "P1").alias("p1"), F.count("task_id").alias("fix_task_count")
    )
    joined = scores
    for other in (found, todo, coverage(evidence).drop("claims")):
        joined = joined.join(other, "project_id", "left")
    joined = joined.fillna(0)
    return joined.select(
        "project_id",
        F.col("total_score").alias("score"),
        "trust_debt",
        F.greatest("rule_blockers", "p0").alias("blockers"),
        F.greatest("rule_warnings", "p1").alias("warnings"),
        "evidence_coverage",
        F.coalesce(F.col("dimensions")[MATERIAL], F.lit(0)).alias("material_completeness"),
        F.coalesce(F.col("dimensions")[LOGIC], F.lit(0)).alias("consistency_score"),
        "fix_task_count",
    )


def valid_metrics() -> Column:
    """Scores are whole and from 0 to 100, counts whole and up to a million, coverage from 0 to 100."""
    whole = lambda c, top: F.col(c).isNotNull() & F.col(c).between(0, top) & (F.floor(c) == F.col(c))
    test = F.col("evidence_coverage").between(0, 100)
    for name in ("score", "trust_debt", "material_completeness", "consistency_score"):
        test = test & whole(name, 100)
    for name in ("blockers", "warnings", "fix_task_count"):
        test = test & whole(name, 1_000_000)
    return F.coalesce(test, F.lit(False))


def audit_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """project_id, old_ and new_ of each metric, summary."""
    left = old.where(valid_metrics()).select("project_id", *[F.col(m).alias(f"old_{m}") for m in METRICS])
    right = new.where(valid_metrics()).select("project_id", *[F.col(m).alias(f"new_{m}") for m in METRICS])
    text = lambda name: F.col(name).cast("string")
    summary = F.concat(
        F.lit("分数从 "), text("old_score"), F.lit(" 分变为 "), text("new_score"),
        F.lit(" 分；提交前要处理的问题从 "), text("old_blockers"), F.lit(" 个变为 "), text("new_blockers"),
        F.lit(" 个，建议补齐的地方从 "), text("old_warnings"), F.lit(" 个变为 "), text("new_warnings"),
        F.lit(" 个；修改任务从 "), text("old_fix_task_count"), F.lit(" 项变为 "), text("new_fix_task_count"), F.lit(" 项。"),
    )
    return left.join(right, "project_id").withColumn("summary", summary)


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """project_id, path, kind (created, deleted, modified) of files whose digest differs; both have a digest column."""
    left = old.select("project_id", "path", F.col("digest").alias("__old"))
    right = new.select("project_id", "path", F.col("digest").alias("__new"))
    kind = F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNull(), "deleted").otherwise("modified")
    joined = left.join(right, ["project_id", "path"], "full_outer").where(~F.col("__old").eqNullSafe(F.col("__new")))
    return joined.select("project_id", "path", kind.alias("kind"))
