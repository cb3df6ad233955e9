"""Fix tasks: findings and open claims grouped by the material that would settle them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.functions.text import first_match, lower_ascii, trimmed


def candidate_tasks(findings: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """project_id, part, seq, title, priority, reason, required_material, affected_rules, related_files."""
    rank = first_match([(F.col("severity") == "BLOCKER", "P0"), (F.col("severity") == "WARNING", "P1")], "P2")
    title = F.when(F.col("fix_suggestion") == "", F.col("title")).otherwise(F.col("fix_suggestion"))
    by_finding = findings.select(
        "project_id",
        F.lit(0).alias("part"),
        F.col("seq").cast("long").alias("seq"),
        title.alias("title"),
        rank.alias("priority"),
        "reason",
        F.col("missing_evidence").alias("required_material"),
        F.array("rule_id").alias("affected_rules"),
        F.col("evidence").alias("related_files"),
    )
    review = F.col("status") == "NEED_REVIEW"
    material = F.when(F.size("missing_evidence") > 0, F.col("missing_evidence")).otherwise(
        F.array(F.when(review, "人工复核声明原文与证据").otherwise("可独立复核的来源材料"))
    )
    sources = claims.select("project_id", "claim_id", F.col("path").alias("source"))
    open_claims = evidence.where("status <> 'SUPPORTED'").join(sources, ["project_id", "claim_id"], "left")
    by_claim = open_claims.select(
        "project_id",
        F.lit(1).alias("part"),
        F.regexp_extract("claim_id", "([0-9]+)$", 1).cast("long").alias("seq"),
        F.concat(F.lit("为声明 "), F.col("claim_id"), F.lit(" 补充独立证据")).alias("title"),
        F.when(F.col("status").isin("UNSUPPORTED", "CONFLICTED"), "P0").otherwise("P1").alias("priority"),
        "reason",
        material.alias("required_material"),
        F.array(F.concat(F.lit("EVIDENCE_"), F.col("claim_id"))).alias("affected_rules"),
        F.when(F.coalesce(F.col("source"), F.lit("")) != "", F.concat("evidence_files", F.array("source"))).otherwise(F.col("evidence_files")).alias("related_files"),
    )
    return by_finding.unionByName(by_claim)


def task_key() -> Column:
    cleaned = F.array_sort(F.array_distinct(F.transform("required_material", lambda m: lower_ascii(trimmed(m)))))
    return F.when(F.size("required_material") == 0, lower_ascii(trimmed(F.col("title")))).otherwise(F.array_join(cleaned, "|"))


def group_tasks(tasks: DataFrame, lists: bool = True) -> DataFrame:
    """project_id, task_id, title, priority, reason, required_material, affected_rules, related_files.

    The first task of a group gives title and reason, the most urgent the priority; lists keep first occurrences in
    order. Tasks are numbered by priority, then place. ``lists``: whether the last three columns are asked for; without them
    a group of any number of tasks is a few values.
    """
    columns = ["required_material", "affected_rules", "related_files"] if lists else []
    proofs = F.size(F.filter("affected_rules", lambda r: r.startswith("EVIDENCE_")))
    place = F.struct("part", "seq")
    listed = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", c))), lambda x: x[c])))
    grouped = (
        tasks.withColumn("key", task_key())
        .groupBy("project_id", "key")
        .agg(
            F.min(place).alias("place"),
            F.min_by("title", place).alias("title"),
            F.min("priority").alias("priority"),
            F.min_by("reason", place).alias("reason"),
            F.sum(proofs).alias("claims"),
            *[listed(c).alias(c) for c in columns],
        )
    )
    number = F.row_number().over(Window.partitionBy("project_id").orderBy("priority", "place"))
    claims = F.col("claims")
    title = F.when(claims > 1, F.concat(F.lit("为 "), claims.cast("string"), F.lit(" 条声明补充同类独立证据"))).otherwise(F.col("title"))
    return grouped.select(
        "project_id",
        F.format_string("FIX-%03d", number).alias("task_id"),
        title.alias("title"),
        "priority",
        "reason",
        *columns,
    )


def repair_plan(tasks: DataFrame) -> DataFrame:
    """project_id, markdown, diff_text: the tasks as a list, and as a file that a patch would add."""
    line = F.concat(F.lit("- ["), F.col("priority"), F.lit("] "), F.col("task_id"), F.lit(" "), F.col("title"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("task_id", line.alias("line")))), lambda x: x.line)
    plans = tasks.groupBy("project_id").agg(listed.alias("lines"))
    head = F.concat(F.lit("--- /dev/null\n+++ b/REPAIR_PLAN.md\n@@ -0,0 +1,"), F.size("lines").cast("string"), F.lit(" @@\n"))
    added = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("+"), x)), "\n")
    return plans.select("project_id", F.array_join("lines", "\n").alias("markdown"), F.concat(head, added, F.lit("\n")).alias("diff_text"))
