"""Listing, searching and inspecting a project's files, without the sensitive ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.functions.text import lines_of, lower_ascii, shortened, trimmed


def search_lines(corpus: DataFrame, assets: DataFrame, words: str, matches: int = 500, width: int = 240) -> DataFrame:
    """project_id, path, line_no, line of lines that hold the words, whatever their case: the first of each project."""
    open_files = assets.where(~F.col("sensitive")).select("project_id", "path")
    lines = corpus.join(open_files, ["project_id", "path"]).select(
        "project_id", "path", F.posexplode(lines_of(F.col("text"))).alias("at", "line")
    )
    found = lines.where(lower_ascii(F.col("line")).contains(words.lower()))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("path", "at"))
    return (
        found.withColumn("n", rank)
        .where(F.col("n") <= matches)
        .select("project_id", "path", (F.col("at") + 1).alias("line_no"), shortened(trimmed(F.col("line")), width).alias("line"))
    )


def search_totals(corpus: DataFrame, assets: DataFrame, words: str) -> DataFrame:
    """project_id, scanned, omitted (sensitive), matched files and lines: over all of them, not the listed ones."""
    joined = corpus.join(assets.select("project_id", "path", "sensitive"), ["project_id", "path"])
    hits = F.size(F.filter(lines_of(F.col("text")), lambda x: lower_ascii(x).contains(words.lower())))
    counted = joined.withColumn("hits", F.when(F.col("sensitive"), 0).otherwise(hits).cast("long"))
    return counted.groupBy("project_id").agg(
        F.count_if(~F.col("sensitive")).alias("scanned"),
        F.count_if(F.col("sensitive")).alias("omitted"),
        F.count_if(F.col("hits") > 0).alias("matched_files"),
        F.sum("hits").alias("matched_lines"),
    )


def list_files(assets: DataFrame, role: str | None = None, most: int = 1000) -> DataFrame:
    """The first files of each project by path, without sensitive ones, and of a role if one is given."""
    chosen = assets.where(~F.col("sensitive"))
    if role:
        chosen = chosen.where(F.col("role") == role)
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("path"))
    return chosen.withColumn("n", rank).where(F.col("n") <= most).drop("n")


def top_findings(findings: DataFrame, most: int = 48) -> DataFrame:
    """The most severe findings of each project, in order within a severity."""
    severity = F.when(F.col("severity") == "BLOCKER", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(severity, "seq"))
    return findings.withColumn("place", rank).where(F.col("place") <= most)


def uncovered_tasks(tasks: DataFrame, shown: DataFrame, most: int = 3) -> DataFrame:
    """Tasks none of whose rules is among a project's shown findings, the first ``most`` by id."""
    covered = shown.groupBy("project_id").agg(F.collect_set("rule_id").alias("covered"))
    rest = tasks.join(covered, "project_id", "left").where(F.col("covered").isNull() | ~F.arrays_overlap("affected_rules", "covered"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("task_id"))
    return rest.drop("covered").withColumn("place", rank).where(F.col("place") <= most)


def first_issues(issues: DataFrame, most: int = 3) -> DataFrame:
    """The first consistency issues of each project, in the order of the checks."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("seq"))
    return issues.withColumn("place", rank).where(F.col("place") <= most)
