"""Project folders as tables, through Spark's binary file source: limits, pruned folders, deferred files."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions.text import path_parts
from dossierlake.operators.histories import greedy_budget, running_total
from dossierlake.operators.inventory import is_pruned
from dossierlake.workspace import materialize


@dataclass(frozen=True)
class ImportLimits:
    """What of a project is read; the rest is listed with a reason."""

    files: int = 100_000
    file_bytes: int = 64 << 20
    total_bytes: int = 512 << 20
    archive_bytes: int = 64 << 20
    expanded_bytes: int = 512 << 20
    depth: int = 32
    ratio: float = 100.0

    def __post_init__(self):
        if min(self.files, self.file_bytes, self.total_bytes, self.archive_bytes, self.expanded_bytes, self.depth) < 1:
            raise ValueError("a limit is below one")
        if not 1 <= self.ratio < float("inf"):
            raise ValueError("no compression ratio")


def _absolute(path: Column) -> Column:
    """A path without its scheme and authority."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _inside(root: str) -> tuple[Column, Column]:
    """(path below ``root``, whether it is ``root`` itself): cut by the root's own length, so repeated names do no harm."""
    if "://" in root or root.startswith("file:"):
        start = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root)
    else:
        start = os.path.abspath(root)
    start = "/" + start.strip("/")
    path = _absolute(F.col("path"))
    below = F.when(path.startswith(start + "/"), F.substring(path, len(start) + 2, 1_000_000))
    return below, path == start


def scan_projects(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """project_id (the first folder below ``root``), path, size_bytes, content of all files in folders below it.

    A file right below ``root`` is a project of its own, named after it, and so is ``root`` where it is one file. Sizes and
    names are read without content unless a plan needs it: the source prunes that column.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below, itself = _inside(root)
    name = F.substring_index(_absolute(F.col("path")), "/", -1)
    inside = F.when(itself, name).otherwise(below)
    rest = F.regexp_replace(inside, "^[^/]*/", "")
    columns = [F.substring_index(inside, "/", 1).alias("project_id"), rest.alias("path"), F.col("length").alias("size_bytes")]
    return files.select(*columns, *(["content"] if with_content else []))


def open_project(spark: SparkSession, path: str, project_id: str | None = None) -> DataFrame:
    """project_id, path, size_bytes, content of one project: all files of a folder, or a single file.

    What Spark finds there says which it is; see ``archives.open_archive`` for the entries of an archive.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below, itself = _inside(path)
    name = F.substring_index(_absolute(F.col("path")), "/", -1)
    owner = project_id or path.rstrip("/").rpartition("/")[2]
    return files.select(F.lit(owner).alias("project_id"), F.when(itself, name).otherwise(below).alias("path"), F.col("length").alias("size_bytes"), "content")


def metadata_only(spark: SparkSession, rows: list[tuple[str, str, int, str]]) -> DataFrame:
    """project_id, path, size_bytes, reason: what is listed without being opened (links, devices, unsupported archives)."""
    return spark.createDataFrame(rows, "project_id string, path string, size_bytes long, reason string")


def import_plan(files: DataFrame, limits: ImportLimits | None = None) -> DataFrame:
    """project_id, path, size_bytes, reason: null for the files that are read.

    Pruned folders are left out. A file too deep or too large is deferred; so is one that doesn't fit what is left of
    the total, while later, smaller ones may; and so are files beyond the count.
    """
    limits = limits or ImportLimits()
    listed = files.where(~is_pruned(F.col("path"))).select("project_id", "path", "size_bytes")
    numbered = running_total(listed.withColumn("one", F.lit(1)), "project_id", "path", "one", "ahead")
    listed = numbered.withColumn("beyond", F.col("ahead") >= limits.files).drop("one", "ahead")
    early = F.when(F.col("beyond"), "FILE_COUNT_DEFERRED").when(F.size(path_parts(F.col("path"))) > limits.depth, "PATH_DEPTH_LIMIT").when(
        F.col("size_bytes") > limits.file_bytes, "LARGE_BINARY_DEFERRED"
    )
    marked = materialize(listed.withColumn("reason", early).drop("beyond"), "import-plan")
    fits = greedy_budget(marked.where("reason is null"), "project_id", "path", "size_bytes", limits.total_bytes)
    budget = fits.select("project_id", "path", "size_bytes", F.when(~F.col("kept"), "COPY_BUDGET_DEFERRED").alias("reason"))
    return marked.where("reason is not null").unionByName(budget)


def deferral_counts(plan: DataFrame) -> DataFrame:
    """project_id, reason, files, bytes of what isn't read."""
    return plan.where("reason is not null").groupBy("project_id", "reason").agg(F.count("path").alias("files"), F.sum("size_bytes").alias("bytes"))
