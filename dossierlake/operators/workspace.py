"""Repaired workspaces and stored audits: which files may be edited, edits, patches, and tables partitioned by project."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.text import occurrences

EDITABLE_BYTES = 1 << 20


def looks_binary(content: Column) -> Column:
    """A NUL, or more than one control byte in twenty, in the first 4 KiB."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    controls = F.length(head) - F.length(F.regexp_replace(head, r"[\x01-\x08\x0B\x0E-\x1F]", ""))
    return head.contains("\0") | (controls * 20 > F.length(head))


def editable(assets: DataFrame) -> DataFrame:
    """Auditable texts and codes of at most 1 MiB that aren't sensitive, with kind and size_bytes."""
    return assets.where(F.col("auditable") & ~F.col("sensitive") & F.col("kind").isin("text", "code") & (F.col("size_bytes") <= EDITABLE_BYTES))


def apply_edit(files: DataFrame, old: str, new: str, expected: int = 1) -> DataFrame:
    """Files whose text holds ``old`` exactly ``expected`` times, with each of them replaced."""
    hits = files.where(occurrences(F.col("text"), old) == expected)
    return hits.withColumn("text", F.replace("text", F.lit(old), F.lit(new)))


def patches(old: DataFrame, new: DataFrame) -> DataFrame:
    """project_id, path, patch: a unified diff of each text file that differs; both have a text column.

    A file's two versions are one row, so patches are made where the row is.
    """
    left = old.select("project_id", "path", F.col("text").alias("before"))
    right = new.select("project_id", "path", F.col("text").alias("after"))
    changed = left.join(right, ["project_id", "path"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))

    @F.pandas_udf("string")
    def diffed(paths: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for path, a, b in zip(paths, before, after, strict=True):
            source = f"a/{path}" if a is not None else "/dev/null"
            target = f"b/{path}" if b is not None else "/dev/null"
            lines = difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), source, target, lineterm="")
            out.append("\n".join(lines) + "\n")
        return pd.Series(out)

    return changed.select("project_id", "path", diffed("path", "before", "after").alias("patch"))


def combined_patch(each: DataFrame) -> DataFrame:
    """project_id, patch: all patches of a project by path."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("path", "patch"))), lambda x: x.patch)
    return each.groupBy("project_id").agg(F.array_join(listed, "").alias("patch"))


def store(frame: DataFrame, folder: str) -> None:
    """Write a stage's table by project; a run again replaces the projects that it has and no others."""
    (
        frame.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("project_id")
        .parquet(folder)
    )
