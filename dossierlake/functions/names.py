"""Column names that meet no user's column."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(left: DataFrame, right: DataFrame, count: int) -> list[str]:
    taken = {c.lower() for c in (*left.columns, *right.columns)}
    stem = "__own"
    while any(c.startswith(stem) for c in taken):
        stem += "_"
    return [f"{stem}{k}" for k in range(count)]
