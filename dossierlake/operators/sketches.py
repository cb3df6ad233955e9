"""Distinct counts and quantiles by mergeable sketches: made once by project, merged upwards at no further reading.

An HLL sketch of 2^12 registers counts distinct values with a standard error of 1.04 / sqrt(2^12), 1.6 %; a KLL sketch of
k = 200 finds quantiles with a rank error of 1.33 % in 99 of 100 cases. Both are a few kilobytes whatever the rows, are
combined before the shuffle, and are stored as they are, so days, projects or sources can be merged later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTERS_LOG2 = 12
DISTINCT_ERROR, RANK_ERROR = 0.0163, 0.0133


def sketches(rows: DataFrame, by: list[str], distinct: Column, value: Column) -> DataFrame:
    """``by``, rows, distinct_sketch, value_sketch. Nulls of ``distinct`` and ``value`` count in ``rows`` alone."""
    held = rows.select(*by, distinct.alias("d"), value.cast("double").alias("v"))
    return held.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("d", REGISTERS_LOG2).alias("distinct_sketch"), F.kll_sketch_agg_double("v").alias("value_sketch")
    )


def merged(made: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones."""
    return made.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch")
    )


def estimates(made: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``by``, rows, distinct, and quantiles (an array) of each group; null quantiles of groups without values."""
    some = F.kll_sketch_get_n_double("value_sketch") > 0
    quantiles = F.array(*(F.when(some, F.kll_sketch_get_quantile_double("value_sketch", F.lit(r))) for r in ranks))
    return made.select(*by, "rows", F.hll_sketch_estimate("distinct_sketch").alias("distinct"), quantiles.alias("quantiles"))
