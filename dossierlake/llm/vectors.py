"""What the vector searches share: which vectors take part, and equal vectors as one class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, vector (array of doubles) of the rows that take part.

    Left out: null ids and vectors, and vectors that hold null or non-finite components. Where lengths differ, a
    shorter vector counts as having zeros behind it, an empty one as all zeros.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (
        vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
        .where("id is not null and vector is not null")
        .where(F.forall("vector", finite))
    )


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """vector, ids, counts: each distinct vector with the ``keep`` smallest of its ids, and how many rows each has.

    No search for ``keep - 1`` neighbours needs more of them, so a vector that a third of all rows share stays one
    small row. The limit on the rank goes before the shuffle as well as after it.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.groupBy("vector", "id").count().withColumn("rank", rank).where(F.col("rank") <= keep)
    own = few.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("id", "count"))).alias("own"))
    return own.select("vector", F.col("own.id").alias("ids"), F.col("own.count").alias("counts"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """[rows, width] of a column of arrays without nulls, with zeros behind shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) == len(column) * width and (column.value_lengths().to_numpy() == width).all():
        return flat.reshape(len(column), width)
    sizes = column.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score and any further columns: the k best of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    more = [c for c in found.columns if c not in ("query_id", "vec_id", "score")]
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", *more)
    )
