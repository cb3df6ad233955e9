"""Whitening of embeddings: covariance by generated column aggregates, eigenvectors by LAPACK.

Entries are whole numbers x = floor(64 c) + 1,000,000. The covariance's upper triangle is one aggregation of generated
sums, one for each pair of dimensions, of products of entries that are centred first; partial sums of each partition
meet in ``GROUPS`` rows, so the driver adds up that many rows of numbers, whatever the table's size. Vectors are
projected where they lie; the same aggregation over the projections then measures how far their covariance is from the
identity.

Left out: null vectors and those with null or non-finite entries. Where lengths differ, a shorter vector (also an empty
one) has entries c = 0 behind it. Null and repeated ids, and equal vectors, are rows like any other. A component whose
eigenvalue is zero to double precision has no direction to scale and isn't returned; so one row, or rows that are all
equal, give an empty result, as an empty table does. Entries are held to 2^62 in size. Deviations beyond a long are null.
More than ``PAIRS`` pairs are summed in tiles of so many, each an aggregation of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import slices
from dossierlake.workspace import materialize

SCALE, SHIFT, HELD = 64, 1_000_000, 1 << 62
#: Sums of one aggregation at most, and rows of them that reach the driver.
PAIRS, GROUPS = 8_256, 16


class Whitening(NamedTuple):
    """Fitted to n vectors: sums of each dimension, eigenvalues falling, eigenvectors as columns, trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_entries(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, x (array of long) of the rows that take part."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    bound = F.lit(float(HELD))
    whole = lambda c: F.greatest(F.least(F.floor(F.least(F.greatest(c * SCALE, -bound), bound)), F.lit(HELD)), F.lit(-HELD)).cast("long") + SHIFT
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("c"))
    return rows.where(F.col("c").isNotNull() & F.forall("c", finite)).select("vec_id", F.transform("c", whole).alias("x"))


def added_up(rows: DataFrame, sums: list[Column]) -> list[list]:
    """Each sum over all rows, as a list of at most GROUPS partial sums."""
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("__group")
    found = rows.groupBy(group).agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).drop("__group").collect()
    return [[r[k] for r in found] for k in range(len(sums))]


def second_moments(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of each pair of (centred) columns, as a full matrix: upper triangles of generated SQL."""
    width = len(columns)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    out = np.zeros((width, width))
    for at in range(0, len(pairs), PAIRS):
        tile = pairs[at : at + PAIRS]
        for (i, j), parts in zip(tile, added_up(rows, [F.expr(f"sum({columns[i]} * {columns[j]})") for i, j in tile]), strict=True):
            out[i, j] = out[j, i] = sum(p for p in parts if p is not None)
    return out


def fit(rows: DataFrame, width: int) -> Whitening | None:
    """Whitening of ``rows`` with an array x of ``width`` longs; None where there are none."""
    sums = added_up(rows, [F.count(F.lit(1)), *(F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(width))])
    n, totals = sum(sums[0]), [int(sum(s)) for s in sums[1:]]
    if not n:
        return None
    centred = rows.select(*((F.col("x")[i] - F.lit(totals[i] / n)).alias(f"c{i}") for i in range(width)))
    covariance = second_moments(centred, [f"c{i}" for i in range(width)]) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = int((values > max(values[0], 0.0) * width * np.finfo(float).eps).sum())
    return Whitening(n, totals, values[:real], vectors[:, :real], float(np.trace(covariance)))


def project(rows: DataFrame, fitted: Whitening, components: int) -> DataFrame:
    """``rows`` with an array ``white`` of the projections on the first components, each over its standard deviation."""
    kept = min(components, len(fitted.values))
    mean = np.array([s / fitted.n for s in fitted.sums])
    scaled = fitted.vectors[:, :kept] / np.sqrt(fitted.values[:kept])
    names = rows.columns
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 10_000):
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, len(mean))
            white = ((x - mean) @ scaled).ravel()
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * kept)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(white))], names=[*names, "white"])

    return rows.mapInArrow(projected, f"{kinds}, white array<double>")


def deviation(fitted: Whitening) -> Column:
    """Sum of (n x - S)^2 over an array x's dimensions, exact; null beyond a long."""
    wide = lambda v: F.lit(v).cast("decimal(38,0)")
    sums = F.array(*(F.lit(str(s)).cast("decimal(38,0)") for s in fitted.sums))
    from_mean = F.zip_with("x", sums, lambda x, s: (x.cast("decimal(19,0)") * F.lit(fitted.n).cast("decimal(18,0)")).cast("decimal(38,0)") - s)
    return F.aggregate(
        from_mean,
        wide(0),
        lambda total, d: F.when(
            total.isNotNull() & (F.abs(d) < wide(3_037_000_500)), (total + (d.cast("decimal(19,0)") * d.cast("decimal(19,0)"))).cast("decimal(38,0)")
        ),
        lambda total: total.try_cast("long"),
    )


def whiten(vectors: DataFrame, components: int = 32, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue of each row and component."""
    spark = vectors.sparkSession
    entries = whole_entries(vectors, id_column, vector_column)
    kind = entries.schema["vec_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double")
    width = entries.agg(F.max(F.size("x"))).first()[0] or 0
    more = F.greatest(F.lit(width) - F.size("x"), F.lit(0))
    rows = entries.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), more)))
    fitted = fit(rows, width) if width else None
    if fitted is None or not len(fitted.values):
        return empty
    kept = min(components, len(fitted.values))
    white = materialize(project(rows.withColumn("deviation", deviation(fitted)), fitted, components).drop("x"), "whitened")
    names = [f"w{k}" for k in range(kept)]
    apart = white.select(*(F.col("white")[k].alias(w) for k, w in enumerate(names)))
    means = [sum(p) / fitted.n for p in added_up(apart, [F.sum(w) for w in names])]
    centred = apart.select(*((F.col(w) - F.lit(m)).alias(w) for w, m in zip(names, means, strict=True)))
    error = float(np.abs(second_moments(centred, names) / fitted.n - np.eye(kept)).max())
    explained = F.array(*(F.lit(float(v / fitted.trace)) for v in fitted.values[:kept]))
    values = F.array(*(F.lit(float(v)) for v in fitted.values[:kept]))
    each = white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, "at").alias("explained"),
        F.lit(error).alias("identity_error"),
        F.get(values, "at").alias("eigenvalue"),
    )
