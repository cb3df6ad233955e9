"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. A source takes the documents whose hash is at most the source's
threshold, so nothing is sorted and a larger budget takes a superset of a smaller one. The threshold is found digit
by digit: sizes are summed by source and hash bucket, the bucket in which the budget ends is found, and only that
bucket is looked at again in finer buckets.

Nulls: a null source is a source of its own, last in order; a null id hashes as the empty text; a null size counts 0.
Rows with one id (repeats, also with different texts) share a hash. Where a source's budget ends within such rows, they are
taken one by one, in order of a hash of all their columns, so a source comes near its target also where one id holds most
of it; rows that are alike in every column are the same to a mix. No document is taken more than ``most`` times, empty ones included. An empty table gives an empty
result. A very long text is one size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.llm.common import free_name
from dossierlake.operators.histories import running_total
from dossierlake.workspace import materialize

#: A digit's bits bound what a source's histogram has: 1024 rows at every step.
HASH_BITS, DIGIT_BITS = 60, 10
#: Weights by the source's place in order, repeating.
WEIGHTS = (3, 1, 2)
#: How often a mix takes a document at most.
MOST = 2.0


def id_hash(column: str) -> Column:
    """60 bits of the id's md5: the same in any SQL engine."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target. One row a source goes through one task here: sums, not documents.

    All sources share ``share`` times all sizes by weight, none above ``most`` times its own size. Where some are
    held at that bound, the rest divide what is left by weight, which is one common level for target / weight.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    filled = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    totals = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(in_order))
        .withColumn("weight", weight.cast("double"))
        .withColumn("bound", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("held", F.sum("bound").over(filled))
        .withColumn("free", F.sum("weight").over(everything) - F.sum("weight").over(filled))
    )
    fits = (F.col("held") + F.col("ratio") * F.col("free") <= F.col("budget")) & (F.col("free") > 0)
    last = F.max(F.when(fits, F.struct("ratio", "held", "free"))).over(everything)
    level = F.coalesce(
        (F.col("budget") - F.col("last.held")) / F.col("last.free"),
        F.col("budget") / F.sum("weight").over(everything),
    )
    return (
        totals.withColumn("last", last)
        .withColumn("target", F.least("bound", F.col("weight") * level))
        .select("source", "source_size", "target")
    )


def source_thresholds(
    docs: DataFrame,
    size: Column,
    id_column: str = "doc_id",
    source_column: str = "source",
    share: float = 1.5,
    most: float = MOST,
    weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """mix_source, source_size, target, whole, threshold, edge, room: one row a source.

    A source whose target is k times its size and a rest takes every document k (``whole``) times, and those with a
    hash up to its threshold once more. The document at the threshold is in if that brings the source nearer to its
    target. Where several rows have the hash at which the budget ends, that is the ``edge`` (else null): those below it are
    in, and of its rows as many as ``room`` has words for.
    """
    sizes = docs.select(
        F.col(source_column).alias("source"),
        F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"),
        id_hash(id_column).alias("hash"),
    )
    sizes = materialize(sizes, "mix-sizes")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = (
        source_targets(sizes, share, most, weights)
        .withColumn("whole", whole.cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("below", F.lit(0).cast("long"))
        .withColumn("own", F.lit(0).cast("long"))
    )
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        state = materialize(_refine(sizes, state, shift), "mix-state")
    nearer = F.col("below") + F.col("own") - F.col("rest") < F.col("rest") - F.col("below")
    # own is null where the rest is more than all documents: then all are in
    threshold = F.when(F.col("own").isNull(), F.lit((1 << HASH_BITS) - 1)).otherwise(
        F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1)
    )
    edges = state.where(F.col("own").isNotNull()).select(F.col("source").alias("of"), F.col("prefix").alias("at"))
    shared = sizes.join(edges, F.col("source").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("at")))
    several = shared.groupBy("of", "at").count().where("count > 1").select("of", F.col("at").alias("edge"))
    found = state.withColumn("threshold", threshold.cast("long")).join(several, F.col("source").eqNullSafe(F.col("of")), "left")
    below_edge = F.when(F.col("edge").isNull(), F.col("threshold")).otherwise(F.col("edge") - 1)
    return found.select(
        F.col("source").alias("mix_source"), "source_size", "target", "whole", below_edge.alias("threshold"), "edge", (F.col("rest") - F.col("below")).alias("room")
    )


def mix_sources(
    docs: DataFrame,
    size: Column,
    id_column: str = "doc_id",
    source_column: str = "source",
    copies: str = "copies",
    details: bool = True,
    **how,
) -> DataFrame:
    """``docs`` with a column ``copies`` of how often the mix takes each document and, with details, source_size and target.

    Documents meet one small row of their source; nothing is joined on ids, so repeated and null ids do no harm.
    Columns of ``docs`` with the name of one of these are replaced; all others stay, whatever their names.
    """
    found = materialize(source_thresholds(docs, size, id_column, source_column, **how), "mix-thresholds")
    added = [copies, *(("source_size", "target") if details else ())]
    plain = docs.drop(*[c for c in added if c not in (id_column, source_column)])
    names = {c: free_name(plain, f"__mix_{c}") for c in ("mix_source", "whole", "threshold", "edge", "room")}
    found = found.select(*[F.col(c).alias(n) for c, n in names.items()], *(("source_size", "target") if details else ()))
    joined = plain.join(found, F.col(source_column).eqNullSafe(F.col(names["mix_source"])))
    bound = F.lit(math.floor(how.get("most", MOST))).cast("long")

    def taken(rows: DataFrame, once_more: Column) -> DataFrame:
        return rows.withColumn(copies, F.least(F.col(names["whole"]) + once_more.cast("long"), bound)).select(*plain.columns, copies, *added[1:])

    up_to = id_hash(id_column) <= F.col(names["threshold"])
    if found.where("edge is not null").isEmpty():
        return taken(joined, up_to)
    at_edge = F.coalesce(id_hash(id_column) == F.col(names["edge"]), F.lit(False))
    order, own, before = (free_name(joined, f"__mix_{c}") for c in ("order", "own", "before"))
    alike = F.xxhash64(*(F.col(f.name) for f in plain.schema if not f.dataType.simpleString().startswith(("map", "variant"))))
    edge = joined.where(at_edge).withColumn(order, F.struct(alike.alias("hash"), F.expr("uuid()").alias("row")))
    edge = edge.withColumn(own, F.coalesce(size.cast("long"), F.lit(0).cast("long")))
    placed = running_total(edge, names["mix_source"], order, own, before)
    fits = 2 * F.col(before) + F.col(own) < 2 * F.col(names["room"])
    return taken(joined.where(~at_edge), up_to).unionByName(taken(placed, fits))


def _refine(sizes: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """One digit more of each source's boundary: the first bucket with which the sum passes the source's rest."""
    bucket = F.expr(f"shiftright(hash, {shift})")
    at = state.select(F.col("source").alias("of"), "prefix", "own")
    inside = F.col("source").eqNullSafe(F.col("of")) & (
        F.expr(f"shiftright(hash, {shift + DIGIT_BITS})") == F.col("prefix")
    )
    histogram = (
        sizes.join(at.where(F.col("own").isNotNull()), inside)
        .groupBy("source", bucket.alias("bucket"))
        .agg(F.sum("size").alias("tokens"))
        .withColumnRenamed("source", "of")
    )
    upto = Window.partitionBy("of").orderBy("bucket")
    reached = (
        state.join(histogram, F.col("source").eqNullSafe(F.col("of")), "left")
        .withColumn("sum", F.col("below") + F.sum("tokens").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("passes", F.col("sum") > F.col("rest"))
    )
    first = F.min(F.when(F.col("passes"), F.struct("bucket", F.col("sum") - F.col("tokens"), "tokens")))
    return (
        reached.groupBy("source", "source_size", "target", "whole", "rest")
        .agg(first.alias("first"))
        .select(
            "source",
            "source_size",
            "target",
            "whole",
            "rest",
            F.col("first.bucket").alias("prefix"),
            F.col("first.col2").alias("below"),
            F.col("first.tokens").alias("own"),
        )
    )
