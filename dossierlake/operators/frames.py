"""Window frames over time, with every key spread over ranges of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.names import free_names
from dossierlake.operators.histories import running_total, running_totals
from dossierlake.operators.intervals import last_before
from dossierlake.workspace import materialize


def range_sums(rows: DataFrame, key: str, time: str, row: str, size: str | list[str], width: int, name: str | list[str]) -> DataFrame:
    """``rows`` with the sum of ``size`` (long, null counts as 0) over the rows of its key from ``time`` - width to ``time``.

    Both ends are included, so rows at one time have one value, as in a frame by range; ``time`` is a long and
    ``row`` is unique. A sum over a frame is the difference of two running totals: one up to the row's own time, the
    largest of that time's rows by place, one before the frame begins. Totals and the look-up go over ranges of (key, time),
    so a key with a third of all rows is no long task. Rows without key or time have a null sum and count nowhere. Lists of
    ``size`` and ``name`` give several sums from one pass.
    """
    names, sizes = ([x] if isinstance(x, str) else x for x in (name, size))
    place, began, owner, ended, low, upto, *rest = free_names(rows, rows, 6 + 2 * len(names))
    own, before = rest[: len(names)], rest[len(names) :]
    counts = F.col(key).isNotNull() & F.col(time).isNotNull()
    sized = rows.withColumns({o: F.when(counts, F.coalesce(s, F.lit(0))).otherwise(0).cast("long") for o, s in zip(own, sizes, strict=True)})
    placed = running_totals(sized.withColumn(place, F.struct(time, row)), key, place, dict(zip(before, own, strict=True)))
    totals = F.struct(*[(F.col(b) + F.col(o)).alias(n) for b, o, n in zip(before, own, names, strict=True)])
    placed = materialize(placed.withColumn(upto, totals).drop(*own, *before), "totals")
    ends = placed.where(counts).groupBy(F.col(key).alias(owner), F.col(time).alias(ended)).agg(F.max_by(upto, row).alias(upto))
    known = placed.drop(place, upto).join(ends, (F.col(key) == F.col(owner)) & (F.col(time) == F.col(ended)), "left").drop(owner, ended)
    earlier = ends.select(F.col(owner).alias(key), F.col(ended).alias(began), upto)
    found = last_before(known.withColumn(began, F.col(time) - width), earlier, key, began, began, low)
    sums = {n: F.when(counts, F.col(upto)[n] - F.coalesce(F.col(low)[upto][n], F.lit(0))) for n in names}
    return found.select(*[c for c in rows.columns if c not in names], *[v.alias(n) for n, v in sums.items()])


def places(rows: DataFrame, key: str, order: str, tiles: int) -> DataFrame:
    """``rows`` with place (from 1), percent_rank and ntile of ``order`` (unique within a key), null keys as a key.

    A row's place is a running count over ranges; the key's size comes from one row a key.
    """
    one, before, size, owner = free_names(rows, rows, 4)
    counted = running_total(rows.withColumn(one, F.lit(1)), key, order, one, before).drop(one)
    sizes = rows.groupBy(F.col(key).alias(owner)).agg(F.count(F.lit(1)).alias(size))
    joined = counted.join(sizes, F.col(key).eqNullSafe(F.col(owner))).drop(owner)
    place = F.col(before)
    share = F.when(F.col(size) > 1, place / (F.col(size) - 1)).otherwise(0.0)
    small, larger = F.floor(F.col(size) / tiles), F.pmod(F.col(size), F.lit(tiles))
    head = larger * (small + 1)
    tile = F.when(place < head, F.floor(place / (small + 1))).otherwise(larger + F.floor((place - head) / F.greatest(small, F.lit(1)))) + 1
    return joined.select(*rows.columns, (place + 1).alias("place"), share.alias("percent_rank"), tile.cast("int").alias("ntile"))


def last_known(rows: DataFrame, key: str, time: str, row: str, value: str, name: str) -> DataFrame:
    """``rows`` with the last ``value`` of its key that isn't null, up to its own time (of one time the largest ``row``)."""
    known = rows.where(F.col(value).isNotNull()).select(key, time, row, F.col(value).alias("v"))
    return last_before(rows, known, key, time, row, name, also_equal=True).withColumn(name, F.col(f"{name}.v"))
