"""Ordered rows: message budgets, repeated calls, last turns, blank lines and greedy budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.functions.text import byte_length, trimmed
from dossierlake.workspace import materialize


def message_budget(messages: DataFrame, key: str, order: str, text: Column, most: int = 32, each: int = 4096, total: int = 65536) -> DataFrame:
    """The newest ``most`` messages of each history and its first system message, within bytes.

    Adds kept_bytes: the system message takes its share first, then the newest, until nothing is left. A pinned
    system message from before the newest ones takes the place of the oldest of them.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    oldest = Window.partitionBy(key).orderBy(order)
    system = F.col("role") == "system"
    ranked = (
        messages.withColumn("bytes", F.least(byte_length(text), F.lit(each)).cast("long"))
        .withColumn("back", F.row_number().over(newest))
        .withColumn("pinned", system & (F.sum(system.cast("int")).over(oldest.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    )
    outside = F.max((F.col("pinned") & (F.col("back") > most)).cast("int")).over(Window.partitionBy(key))
    ranked = ranked.withColumn("outside", outside)
    kept = ranked.where(F.col("pinned") | (F.col("back") <= most - F.col("outside")))
    first = Window.partitionBy(key).orderBy(F.desc("pinned"), "back").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("bytes").over(first), F.lit(0))
    return kept.withColumn("kept_bytes", F.least("bytes", F.lit(total) - used)).where("kept_bytes > 0").drop("outside")


def repeated_calls(calls: DataFrame, key: str, order: list[str], same: list[str], limit: int = 3) -> DataFrame:
    """Add run (place in a run of equal calls) and verdict: run, reject (second), abort (from ``limit`` on)."""
    rows = Window.partitionBy(key).orderBy(*order)
    changed = None
    for c in same:
        test = ~F.col(c).eqNullSafe(F.lag(c).over(rows))
        changed = test if changed is None else changed | test
    first = F.lag(F.lit(1)).over(rows).isNull()
    island = F.sum((changed | first).cast("int")).over(rows.rowsBetween(Window.unboundedPreceding, 0))
    marked = calls.withColumn("island", island)
    run = F.row_number().over(Window.partitionBy(key, "island").orderBy(*order))
    verdict = F.when(F.col("run") >= limit, "abort").when(F.col("run") == 2, "reject").otherwise("run")
    return marked.withColumn("run", run).withColumn("verdict", verdict)


def last_turns(messages: DataFrame, key: str, order: str, most: int = 6) -> DataFrame:
    """The newest ``most`` user and assistant messages of each history."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return messages.where(F.col("role").isin("user", "assistant")).withColumn("back", rank).where(F.col("back") <= most)


def rewind(messages: DataFrame, key: str, order: str) -> DataFrame:
    """What comes before each history's last user message; nothing of a history without one."""
    last = messages.where("role = 'user'").groupBy(key).agg(F.max(order).alias("__last"))
    return messages.join(last, key).where(F.col(order) < F.col("__last")).drop("__last")


def without_double_blanks(lines: DataFrame, key: list[str], order: str, line: str) -> DataFrame:
    """Lines without those blank ones that follow a blank one."""
    blank = trimmed(F.col(line)) == ""
    before = F.lag(blank).over(Window.partitionBy(*key).orderBy(order))
    return lines.withColumn("__after", F.coalesce(before, F.lit(False))).where(~(blank & F.col("__after"))).drop("__after")


def running_total(rows: DataFrame, key: str, order: str, size: str, name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``size`` over what comes before each row of its key.

    Rows are dealt to ranges of (key, order), so a key that holds a third of all rows is spread over many tasks: sums
    within a range come from a window, those of whole ranges from a table of one row a key and range.
    """
    return running_totals(rows, key, order, {name: size})


def running_totals(rows: DataFrame, key: str, order: str, sizes: dict[str, str]) -> DataFrame:
    """As running_total, of several columns in one pass: ``sizes`` has a column for each new name."""
    first = next(iter(sizes))
    place, owner, at = (f"__{first}_{x}" for x in ("range", "key", "at"))
    sum_, ahead = (lambda name: f"__{name}_sum"), (lambda name: f"__{name}_ahead")
    # without a number Spark joins small ranges, so a few rows aren't a task and a file for each of hundreds of them
    ranged = rows.repartitionByRange(key, order).withColumn(place, F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sums = ranged.groupBy(key, place).agg(*[F.sum(size).alias(sum_(name)) for name, size in sizes.items()])
    earlier = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias(owner), F.col(place).alias(at), *[F.coalesce(F.sum(sum_(n)).over(earlier), F.lit(0)).alias(ahead(n)) for n in sizes])
    joined = ranged.join(sums, F.col(key).eqNullSafe(F.col(owner)) & (F.col(place) == F.col(at)))
    inner = Window.partitionBy(key, place).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = {name: (F.col(ahead(name)) + F.coalesce(F.sum(size).over(inner), F.lit(0))).cast("long") for name, size in sizes.items()}
    return joined.withColumns(totals).drop(place, owner, at, *map(ahead, sizes))


def greedy_budget(files: DataFrame, key: str, order: str, size: str, total: int, small: int = 50_000) -> DataFrame:
    """key, order, size, kept: a file is in if it still fits; a larger one is passed over and later, smaller ones may fit.

    No running sum alone can say this. Where no key has more than ``small`` files open, a task folds its keys one after
    another, in order, whatever their number.
    Where one has, all keys take a round: what is larger than its key's room is out; of the rest all is in up to the first
    file that doesn't fit, which is out; what comes behind goes on with the room that is left. Within a key ``order`` is
    unique. A null size counts as 0.
    """
    pick = [F.col(c) for c in (key, order, size)]
    need = F.coalesce(F.col(size), F.lit(0))
    open_files = files.select(*pick, F.lit(total).cast("long").alias("room"))
    done: list[DataFrame] = []
    while (open_files.groupBy(key).count().agg(F.max("count")).first()[0] or 0) > small:
        done.append(open_files.where(need > F.col("room")).select(*pick, F.lit(False).alias("kept")))
        placed = materialize(running_total(open_files.where(need <= F.col("room")), key, order, size), "budget")
        over = F.col("before") + need > F.col("room")
        first = placed.where(over).groupBy(key).agg(F.min(F.struct("before", F.col(order).alias("o"))).alias("first"))
        first = first.select(F.col(key).alias("__key"), F.col("first.o").alias("stop"), F.col("first.before").alias("used"))
        marked = placed.join(first, F.col(key).eqNullSafe(F.col("__key")), "left")
        state = F.when(F.col("stop").isNull() | (F.col(order) < F.col("stop")), "in").when(F.col(order) == F.col("stop"), "out").otherwise("open")
        marked = materialize(marked.withColumn("state", state), "budget-states")
        done.append(marked.where("state <> 'open'").select(*pick, (F.col("state") == "in").alias("kept")))
        open_files = marked.where("state = 'open'").select(*pick, (F.col("room") - F.col("used")).alias("room"))
    kinds = dict(files.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, order, size)) + ", kept boolean"
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = open_files.repartition(tasks, key).sortWithinPartitions(key, order).mapInPandas(_folded(key, order, size), schema)
    for part in done:
        out = out.unionByName(part)
    return out


def _folded(key: str, order: str, size: str):
    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = object(), 0
        for rows in frames:
            kept = []
            owners = rows[key].astype(object).where(rows[key].notna(), None)
            for owner, own, room in zip(owners, rows[size].fillna(0).tolist(), rows["room"].tolist(), strict=True):
                if owner != last:
                    last, left = owner, int(room)
                kept.append(own <= left)
                left -= own if own <= left else 0
            yield rows[[key, order, size]].assign(kept=kept)

    return folded


def smallest_entries(files: DataFrame, key: list[str], order: str, most: int) -> DataFrame:
    """The first ``most`` entries of each folder; the limit goes before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return files.withColumn("entry", rank).where(F.col("entry") <= most)
