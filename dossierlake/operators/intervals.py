"""Joins in time without comparing everything with everything: the last row before another, and points in intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.functions.names import free_names
from dossierlake.workspace import materialize

#: Each level's buckets are so many times as wide as those of the level below.
FAN = 8


def last_before(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, name: str = "last", also_equal: bool = False) -> DataFrame:
    """``left`` with a struct of the last row of ``right`` that has its key and an earlier ``time``; null if there is none.

    Of rows at one time the largest ``tie`` counts. ``also_equal`` takes rows at the same time too. Both sides are
    dealt to ranges of (key, time), so a key that holds a third of all rows is spread over many tasks: within a range a
    window carries the last row on, and from range to range a table of one row a key and range does. Rows without key or
    time meet nothing; repeated rows are rows; a column of the result's name is replaced.
    """
    own, other, side, place, ahead, at, key_, time_, tie_ = free_names(left, right, 9)
    sides = (1, 0) if also_equal else (0, 1)
    kept = [c for c in left.columns if c != name]
    rights = right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    shape = F.struct(*right.columns)
    none = F.lit(None)
    asked = left.select(F.col(key).alias(key_), F.col(time).alias(time_), none.cast(right.schema[tie].dataType).alias(tie_), F.lit(sides[0]).alias(side), F.struct(*kept).alias(own))
    given = rights.select(F.col(key).alias(key_), F.col(time).alias(time_), F.col(tie).alias(tie_), F.lit(sides[1]).alias(side), shape.alias(other))
    rows = asked.unionByName(given, allowMissingColumns=True)
    order = [time_, side, tie_]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(tasks, key_, *order).withColumn(place, F.spark_partition_id()), "asof")
    lasts = ranged.where(F.col(other).isNotNull()).groupBy(key_, place).agg(F.max_by(other, F.struct(*order)).alias(other))
    first = ranged.groupBy(key_, place).count().drop("count")
    earlier = Window.partitionBy(key_).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    carried = first.join(lasts, [key_, place], "left").select(F.col(key_).alias(at), F.col(place).alias(f"{place}_"), F.last(other, True).over(earlier).alias(ahead))
    inner = Window.partitionBy(key_, place).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # carried rows are few, one a key and range: a hash join on the range's own rows
    held = ranged.withColumn(other, F.last(other, True).over(inner)).where(F.col(own).isNotNull())
    joined = held.join(carried, F.col(key_).eqNullSafe(F.col(at)) & (F.col(place) == F.col(f"{place}_")))
    found = F.when(F.col(time_).isNotNull(), F.coalesce(other, ahead))
    return joined.select(F.col(f"{own}.*"), found.alias(name))


def points_in_intervals(intervals: DataFrame, points: DataFrame, start: Column, end: Column, at: Column, base: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of an interval and a point within it (both ends included) with equal ``keys``: structs ``interval``, ``point``.

    ``start``, ``end`` and ``at`` are whole numbers, such as microseconds. An interval is cut into the two or three
    buckets that it touches on the level whose buckets are at least its length (``base`` on the lowest, FAN times as
    wide on each next), a point is in one bucket on each level that some interval uses: an equality join of few copies a
    row, whatever the lengths, which meets each pair once. Intervals without an end, start or key, or that end before
    they start, and points without any of theirs, meet nothing.
    """
    left = intervals.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), start.cast("long").alias("s"), end.cast("long").alias("e"), F.struct(*intervals.columns).alias("interval"))
    left = left.where("s is not null and e >= s")
    steps = F.log((F.col("e") - F.col("s") + 1) / F.lit(base)) / F.log(F.lit(float(FAN)))
    left = left.withColumn("level", F.greatest(F.ceil(steps), F.lit(0)).cast("int"))
    width = lambda level: F.lit(base).cast("long") * F.pow(F.lit(float(FAN)), level).cast("long")
    bucket = lambda t, level: F.floor(t / width(level)).cast("long")
    levels = sorted(r.level for r in left.select("level").distinct().collect())  # a few dozen at most: 8^21 is beyond a long
    cut = left.withColumn("bucket", F.explode(F.sequence(bucket(F.col("s"), F.col("level")), bucket(F.col("e"), F.col("level")))))
    right = points.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), at.cast("long").alias("at"), F.struct(*points.columns).alias("point"))
    used = F.array(*map(F.lit, levels)).cast("array<int>")
    spread = right.where("at is not null").withColumn("level", F.explode(used)).withColumn("bucket", bucket(F.col("at"), F.col("level")))
    joined = cut.join(spread, [f"k{i}" for i in range(len(keys))] + ["level", "bucket"])
    return joined.where("at between s and e").select("interval", "point")
