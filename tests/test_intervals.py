"""As-of and interval joins against comparing everything with everything, with hot keys, ties, nulls and clashing names."""

import random

from pyspark.sql import functions as F

from dossierlake.operators import intervals


def test_last_before_against_all_pairs(spark):
    rng = random.Random(5)
    key = lambda: rng.choice([1] * 8 + [2, 3, None])
    left = [(i, key(), rng.choice([*range(40), None])) for i in range(400)] + [(7, 1, 20)] * 2
    right = [(i, key(), rng.choice([*range(40), None]), rng.randint(0, 9)) for i in range(150)]
    ours = spark.createDataFrame(left, "__own0 long, k long, t long")
    theirs = spark.createDataFrame(right, "id long, k long, t long, tie long")
    for also_equal in (False, True):
        got = intervals.last_before(ours, theirs, "k", "t", "tie", "hit", also_equal).collect()
        want = []
        for i, k, t in left:
            fits = [(r[2], r[3]) for r in right if None not in (k, t, r[1], r[2]) and r[1] == k and (r[2] < t or also_equal and r[2] == t)]
            want.append((i, k, t, max(fits) if fits else None))
        show = lambda rows: sorted(map(repr, rows))
        assert show((r[0], r.k, r.t, (r.hit.t, r.hit.tie) if r.hit else None) for r in got) == show(want)
    assert intervals.last_before(ours.limit(0), theirs, "k", "t", "tie").count() == 0
    assert intervals.last_before(ours, theirs.limit(0), "k", "t", "tie").where("last is not null").count() == 0


def test_a_hot_key_is_spread_over_ranges(spark):
    rows = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.col("id").alias("tie"))
    found = intervals.last_before(rows, rows, "k", "t", "tie")
    assert found.where("t > 0 and last.t <> t - 1").count() == 0
    assert found.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1


def test_points_in_intervals_against_all_pairs(spark):
    rng = random.Random(6)
    key = lambda: rng.choice(["a"] * 6 + ["b", None])
    spans = []
    for i in range(200):
        s = rng.randint(-5000, 5000)
        spans.append((i, key(), rng.choice([s, s, s, None]), s + rng.choice([-3, 0, 1, 9, 10, 11, 79, 80, 640, 5000, 10**7])))
    points = [(i, key(), rng.choice([*range(-5200, 5200, 7), None])) for i in range(500)]
    left, right = spark.createDataFrame(spans, "id long, k string, s long, level long"), spark.createDataFrame(points, "id long, k string, at long")
    for keys in ((), ("k",)):
        found = intervals.points_in_intervals(left, right, F.col("s"), F.col("level"), F.col("at"), 10, keys)
        got = sorted((r.interval.id, r.point.id) for r in found.collect())
        want = sorted(
            (i, j) for i, k, s, e in spans for j, l, t in points
            if None not in (s, t) and s <= t <= e and (not keys or (k is not None and k == l))
        )
        assert got == want
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.points_in_intervals(left.limit(0), right, F.col("s"), F.col("level"), F.col("at"), 10).count() == 0
