"""Sketches merged upwards against exact counts and quantiles."""

import random

from pyspark.sql import functions as F

from dossierlake.operators import sketches


def test_merged_sketches_stay_within_their_bounds(spark):
    rng = random.Random(2)
    rows = [(f"p{i % 7}", rng.randint(0, 9000), rng.gauss(0, 10)) for i in range(20_000)] + [("p0", None, None), (None, 1, 1.0), ("only nulls", None, None)]
    made = sketches.sketches(spark.createDataFrame(rows, "p string, d long, v double"), ["p"], F.col("d"), F.col("v"))
    by = {r.p: r for r in sketches.estimates(made, ["p"]).collect()}
    assert by["only nulls"].rows == 1 and by["only nulls"].distinct == 0 and list(by["only nulls"].quantiles) == [None] * 3
    [whole] = sketches.estimates(sketches.merged(made, []), []).collect()
    for found, own in [(whole, rows), (by["p3"], [r for r in rows if r[0] == "p3"]), (by[None], [rows[-2]])]:
        exact, values = len({d for _, d, _ in own if d is not None}), sorted(v for *_, v in own if v is not None)
        assert found.rows == len(own) and abs(found.distinct - exact) <= max(0.5, 4 * sketches.DISTINCT_ERROR * exact)
        for q, value in zip((0.25, 0.5, 0.75), found.quantiles, strict=True):
            under, upto = sum(v < value for v in values) / len(values), sum(v <= value for v in values) / len(values)
            assert under - 3 * sketches.RANK_ERROR <= q <= upto + 3 * sketches.RANK_ERROR
