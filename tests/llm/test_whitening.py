"""Whitening against numpy over all rows at once."""

import duckdb
import numpy as np
import pytest
from oracle import SMALL
from pyspark.sql import Row

from dossierlake.llm import registry, whitening


def check(got, ids, entries, components=32):
    n, sums = len(entries), entries.sum(axis=0)
    centred = entries - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, len(values))
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, k + 1) for i in ids for k in range(kept))
    want = centred @ vectors[:, :kept] / np.sqrt(values[:kept])
    places = {i: k for k, i in enumerate(ids)}
    exact = [sum(int(d) ** 2 for d in n * row - sums) for row in entries]
    signs = {}
    for r in got:
        row = places[r.vec_id]
        assert r.n == n and r.deviation == exact[row]
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        expected = want[row, r.component - 1]
        sign = signs.setdefault(r.component, np.sign(expected * r.whitened)) if abs(expected) > 0.1 else None
        assert abs(abs(r.whitened) - abs(expected)) < 1e-6 and (sign is None or sign == np.sign(expected * r.whitened))
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9


def test_query_against_numpy(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet'").fetchall()
    entries = np.floor(64 * np.array([r[1] for r in rows], dtype=np.float64)).astype(np.int64) + 1_000_000
    check(registry.QUERIES["op12_whitening"](spark, SMALL).collect(), [r[0] for r in rows], entries)


def test_tiles_add_up_to_one_aggregation(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 7), float(i % 5), float(i)) for i in range(50)], "a double, b double, c double")
    whole = whitening.second_moments(rows, ["a", "b", "c"])
    monkeypatch.setattr(whitening, "PAIRS", 2)
    data = np.array([tuple(r) for r in rows.collect()])
    assert np.allclose(whole, data.T @ data) and np.allclose(whitening.second_moments(rows, ["a", "b", "c"]), whole)


def test_rows_without_a_vector_short_ones_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, -2.0]), (2, [1.5, -1.0]), (3, []), (None, [0.25, 0.25, 9.0]), (7, [3.0, 2.0, 1.0]), (8, None), (9, [None, 1.0]), (10, [nan, 1.0]), (11, [inf])]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, white double")
    got = whitening.whiten(frame).collect()
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    entries = np.array([[np.floor(64 * x) for x in v] + [0.0] * (3 - len(v)) for _, v in kept]).astype(np.int64) + 1_000_000
    names = {None: -1}
    named = [Row(**(r.asDict() | {"vec_id": names.get(r.vec_id, r.vec_id)})) for r in got]
    check(named, [names.get(i, i) for i, _ in kept], entries)
    again = whitening.whiten(spark.createDataFrame([(5, [1.0, 2.0])] * 3 + [(5, [2.0, 4.0])], "vec_id long, embedding array<double>")).collect()
    assert len(again) == 4 and {r.component for r in again} == {1} and len({r.whitened for r in again}) == 2


def test_nothing_to_whiten_and_entries_beyond_a_long(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 2, kind)).count() == 0
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], kind)).collect()
    assert {r.vec_id for r in far} == {1, 2, 3} and {r.vec_id for r in far if r.deviation is None} == {1, 2}
    assert all(np.isfinite(r.whitened) for r in far)
