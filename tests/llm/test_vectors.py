"""Searches against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import kmeans_tree, mtree


def rows_of(rng, n, dims=8):
    data = rng.normal(size=(n, dims)) * rng.choice([0.2, 1, 3], (n, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(n + i, data[7].tolist()) for i in range(60)]  # many copies of one vector
    rows += [(5000, None), (5020, [1.0, None] * (dims // 2)), (5040, [float("nan")] * dims), (5060, [float("inf")] * dims)]
    rows += [(5080, [0.0] * dims), (5100, [1.0]), (None, [1.0] * dims), (5120, []), rows[3]]
    return rows


def usable(rows, dims=8, zero=True):
    """(id, vector) of the rows that take part, zeros behind shorter vectors."""
    out = []
    for i, v in rows:
        if i is None or v is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        if zero or any(v):
            out.append((i, np.array([*v, *[0.0] * (dims - len(v))])))
    return out


def plain(vectors, wanted, score, k):
    """(query, rank, candidate, score): queries once, candidates as often as they come."""
    found = []
    for q, own in dict((i, v) for i, v in vectors if wanted(i)).items():
        best = sorted((-score(own, v), i) for i, v in vectors if i != q)[:k]
        found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(found)


def code(v):
    return [int(x) * 64 if abs(x) > 2**50 else int(np.floor(x * 64)) for x in v.tolist()]


def inner(a, b):
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(code(a), code(b)))))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")


@pytest.mark.parametrize(("tree", "page", "queries"), [(16_000, 256, 8_000), (60, 12, 7)])
def test_exact_search_is_exact(spark, monkeypatch, tree, page, queries):
    for name, value in (("TREE", tree), ("PAGE", page), ("QUERIES", queries)):
        monkeypatch.setattr(mtree, name, value)
    rows = rows_of(np.random.default_rng(1), 400)
    got = mtree.top_k(frame(spark, rows), F.col("id") % 20 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == plain(usable(rows), lambda q: q % 20 == 0, inner, 5)


@pytest.mark.parametrize("sizes", [[1e9], [2.0**21], [1.0, 1e9, 1e17, 1e200], [1e-300, 1e-3, 1.7e308, 1e4]])
def test_scores_of_large_components_are_exact(spark, monkeypatch, sizes):
    for name, value in (("TREE", 100), ("PAGE", 16)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(5)
    data = rng.uniform(-1, 1, (300, 6)) * rng.choice(sizes, (300, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [rows[3]] * 8 + [rows[20]] * 3 + [(500 + i, rows[40][1]) for i in range(12)]
    got = mtree.top_k(frame(spark, rows), F.col("id") % 20 == 0, 6).collect()
    assert sorted(tuple(r) for r in got) == plain(usable(rows, 6), lambda q: q % 20 == 0, inner, 6)


def test_tree_passes_over_most_of_clustered_data():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 8)) * 100
    vectors = (np.repeat(centers, 200, axis=0) + rng.normal(size=(8000, 8))) / 64
    band = int(mtree.bands_of(vectors).max())
    top = float((mtree._scaled(vectors, band) ** 2).sum(axis=1).max())
    group = pd.DataFrame({"vector": list(vectors), "ids": [[i] for i in range(8000)], "counts": [[1]] * 8000})
    pivot = np.zeros(9)
    tree = mtree.MTree(mtree.build(group, 8, band, top, pivot), 8, band, top, pivot)
    codes = np.floor(vectors * 64)
    found = tree.search(np.array([17]), vectors[17:18], np.array([-np.inf]), 5)
    assert [s for _, _, s in found] == sorted(np.delete(codes @ codes[17], 17).astype(int).tolist())[-5:][::-1]
    assert tree.seen < 8000 / 2


def test_fewer_candidates_than_asked_for(spark):
    got = mtree.top_k(frame(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5])]), F.col("id") % 20 == 0, 20).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 96)] or [tuple(r) for r in got] == [(0, 1, 1, 64 * 32 + 128 * 32)]


@pytest.mark.parametrize("search", [mtree.top_k, kmeans_tree.nearest])
def test_empty_tables(spark, search):
    assert search(frame(spark, []), F.col("id") % 20 == 0, 5).count() == 0
    assert search(frame(spark, [(1, None)]), F.col("id") % 20 == 0, 5).count() == 0


def cosine(a, b):
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


@pytest.mark.parametrize(("leaf", "block"), [(150, 20_000), (12, 25)])
def test_nearest_reaches_its_recall(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(kmeans_tree, "LEAF", leaf)
    monkeypatch.setattr(kmeans_tree, "BLOCK", block)
    rows = rows_of(np.random.default_rng(4), 1500)
    got = kmeans_tree.nearest(frame(spark, rows), F.col("id") % 50 == 0, 5).collect()
    vectors = dict(usable(rows, zero=False))
    want = plain(usable(rows, zero=False), lambda q: q % 50 == 0, cosine, 5)
    best = {}
    for q, _, i, s in want:
        best.setdefault(q, {})[i] = s
    hits = 0
    for r in got:
        assert r.score == pytest.approx(cosine(vectors[r.query_id], vectors[r.vec_id]), abs=1e-12)
        hits += r.vec_id in best[r.query_id]
    assert hits >= 0.9 * len(want)
    for q in best:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
