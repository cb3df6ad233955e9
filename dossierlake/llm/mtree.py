"""Exact top-k by inner product through M-trees.

Components are turned into the integers floor(64 x). Largest inner product is nearest in a metric space: with M the
largest norm of a band of candidates, a candidate c gets one more coordinate, sqrt(M^2 - |c|^2), and a query zero; then
the squared distance is |q|^2 + M^2 - 2 q.c.

Candidates are dealt to bands by their norm (a power of 2 each, so that one huge vector spoils only its own band) and in
a band to shards by the nearest of a few pivots. A shard, or a block of a large one, is an M-tree written once as a
table of pages: a page has a pivot, a covering radius, its distance to the shard's pivot, and entries sorted by their
stored distance to the page's pivot. A query first searches the shard with the best bound, which bounds its k-th score,
then those shards whose covering ball can hold as good a candidate. In a tree every query takes its most promising page
first; pages and entries whose stored distances differ too much from the query's are passed over unseen.

Queries meet a shard in blocks of their own, as many as were sent there, so no group grows with the number of queries or
candidates. Geometry is in doubles, scaled by powers of 2, with slack above their rounding; scores are exact: as doubles
where all products and sums stay below 2**53, else in Python's integers. A score beyond 64 bits counts as the largest or
smallest long.

A query asks once however often its row is repeated; repeated candidates count each. Rows with the query's id are never
its candidates. See ``vectors.usable`` for rows that take no part and for vectors of different lengths.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.vectors import best_of, classes, matrix, usable
from dossierlake.workspace import materialize

SCALE = 64
#: Candidates in a tree, queries that meet it at once, entries of a page, and pivots at most (and one a band).
TREE, QUERIES, PAGE, PIVOTS = 16_000, 8_000, 256, 2048
FAN_OUT = 12
#: Relative slack of distances, far above their rounding errors.
SLACK = 1e-9
LONG = 1 << 63


def bands_of(vectors: np.ndarray) -> np.ndarray:
    """The power of 2 next to each code's norm; that of a zero code is 0."""
    most = np.maximum(np.abs(vectors).max(axis=1, initial=0), 1 / SCALE)
    own = _scaled(vectors, np.frexp(most)[1] + 6)
    norm = np.sqrt((own * own).sum(axis=1))
    with np.errstate(divide="ignore"):
        band = np.rint(np.log2(norm)) + np.frexp(most)[1] + 6
    return np.where(norm > 0, band, 0).astype(np.int64)


def _scaled(vectors: np.ndarray, bands: np.ndarray | int) -> np.ndarray:
    """The codes of vectors over 2 ** bands, exactly."""
    bands = np.broadcast_to(bands, len(vectors))[:, None]
    large = np.abs(vectors) >= 2.0**50  # these are integers already
    return np.where(large, np.ldexp(vectors, 6 - bands), np.ldexp(np.floor(np.where(large, 0, vectors) * SCALE), -bands))


def lift(codes: np.ndarray, top: float) -> np.ndarray:
    """Candidates in the metric space: one more coordinate brings all norms to sqrt(top)."""
    rest = np.sqrt(np.maximum(top - (codes * codes).sum(axis=1), 0))
    return np.concatenate([codes, rest[:, None]], axis=1)


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


def exact_score(query: np.ndarray, candidate: np.ndarray) -> int:
    """The inner product of two vectors' codes, cut to a long."""
    codes = [[int(x) * SCALE if abs(x) >= 2.0**50 else math.floor(x * SCALE) for x in v.tolist()] for v in (query, candidate)]
    return max(-LONG, min(LONG - 1, sum(a * b for a, b in zip(*codes))))


def split(points: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows of points in pages of at most PAGE, each divided by the nearest of a few picks."""
    pages, todo = [], [np.arange(len(points))]
    squares = (points * points).sum(axis=1)
    while todo:
        rows = todo.pop()
        if len(rows) <= PAGE:
            pages.append(rows)
            continue
        picks = rng.choice(rows, min(FAN_OUT, -(-2 * len(rows) // PAGE)), replace=False)
        near = (squares[picks] - 2 * points[rows] @ points[picks].T).argmin(axis=1)
        parts = [rows[near == i] for i in range(len(picks)) if (near == i).any()]
        todo += parts if len(parts) > 1 else np.array_split(rows, FAN_OUT)
    return pages


def build(group: pd.DataFrame, width: int, band: int, top: float, pivot: np.ndarray) -> pd.DataFrame:
    """The pages of one tree: pivot, radius, parent (its distance to the shard's pivot), and entries by stored distance."""
    vectors = np.zeros((len(group), width))
    for i, v in enumerate(group["vector"]):
        vectors[i, : len(v)] = v
    points = lift(_scaled(vectors, band), top)
    ids, counts = group["ids"].tolist(), group["counts"].tolist()
    out = []
    for page, rows in enumerate(split(points, np.random.default_rng(len(group)))):
        center = points[rows].mean(axis=0)
        away = distances(points[rows], center)
        order = np.argsort(away)
        rows, away = rows[order], away[order]
        out.append(
            {
                "page": page,
                "pivot": center.tobytes(),
                "radius": float(away[-1]),
                "parent": float(np.sqrt(((center - pivot) ** 2).sum())),
                "stored": away.tobytes(),
                "vectors": vectors[rows].tobytes(),
                "ids": [ids[r] for r in rows],
                "counts": [counts[r] for r in rows],
            }
        )
    return pd.DataFrame(out)


PAGES = "page long, pivot binary, radius double, parent double, stored binary, vectors binary, ids array<array<long>>, counts array<array<long>>"


class MTree:
    """The pages of one tree, read back. ``seen`` counts the candidates whose own scores were computed."""

    def __init__(self, pages: pd.DataFrame, width: int, band: int, top: float, pivot: np.ndarray):
        self.width, self.band, self.top, self.pivot = width, band, top, pivot
        self.pivots = np.stack([np.frombuffer(x) for x in pages["pivot"]])
        self.radius, self.parent = pages["radius"].to_numpy(), pages["parent"].to_numpy()
        self.stored = [np.frombuffer(x) for x in pages["stored"]]
        self.first = np.cumsum([0, *map(len, self.stored)])
        self.vectors = np.concatenate([np.frombuffer(x).reshape(-1, width) for x in pages["vectors"]])
        self.codes = _scaled(self.vectors, band)
        self.ids = [own for page in pages["ids"] for own in page]
        self.counts = [own for page in pages["counts"] for own in page]
        self.sole = np.array([own[0] if len(own) == 1 else 0 for own in self.ids])
        self.single = np.array([len(own) == 1 for own in self.ids])
        self.seen = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, id, score) of each query's k best candidates; at least all of those that score its floor or more."""
        n, bands = len(queries), bands_of(queries)
        own = _scaled(queries, bands)
        norms = (own * own).sum(axis=1)
        both = bands + self.band
        exact = both <= 51
        error = np.where(exact, 0.0, self.width * 2.0**-50)
        kind = np.float32 if (both <= 22).all() else np.float64
        asked, held = own.astype(kind), self.codes.astype(kind)
        cap = np.ldexp(1.0, np.clip(63 - both, -1000, 1000))
        floors = np.minimum(cap, np.ldexp(floors, -both))

        def reach_of(floor: np.ndarray) -> np.ndarray:
            room = np.maximum(0, norms + self.top - 2 * (np.where(np.isfinite(floor), floor, 0) - error))
            return np.where(np.isfinite(floor), np.sqrt(room) + SLACK * np.sqrt(norms + self.top), np.inf)

        reach = reach_of(floors)
        points = np.concatenate([own, np.zeros((n, 1))], axis=1)
        home = distances(points, self.pivot)
        # a page's own distance is computed only where the stored one to its parent doesn't rule it out
        away = np.full((n, len(self.radius)), np.inf)
        for p in range(len(self.radius)):
            rows = np.flatnonzero(np.abs(home - self.parent[p]) - self.radius[p] <= reach)
            away[rows, p] = distances(points[rows], self.pivots[p])
        lower = away - self.radius
        order = np.argsort(lower, axis=1)
        row, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for turn in range(order.shape[1]):
            page = order[:, turn]
            going = np.flatnonzero(lower[np.arange(n), page] <= reach)
            if not len(going):
                break
            new = [(row, at, score)]
            for p in np.unique(page[going]):
                rows = going[page[going] == p]
                low = np.searchsorted(self.stored[p], (away[rows, p] - reach[rows]).min(), "left")
                high = np.searchsorted(self.stored[p], (away[rows, p] + reach[rows]).max(), "right")
                first = self.first[p] + low
                scores = asked[rows] @ held[first : self.first[p] + high].T
                self.seen += scores.size
                x, y = np.nonzero(scores >= (floors[rows] - error[rows]).astype(kind)[:, None])
                value, x, y = scores[x, y], rows[x], first + y
                mine = ~(self.single[y] & (self.sole[y] == query_ids[x]))
                new.append((x[mine], y[mine], value[mine].astype(np.float64)))
            row, at, score = (np.concatenate(c) for c in zip(*new))
            by = np.lexsort((-score, row))
            row, at, score = row[by], at[by], score[by]
            begin = np.searchsorted(row, np.arange(n))
            full = np.flatnonzero(np.append(begin[1:], len(row)) - begin >= k)
            kth = score[begin[full] + k - 1]
            floors[full] = np.minimum(cap[full], np.maximum(floors[full], kth - error[full]))
            reach = reach_of(floors)
            keep = score >= floors[row] - error[row]
            row, at, score = row[keep], at[keep], score[keep]
        out: list[tuple[int, int, int]] = []
        bounds = np.searchsorted(row, np.arange(n + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            mine, best = int(query_ids[i]), []
            for r, s in zip(at[bounds[i] : bounds[i + 1]].tolist(), score[bounds[i] : bounds[i + 1]].tolist()):
                value = int(math.ldexp(s, int(both[i]))) if exact[i] else exact_score(queries[i], self.vectors[r])
                best += [(-value, j) for j, c in zip(self.ids[r], self.counts[r]) if j != mine for _ in range(min(c, k))]
            out += [(mine, j, -s) for s, j in heapq.nsmallest(k, best)]
        return out


def top_k(vectors: DataFrame, queries: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows of which ``queries`` (a condition on ``id``) is true.

    Every other row is a candidate; one with the query's id never is. Ties go to the smaller id.
    """
    rows = usable(vectors, id_column, vector_column)
    known = classes(rows, k + 1)
    width = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = matrix(b.column("vector"), width)
            bands = bands_of(own)
            square = (_scaled(own, bands) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bands), pa.array(square)], names=[*b.schema.names, "band", "square"])

    schema = "vector array<double>, ids array<long>, counts array<long>"
    known = materialize(known.mapInArrow(measured, f"{schema}, band long, square double"), "vector-classes")
    by_hash = F.struct(F.xxhash64("vector").alias("h"), "vector")
    # one row a band: there are as many as powers of 2 among the norms
    of_band = {r["band"]: r for r in known.groupBy("band").agg(F.max("square").alias("top"), F.min(by_hash).alias("first"), F.count("ids").alias("n")).collect()}
    total = sum(r["n"] for r in of_band.values())
    picked = {(b, tuple(r["first"]["vector"])) for b, r in of_band.items()}
    picked |= {(r["band"], tuple(r["vector"])) for r in known.orderBy(*(by_hash[c] for c in ("h", "vector"))).limit(min(PIVOTS, total // TREE)).select("band", "vector").collect()}
    picked = sorted(picked)
    tops = {b: float(r["top"]) for b, r in of_band.items()}
    owner = np.array([b for b, _ in picked], dtype=np.int64)
    points = np.zeros((len(picked), width + 1))
    for i, (b, v) in enumerate(picked):
        points[i] = lift(_scaled(np.array([[*v, *[0.0] * (width - len(v))]]), b), tops[b])[0]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, bands = matrix(b.column("vector"), width), b.column("band").to_numpy()
            shard, away = np.zeros(len(own), dtype=np.int64), np.zeros(len(own))
            for band in np.unique(bands):
                at, mine = np.flatnonzero(bands == band), np.flatnonzero(owner == band)
                lifted = lift(_scaled(own[at], int(band)), tops[band])
                apart = np.stack([distances(lifted, points[s]) for s in mine], axis=1)
                shard[at], away[at] = mine[apart.argmin(axis=1)], apart.min(axis=1)
            columns = [b.column(c) for c in ("vector", "ids", "counts")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shard), pa.array(away)], names=["vector", "ids", "counts", "shard", "away"])

    held = materialize(known.mapInArrow(nearest, f"{schema}, shard long, away double"), "vector-shards")
    # one row a shard, at most PIVOTS and one a band
    sizes = materialize(held.groupBy("shard").agg(F.max("away").alias("radius"), F.ceil(F.count("ids") / TREE).alias("blocks")), "shard-sizes")
    radius = {r["shard"]: r["radius"] for r in sizes.collect()}
    blocked = held.join(sizes.select("shard", "blocks"), "shard").withColumn("block", F.expr("pmod(xxhash64(vector), blocks)"))

    def pages(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shard, block = int(key[0]), int(key[1])
        band = int(owner[shard])
        return build(group, width, band, tops[band], points[shard]).assign(shard=shard, block=block)

    trees = blocked.select("shard", "block", "vector", "ids", "counts").groupBy("shard", "block")
    trees = materialize(trees.applyInPandas(pages, f"{PAGES}, shard long, block long"), "vector-pages")
    asked = rows.where(queries).groupBy("id", "vector").agg(F.lit(float("-inf")).alias("floor"))
    asked = materialize(asked.select(F.col("id").alias("query_id"), "vector", "floor"), "vector-queries")

    def route(first: bool):
        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = matrix(b.column("vector"), width)
                if not len(own) or not radius:
                    continue
                floors, bands = b.column("floor").to_numpy(zero_copy_only=False), bands_of(own)
                scaled = _scaled(own, bands)
                zero, norms = np.concatenate([scaled, np.zeros((len(own), 1))], axis=1), (scaled * scaled).sum(axis=1)
                bound, reach = np.full((len(own), len(points)), np.inf), np.zeros((len(own), len(points)))
                for s, r in radius.items():
                    top, both = tops[owner[s]], bands + owner[s]
                    bound[:, s] = np.maximum(0, distances(zero, points[s]) - r)
                    low = np.minimum(np.ldexp(1.0, np.clip(63 - both, -1000, 1000)), np.ldexp(floors, -both)) - np.where(both <= 51, 0.0, width * 2.0**-50)
                    room = np.maximum(0, norms + top - 2 * np.where(np.isfinite(low), low, 0))
                    reach[:, s] = np.where(np.isfinite(low), np.sqrt(room) + SLACK * np.sqrt(norms + top), np.inf)
                # the best score that a shard can hold, in the query's own scale
                best = norms[:, None] + np.array([tops[b] for b in owner]) - bound**2
                best = np.where(np.isfinite(bound), np.sign(best) * (np.log2(np.abs(best) + 1e-300) + owner + 1100), -np.inf)
                home = best.argmax(axis=1)
                go = np.zeros_like(bound, dtype=bool)
                go[np.arange(len(own)), home] = True
                x, y = np.nonzero(go if first else ~go & (bound <= reach))
                columns = [b.column(c).take(pa.array(x)) for c in ("query_id", "vector", "floor")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(y)], names=["query_id", "vector", "floor", "shard"])

        return routed

    def searched(questions: DataFrame, first: bool, name: str) -> DataFrame:
        schema = "query_id long, vector array<double>, floor double, shard long"
        sent = materialize(questions.select("query_id", "vector", "floor").mapInArrow(route(first), schema), f"{name}-sent")
        loads = sent.groupBy("shard").agg(F.ceil(F.count("query_id") / QUERIES).alias("parts"))
        shape = materialize(sizes.select("shard", "blocks").join(loads, "shard"), f"{name}-shape")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = trees.join(shape.select("shard", "parts"), "shard").withColumn("part", every("parts"))
        right = sent.join(shape, "shard").withColumn("part", F.expr("pmod(xxhash64(query_id), parts)"))
        right = right.withColumn("block", every("blocks"))
        keys = ["shard", "block", "part"]

        def search(key: tuple, c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            found: list[tuple[int, int, int]] = []
            if len(c) and len(q):
                shard, band = int(key[0]), int(owner[int(key[0])])
                tree = MTree(c.sort_values("page"), width, band, tops[band], points[shard])
                own = np.zeros((len(q), width))
                for i, v in enumerate(q["vector"]):
                    own[i, : len(v)] = v
                found = tree.search(q["query_id"].to_numpy(), own, q["floor"].to_numpy(dtype=np.float64), k)
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

        pairs = left.drop("parts").groupBy(*keys).cogroup(right.drop("parts", "blocks").groupBy(*keys))
        return materialize(pairs.applyInPandas(search, "query_id long, vec_id long, score long"), name)

    home = searched(asked, True, "vector-home")
    bound = best_of(home, k).where(F.col("rank") == k).select(F.col("query_id").alias("of"), "score")
    informed = asked.drop("floor").join(bound, F.col("query_id") == F.col("of"), "left")
    informed = informed.withColumn("floor", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))))
    return best_of(home.unionByName(searched(informed, False, "vector-others")), k)
