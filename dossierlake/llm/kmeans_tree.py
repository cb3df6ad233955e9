"""Approximate nearest neighbours by cosine through a hierarchical k-means tree.

The tree is fitted to unit vectors of a bounded sample: each node splits its part by k-means into ``BRANCHES``. Every
row is indexed under its nearest child at each level. A query goes through the tree best bin first, with a priority
queue of nodes by distance to their centroids, and visits so many leaves as calibration asked for: for a sample of the
queries true neighbours are computed over all rows, and visits widen until ``RECALL`` of them lie in visited leaves.
Scores are exact cosines of the original vectors.

See ``vectors.usable`` for rows that take no part and for different lengths; zero vectors take no part either. Equal
vectors are one class. A query asks once however often its row is repeated; repeated candidates count each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.vectors import best_of, classes, matrix, usable
from dossierlake.workspace import materialize

#: Vectors the tree is fitted to, children of a node, and vectors a leaf should hold.
SAMPLE, BRANCHES, LEAF = 60_000, 16, 150
#: Queries that visits are calibrated on, and the share of their true neighbours to be found.
CALIBRATION, RECALL = 300, 0.95
#: Neighbouring leaves that are searched in one group, and vectors and queries of a group at most.
BUNDLE, BLOCK = 16, 20_000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaling first keeps extreme components from overflowing."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Cosine of ``query`` with each row, summed in the same order for every row so that equal rows get equal scores."""
    a, b = query / np.abs(query).max(), candidates / np.abs(candidates).max(axis=1, keepdims=True)
    return (b * a).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum()))


class KMeansTree:
    """Nodes in arrays: centroids, first child (0: a leaf) and number of children; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaf: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        width = sample.shape[1] if sample.ndim == 2 else 1
        self.centroids = [np.zeros(width)]
        self.first, self.count = [0], [0]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= 1.5 * leaf:
                continue
            # the last split makes no more children than leaves are needed
            centers = self._cluster(sample[rows], min(BRANCHES, max(2, round(len(rows) / leaf))), rng)
            owner = self._nearest(sample[rows], centers)
            parts = [rows[owner == i] for i in range(len(centers)) if (owner == i).any()]
            if len(parts) < 2:
                continue
            self.first[node], self.count[node] = len(self.first), len(parts)
            for part in parts:
                todo.append((len(self.first), part))
                self.centroids.append(sample[part].mean(axis=0))
                self.first.append(0)
                self.count.append(0)
        self.centroids = np.array(self.centroids)
        self.first, self.count = np.array(self.first), np.array(self.count)
        self.leaf_of = np.cumsum(self.count == 0) - 1
        self.leaves = int((self.count == 0).sum())

    @staticmethod
    def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
        return ((centers * centers).sum(axis=1) - 2 * rows @ centers.T).argmin(axis=1)

    @classmethod
    def _cluster(cls, rows: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
        centers = rows[rng.choice(len(rows), min(parts, len(rows)), replace=False)]
        for _ in range(rounds):
            owner = cls._nearest(rows, centers)
            sums = np.zeros_like(centers)
            np.add.at(sums, owner, rows)
            counts = np.bincount(owner, minlength=len(centers))
            centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        return centers

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(rows), dtype=np.int64)
        while (self.count[node] > 0).any():
            for n in np.unique(node[self.count[node] > 0]):
                at = np.flatnonzero(node == n)
                first, count = self.first[n], self.count[n]
                node[at] = first + self._nearest(rows[at], self.centroids[first : first + count])
        return self.leaf_of[node]

    def visit(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves, best bin first."""
        heap, found = [(0.0, 0)], []
        while heap and len(found) < leaves:
            _, node = heapq.heappop(heap)
            if not self.count[node]:
                found.append(int(self.leaf_of[node]))
                continue
            children = range(self.first[node], self.first[node] + self.count[node])
            away = ((self.centroids[children.start : children.stop] - query) ** 2).sum(axis=1)
            for d, child in zip(away.tolist(), children, strict=True):
                heapq.heappush(heap, (d, child))
        return found


def compare(
    query_ids: list[int], queries: np.ndarray, candidates: np.ndarray, ids: list[list[int]], counts: list[list[int]], k: int
) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine) of the k best candidates of each query."""
    out: list[tuple[int, int, float]] = []
    ready = unit(candidates)
    sole = np.array([own[0] if len(own) == 1 else 0 for own in ids])
    single = np.array([len(own) == 1 for own in ids])
    for i in range(0, len(queries), 256):
        rough = unit(queries[i : i + 256]) @ ready.T
        for query_id, query, scores in zip(query_ids[i : i + 256], queries[i : i + 256], rough, strict=True):
            scores[single & (sole == query_id)] = -np.inf  # the query's own rows alone
            # rough scores are right to far less than the margin
            floor = np.partition(scores, -k)[-k] - 1e-9 if len(scores) > k else -np.inf
            near = np.flatnonzero((scores >= floor) & (scores > -np.inf))
            exact = cosines(query, candidates[near])
            own = [
                (-s, j)
                for r, s in zip(near.tolist(), exact.tolist(), strict=True)
                for j, c in zip(ids[r], counts[r])
                if j != query_id
                for _ in range(min(c, k))
            ]
            out += [(query_id, j, -s) for s, j in heapq.nsmallest(k, own)]
    return out


def _calibrated(held: DataFrame, queries: DataFrame, tree: KMeansTree, k: int, width: int) -> int:
    """Leaves to visit so that at least RECALL of the sample's true neighbours are found among ``held``, all rows."""
    rows = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).collect()
    if not rows:
        return 1
    ids, vectors = [r["query_id"] for r in rows], np.array([[*r["vector"], *[0.0] * (width - len(r["vector"]))] for r in rows])

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = b.column("ids").to_pylist()
                leaf_of = {i: leaf for each, leaf in zip(own, b.column("leaf").to_pylist()) for i in each}
                found = compare(ids, vectors, matrix(b.column("vector"), width), own, b.column("counts").to_pylist(), k)
                columns = [[f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [leaf_of[f[1]] for f in found]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                    names=["query_id", "vec_id", "score", "leaf"],
                )

    found = held.select("vector", "ids", "counts", "leaf").mapInArrow(true, "query_id long, vec_id long, score double, leaf long")
    leaves: dict[int, list[int]] = {}
    for r in best_of(found, k).collect():  # CALIBRATION * k rows
        leaves.setdefault(r["query_id"], []).append(r["leaf"])
    places = []
    for query_id, vector in zip(ids, unit(vectors), strict=True):
        order = {leaf: place for place, leaf in enumerate(tree.visit(vector, tree.leaves))}
        places += [order[leaf] for leaf in leaves.get(query_id, [])]
    if not places:
        return 1
    return int(np.quantile(places, RECALL, method="higher")) + 1


def nearest(vectors: DataFrame, queries: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, visited for the rows of which ``queries`` (a condition on ``id``) is true.

    visited: the leaves that each query's search went to. One with the query's id is never a candidate.
    """
    rows = usable(vectors, id_column, vector_column).where(F.exists("vector", lambda x: x != 0))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    known = materialize(classes(rows, k + 1), "vector-classes")
    total = known.count()
    sample = known.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).select("vector").toArrow()
    fitted = unit(matrix(sample["vector"], width)) if sample.num_rows else np.zeros((0, 1))
    tree = KMeansTree(fitted, max(4.0, LEAF * len(fitted) / max(total, 1)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.assign(unit(matrix(b.column("vector"), width))) if b.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], names=[*b.schema.names, "leaf"])

    held = materialize(known.mapInArrow(index, "vector array<double>, ids array<long>, counts array<long>, leaf long"), "vector-leaves")
    asked = rows.where(queries).groupBy("id", "vector").count().select(F.col("id").alias("query_id"), "vector")
    asked = materialize(asked, "vector-queries")
    visits = _calibrated(held, asked, tree, k, width)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, bundles, leaves = [], [], []
            for i, v in enumerate(unit(matrix(b.column("vector"), width))) if b.num_rows else ():
                own: dict[int, list[int]] = {}
                for leaf in tree.visit(v, visits):
                    own.setdefault(leaf // BUNDLE, []).append(leaf)
                at += [i] * len(own)
                bundles += own.keys()
                leaves += own.values()
            columns = [b.column("query_id").take(pa.array(at, pa.int64())), b.column("vector").take(pa.array(at, pa.int64()))]
            columns += [pa.array(bundles, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vector", "bundle", "leaves"])

    sent = asked.mapInArrow(send, "query_id long, vector array<double>, bundle long, leaves array<long>")
    bundled = held.withColumn("bundle", F.expr(f"leaf div {BUNDLE}"))
    sizes = bundled.groupBy("bundle").agg(F.ceil(F.count("ids") / BLOCK).alias("blocks"))
    loads = sent.groupBy("bundle").agg(F.ceil(F.count("query_id") / BLOCK).alias("parts"))
    shape = materialize(sizes.join(loads, "bundle"), "bundle-shapes")
    block, part = (F.expr(f"pmod(xxhash64({c}), {n})") for c, n in (("vector", "blocks"), ("query_id", "parts")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = bundled.join(shape, "bundle").withColumn("block", block).withColumn("part", every("parts"))
    right = sent.join(shape, "bundle").withColumn("part", part).withColumn("block", every("blocks"))
    keys = ["bundle", "block", "part"]

    def stacked(column: pd.Series) -> np.ndarray:
        return matrix(pa.array(column, pa.list_(pa.float64())), width)

    def search(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, list[tuple[float, int]]] = {}
        if len(c) and len(q):
            asking: dict[int, list[int]] = {}
            for i, own in enumerate(q["leaves"]):
                for leaf in own:
                    asking.setdefault(int(leaf), []).append(i)
            vectors, ids = stacked(q["vector"]), q["query_id"].to_numpy()
            for leaf, rows in c.groupby("leaf"):
                at = asking.get(int(leaf), [])
                if at:
                    own = rows["ids"].tolist(), rows["counts"].tolist()
                    for query_id, vec_id, score in compare(ids[at].tolist(), vectors[at], stacked(rows["vector"]), *own, k):
                        best.setdefault(query_id, []).append((-score, vec_id))
        found = [(i, j, -s) for i, own in best.items() for s, j in heapq.nsmallest(k, own)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    left, right = left.select(*keys, "leaf", "vector", "ids", "counts"), right.select(*keys, "query_id", "vector", "leaves")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    return best_of(found, k).withColumn("visited", F.lit(visits))
