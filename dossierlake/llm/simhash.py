"""SimHash near-duplicates found through vantage-point trees.

A fingerprint has 64 bits; two link when at most ``radius`` bits differ. If they do, then in one of ``PARTS`` equal
parts of the bits at most ``radius // PARTS`` differ, so each part has a vantage-point tree of its own in which the
search radius is that small (over all 64 bits the distances of unrelated texts lie too close together for a radius of
3 to prune anything).

A tree's nodes hold a vantage point and the median distance to it. A fingerprint's home shard is where its own
distances lead. The triangle bound tells which other shards can hold a partner: at a node at distance d, partners lie
between d - r and d + r, so a query goes on to the inner side if d - r <= median and to the outer side if
d + r > median. A pair whose homes part at some node is found by the query from the inner side. The upper levels are
laid out on a bounded sample, which decides only how even shards are; every distinct fingerprint is placed. Shards that
are still crowded are divided again, each by a tree over a sample of its own, until none is or none can be: so shards
multiply with the data. In a shard every query is compared with every member over all 64 bits.

A shard passes on a spanning forest of its links and not all pairs. What no vantage point divides (a dense cluster) is
cut into blocks and every pair of blocks is a group of its own, so no group is unbounded.

A very long text is hashed as a whole, in memory at about 100 bytes a word. Equal fingerprints are one node however many
rows have them, so copies and ties cost nothing more. Other columns, whatever their names, don't come along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.llm.common import slices, text_batches
from dossierlake.llm.components import connected_components
from dossierlake.workspace import materialize

SEED = 42
PARTS = 2
PART_BITS = 64 // PARTS
#: Fingerprints that the upper levels are laid out on, fingerprints a shard should have, levels that a crowded shard is
#: divided by at once, and fingerprints of it that they are laid out on.
TREE_SAMPLE, SHARD, LEVELS, OWN_SAMPLE = 100_000, 1500, 4, 512
#: Members or queries of a shard that are compared in one group at most.
BLOCK = 6000


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 values of the text's word shingles, repeats included.

    A-Z in lower case; words are runs of anything but space and 09 to 0D. A text with fewer words is one shingle; one
    without words has none.
    """
    found = (text or "").encode().lower().split()
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)] if found else []
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[: len(found) - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of the text's word shingles: a bit is 1 if it is set in over half of their hashes; zero without words."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(hashes: list[int]) -> int:
    if not hashes:
        return 0
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, fingerprint as a long with the same 64 bits."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"]
            )

    return rows.mapInArrow(hashed, f"doc_id {kind}, fingerprint long")


def part_of(codes: np.ndarray, part: int) -> np.ndarray:
    return (codes >> np.uint64(part * PART_BITS)) & np.uint64((1 << PART_BITS) - 1)


class VantagePointTree:
    """The upper levels of a balanced tree over one part: node k has children 2 k + 1 (inner) and 2 k + 2 (outer)."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.points = rng.integers(0, 1 << PART_BITS, (1 << depth) - 1, dtype=np.uint64)
        self.medians = np.full(len(self.points), PART_BITS // 2, dtype=np.int16)
        held = {0: sample}
        for node in range(len(self.points)):
            own = held.pop(node)
            if len(own):
                self.points[node] = own[rng.integers(len(own))]
            away = np.bitwise_count(own ^ self.points[node])
            if len(own):
                self.medians[node] = int(np.median(away))
            inner = away <= self.medians[node]
            held[2 * node + 1], held[2 * node + 2] = own[inner], own[~inner]

    @classmethod
    def of(cls, points: np.ndarray, medians: np.ndarray) -> VantagePointTree:
        tree = cls.__new__(cls)
        tree.points, tree.medians, tree.depth = points, medians, int(math.log2(len(points) + 1))
        return tree

    def shards(self, codes: np.ndarray, radius: int, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home) for each home shard and each shard to query, without those that their partners query.

        Rows for which ``home`` is false come as queries only.
        """
        row = np.arange(len(codes))
        node = np.zeros(len(codes), dtype=np.int64)
        home = np.ones(len(codes), dtype=bool) if home is None else home
        for _ in range(self.depth):
            away = np.bitwise_count(codes[row] ^ self.points[node]).astype(np.int16)
            middle = self.medians[node]
            inside = away <= middle
            # off the home path a query follows the triangle bound to both sides; on it, it only leaves outwards
            inner = np.where(home, inside, away - radius <= middle)
            outer = away + radius > middle
            row, home, node = (
                np.concatenate([row[inner], row[outer]]),
                np.concatenate([home[inner], home[outer] & ~inside[outer]]),
                np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2]),
            )
        return row, node - len(self.points), home


PLACED = "shard long, member boolean, fingerprint long, part int"


def divided(placed: DataFrame, radius: int) -> DataFrame:
    """``placed`` with crowded shards divided by trees of their own, again and again while that makes them smaller."""
    rounds, whole = [], F.lit(1 << 62)
    while True:
        sizes = placed.groupBy("shard").agg(F.count_if("member").alias("m"))
        sizes = sizes if not rounds else sizes.join(rounds[-1], "shard")
        before = F.col("before") if rounds else whole
        crowded = materialize(sizes.where((F.col("m") > BLOCK) & (F.col("m") < 0.9 * before)).select("shard", "m"), "vp-crowded")
        if crowded.isEmpty():
            return placed
        in_order = Window.partitionBy("shard").orderBy(F.xxhash64("fingerprint"))
        sample = placed.where("member").join(crowded, "shard", "left_semi").withColumn("rank", F.row_number().over(in_order))

        def laid_out(group: pd.DataFrame) -> pd.DataFrame:
            codes, part = group["fingerprint"].to_numpy().view(np.uint64), int(group["part"].iat[0])
            tree = VantagePointTree(part_of(codes, part), LEVELS, seed=part)
            points, medians = tree.points.view(np.int64).tolist(), tree.medians.tolist()
            return pd.DataFrame({"shard": group["shard"].iloc[:1], "points": [points], "medians": [medians]})

        trees = sample.where(F.col("rank") <= OWN_SAMPLE).select("shard", "fingerprint", "part").groupBy("shard")
        trees = trees.applyInPandas(laid_out, "shard long, points array<long>, medians array<int>")
        trees = materialize(trees.join(crowded, "shard"), "vp-trees")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shard, member, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "member", "part"))
                codes = b.column("fingerprint").to_numpy(zero_copy_only=False)
                for own in np.unique(shard):
                    at = np.flatnonzero(shard == own)
                    points, medians = (np.array(b.column(c)[at[0]].as_py()) for c in ("points", "medians"))
                    tree = VantagePointTree.of(points.view(np.uint64), medians.astype(np.int16))
                    mine = part_of(codes[at].view(np.uint64), int(part[at[0]]))
                    row, child, home = tree.shards(mine, radius, member[at])
                    # equal names of different shards would only make needless comparisons
                    names = [xxhash.xxh64_intdigest(f"{own}/{c}") >> 1 for c in range(1 << LEVELS)]
                    arrays = [pa.array(np.array(names, dtype=np.int64)[child]), pa.array(home), pa.array(codes[at][row])]
                    arrays += [pa.array(part[at][row]), b.column("m").take(pa.array(at[row]))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["shard", "member", "fingerprint", "part", "before"])

        again = placed.join(trees, "shard").mapInArrow(place, f"{PLACED}, before long")
        again = materialize(again, "vp-divided")
        left = placed.join(crowded, "shard", "left_anti").withColumn("before", F.lit(0).cast("long"))
        both = left.unionByName(again)
        rounds.append(both.groupBy("shard").agg(F.max("before").alias("before")))
        placed = both.drop("before")


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """a, b: links that join all fingerprints within ``radius`` bits, directly or through others of their shard."""
    near = radius // PARTS
    total = distinct.count()
    sample = np.array(
        [r[0] for r in distinct.orderBy(F.xxhash64("fingerprint")).limit(TREE_SAMPLE).collect()], dtype=np.int64
    ).view(np.uint64)
    depth = max(0, min(math.ceil(math.log2(max(total, 1) / SHARD)), int(math.log2(max(len(sample), 1) / 8 + 1))))
    trees = [VantagePointTree(part_of(sample, p), depth, seed=p) for p in range(PARTS)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column("fingerprint").to_numpy(zero_copy_only=False)
            for part, tree in enumerate(trees):
                row, shard, home = tree.shards(part_of(codes.view(np.uint64), part), near)
                arrays = [pa.array(shard * PARTS + part), pa.array(home), pa.array(codes[row])]
                arrays.append(pa.array(np.full(len(row), part, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "member", "fingerprint", "part"])

    placed = materialize(distinct.mapInArrow(place, PLACED), "vp-shards")
    placed = divided(placed, near).drop("part")
    # a shard's members and queries are cut into blocks; a group is a block of members and a block of either
    sizes = placed.groupBy("shard").agg(
        F.ceil(F.count_if("member") / BLOCK).alias("m"), F.ceil(F.count_if(~F.col("member")) / BLOCK).alias("q")
    )
    whole = F.sequence(F.lit(0).cast("long"), F.col("m") - 1)
    mine = F.expr("pmod(xxhash64(fingerprint), if(member, m, q))")
    # for members i <= j: as the block that is looked through and as the block that asks
    pairs = F.when(
        F.col("member"),
        F.concat(
            F.transform(whole, lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(True).alias("held"))),
            F.filter(
                F.transform(whole, lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(False).alias("held"))),
                lambda x: x.i < x.j,
            ),
            F.transform(
                F.when(F.col("q") > 0, F.sequence(F.lit(1).cast("long"), F.col("q"))).otherwise(
                    F.array().cast("array<long>")
                ),
                lambda j: F.struct(mine.alias("i"), (-j).alias("j"), F.lit(True).alias("held")),
            ),
        ),
    ).otherwise(
        F.transform(whole, lambda i: F.struct(i.alias("i"), (-1 - mine).alias("j"), F.lit(False).alias("held")))
    )
    dealt = (
        placed.join(sizes.where("m > 0"), "shard")
        .select("shard", "fingerprint", F.explode(pairs).alias("p"))
        .select("shard", "p.i", "p.j", "p.held", "fingerprint")
        .where("held or j < 0 or i < j")
        .where("not (held and j >= 0 and i > j)")
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        held = group["held"].to_numpy()
        codes = group["fingerprint"].to_numpy()
        return forest(codes[held], codes[~held] if not held.all() else None, radius)

    return dealt.groupBy("shard", "i", "j").applyInPandas(compare, "a long, b long")


def forest(members: np.ndarray, asking: np.ndarray | None, radius: int) -> pd.DataFrame:
    """A spanning forest of the links among ``members``, or of those from ``asking`` to them."""
    among = asking is None
    other = members if among else asking
    m, q = members.view(np.uint64), other.view(np.uint64)
    nodes = members if among else np.concatenate([members, asking])
    base = 0 if among else len(m)
    label, out = np.arange(len(nodes)), [np.zeros((0, 2), dtype=np.int64)]
    step = max(1, 2_000_000 // max(1, len(m)))
    for i in range(0, len(q), step):
        x, y = np.nonzero(np.bitwise_count(q[i : i + step, None] ^ m[None]) <= radius)
        x = x + i + base
        while True:
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            apart = low < high
            if not apart.any():
                break
            x, y, low, high = x[apart], y[apart], low[apart], high[apart]
            # each label hangs itself once under a smaller one, so these links make no circle
            _, first = np.unique(high, return_index=True)
            out.append(np.stack([nodes[x[first]], nodes[y[first]]], axis=1))
            under = np.arange(len(nodes))
            under[high[first]] = low[first]
            while (under[under] != under).any():
                under = under[under]
            label = under[label]
    return pd.DataFrame(np.concatenate(out), columns=["a", "b"])


def near_duplicates(
    docs: DataFrame, words: int = 5, radius: int = 3, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id that links lead to, the own one included.

    Texts without words have fingerprint zero and link like any other. Null ids take part and never name a component
    of others; a component of null ids alone has a null component_id. Repeated rows stay repeated.
    """
    marked = materialize(fingerprints(docs, words, id_column, text_column), "fingerprints")
    distinct = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    distinct = materialize(distinct, "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fingerprint"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fingerprint"), "component_id")
    return marked.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
