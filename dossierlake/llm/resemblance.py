"""Near-duplicates whose sets of word shingles have a Jaccard similarity of at least ``SHARE``, each link confirmed exactly.

Texts with equal sets are one. Links are proposed by two means. The first are SimHash fingerprints found near through
vantage-point trees (``simhash.links``). Those alone can't give right results here: sets of similarity 0.8 differ in some
10 of 64 bits, far beyond any radius at which trees prune. So of each distinct set ``BANDS`` keys are made besides, each from the least values of ``ROWS`` hash
functions (MinHash). Two sets of similarity s share a key with probability 1 - (1 - s ** ROWS) ** BANDS: at 0.8 all but
one pair in a million do. Keys only propose: a link is made where the sets themselves, compared as wholes, reach the bar.

Sets that share a key or a fingerprint are first compared with the first one that has it, which settles a dense group in as many
comparisons as it has members. Where the members of a key then still lie in different components, all pairs of the sets
that keys connect are compared, apart from those that are joined already. Large groups are cut into blocks by size of
text and every pair of blocks is a group of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import free_name, slices, text_batches
from dossierlake.llm.components import connected_components
from dossierlake.llm.simhash import SEED, fingerprint_of, shingle_hashes
from dossierlake.llm.simhash import links as fingerprint_links
from dossierlake.workspace import materialize

#: The least similarity of a link, as a fraction.
SHARE = (4, 5)
BANDS, ROWS = 60, 7
#: Bits in which near fingerprints differ at most.
RADIUS = 3
#: Characters of text in a block, and what a text counts besides its own.
BLOCK, TEXT = 4_000_000, 8000
#: Shingles that are hashed at once.
STEP = 2048

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted XXH64 values of a text's distinct shingles; none for a text without words."""
    return np.unique(np.array(shingle_hashes(text, words), dtype=np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    """A key for each band, as longs; none for an empty set."""
    if not len(own):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(own), STEP):
        np.minimum(least, (_FACTORS[:, None] * own[None, i : i + STEP]).min(axis=1), out=least)
    raw = [row.tobytes() for row in least.reshape(BANDS, ROWS)]
    return np.array([xxhash.xxh64_intdigest(x, k) for k, x in enumerate(raw)], dtype=np.uint64).view(np.int64).tolist()


def reaches(overlap: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b shingles with so many in common are similar enough."""
    return SHARE[1] * overlap >= SHARE[0] * (a + b - overlap)


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """row, same (equal for equal sets), keys, fingerprint."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            same, keys, prints = [], [], []
            for text in b.column("text").to_pylist():
                hashes = shingle_hashes(text, words)
                own = np.unique(np.array(hashes, dtype=np.uint64))
                same.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                keys.append(band_keys(own))
                prints.append(fingerprint_of(hashes))
            arrays = [b.column("row"), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            arrays.append(pa.array(np.array(prints, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "same", "keys", "fingerprint"])

    return rows.mapInArrow(sketched, "row long, same binary, keys array<long>, fingerprint long")


def near_fingerprints(reps: DataFrame) -> DataFrame:
    """a, b: rows whose fingerprints are equal or near, as a forest of first rows and a star below each."""
    first = materialize(reps.groupBy("fingerprint").agg(F.min("row").alias("first")), "first-fingerprints")
    stars = reps.join(first, "fingerprint").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    near = fingerprint_links(first.select("fingerprint"), RADIUS)
    for end in ("a", "b"):
        named = first.select(F.col("fingerprint").alias(end), F.col("first").alias(f"row_{end}"))
        near = near.join(named, end).drop(end)
    return stars.unionByName(near.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")))


def confirmed(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Those pairs a, b of ``rows`` that are similar enough."""
    both = pairs.join(rows.select(F.col("row").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(rows.select(F.col("row").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = shingle_set(x, words), shingle_set(y, words)
                keep.append(bool(reaches(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compared, "a long, b long")


def compare_all(group: pd.DataFrame, words: int) -> pd.DataFrame:
    """Links that join what is similar in a group: between its two blocks or, where it has one, within it."""
    rows, block = group["row"].to_numpy(), group["block"].to_numpy()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    sets = [shingle_set(t, words) for t in group["text"]]
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    held = np.zeros(int(ids.max()) + 1, dtype=np.int64)
    labels = group["label"].to_numpy()
    out: list[tuple[int, int]] = []
    two = block.min() != block.max()
    for i in np.nonzero(block == block.min())[0]:
        own = ids[starts[i] : starts[i] + sizes[i]]
        held[own] = 1
        near = reaches(np.add.reduceat(held[ids], starts), sizes[i], sizes)
        held[own] = 0
        near &= block != block[i] if two else np.arange(len(rows)) > i
        for j in np.nonzero(near)[0]:
            a, b = root(int(labels[i])), root(int(labels[j]))
            if a != b:
                parent[a] = b
                out.append((int(rows[i]), int(rows[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def links(reps: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """a, b: links that join all rows of ``reps`` (distinct sets) that are similar enough and share a key or fingerprint."""
    buckets = reps.select("row", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("row").alias("n"), F.min("row").alias("first")).where("n > 1")
    members = materialize(buckets.join(shared, "key"), "band-members")
    stars = members.where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    stars = stars.unionByName(near_fingerprints(reps)).distinct()
    direct = materialize(confirmed(stars, rows, words), "direct-links")

    joined = connected_components(direct).withColumnRenamed("node", "row")
    label = F.coalesce("root", "row").alias("label")
    labelled = members.where("n > 2").join(joined, "row", "left").select("key", "row", "first", label)
    labelled = materialize(labelled, "labelled-members")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    left = labelled.join(mixed, "key", "left_semi")
    coarse = connected_components(left.select(F.col("row").alias("a"), F.col("first").alias("b")))
    work = (
        coarse.select(F.col("node").alias("row"), F.col("root").alias("group"))
        .join(joined, "row", "left")
        .select("row", "group", label)
        .join(rows, "row")
    )
    work = materialize(work, "left-members")
    blocks = work.groupBy("group").agg(F.ceil(F.sum(F.length("text") + TEXT) / BLOCK).alias("blocks"))
    block = F.expr("pmod(xxhash64(row), blocks)")
    dealt = (
        work.join(blocks, "group")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        .select("group", "i", "j", "block", "row", "label", "text")
    )
    rest = dealt.groupBy("group", "i", "j").applyInPandas(lambda g: compare_group(g, words), "a long, b long")
    return direct.unionByName(rest)


def compare_group(group: pd.DataFrame, words: int) -> pd.DataFrame:
    """``compare_all`` where there is something to compare: a pair of blocks of which one is empty has nothing."""
    apart = group["i"].iat[0] != group["j"].iat[0]
    if group["label"].nunique() < 2 or (apart and group["block"].nunique() < 2):
        return pd.DataFrame({"a": np.array([], dtype=np.int64), "b": np.array([], dtype=np.int64)})
    return compare_all(group, words)


def one_of_each(docs: DataFrame, words: int = 5, text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group that links join: the first as the table stands when it is written down.

    Texts without words are one group. Rows get keys of their own, so null and repeated ids do no harm. Other columns may
    have any name. An empty table stays empty. A very long text is compared as a whole, in memory at about 100 bytes a word.
    """
    text_batches(docs.sparkSession)
    key = free_name(docs, "__row")
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    rows = keyed.select(F.col(key).alias("row"), F.col(text_column).alias("text"))
    marked = materialize(sketches(rows, words), "sketches")
    firsts = materialize(marked.groupBy("same").agg(F.min("row").alias("row")).select("row"), "distinct-sets")
    reps = marked.select("row", "keys", "fingerprint").join(firsts, "row", "left_semi")
    later = connected_components(links(reps, rows, words)).where("node <> root").select(F.col("node").alias("row"))
    kept = firsts.join(later, "row", "left_anti").withColumnRenamed("row", key)
    return keyed.join(kept, key, "left_semi").drop(key)
