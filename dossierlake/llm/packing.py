"""Packing token sequences by column generation for the cutting-stock problem.

A document's ids are cut into pieces of ``CAPACITY`` and a rest. Full pieces fill a sequence each. The rests' lengths
are rounded up to classes of ``UNIT`` ids, and the histogram of classes (``CAPACITY / UNIT`` numbers, whatever the
corpus) is all that reaches the driver. There a linear program chooses how often to use each pattern of classes: its
columns are priced by a knapsack dynamic program over the classes' dual values until none would lower the number of
sequences. Counts are rounded down, and the few rests left over are placed first-fit by decreasing length. Documents
are ranked within their class on Spark, and the rank gives the sequence.

Rests of one length are ranked by their piece's number, which follows the order in which the table is read: a rerun may
give equal rests each other's places, but never other sequences. A null or empty text is its end id alone, a repeated
row a document of its own, and an empty table has no sequences. A very long text is encoded piece by piece, in memory at
about 5 bytes a character. Other columns, whatever their names, don't come along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.llm.common import slices, text_batches
from dossierlake.llm.tokenizing import MEMORY, shared_tokenizer
from dossierlake.workspace import materialize

CAPACITY, UNIT = 2048, 8
#: Rests ranked in one group: a class is dealt to as many groups as its table needs.
GROUP = 20_000
#: The program also stops this near the bound that total length sets, or after so many columns.
GAP, COLUMNS = 1e-4, 6000


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of items of sizes 1..len(values) with total size at most ``capacity``: value and counts."""
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        n = min(c, len(values))
        options = best[c - n : c][::-1] + values[:n]
        k = int(options.argmax())
        best[c], taken[c] = (options[k], k + 1) if options[k] > best[c - 1] else (best[c - 1], 0)
    counts, c = np.zeros(len(values), dtype=np.int64), capacity
    while c > 0:
        if taken[c]:
            counts[taken[c] - 1] += 1
        c -= taken[c] or 1
    return float(best[capacity]), counts


def pattern_counts(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many of each class, classes being sizes 1..len(demand)) and how often each is used.

    Together they hold every class at least as often as ``demand`` says.
    """
    present = np.flatnonzero(demand)
    if not len(present):
        return []
    sizes = present + 1
    need = demand[present].astype(np.float64)
    m = len(present)
    # to begin with, a pattern for each class: as many of it as fit
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(m)]
    inverse = np.diag(1.0 / (capacity // sizes))
    level = inverse @ need
    bound = float((need * sizes).sum() / capacity)
    values = np.zeros(len(demand))
    for _ in range(COLUMNS):
        if level.sum() <= bound * (1 + GAP):
            break
        duals = inverse.sum(axis=0)
        values[present] = np.maximum(duals, 0)
        worth, counts = knapsack(values, capacity)
        if worth <= 1 + 1e-9:
            break
        column = counts[present]
        direction = inverse @ column
        positive = direction > 1e-9
        ratios = np.where(positive, level / np.where(positive, direction, 1), np.inf)
        out = int(ratios.argmin())
        level = np.maximum(level - ratios[out] * direction, 0)
        level[out] = ratios[out]
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        columns[out] = column
    left = demand.astype(np.int64).copy()
    used = []
    for column, x in sorted(zip(columns, level), key=lambda c: -c[1]):
        times = int(x + 1e-9)
        hit = column > 0
        if times and hit.any():
            times = min(times, int((left[present][hit] // column[hit]).min()))
        if times:
            pattern = np.zeros(len(demand), dtype=np.int64)
            pattern[present] = column
            left -= times * pattern
            used.append((pattern, times))
    return used + first_fit(left, capacity)


def first_fit(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """First-fit decreasing over counts of classes."""
    rooms: list[int] = []
    patterns: list[np.ndarray] = []
    for k in range(len(left) - 1, -1, -1):
        first = 0
        for _ in range(int(left[k])):
            first = next((i for i in range(first, len(rooms)) if rooms[i] >= k + 1), len(rooms))
            if first == len(rooms):
                rooms.append(capacity)
                patterns.append(np.zeros(len(left), dtype=np.int64))
            rooms[first] -= k + 1
            patterns[first][k] += 1
    return [(p, 1) for p in patterns]


@dataclass
class Layout:
    """For each class: from which rank on which pattern's sequences take its documents. Bounded by the classes."""

    #: By class: arrays of first rank, copies in a sequence, the pattern's first sequence, the first slot in it.
    by_class: dict[int, np.ndarray]
    sequences: int

    @classmethod
    def of(cls, demand: np.ndarray, capacity: int) -> Layout:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks = np.zeros(len(demand), dtype=np.int64)
        sequence = 0
        for pattern, times in pattern_counts(demand, capacity):
            slot = 0
            for k in np.flatnonzero(pattern).tolist():
                rows.setdefault(k + 1, []).append((int(ranks[k]), int(pattern[k]), sequence, slot))
                ranks[k] += times * pattern[k]
                slot += int(pattern[k])
            sequence += times
        return cls({k: np.array(v, dtype=np.int64) for k, v in rows.items()}, sequence)

    def place(self, kind: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of the documents of these classes and ranks."""
        sequence, slot = np.zeros(len(kind), dtype=np.int64), np.zeros(len(kind), dtype=np.int64)
        for k in np.unique(kind):
            at = np.flatnonzero(kind == k)
            rows = self.by_class[int(k)]
            own = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
            past = rank[at] - own[:, 0]
            sequence[at] = own[:, 2] + past // own[:, 1]
            slot[at] = own[:, 3] + past % own[:, 1]
        return sequence, slot


def tokenized_pieces(
    docs: DataFrame,
    tokenizer: str,
    drops_blanks: bool,
    end_id: int,
    id_column: str,
    text_column: str,
    capacity: int,
    memory: int = MEMORY,
    id_bytes: int = 4,
) -> DataFrame:
    """piece, doc_id, start, length, doc_tokens, ids (little-endian, ``id_bytes`` each), written once.

    Every row of ``docs`` is a document of its own, also where an id repeats or is null; a null text has the end id.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            encoder = shared_tokenizer(tokenizer, drops_blanks, memory)
            ending = np.uint32(end_id).tobytes()
            encoded = [ids + ending for ids in encoder.encode(batch.column("text").to_pylist())]
            if id_bytes == 2:
                encoded = [np.frombuffer(ids, "<u4").astype("<u2").tobytes() for ids in encoded]
            counts = np.array([len(e) // id_bytes for e in encoded], dtype=np.int64)
            parts = -(-counts // capacity)
            owner = np.repeat(np.arange(len(encoded)), parts)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
            length = np.minimum(capacity, counts[owner] - start)
            spans = zip(owner.tolist(), (start * id_bytes).tolist(), (length * id_bytes).tolist())
            ids = [encoded[o][s : s + n] for o, s, n in spans]
            arrays = [batch.column("doc_id").take(pa.array(owner)), *map(pa.array, (start, length, counts[owner]))]
            names = ["doc_id", "start", "length", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.binary())], names=names)

    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids binary"
    pieces = rows.mapInArrow(cut, schema).withColumn("piece", F.monotonically_increasing_id())
    return materialize(pieces, "pieces")


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """piece, sequence_id, offset for a table with piece (unique) and length (1..capacity).

    Lengths alone move here. Sequence ids are unique; those of patterns come first, then those of full pieces.
    """
    kind = F.ceil(F.col("length") / unit).cast("long")
    rests = pieces.where(F.col("length") < capacity).select("piece", "length", kind.alias("kind"))
    counted = rests.groupBy("kind").count().collect()  # capacity / unit rows at most
    demand = np.zeros(-(-capacity // unit), dtype=np.int64)
    for row in counted:
        demand[row["kind"] - 1] = row["count"]
    layout = Layout.of(demand, capacity // unit)

    groups = int(demand.sum()) // GROUP + 1
    dealt = rests.withColumn("part", F.expr(f"pmod(xxhash64(piece), {groups})"))
    earlier = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("kind", "part").count().select("kind", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    )
    within = F.row_number().over(Window.partitionBy("kind", "part").orderBy("piece")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["kind", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, ranks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "rank"))
            sequence, slot = layout.place(kinds, ranks)
            arrays = [b.column("piece"), b.column("length"), pa.array(sequence), pa.array(slot)]
            yield pa.RecordBatch.from_arrays(arrays, names=["piece", "length", "sequence_id", "slot"])

    placed = ranked.select("piece", "length", "kind", (F.col("within") + F.col("before")).alias("rank")).mapInArrow(
        place, "piece long, length long, sequence_id long, slot long"
    )
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(ahead), F.lit(0).cast("long"))
    full = pieces.where(F.col("length") == capacity).select(
        "piece", (F.col("piece") + layout.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.select("piece", "sequence_id", offset.alias("offset")).unionByName(full)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    drops_blanks: bool,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    memory: int = MEMORY,
    id_bytes: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """The pieces with their ids, and where each lies. Join them on ``piece`` for the packed sequences.

    ``id_bytes`` is 2 or 4; two do for tokenizers of up to 65,536 ids and halve what is written and shuffled.
    """
    pieces = tokenized_pieces(docs, tokenizer, drops_blanks, end_id, id_column, text_column, capacity, memory, id_bytes)
    return pieces, place_pieces(pieces.select("piece", "length"), capacity)
