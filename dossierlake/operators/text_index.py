"""Search in texts through an index of three-byte grams with their places.

Texts are indexed in blocks of some megabytes, each where it is read: nothing is shuffled, so the index is all that lies
on disks. A posting is a gram, a block, and the places (bytes, in A-Z lower case) where the gram stands in the block, as
differences in bytes of seven bits; a block's files are a posting of the gram ``FILES``. Two zero bytes behind each text
make every byte begin a gram. Postings of a block lie in Parquet in order of gram, so a search reads the row groups of its
grams and no text: a needle's grams at every third byte, and its last one, stand at places that differ by their offsets
exactly where the needle stands. Needles of one or two bytes are a range of grams. Line numbers come from the postings of
the line feed. A file is never cut, so all that a search says of it comes from one block.

Texts of null are empty; repeated files have repeated postings, so they are not allowed, as anywhere in the audit. Other
columns don't come along. A block, or a very long text, is read in memory of some 30 bytes a byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = 0x0A
#: The gram of the row that lists a block's files.
FILES = -1
#: Bytes of text that are indexed together.
BLOCK = 4 << 20
#: Bytes of a row group: what a search reads at least for a gram of a block.
ROW_GROUP = 1 << 20
#: Grams that are looked for one by one in the files' statistics; more are looked for by ranges.
POINTS = 400


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes of seven bits, the last of each without its high bit; and how many each takes."""
    sizes = 1 + (values >= 1 << 7).astype(np.int64) + (values >= 1 << 14) + (values >= 1 << 21) + (values >= 1 << 28)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(5):
        has = sizes > k
        last = sizes[has] == k + 1
        out[ends[has] - sizes[has] + k] = (values[has] >> 7 * k & 0x7F) | np.where(last, 0, 0x80)
    return out, sizes


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 0x80)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    values = np.zeros(len(ends), dtype=np.int64)
    for k in range(5):
        has = starts + k <= ends
        values[has] |= (data[starts[has] + k].astype(np.int64) & 0x7F) << 7 * k
    return values


def block_postings(texts: list[bytes]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(grams, rising; places of each; where each text starts) of texts that are laid one behind another."""
    data = np.frombuffer(b"".join(t + b"\0\0" for t in texts), dtype=np.uint8).astype(np.int32)
    data[(data >= 65) & (data <= 90)] += 32
    lengths = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    own = np.ones(len(data), dtype=bool)
    own[starts + lengths - 1] = own[starts + lengths - 2] = False
    at = np.flatnonzero(own)
    codes = data[at] << 16
    codes |= data[at + 1] << 8
    codes |= data[at + 2]
    both = codes.astype(np.int64) << 32 | at
    del data, codes, at
    both.sort()
    grams, places = (both >> 32).astype(np.int32), both & 0xFFFFFFFF
    del both
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
    steps = np.diff(places, prepend=0)
    steps[first] = places[first]
    content, sizes = packed(steps)
    bounds = np.append(np.append(0, np.cumsum(sizes))[first], len(content)).astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(content)])
    return pa.array(grams[first]), kept, starts


def postings(corpus: DataFrame) -> DataFrame:
    """block, gram, places, files; the rows of a block in order of gram."""
    rows = corpus.select("project_id", "path", "text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, size = [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            grams, places, starts = block_postings(texts)
            columns = [pa.concat_arrays([n.column(c) for n in names]) for c in ("project_id", "path")]
            files = pa.StructArray.from_arrays([*columns, pa.array(starts)], names=["project_id", "path", "start"])
            name = uuid.uuid4().hex
            for g, p, f in ((pa.array([FILES], pa.int32()), pa.array([b""]), pa.ListArray.from_arrays(pa.array([0, len(files)], pa.int32()), files)), (grams, places, None)):
                f = pa.nulls(len(g), pa.list_(files.type)) if f is None else f
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), g, p, f], names=["block", "gram", "places", "files"])

        for batch in batches:
            for at in range(batch.num_rows):
                text = (batch.column("text")[at].as_py() or "").encode()
                if size and size + len(text) > BLOCK:
                    yield from block()
                    names, texts, size = [], [], 0
                names.append(batch.slice(at, 1))
                texts.append(text)
                size += len(text) + 2
        if size:
            yield from block()

    return rows.mapInArrow(indexed, f"block string, gram int, places binary, files array<struct<project_id:{kinds['project_id']},path:{kinds['path']},start:bigint>>")


def build_index(corpus: DataFrame, folder: str, row_group: int = ROW_GROUP) -> None:
    """Write the postings of a corpus (project_id, path, text) to ``folder``, each block in order of gram.

    Where texts are too few for a block a task, fewer tasks take them.
    """
    size = corpus.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    made = postings(corpus.coalesce(size // BLOCK + 1))
    made.write.option("compression", "zstd").option("parquet.block.size", row_group).parquet(folder)


def needle_parts(needle: str) -> list[tuple[int, int, int]]:
    """(lowest gram, highest gram, offset) of each part of a needle; all of them together cover it."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in needle.encode())
    if not data or 0 in data:
        raise ValueError(f"not searchable: {needle!r}")
    if len(data) < 3:
        low = int.from_bytes(data.ljust(3, b"\0"), "big")
        return [(low, low + (1 << 8 * (3 - len(data))) - 1, 0)]
    offsets = sorted({*range(0, len(data) - 2, 3), len(data) - 3})
    return [(g := int.from_bytes(data[o : o + 3], "big"), g, o) for o in offsets]


def grams_within(ranges: Iterable[tuple[int, int]]) -> Column:
    """A test that Parquet's statistics can answer: equalities for single grams, ranges for short needles."""
    merged: list[list[int]] = []
    for low, high in sorted(set(ranges)):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(high, merged[-1][1])
        else:
            merged.append([low, high])
    while len(merged) > POINTS:  # the nearest neighbours become one range; the search leaves out what is between them
        k = min(range(len(merged) - 1), key=lambda i: merged[i + 1][0] - merged[i][1])
        merged[k : k + 2] = [[merged[k][0], merged[k + 1][1]]]
    test = F.lit(False)
    for low, high in merged:
        test = test | (F.col("gram") == low if low == high else F.col("gram").between(low, high))
    return test


def read_grams(spark: SparkSession, folder: str, ranges: Iterable[tuple[int, int]]) -> DataFrame:
    return spark.read.parquet(folder).where(grams_within(ranges))


def places_in_block(grams: np.ndarray, places: pa.Array, parts: list[tuple[int, int, int]]) -> np.ndarray:
    """Rising places where all ``parts`` of a needle stand; ``grams`` rise."""
    found = None
    for low, high, offset in parts:
        own = range(*np.searchsorted(grams, [low, high + 1]))
        each = [np.cumsum(unpacked(np.frombuffer(places[k].as_py(), dtype=np.uint8))) for k in own]
        here = np.sort(np.concatenate(each)) - offset if each else np.zeros(0, dtype=np.int64)
        found = here if found is None else np.intersect1d(found, here, assume_unique=True)
        if not len(found):
            break
    return found


def _search(spark: SparkSession, folder: str, needles: list[str], as_lines: bool) -> DataFrame:
    """A block's postings of all needles meet in one group, which is no larger than the block."""
    parts = {n: needle_parts(n) for n in needles}
    feeds = [(FEED << 16, (FEED + 1 << 16) - 1, 0)]
    ranges = [(low, high) for own in [*parts.values(), feeds if as_lines else []] for low, high, _ in own]
    rows = read_grams(spark, folder, [(FILES, FILES), *ranges])
    each = rows.schema["files"].dataType.elementType
    name = "lines" if as_lines else "places"
    schema = f"needle string, project_id {each['project_id'].dataType.simpleString()}, path {each['path'].dataType.simpleString()}, {name} array<{'long' if as_lines else 'int'}>"
    kind = pa.int64() if as_lines else pa.int32()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(batches).sort_by("gram").combine_chunks()
        grams = block.column("gram").to_numpy()
        files = block.column("files").chunk(0)[0].values
        places, starts = block.column("places").chunk(0), files.field("start").to_numpy()
        ends = places_in_block(grams, places, feeds) if as_lines else None
        for needle, own in parts.items():
            found = places_in_block(grams, places, own)
            if not len(found):
                continue
            at = np.searchsorted(starts, found, "right") - 1
            if as_lines:
                values = np.searchsorted(ends, found, "right") - np.searchsorted(ends, starts, "left")[at] + 1
                new = np.append(True, (at[1:] != at[:-1]) | (values[1:] != values[:-1]))
                at, values = at[new], values[new]
            else:
                values = found - starts[at]
            which, first = np.unique(at, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(values, kind))
            told = files.take(pa.array(which))
            yield pa.RecordBatch.from_arrays([pa.array([needle] * len(which)), told.field("project_id"), told.field("path"), lists], names=["needle", "project_id", "path", name])

    return rows.groupBy("block").applyInArrow(searched, schema)


def find_places(spark: SparkSession, folder: str, needles: list[str]) -> DataFrame:
    """needle, project_id, path, places (bytes, rising) of every file that holds a needle, whatever the case of A-Z.

    ``needles`` is a stated list of distinct texts. An exact intersection.
    """
    return _search(spark, folder, needles, as_lines=False)


def find_lines(spark: SparkSession, folder: str, needles: list[str]) -> DataFrame:
    """needle, project_id, path, lines: the numbers, from 1, of a file's lines that hold the needle."""
    return _search(spark, folder, [n for n in needles if "\n" not in n], as_lines=True)
