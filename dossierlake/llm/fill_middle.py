"""Fill-in-middle: a text's units are found by an automaton, and its middle goes behind its suffix.

A unit is a run of blanks (space, 09 to 0D) with the word behind it, or blanks alone at the end of a text. So a unit
ends where a blank follows a word: an automaton of three states over UTF-8 bytes sees it, and n is its count of such
ends and one more. It runs in parallel. A chunk of a text, not knowing what stands before it, gives a function: for each
state that it may be entered in, the state that it is left in and the units that end within it. Such functions compose
associatively, so a prefix scan over a text's chunks resolves every chunk's entry state and how many units end before
it; then the one chunk that holds a wanted end looks for it.

Texts up to ``CHUNK`` bytes are one chunk, entered in the first state, so both their cuts are found where they lie:
no shuffle. Longer ones are written as chunks that all cores share (any bytes, also within a character: its further
bytes count as part of a word and not as code points). Only numbers of them are grouped: a row of Spark holds 2 GiB at
most, so at most 32,768 functions a text. Their cuts, one small row a text, are joined back by id and digest.

Null and empty texts are plain with n = 0 and an empty output; a null id counts as ''. Repeated rows give repeated
rows; equal ids with different texts draw the same numbers. Other columns of any name pass through; ``name`` replaces
one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from dossierlake.llm.common import free_name, text_batches
from dossierlake.workspace import materialize

#: Bytes of a text that one scan takes.
CHUNK = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: States: nothing read, last read a blank, last read of a word. Rows are states, columns the class of the next byte
#: (blank, other): where it leads, and whether a unit ends before it.
START, BLANK, WORD = 0, 1, 2
NEXT = np.array([[BLANK, WORD], [BLANK, WORD], [BLANK, WORD]])
ENDS = np.array([[0, 0], [0, 0], [1, 0]])
#: The class of each byte, and whether it begins a code point.
CLASS = np.ones(256, dtype=np.int8)
CLASS[[0x20, *range(0x09, 0x0E)]] = 0
LEADS = np.array([b & 0xC0 != 0x80 for b in range(256)])


def ends_within(data: np.ndarray) -> np.ndarray:
    """Places, from 1 on, before which a unit ends whatever state ``data`` is entered in.

    From the second byte on the state is known: each row of NEXT is the same, so the byte before decides it.
    """
    kinds = CLASS[data]
    return np.flatnonzero(ENDS[NEXT[START][kinds[:-1]], kinds[1:]]) + 1


def transition(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry state: the state after ``data``, and the units that end within it."""
    if not len(data):
        return np.arange(3), np.zeros(3, dtype=np.int64)
    first, last = CLASS[data[0]], CLASS[data[-1]]
    left = NEXT[:, first] if len(data) == 1 else np.full(3, NEXT[START, last])
    return left, ENDS[:, first] + len(ends_within(data))


def compose(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``f`` and then ``g``, for stacks of functions: associative."""
    return np.take_along_axis(g[0], f[0], -1), f[1] + np.take_along_axis(g[1], f[0], -1)


def prefixes(left: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of all functions up to each one, in log2 steps."""
    step = 1
    while step < len(left):
        later = compose((left[:-step], ends[:-step]), (left[step:], ends[step:]))
        left, ends = np.concatenate([left[:step], later[0]]), np.concatenate([ends[:step], later[1]])
        step *= 2
    return left, ends


def place_of(data: np.ndarray, entry: int, nth: int) -> int:
    """The byte before which the ``nth`` unit within ``data`` ends."""
    at_once = int(ENDS[entry, CLASS[data[0]]])
    return 0 if nth <= at_once else int(ends_within(data)[nth - at_once - 1])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value begins (and the last one ends)."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8))[places[0] : places[-1]], places - places[0]


@F.arrow_udf(StructType().add("n", LongType()).add("first", LongType()).add("second", LongType()))
def cuts_of_short(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Units of each text, and the code points before its two cuts; all texts of a batch in one scan."""
    if not len(texts):
        return pa.StructArray.from_arrays([pa.array([], pa.int64())] * 3, names=["n", "first", "second"])
    data, places = bytes_of(texts)
    starts, stops = places[:-1], places[1:]
    ends = ends_within(data) if len(data) else np.zeros(0, dtype=np.int64)
    ends = ends[~np.isin(ends, starts)]  # a text is entered in the first state, in which no unit ends
    before = np.searchsorted(ends, starts)
    n = np.searchsorted(ends, stops) - before + (stops > starts)
    points = np.concatenate([[0], np.cumsum(LEADS[data])])
    drawn = np.sort([a.to_numpy(zero_copy_only=False).astype(np.int64) % (n + 1) for a in (one, two)], axis=0)
    ends = np.append(ends, 0)
    at = [np.where(k == 0, starts, np.where(k == n, stops, ends[np.clip(before + k - 1, 0, len(ends) - 1)])) for k in drawn]
    return pa.StructArray.from_arrays(
        [pa.array(n), *(pa.array(points[a] - points[starts]) for a in at)], names=["n", "first", "second"]
    )


def chunks_of(long: DataFrame, key: list[str], text: str, size: int) -> DataFrame:
    """key, chunk, data: the bytes of each text in chunks, dealt to all cores."""
    raw = F.col(text).cast("binary")
    count = F.ceil(F.octet_length(raw) / size).cast("int")
    each = long.select(*key, raw.alias("data"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    return each.select(*key, "chunk", F.substring("data", F.col("chunk") * size + 1, F.lit(size)).alias("data")).repartition(*key, "chunk")


def cuts_of_long(long: DataFrame, key: list[str], drawn: list[Column], text: str, size: int) -> DataFrame:
    """key, n, first, second of long texts: scan of the chunks, prefix composition, selection in the chunks that matter."""
    kinds = ", ".join(f"{c} {long.schema[c].dataType.simpleString()}" for c in key)
    chunks = materialize(chunks_of(long, key, text, size), "chunks")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(d.as_buffer(), dtype=np.uint8) for d in b.column("data")]
            found = [transition(d) for d in rows]
            columns = [*(b.column(c) for c in key), b.column("chunk")]
            columns += [pa.array([f[k].tolist() for f in found], pa.list_(pa.int64())) for k in (0, 1)]
            columns.append(pa.array([int(LEADS[d].sum()) for d in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "chunk", "left", "ends", "points"])

    def resolve(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        left, ends = (np.array(table.column(c).to_pylist()) for c in ("left", "ends"))
        points = table.column("points").to_numpy()
        left, ends = prefixes(left, ends)
        entry, before = np.append(START, left[:-1, START]), np.append(0, ends[:-1, START])
        columns = {"entry": entry, "before": before, "upto": ends[:, START], "points_before": np.cumsum(points) - points, "n": np.full(len(left), ends[-1, START] + 1), "points": np.full(len(left), points.sum())}
        return pa.table({c: table.column(c) for c in [*key, "chunk"]} | {c: pa.array(v, pa.int64()) for c, v in columns.items()})

    functions = chunks.mapInArrow(scan, f"{kinds}, chunk int, left array<long>, ends array<long>, points long")
    resolved = functions.groupBy(*key).applyInArrow(
        resolve, f"{kinds}, chunk int, entry long, before long, upto long, points_before long, n long, points long"
    )
    one, two = (d % (F.col("n") + 1) for d in drawn)
    cuts = resolved.withColumn("low", F.least(one, two)).withColumn("high", F.greatest(one, two))
    within = lambda k: F.when((F.col(k) > F.col("before")) & (F.col(k) <= F.col("upto")) & (F.col(k) < F.col("n")), F.col(k) - F.col("before"))
    cuts = materialize(cuts.withColumn("nth_low", within("low")).withColumn("nth_high", within("high")), "cuts")
    asked = cuts.where("nth_low is not null or nth_high is not null").select(*key, "chunk", "entry", "points_before", "nth_low", "nth_high")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places: list[list[int | None]] = [[], []]
            for r in b.select(["data", "entry", "points_before", "nth_low", "nth_high"]).to_pylist():
                data = np.frombuffer(r["data"], dtype=np.uint8)
                for out, nth in zip(places, (r["nth_low"], r["nth_high"]), strict=True):
                    out.append(None if nth is None else r["points_before"] + int(LEADS[data[: place_of(data, r["entry"], nth)]].sum()))
            columns = [*(b.column(c) for c in key), *(pa.array(p, pa.int64()) for p in places)]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "first", "second"])

    same = [c for c in key if c != key[0]] + ["chunk"]
    left, right = chunks.alias("c"), asked.alias("a")
    on = F.col(f"c.{key[0]}").eqNullSafe(F.col(f"a.{key[0]}"))
    for c in same:
        on = on & (F.col(f"c.{c}") == F.col(f"a.{c}"))
    held = left.join(right, on).select(*(F.col(f"c.{c}").alias(c) for c in key), "data", "entry", "points_before", "nth_low", "nth_high")
    found = held.mapInArrow(select, f"{kinds}, first long, second long")
    edge = lambda k: F.when(F.col(k) == 0, F.lit(0).cast("long")).when(F.col(k) == F.col("n"), F.col("points"))
    known = cuts.where("chunk = 0").select(*key, "n", edge("low").alias("first"), edge("high").alias("second"))
    both = known.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    return both.groupBy(*key).agg(*(F.max(c).alias(c) for c in ("n", "first", "second")))


def drawn_numbers(id_column: str, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the SHA-256 of seed, colon and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def rearranged(text: Column, form: Column, first: Column, second: Column) -> Column:
    prefix, middle = F.substring(text, F.lit(1), first.cast("int")), F.substring(text, first.cast("int") + 1, (second - first).cast("int"))
    suffix = F.substring(text, second.cast("int") + 1, F.lit((1 << 31) - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from the output and its form alone."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame,
    seed: int = 42,
    rate: int = 50,
    spm_rate: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
    name: str = "fim",
    chunk: int = CHUNK,
) -> DataFrame:
    """``docs`` with a struct of n, form, prefix_chars, middle_chars (null where plain) and output.

    ``rate`` in a hundred texts are rearranged, ``spm_rate`` in a hundred of these with the suffix first. Texts that hold
    one of the marks stay plain.
    """
    text_batches(docs.sparkSession)
    h = drawn_numbers(id_column, seed)
    text, cut = F.coalesce(F.col(text_column), F.lit("")), free_name(docs, "__cut")
    digest = free_name(docs, "__digest")
    is_long = F.coalesce(F.octet_length(F.col(text_column)), F.lit(0)) > chunk
    short = docs.where(~is_long).withColumn(cut, cuts_of_short(text.cast("binary"), h[0], h[1]))

    long = docs.where(is_long)
    keyed = long.select(F.col(id_column).alias("id"), F.sha2(F.col(text_column).cast("binary"), 256).alias("digest"), F.col(text_column).alias("text"))
    found = cuts_of_long(keyed.dropDuplicates(["id", "digest"]), ["id", "digest"], drawn_numbers("id", seed)[:2], "text", chunk)
    cuts = found.select(F.col("id").alias(f"{digest}_id"), F.col("digest").alias(digest), F.struct("n", "first", "second").alias(cut))
    marked = long.withColumn(f"{digest}_own", F.sha2(F.col(text_column).cast("binary"), 256))
    same = F.col(id_column).eqNullSafe(F.col(f"{digest}_id")) & (F.col(f"{digest}_own") == F.col(digest))
    done = short.unionByName(marked.join(cuts, same).select(*docs.columns, cut))

    plain = (text == "") | (h[2] % 100 >= rate)
    for mark in SENTINELS:
        plain = plain | text.contains(mark)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    first, second = F.col(cut)["first"], F.col(cut)["second"]
    own = F.struct(
        F.col(cut).n.alias("n"),
        form.alias("form"),
        F.when(~plain, first).alias("prefix_chars"),
        F.when(~plain, second - first).alias("middle_chars"),
        rearranged(text, form, first, second).alias("output"),
    )
    return done.select(*(c for c in docs.columns if c != name), own.alias(name))
