"""Language-model scores by a weighted backoff automaton, learned from the whole corpus.

Words and one end a text are tokens. n-gram counts over all training documents are smoothed with a Dirichlet prior
towards the next shorter history, down to single tokens:

    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))            p(w | h) = (c(h w) + MU p(w | h')) / (c(h) + MU)

The model is as large as the corpus, so no machine holds it. Documents are put into chunks of bounded size. A chunk
asks for the counts of just the n-grams it holds: its distinct n-grams, as sorted 64-bit hashes with the chunk's own
training counts, go to buckets by hash, where they are summed over all chunks and sent back. From its counts a chunk
builds the part of the automaton that its documents can reach, which gives the same scores as the whole one.

Chunks and buckets both grow with the corpus, so messages from each to each would grow as its square. They meet in
steps instead: in each, ``FAN`` groups of chunks at most send their keys of one range to one task, which sums them and
passes the sums on in ``FAN`` smaller ranges at most; totals come back the same way. A task holds about ``BUCKET`` keys at
every step, a frequent word ``FAN`` entries, and messages are as many as ``FAN`` times the buckets. Up to ``FAN`` chunks and
buckets one step does.

States are the seen histories. A seen n-gram is an arc with its smoothed log-probability; where a state has no arc for
the next word, its failure arc leads to the history one word shorter, at the weight log(MU / (c(h) + MU)). All
documents of a chunk are traversed side by side, once from left to right, each carrying its state and its sum.

A null or empty text is its end token alone. Every row is a document, also where ids repeat; a null id counts as ''
where the fold is drawn. With no training documents all counts are 0 and p(w) is 1 for the one unknown class. A very
long text is a chunk of its own, in memory at about 100 bytes a word, and is traversed in segments side by side. Ids may
be of any type. Other columns of the input, whatever their names, don't come along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dossierlake.llm.common import slices, text_batches
from dossierlake.workspace import materialize

MU = 1.0
#: Bytes of text in a chunk (a longer document is a chunk of its own), and n-grams that meet in a bucket about.
CHUNK, BUCKET = 16 << 20, 1_500_000
#: Messages that meet in a task, and words of a long text that one state is carried over.
FAN, SEGMENT = 256, 4000
#: Hashes of what no word can be: the end of a text, and the place before its first word.
END, START = (xxhash.xxh64_intdigest(x) for x in (b"", b" "))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers with their bytes sorted by place, which compress well where they are small."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def cut_by_range(keys: np.ndarray, buckets: int, width: int) -> list[tuple[int, slice]]:
    """(range, its part of sorted keys) for the ranges that have keys; buckets are equal parts of the hash, and a range
    is so many buckets."""
    own = (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64) // width
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    return [(int(own[i]), slice(i, j)) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(own)])]


MESSAGE = "level int, place long, of long, source long, keys binary, counts binary"


def message_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = zip(*rows) if rows else [[]] * 6
    names = ["level", "place", "of", "source", "keys", "counts"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def messages_of(level: int, keys: np.ndarray, counts: np.ndarray, buckets: int, width: int, of: int, source: int) -> list[tuple]:
    """One message a range, of keys as differences."""
    cut = cut_by_range(keys, buckets, width)
    return [(level, r, of, source, pack(np.diff(keys[x], prepend=np.uint64(0))), pack(counts[x])) for r, x in cut]


def summed(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys and their sums over the messages of a group; where each message's keys are, and where each begins."""
    keys = [np.cumsum(unpack(x, "<u8")) for x in group["keys"]]
    counts = np.concatenate([unpack(x, "<u8") for x in group["counts"]])
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.uint64)
    return found, sums, inverse, np.cumsum([len(x) for x in keys])[:-1]


def answers_to(group: pd.DataFrame, totals: np.ndarray, inverse: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
    """Each message's totals, for whoever sent it."""
    back = [pack(x) for x in np.split(totals[inverse], bounds)]
    return pd.DataFrame({"source": group["source"], "level": group["level"], "place": group["place"], "totals": back})


def counted(asked: DataFrame, buckets: list[int], steps: int) -> tuple[DataFrame, int, int]:
    """source, level, place, totals for every message; and the number of tokens and of distinct ones."""
    keys = ["level", "place", "of"]

    def combine(step: int):
        def combined(group: pd.DataFrame) -> pd.DataFrame:
            level, of = int(group["level"].iat[0]), int(group["of"].iat[0])
            found, sums, _, _ = summed(group)
            rows = messages_of(level, found, sums, buckets[level], FAN ** (steps - step - 1), of // FAN, of)
            return pd.DataFrame(rows, columns=["level", "place", "of", "source", "keys", "counts"])

        return combined

    def total(group: pd.DataFrame) -> pd.DataFrame:
        found, sums, inverse, bounds = summed(group)
        out = answers_to(group, sums, inverse, bounds).assign(tokens=0, types=0)
        if group["level"].iat[0] == 0:
            real = found != np.uint64(START)
            out.iloc[0, out.columns.get_loc("tokens")] = int(sums[real].sum())
            out.iloc[0, out.columns.get_loc("types")] = int((sums[real] > 0).sum())
        return out

    def passed_on(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        _, _, inverse, bounds = summed(group)
        parts = answers.sort_values("part")["totals"]
        return answers_to(group, np.concatenate([unpack(x, "<u8") for x in parts]), inverse, bounds)

    levels = [asked]
    for step in range(1, steps):
        levels[-1] = materialize(levels[-1], "lm-messages", compression="uncompressed")
        levels.append(levels[-1].groupBy(*keys).applyInPandas(combine(step), MESSAGE))
    schema = "source long, level int, place long, totals binary"
    answers = levels.pop().groupBy(*keys).applyInPandas(total, f"{schema}, tokens long, types long")
    answers = materialize(answers, "lm-counts", compression="uncompressed")
    known = answers.agg(F.sum("tokens"), F.sum("types")).first()
    while levels:
        given = answers.select("level", F.expr(f"place div {FAN}").alias("place"), F.col("source").alias("of"), F.col("place").alias("part"), "totals")
        pairs = levels.pop().groupBy(*keys).cogroup(given.groupBy(*keys))
        answers = materialize(pairs.applyInPandas(passed_on, schema), "lm-counts", compression="uncompressed")
    return answers, known[0] or 0, known[1] or 0


@dataclass
class Level:
    """The distinct n-grams of one length in a chunk: by its place, the prefix and suffix one word shorter, the word."""

    at: np.ndarray  # of each position of the chunk the n-gram that ends there, or -1
    hashes: np.ndarray
    prefix: np.ndarray
    word: np.ndarray
    suffix: np.ndarray


def levels_of(stream: np.ndarray, starts: np.ndarray, words: np.ndarray, order: int) -> list[Level]:
    """The n-grams of lengths 1 to ``order`` of documents that begin at ``starts``."""
    nothing = np.zeros(0, dtype=np.int64)
    levels = [Level(stream, words, nothing, np.arange(len(words)), nothing)]
    inner = np.ones(len(stream), dtype=bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    for _ in range(1, order):
        below = levels[-1]
        ends = inner[below.at[inner - 1] >= 0]
        found, inverse = np.unique(below.at[ends - 1].astype(np.int64) * len(words) + stream[ends], return_inverse=True)
        # places in a chunk fit into four bytes
        at = np.full(len(stream), -1, dtype=np.int32)
        at[ends] = inverse
        prefix, word = (found // len(words)).astype(np.int32), (found % len(words)).astype(np.int32)
        suffix = np.zeros(len(found), dtype=np.int32)
        suffix[inverse] = below.at[ends]
        mixed = (below.hashes[prefix] ^ (below.hashes[prefix] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed + words[word]) * np.uint64(0x94D049BB133111EB)
        levels.append(Level(at, mixed ^ (mixed >> np.uint64(32)), prefix, word, suffix))
    return levels


class BackoffAutomaton:
    """States 0 (no history) and one a seen history; arcs sorted by (state, word); failure arcs by state."""

    def __init__(self, levels: list[Level], counts: list[np.ndarray], tokens: int, types: int):
        words = len(levels[0].word)
        self.words, self.order = words, len(levels)
        self.base = np.log10((counts[0] + 0.1) / (tokens + 0.1 * (types + 1)))
        state = np.zeros(words, dtype=np.int64)
        states = 1
        weights, fails = [np.zeros(1)], [np.zeros(1, dtype=np.int64)]
        keys, logs, follow = [], [], []
        lower = np.exp(self.base * np.log(10))
        by_level = []
        for k in range(self.order - 1):
            seen = counts[k] > 0
            own = np.zeros(len(counts[k]), dtype=np.int64)
            own[seen] = states + np.arange(int(seen.sum()))
            states += int(seen.sum())
            by_level.append(own)
            weights.append(np.log10(MU / (counts[k][seen] + MU)))
            fails.append(by_level[k - 1][levels[k].suffix[seen]] if k else np.zeros(int(seen.sum()), dtype=np.int64))
        for k in range(1, self.order):
            level, count = levels[k], counts[k]
            lower = (count + MU * lower[level.suffix]) / (counts[k - 1][level.prefix] + MU)
            seen = count > 0
            keys.append(by_level[k - 1][level.prefix[seen]] * words + level.word[seen])
            logs.append(np.log10(lower[seen]))
            # the next history is the n-gram itself, or without its first word where that would be too long
            follow.append(by_level[k][seen] if k < self.order - 1 else by_level[k - 1][level.suffix[seen]])
        state = by_level[0] if by_level else state
        self.unigram_next = state
        self.weight, self.fail = np.concatenate(weights), np.concatenate(fails)
        merged = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        keys.clear()
        order = np.argsort(merged)
        self.keys = merged[order]
        del merged
        self.log = np.concatenate(logs)[order] if logs else np.zeros(0)
        logs.clear()
        self.next = np.concatenate(follow)[order].astype(np.int32) if follow else np.zeros(0, dtype=np.int32)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of the word after each state, and the next state."""
        gain, after = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        todo = np.arange(len(state))
        if len(self.keys):
            for _ in range(self.order - 1):
                key = state * self.words + word[todo]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[arc] == key) & (state > 0)
                gain[todo[hit]] += self.log[arc[hit]]
                after[todo[hit]] = self.next[arc[hit]]
                todo, state = todo[~hit], state[~hit]
                gain[todo] += self.weight[state]
                state = self.fail[state]
        gain[todo] += self.base[word[todo]]
        after[todo] = self.unigram_next[word[todo]]
        return gain, after

    def traverse(self, stream: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-probability of each document after its START.

        Documents are traversed side by side, long ones in segments. A state is the longest seen history of at most
        ``order - 1`` words, so a later segment's first state comes from the words just before it.
        """
        pieces = np.maximum(1, -(-(lengths - 1) // SEGMENT))
        owner = np.repeat(np.arange(len(starts)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[owner] + 1 + place * SEGMENT
        size = np.minimum(SEGMENT, starts[owner] + lengths[owner] - begin)
        by_size = np.argsort(-size, kind="stable")
        begin, size, later = begin[by_size], size[by_size], np.flatnonzero(place[by_size] > 0)
        state = self.unigram_next[stream[begin - 1]]
        state[later] = 0
        for back in range(self.order - 1, 0, -1):
            state[later] = self.step(state[later], stream[begin[later] - back])[1]
        total = np.zeros(len(begin))
        going = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        for t, n in enumerate(going.tolist()):
            gain, state = self.step(state[:n], stream[begin[:n] + t])
            total[:n] += gain
        return np.bincount(owner[by_size], weights=total, minlength=len(starts))


def _encode(ids: list, train: list[bool], texts: list[bytes]) -> dict:
    """One chunk: its words' hashes, and its documents as places in them, each with START before and END behind."""
    known: dict[bytes, int] = {}
    parts, lengths = [], []
    for text in texts:
        found = text.lower().split()
        parts.append(np.fromiter((known.setdefault(w, len(known) + 2) for w in found), np.uint32, len(found)))
        lengths.append(len(found) + 2)
    stream = np.zeros(sum(lengths), dtype=np.uint32)
    at = 0
    for part in parts:
        stream[at + 1 : at + 1 + len(part)] = part
        stream[at + 1 + len(part)] = 1
        at += len(part) + 2
    words = np.array([START, END, *map(xxhash.xxh64_intdigest, known)], dtype=np.uint64)
    return {
        "ids": ids,
        "train": np.array(train, dtype=np.uint8).tobytes(),
        "lengths": np.array(lengths, dtype=np.uint32).tobytes(),
        "words": words.tobytes(),
        "stream": pack(stream),
        "tokens": len(stream),
    }


def _decoded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """stream, starts, lengths, train (by document), words."""
    lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
    stream = unpack(row["stream"], "<u4").astype(np.int64)
    train = np.frombuffer(row["train"], np.uint8).astype(bool)
    return stream, np.cumsum(lengths) - lengths, lengths, train, np.frombuffer(row["words"], np.uint64)


def score_documents(
    docs: DataFrame, train_on: Column, order: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities), train."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), train_on.alias("train"), F.col(text_column).cast("binary").alias("text"))
    kind, arrow_kind = rows.schema["doc_id"].dataType.simpleString(), to_arrow_type(rows.schema["doc_id"].dataType)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, train, texts, size = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            row = _encode(ids, train, texts)
            types = {"ids": pa.list_(arrow_kind), "tokens": pa.int64()}
            columns = {"chunk": pa.array([(part << 32) | made], pa.int64())}
            columns |= {k: pa.array([v], types.get(k, pa.binary())) for k, v in row.items()}
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for b in slices(batches):
            for i, t, x in zip(b.column("doc_id").to_pylist(), b.column("train").to_pylist(), b.column("text").to_pylist()):
                x = x or b""
                if ids and size + len(x) > CHUNK:
                    yield chunk()
                    ids, train, texts, size, made = [], [], [], 0, made + 1
                ids.append(i)
                train.append(bool(t))
                texts.append(x)
                size += len(x)
        if ids:
            yield chunk()

    columns = f"chunk long, ids array<{kind}>, train binary, lengths binary, words binary, stream binary, tokens long"
    chunks = materialize(rows.mapInArrow(encode, columns), "lm-chunks", compression="uncompressed")
    positions, n_chunks = chunks.agg(F.sum("tokens"), F.count("chunk")).first()
    buckets = [max(1, -(-(positions or 0) // (BUCKET * (8 if k == 0 else 1)))) for k in range(order)]
    steps = 1
    while FAN**steps < max(n_chunks, *buckets):
        steps += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                stream, starts, lengths, train, words = _decoded(row)
                learned = np.repeat(train, lengths)
                of = (xxhash.xxh32_intdigest(str(row["chunk"])) * FAN ** (steps - 1)) >> 32
                for k, level in enumerate(levels_of(stream, starts, words, order)):
                    here = level.at[learned & (level.at >= 0)]
                    counts = np.bincount(here, minlength=len(level.hashes)).astype(np.uint64)
                    by_hash = np.argsort(level.hashes)
                    keys, counts = level.hashes[by_hash], counts[by_hash]
                    yield message_batch(messages_of(k, keys, counts, buckets[k], FAN ** (steps - 1), of, row["chunk"]))

    answers, tokens, types = counted(chunks.mapInArrow(ask, MESSAGE), buckets, steps)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answered = right.select(["level", "place", "totals"]).to_pylist()
        del right
        for row in left.to_pylist():
            stream, starts, lengths, train, words = _decoded(row)
            levels = levels_of(stream, starts, words, order)
            counts = []
            for k, level in enumerate(levels):
                own = sorted((r["place"], r["totals"]) for r in answered if r["level"] == k)
                totals = np.empty(len(level.hashes), dtype=np.float64)
                totals[np.argsort(level.hashes)] = np.concatenate([unpack(x, "<u8") for _, x in own])
                counts.append(totals)
                # two workers share an executor, so what isn't needed any more goes at once
                level.hashes = level.at = None
            seen = counts[0][stream] > 0
            seen[starts] = False
            automaton = BackoffAutomaton(levels, counts, tokens, types)
            del levels, counts
            score = automaton.traverse(stream, starts, lengths)
            each = automaton.base[stream]
            each[starts] = 0
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(row["ids"], arrow_kind),
                        "n_tokens": pa.array(lengths - 1),
                        "n_known": pa.array(np.add.reduceat(seen.astype(np.int64), starts)),
                        "train_tokens": pa.array(np.full(len(lengths), tokens, dtype=np.int64)),
                        "base_score": pa.array(np.add.reduceat(each, starts)),
                        "score": pa.array(score),
                        "train": pa.array(train),
                    }
                )
            )
        return pa.concat_tables(out)

    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, train boolean"
    parts = answers.select(F.col("source").alias("chunk"), "level", "place", "totals").groupBy("chunk")
    return chunks.groupBy("chunk").cogroup(parts).applyInArrow(scored, schema)
