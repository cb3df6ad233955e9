"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide over the embedded
bytes of each chunk and are max-pooled over its places. A maximum can't tell that a chunk says one thing over and over, so
the share of its 8-byte windows that repeat another one of it comes besides. The chunks' pooled values are combined (their
mean and their maximum) into one probability. Nothing but the text is an input.

Training uses at most ``TRAIN_ROWS`` labelled documents, those with the smallest hashes, so every run takes the same; of
each it reads the whole text. They are dealt to ``SHARDS`` groups by hash. In each of ``ROUNDS`` rounds every group
takes Adam steps from the same network on its own documents in a task of its own, and the networks that come back are
averaged by their documents (a few ten kilobytes each). Chunks go through the filters ``BLOCK`` at once, so memory follows
the bytes of a text and not the network's activations.

Ids may be of any type and are compared as texts. A null or empty text has one chunk of padding and gets the score the
network learned for that. Documents without a label or with a null id don't train; a repeated id trains on each of its
rows and labels, up to the bound. Without labels of both kinds every score is the share of label 1 (0.5 without labels).
Scores depend on nothing but the text, so ties and repeated rows get equal ones. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import parts_of, text_batches
from dossierlake.workspace import materialize

CHUNK, STRIDE = 512, 448
#: Labelled documents at most, groups they are dealt to, rounds, and passes of a group in a round.
TRAIN_ROWS, SHARDS, ROUNDS, PASSES = 4000, 8, 12, 2
#: Chunks that go through the filters at once.
BLOCK = 128
PAD = 256


def raw_bytes(text: str | bytes | None) -> np.ndarray:
    return np.frombuffer(text.encode() if isinstance(text, str) else (text or b""), dtype=np.uint8)


def chunk_count(size: int) -> int:
    return max(1, -(-(size - (CHUNK - STRIDE)) // STRIDE))


def chunk_block(raw: np.ndarray, first: int, last: int) -> np.ndarray:
    """[last - first, CHUNK] byte codes of some of a text's chunks; the text's last one is padded."""
    own = raw[first * STRIDE : (last - 1) * STRIDE + CHUNK]
    padded = np.full((last - first - 1) * STRIDE + CHUNK, PAD, dtype=np.int16)
    padded[: len(own)] = own
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


def blocks(raws: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(chunks, the texts they belong to): all chunks of all texts in order, BLOCK at once."""
    held, owners, room = [], [], BLOCK
    for k, raw in enumerate(raws):
        first, count = 0, chunk_count(len(raw))
        while first < count:
            last = min(count, first + room)
            held.append(chunk_block(raw, first, last))
            owners.append(np.full(last - first, k))
            room -= last - first
            first = last
            if not room:
                yield np.concatenate(held), np.concatenate(owners)
                held, owners, room = [], [], BLOCK
    if held:
        yield np.concatenate(held), np.concatenate(owners)


def repeated(chunks: np.ndarray) -> np.ndarray:
    """The share of each chunk's 8-byte windows that repeat another one, in tenths; those with padding count as different.

    Tenths bring it to the size of the filters' responses, so that it's learned as fast.
    """
    codes = chunks.astype(np.uint8)
    n, places = len(codes), CHUNK - 7
    windows = np.ndarray((n, places), "<u8", codes, 0, (CHUNK, 1)).copy()
    padded = chunks[:, 7:] == PAD
    windows[padded] = np.broadcast_to(np.arange(places, dtype=np.uint64), (n, places))[padded]
    windows.sort(axis=1)
    return ((windows[:, 1:] == windows[:, :-1]).sum(axis=1) * np.float32(10 / places)).astype(np.float32)


@dataclass
class ByteConvNet:
    """embed: [257, d]; filters: [width * d, f]; bias: [f]; out: [2 (f + 1)]; shift: [1]. All are float32."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    WIDTH, STEP, DIMS, COUNT = 8, 4, 8, 24

    @classmethod
    def fresh(cls, shift: float, seed: int = 7) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (257, cls.DIMS)).astype(np.float32)
        embed[PAD] = 0
        filters = rng.normal(0, (cls.WIDTH * cls.DIMS) ** -0.5, (cls.WIDTH * cls.DIMS, cls.COUNT)).astype(np.float32)
        out = np.zeros(2 * cls.COUNT + 2, np.float32)
        return cls(embed, filters, np.zeros(cls.COUNT, np.float32), out, np.array([shift], np.float32))

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def pool(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response in each chunk and the share of repeats, [chunks, f + 1]; the responses' places."""
        seen = self.embed[chunks]
        places = (CHUNK - self.WIDTH) // self.STEP + 1
        n, d = len(chunks), self.DIMS
        # a window's bytes lie side by side in memory
        shape, (a, b, c) = (n, places, self.WIDTH * d), seen.strides
        flat = np.lib.stride_tricks.as_strided(seen, shape, (a, b * self.STEP, c)).reshape(n * places, -1)
        response = (flat @ self.filters).reshape(n, places, -1)
        at = response.argmax(axis=1)
        most = np.maximum(np.take_along_axis(response, at[:, None], axis=1)[:, 0] + self.bias, 0)
        return np.concatenate([most, repeated(chunks)[:, None]], axis=1), at.astype(np.int16)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of each whole text."""
        raws = [raw_bytes(t) for t in texts]
        total, most = np.zeros((len(raws), self.COUNT + 1)), np.zeros((len(raws), self.COUNT + 1), np.float32)
        for chunks, owner in blocks(raws):
            pooled, _ = self.pool(chunks)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[first]] += np.add.reduceat(pooled, first, axis=0, dtype=np.float64)
            most[owner[first]] = np.maximum(most[owner[first]], np.maximum.reduceat(pooled, first, axis=0))
        counts = np.array([chunk_count(len(r)) for r in raws], dtype=np.float64)
        features = np.concatenate([total / counts[:, None], most], axis=1) if len(raws) else np.zeros((0, len(self.out)))
        z = features @ self.out.astype(np.float64) + float(self.shift[0])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def gradients(self, raws: list[np.ndarray], labels: np.ndarray, weigh: np.ndarray) -> list[np.ndarray]:
        """Of the weighed logistic loss over some whole texts, in the order of ``parts``."""
        kept = [(*self.pool(chunks), owner) for chunks, owner in blocks(raws)]
        pooled = np.concatenate([p for p, _, _ in kept])
        owner = np.concatenate([o for _, _, o in kept])
        first = np.searchsorted(owner, np.arange(len(raws)))
        counts = np.diff(np.append(first, len(owner)))
        mean = np.add.reduceat(pooled, first, axis=0) / counts[:, None]
        features = np.concatenate([mean, np.maximum.reduceat(pooled, first, axis=0)], axis=1)
        p = 1 / (1 + np.exp(-np.clip(features @ self.out + self.shift, -60, 60)))
        error = ((p - labels) * weigh / len(raws)).astype(np.float32)
        f = self.COUNT
        ties = np.add.reduceat(pooled[:, :f] == features[owner, f + 1 : -1], first, axis=0, dtype=np.float32)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), np.zeros_like(self.filters), np.zeros_like(self.bias)
        for (chunks, _), (own, at, whose) in zip(blocks(raws), kept, strict=True):
            down = error[whose, None] * self.out[None, :f] / counts[whose, None]
            own = own[:, :f]
            largest = (own == features[whose, f + 1 : -1]) / ties[whose]
            down = (down + largest * error[whose, None] * self.out[None, f + 1 : -1]) * (own > 0)
            d_bias += down.sum(axis=0)
            # only the place of the maximum passes a gradient on
            places = at[:, :, None].astype(np.int64) * self.STEP + np.arange(self.WIDTH)
            codes = chunks[np.arange(len(chunks))[:, None, None], places]
            inputs = self.embed[codes].reshape(len(chunks), f, -1)
            d_filters += np.einsum("cfi,cf->if", inputs, down)
            back = (down[:, :, None] * self.filters.T[None]).reshape(-1, self.DIMS)
            for j in range(self.DIMS):
                d_embed[:, j] += np.bincount(codes.ravel(), weights=back[:, j], minlength=257)
        d_embed[PAD] = 0
        return [d_embed, d_filters, d_bias, features.T @ error, error.sum(keepdims=True)]


def improve(state: list[np.ndarray], texts: list[str | None], labels: np.ndarray, weigh: np.ndarray, turn: int, batch: int = 8, rate: float = 6e-3) -> list[np.ndarray]:
    """Adam steps over a group's documents. state: the network's parts, then Adam's two moments of each."""
    parts, first, second = (list(x) for x in np.array_split(np.array(state, dtype=object), 3))
    raws, rng = [raw_bytes(t) for t in texts], np.random.default_rng(turn)
    steps = turn * PASSES * -(-len(raws) // batch)
    total = ROUNDS * PASSES * -(-len(raws) // batch)
    for _ in range(PASSES):
        order = rng.permutation(len(raws))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            steps += 1
            now = rate * min(1.0, 2 * (1 - steps / (total + 1)))
            for k, g in enumerate(ByteConvNet(*parts).gradients([raws[r] for r in rows], labels[rows], weigh[rows])):
                first[k] = first[k] + 0.1 * (g - first[k])
                second[k] = second[k] + 0.001 * (g**2 - second[k])
                move = now * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
                parts[k] = (parts[k] - move).astype(np.float32)
    return [np.asarray(x, dtype=np.float32) for x in (*parts, *first, *second)]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_column: str,
    train_on: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> ByteConvNet:
    """Train on the labelled documents for which ``train_on`` (a condition on the id) holds."""
    text_batches(docs.sparkSession)
    known = labels.where(train_on & F.col(label_column).isin(0, 1)).select(
        F.col(id_column).cast("string").alias("id"), F.col(label_column).cast("int").alias("label")
    )
    bounded = known.dropna().orderBy(F.xxhash64("id"), "id", "label").limit(TRAIN_ROWS)
    texts = docs.select(F.col(id_column).cast("string").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    hashed = F.xxhash64("id", "label", "text").alias("hash")
    rows = texts.join(F.broadcast(bounded), "id").select("id", "label", "text", hashed)  # TRAIN_ROWS at most
    # a label's id may stand on many documents, so the bound holds for what they give as well
    rows = rows.orderBy("hash", "id", "label").limit(TRAIN_ROWS)
    rows = materialize(rows.select(F.expr(f"pmod(hash, {SHARDS})").alias("shard"), "hash", "label", "text"), "quality-rows")
    n, share = rows.agg(F.count("label"), F.avg("label")).first()
    if not n:
        return ByteConvNet.fresh(0.0)
    if share in (0, 1):
        return ByteConvNet.fresh(float(share - 0.5) * 24)
    state = ByteConvNet.fresh(float(np.log(share / (1 - share)))).parts()
    shapes = [x.shape for x in state] * 3
    sizes = np.cumsum([0, *(int(np.prod(x)) for x in shapes)])
    state = state + [np.zeros_like(x) for x in state] * 2
    good = min(2.0, max(0.5, (1 - share) / share))

    def step(state: list[np.ndarray], turn: int):
        def stepped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = pd.concat([pd.DataFrame({"shard": []}), *batches])
            for _, group in held.groupby("shard"):
                group = group.sort_values(["hash", "text"])
                y = group["label"].to_numpy(dtype=np.int64)
                new = improve(state, group["text"].tolist(), y, np.where(y == 1, good, 1.0), turn)
                yield pd.DataFrame({"n": [len(group)], "state": [np.concatenate([x.ravel() for x in new]).tobytes()]})

        return stepped

    dealt = rows.repartitionById(SHARDS, F.col("shard").cast("int"))
    for turn in range(ROUNDS):
        found = dealt.mapInPandas(step(state, turn), "n long, state binary").collect()  # SHARDS rows
        found = sorted((r["state"], r["n"]) for r in found)
        weights = np.array([m for _, m in found], dtype=np.float64)
        mean = (np.stack([np.frombuffer(s, np.float32) for s, _ in found]) * (weights / weights.sum())[:, None]).sum(axis=0)
        state = [mean[a:b].reshape(x).astype(np.float32) for a, b, x in zip(sizes[:-1], sizes[1:], shapes)]
    return ByteConvNet(*state[:5])


def score(docs: DataFrame, net: ByteConvNet, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` of scores, which replaces one of that name. The network is a few ten kilobytes."""
    text_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *map(net.score, parts_of(texts))]))

    return docs.withColumn(name, scored(F.col(text_column)))
