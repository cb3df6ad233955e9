"""Token ids, packing and record files: exact round trips and accounts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dossierlake.llm import packing, record_files
from dossierlake.llm.tokenizing import TextTokenizer

FILES = {"byte_bpe_50k.json": False, "word_bpe_49k.json": True}
PLAIN = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
OURS = {f: TextTokenizer(public_tokenizers.path(f), drops) for f, drops in FILES.items()}
ROWS = [
    (3, "Plain words, and more."),
    (1, None),
    (2, ""),
    (None, "a null id"),
    (3, "Plain words, and more."),
    (5, "x, " * 9000),
    (4, "same"),
    (4, "other"),
]


def plain_ids(file, text):
    return PLAIN[file].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize(
    "text",
    [None, "", " ", "\n\n", "a  b", "a\n b", "a \n\n  b\n", "it's  they'll\t\tx 1234 12,3", "<|endoftext|> x<|", "a\xa0 b",
     "a　\n b", "́ é x", "日本語 テキスト\r\n次", "x" * 3000, "\x00 \x1c \x01a", "Ünï,cö.dé×,x"],
)
def test_ids_are_the_tokenizers(file, text):
    for _ in range(2):
        assert np.frombuffer(OURS[file].encode([text])[0], "<u4").tolist() == plain_ids(file, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab1!,.' \n\t\r\xa0ÉÀ́s×<|", max_size=40), max_size=5))
def test_ids_of_any_text(texts):
    for file, ours in OURS.items():
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode(texts)] == [plain_ids(file, t) for t in texts]


def test_forgetting_changes_nothing():
    rng = random.Random(2)
    texts = [" ".join(str(rng.randrange(50)) for _ in range(30)) for _ in range(40)]
    small = TextTokenizer(public_tokenizers.path("byte_bpe_50k.json"), memory=5)
    for i in range(0, 40, 8):
        got = small.encode(texts[i : i + 8])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain_ids("byte_bpe_50k.json", t) for t in texts[i : i + 8]]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")


def test_record_files_round_trip(spark):
    folder = record_files.new_folder(spark)
    files = record_files.write_token_files(docs_of(spark, ROWS), folder, public_tokenizers.path("byte_bpe_50k.json"), 0)
    got = sorted(record_files.read_token_files(spark, folder, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 4, 4, 5]
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    want = sorted((str(i), [*plain_ids("byte_bpe_50k.json", t), 0]) for i, t in ROWS)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    for row in files.collect():
        file = record_files.RecordFile(folder, row.path)
        in_order = [(i, x.tolist()) for i, x in file]
        assert len(file) == row.records == len(in_order)
        assert [(i, x.tolist()) for i, x in map(file.__getitem__, range(len(file)))] == in_order
        assert sorted(map(str, ((i, x.tolist()) for i, x in file.shuffled(1)))) == sorted(map(str, in_order))


def test_damage_is_found(tmp_path):
    writer = record_files.RecordWriter(f"file://{tmp_path}", "one", 2)
    writer.write(7, np.array([1, 2, 3]))
    writer.close()
    path = tmp_path / "one.rec"
    raw = bytearray(path.read_bytes())
    assert [(i, x.tolist()) for i, x in record_files.RecordFile(f"file://{tmp_path}", "one.rec")] == [(7, [1, 2, 3])]
    for at in (17, 25, 40, len(raw) - 1):
        bad = raw.copy()
        bad[at] ^= 1
        path.write_bytes(bad)
        with pytest.raises(ValueError):
            list(record_files.RecordFile(f"file://{tmp_path}", "one.rec"))


def test_record_files_of_an_empty_table(spark):
    folder = record_files.new_folder(spark)
    files = record_files.write_token_files(docs_of(spark, []), folder, public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert files.count() == 0
    assert record_files.read_token_files(spark, folder, files).count() == 0


def test_knapsack_is_the_best():
    rng = np.random.default_rng(3)
    for _ in range(20):
        values = rng.random(6) * (rng.random(6) > 0.3)
        worth, counts = packing.knapsack(values, 13)
        best = np.zeros(14)
        for c in range(1, 14):
            best[c] = max([best[c - 1]] + [best[c - k - 1] + values[k] for k in range(6) if k < c])
        assert worth == pytest.approx(best[13])
        assert counts @ values == pytest.approx(worth)
        assert counts @ np.arange(1, 7) <= 13


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_the_demand(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 4 * 10**seed, 64) * (rng.random(64) < 0.7)
    patterns = packing.pattern_counts(demand, 64)
    assert all(p @ np.arange(1, 65) <= 64 for p, _ in patterns)
    assert (sum((p * n for p, n in patterns), np.zeros(64, dtype=np.int64)) == demand).all()
    assert sum(n for _, n in patterns) <= max(len(packing.first_fit(demand, 64)), 1) + 2


def test_packing_accounts_for_every_id(spark):
    rng = np.random.default_rng(0)
    rows = ROWS + [(100 + i, " ".join(["word"] * int(rng.integers(0, 1500)))) for i in range(150)]
    file = "word_bpe_49k.json"
    pieces, placed = packing.pack_documents(docs_of(spark, rows), public_tokenizers.path(file), 1, True)
    got = pieces.join(placed, "piece").collect()
    assert len(got) == pieces.count()
    sequences, docs = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    want = {}
    for i, t in rows:
        ids = [*plain_ids(file, t), 1]
        want.setdefault((i, len(ids)), []).append(zlib.crc32(np.array(ids, "<u4").tobytes()))
    for key, parts in docs.items():
        copies = len(want[key])
        ids = [x for s, p in sorted(parts) for x in p] if copies == 1 else None
        assert sum(len(p) for _, p in parts) == copies * key[1]
        if ids:
            assert zlib.crc32(np.array(ids, "<u4").tobytes()) == want[key][0]
    assert set(docs) == set(want)
    total = sum(len(p) for parts in docs.values() for _, p in parts)
    assert len(sequences) * 2048 <= total * 1.04 + 2 * 2048


def test_packing_an_empty_table(spark):
    pieces, placed = packing.pack_documents(docs_of(spark, []), public_tokenizers.path("word_bpe_49k.json"), 1, True)
    assert pieces.count() == placed.count() == 0
