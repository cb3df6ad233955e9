"""Registered queries against their SQL, or a plain version over the smallest tables."""

import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from oracle import SMALL, same
from test_corpus import WORD, check_replaced, plain_quality, plain_scores

from dossierlake.llm import queries, quality, registry
from dossierlake.llm.common import held_out, tokenizer_path


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name], spark)


def test_one_query_for_each_operator():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in range(1, 14) if sum(x.startswith(f"op{n}_") for x in names) != 1] == []
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_recall_of_the_nearest(spark):
    folder = SMALL.replace("0.001", "0.01")
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        scores = data @ data[i]
        scores[i] = -2
        want |= {(int(ids[i]), int(ids[j])) for j in np.argsort(-scores)[:5]}
    got = registry.QUERIES["op9_nearest"](spark, folder).collect()
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


def test_held_out_folds_and_totals(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    lm = registry.QUERIES["op1_lm_scores"](spark, SMALL).collect()
    assert {r.doc_id for r in lm} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in lm)
    assert {r.train_tokens for r in lm} == {sum(r.n_tokens for r in lm if not r.held_out)}
    held = [r for r in lm if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    quality = registry.QUERIES["op2_quality"](spark, SMALL).collect()
    assert {r.doc_id for r in quality} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in quality)
    pieces = registry.QUERIES["op4_packing"](spark, SMALL).collect()
    records = registry.QUERIES["op10_token_records"](spark, SMALL).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in records} == set(docs)


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


def test_lm_scores_against_the_formula(spark):
    rows = documents()
    got = {r.doc_id: r for r in registry.QUERIES["op1_lm_scores"](spark, SMALL).collect()}
    for i, n, known, total, base, score in plain_scores(rows, queries.LM_ORDER, 1.0):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_quality_against_the_definition(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), "quality", ~held_out("doc_id", 5))
    got = {r.doc_id: r.score for r in registry.QUERIES["op2_quality"](spark, SMALL).collect()}
    rows = documents()[:60]
    assert [got[i] for i, _ in rows] == pytest.approx([plain_quality(net, t) for _, t in rows], abs=1e-3)


def test_fingerprints_and_components_against_all_pairs(spark):
    rows = documents()
    prints = []
    for _, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {(i, f"{p:016x}", rows[find(k)][0]) for k, ((i, _), p) in enumerate(zip(rows, prints))}
    assert {tuple(r) for r in registry.QUERIES["op3_simhash"](spark, SMALL).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_surrogates_against_brute_force(spark):
    rows = documents()
    got = {r.doc_id: r.text for r in registry.QUERIES["op7_surrogates"](spark, SMALL).collect()}
    assert check_replaced([t for _, t in rows], [got[i] for i, _ in rows], queries.SURROGATE_KEY)


def test_packed_and_written_ids_against_the_tokenizers(spark):
    from tokenizers import Tokenizer

    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    rows = documents()
    packing, records = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = registry.QUERIES["op4_packing"](spark, SMALL).collect()
    by_doc, sequences = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, text in rows:
        ids = [*packing.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        ends = [0, *(a + b for a, b in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    got = {r.doc_id: r for r in registry.QUERIES["op10_token_records"](spark, SMALL).collect()}
    start = 0
    for i, text in rows:
        ids = [*records.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
