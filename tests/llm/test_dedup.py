"""SimHash near-duplicates and components against brute force."""

from collections import defaultdict

import numpy as np
import pytest
import xxhash

from dossierlake.llm import resemblance, simhash
from dossierlake.llm.components import connected_components


def plain_fingerprint(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = n
                todo += near[x]
    return root


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b", "A b c", "a b c d e f g " * 50, "é È ünï 漢字 x"])
def test_fingerprint_is_the_plain_one(text):
    for words in (1, 3, 5):
        assert simhash.fingerprint(text, words) == plain_fingerprint(text, words)


def test_spark_hash_is_the_same(spark):
    row = spark.sql("select xxhash64('the quick fox') h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"the quick fox", 42)


def planted(rng, clusters=60, size=12):
    """Clusters around random codes, each code a few bits from another of its cluster."""
    codes = []
    for _ in range(clusters):
        own = [int(rng.integers(0, 1 << 63))]
        for _ in range(size):
            x = own[rng.integers(len(own))]
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            own.append(x)
        codes += own
    return sorted(set(codes))


@pytest.mark.parametrize(("shard", "block", "sample"), [(20, 6000, 100_000), (40, 7, 100_000), (10_000, 50, 100_000), (20, 60, 16)])
def test_links_give_all_components(spark, monkeypatch, shard, block, sample):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("TREE_SAMPLE", sample), ("OWN_SAMPLE", 40)):
        monkeypatch.setattr(simhash, name, value)
    codes = np.array(planted(np.random.default_rng(shard)), dtype=np.uint64)
    signed = codes.view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(c,) for c in signed], "fingerprint long"), 3)
    found = [(r.a, r.b) for r in links.collect()]
    for a, b in found:
        assert (a ^ b).bit_count() <= 3 or ((a ^ b) % (1 << 64)).bit_count() <= 3
    away = np.bitwise_count(codes[:, None] ^ codes[None])
    all_pairs = [(signed[i], signed[j]) for i, j in zip(*np.nonzero(away <= 3)) if i < j]
    assert plain_components(signed, found) == plain_components(signed, all_pairs)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    plain = plain_components(signed, all_pairs)
    linked = {x for p in all_pairs for x in p}
    assert roots == {n: plain[n] for n in linked}


def test_shards_multiply_with_the_data(spark, monkeypatch):
    for name, value in (("SHARD", 20), ("BLOCK", 60), ("TREE_SAMPLE", 16), ("OWN_SAMPLE", 64)):
        monkeypatch.setattr(simhash, name, value)
    largest, placed = [], []
    keep = simhash.divided

    def divided(rows, radius):
        out = keep(rows, radius)
        largest.append(out.where("member").groupBy("shard").count().agg({"count": "max"}).first()[0])
        placed.append(out.count())
        return out

    monkeypatch.setattr(simhash, "divided", divided)
    rng = np.random.default_rng(6)
    for times in (1, 4):
        codes = np.unique(rng.integers(0, 1 << 63, 500 * times, dtype=np.uint64)).astype(np.int64).tolist()
        assert simhash.links(spark.createDataFrame([(c,) for c in codes], "fingerprint long"), 3).count() < len(codes)
    assert max(largest) <= 70
    assert placed[1] < 12 * placed[0]


@pytest.mark.parametrize("size", [1, 700])
def test_a_forest_joins_what_all_links_join(monkeypatch, size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    codes = np.unique(base[rng.integers(0, 3, size)] ^ (np.uint64(1) << rng.integers(0, 6, size, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, size, dtype=np.uint64)))
    signed = codes.view(np.int64)
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 3
    for asking in (None, signed[::2]):
        members = signed if asking is None else signed[1::2]
        found = simhash.forest(members, asking, 3)
        pairs = list(zip(found["a"].tolist(), found["b"].tolist()))
        rows, columns = np.nonzero(near)
        own = [(int(signed[i]), int(signed[j])) for i, j in zip(rows, columns) if i < j and (asking is None or i % 2 != j % 2)]
        whole = plain_components(signed.tolist(), own)
        assert plain_components(signed.tolist(), pairs) == whole
        assert len(pairs) == len(signed) - len(set(whole.values()))


def test_tree_queries_meet_every_near_member():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 32, 4000, dtype=np.uint64)
    codes = np.concatenate([codes, codes ^ (np.uint64(1) << rng.integers(0, 32, 4000, dtype=np.uint64))])
    tree = simhash.VantagePointTree(codes[:500], 7, seed=3)
    row, shard, home = tree.shards(codes, 1)
    homes = dict(zip(row[home].tolist(), shard[home].tolist()))
    seen = set(zip(row.tolist(), shard.tolist()))
    assert len(homes) == len(codes)
    for i in range(4000):
        j = i + 4000
        assert (i, homes[j]) in seen or (j, homes[i]) in seen


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7), (None, 3), (9, 8)]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    roots = {r.node: r.root for r in got}
    assert len(got) == len(roots)
    assert {roots[i] for i in range(100, 161)} == {100}
    assert {roots[k] for k in range(200, 260)} == {5}
    assert roots[9] == 8
    assert 7 not in roots and 3 not in roots


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(1000, None), (1001, ""), (1002, " \n "), (None, "null id text here"), (1003, "Null ID text here")]
    for i in range(80):
        words = rng.choice(vocabulary, rng.integers(1, 60)).tolist()
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            rows.append((500 - i, "  ".join(words).upper()))
        if i % 4 == 0 and len(words) > 40:
            words[5] = "changed"
            rows.append((700 + i, " ".join(words)))
    rows += [rows[10], (5000, "x " * 30_000), (5001, "x " * 30_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = simhash.near_duplicates(docs, words=3).collect()
    assert len(got) == len(rows)
    marks = {(i, plain_fingerprint(t, 3)) for i, t in rows}
    codes = sorted({f for _, f in marks})
    pairs = [(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 3]
    root = plain_components(codes, pairs)
    least = defaultdict(list)
    for i, f in marks:
        least[root[f]].append(i)
    want = {(i, f"{f:016x}", min((x for x in least[root[f]] if x is not None), default=None)) for i, f in marks}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


@pytest.mark.parametrize("block", [4_000_000, 40_000])
def test_one_of_each_joins_what_reaches_the_bar(spark, monkeypatch, block):
    monkeypatch.setattr(resemblance, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(None, None), (1, " \n"), (2, "one two"), (3, "ONE  two")]
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 200))]
        rows.append((100 * i + 10, " ".join(words)))
        for k in range(1 + i % 3 * 3):  # a word changed changes five shingles, so these lie on both sides of the bar
            changed = list(words)
            for at in rng.choice(len(words), rng.integers(0, 7), replace=False):
                changed[at] = f"new{rng.integers(10**9)}"
            rows.append((100 * i + 11 + k, " ".join(changed)))
    hot = [f"h{x}" for x in range(100)]
    for k in range(60):  # a dense group where many pairs miss the bar but a third joins them
        rows.append((90_000 + k, " ".join(hot[:k] + [f"own{k}"] + hot[k + 1 :])))
    sets = []
    for _, t in rows:
        found = (t or "").lower().split()
        sets.append({tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set())
    pairs = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    assert sum(sets[a] != sets[b] for a, b in pairs) > 100
    root = plain_components(range(len(rows)), pairs)
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int").coalesce(1)
    got = resemblance.one_of_each(docs).collect()
    assert sorted(r.n for r in got) == sorted(k for k in root if root[k] == k)


def test_links_below_the_bar_are_not_made(spark):
    words = [f"w{i}" for i in range(60)]
    far = words[:20] + ["x"] + words[21:40] + ["y"] + words[41:58] + ["z", "z"]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(far))], "doc_id long, text string")
    assert resemblance.one_of_each(docs).count() == 2
