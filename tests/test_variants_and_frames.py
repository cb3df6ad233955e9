"""VARIANT flattening against the parser of single files, and frames over ranges against plain loops."""

import json
import random

from pyspark.sql import functions as F

from dossierlake.operators import frames
from dossierlake.sources import extract, variants


def made(rng, depth):
    kind = rng.randint(0, 7 if depth else 5)
    if kind < 6:
        return [None, True, rng.choice([0, -5, 123456, 1234567, 10**15]), rng.choice([0.5, -1e-7, 1 / 3, 123456.5, 0.0001, 2.5e-300]), "té\"x", ""][kind]
    if kind == 6:
        return [made(rng, depth - 1) for _ in range(rng.choice([0, 1, 3, 12]))]
    return {rng.choice("abé") + str(i): made(rng, depth - 1) for i in range(rng.choice([0, 1, 4]))}


def test_flattened_json_against_the_parser_of_files(spark):
    rng = random.Random(4)
    texts = [json.dumps(made(rng, 4)) for _ in range(80)] + ["", "{", "nul", None, "[]", "{}", '"x"', "3", '{"a": [[1, [2, {"b": null}]]]}']
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, t string, pos int")
    got = {r.id: r.text for r in variants.flattened(frame, "id", F.col("t")).collect()}
    for i, t in enumerate(texts):
        want = extract.flatten_json(t) if t else None
        assert got.get(i, "") == (want or ""), t
    assert variants.flattened(frame.limit(0), "id", F.col("t")).count() == 0


def test_frames_against_loops(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["h"] * 6 + ["a", None]), rng.choice([*range(60), None]), rng.choice([1, 5, -2, None]), rng.choice([None, f"v{i}"])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, k string, t long, size long, v string")
    got = {r.id: r.total for r in frames.range_sums(frame, "k", "t", "id", "size", 10, "total").collect()}
    for i, k, t, _, _ in rows:
        want = None if k is None or t is None else sum(s or 0 for _, l, u, s, _ in rows if l == k and u is not None and t - 10 <= u <= t)
        assert got[i] == want
    last = {r.id: r.found for r in frames.last_known(frame, "k", "t", "id", "v", "found").collect()}
    for i, k, t, _, _ in rows:
        fits = [(u, j, v) for j, l, u, _, v in rows if None not in (k, t, u, v) and l == k and u <= t]
        assert last[i] == (max(fits)[2] if fits else None)
    ranked = frames.places(frame, "k", "id", 7).collect()
    for k in ("h", "a", None):
        own = sorted((r.id, r.place, r.percent_rank, r.ntile) for r in ranked if r.k == k)
        n = len(own)
        tiles = [j + 1 for j in range(7) for _ in range(n // 7 + (j < n % 7))]
        assert own == [(i, p + 1, p / (n - 1), tiles[p]) for p, (i, *_) in enumerate(own)]


def test_a_sum_isnt_taken_for_a_missing_role(spark):
    from dossierlake.operators.report import finding_sums

    findings = spark.createDataFrame([("p", "R1", "BLOCKER", ["a.md", "gone.md"]), ("p", "R2", "WARNING", [])], "project_id string, rule_id string, severity string, evidence array<string>")
    assets = spark.createDataFrame([("p", "a.md", "PLAN")], "project_id string, path string, role string")
    rows = {(r.role, r.severity, r.level): (r.findings, r.rules) for r in finding_sums(findings, assets).collect()}
    assert rows[None, None, 3] == (3, 2) and rows[None, None, 5] == (2, 2) and rows[None, None, 7] == (3, 2)
    assert rows["PLAN", "BLOCKER", 0] == (1, 1) and rows[None, "BLOCKER", 0] == (1, 1)


def test_several_sums_from_one_pass(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["h"] * 6 + ["a", None]), rng.choice([*range(40), None]), rng.choice([1, 5, -2, None]), 1) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, k string, t long, size long, one long")
    got = frames.range_sums(frame, "k", "t", "id", ["size", "one"], 10, ["total", "n"])
    assert got.columns == [*frame.columns, "total", "n"]
    for name, size in (("total", "size"), ("n", "one")):
        alone = {r.id: r[name] for r in frames.range_sums(frame, "k", "t", "id", size, 10, name).collect()}
        assert {r.id: r[name] for r in got.collect()} == alone
    counts = {r.id: r.n for r in got.collect()}
    for i, k, t, _, _ in rows:
        want = None if k is None or t is None else sum(l == k and u is not None and t - 10 <= u <= t for _, l, u, _, _ in rows)
        assert counts[i] == want
