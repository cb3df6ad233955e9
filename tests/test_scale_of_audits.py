"""What keeps an audit's work in proportion: classes of files, one look at a text, lengths before patterns."""

import json
import random
import shutil
import sys

import pyarrow as pa
import pyarrow.parquet as pq
from oracle import SMALL, same
from pyspark.sql import functions as F

from dossierlake.functions import text as t
from dossierlake.functions.lexicon import DEFAULT
from dossierlake.operators import claims, diff, evidence, histories, profile, report, trust
from dossierlake.plans import reaudit, whole_audit
from dossierlake.plans.driver import PROSE

ASSET = "project_id string, path string, role string, auditable boolean, sensitive boolean, generated boolean, vendored boolean"
TEXT = "project_id string, path string, status string, text string"


def test_claims_meet_classes_of_files_and_list_the_first_of_all(spark):
    claim = [("p", "CLM-001", "市场规模达到 100 亿元", "MarketScale", "plan.md")]
    stated = spark.createDataFrame(claim, "project_id string, claim_id string, claim_text string, claim_type string, path string")
    names = [f"{i:03d}.md" for i in range(200)]
    body = ["市场规模 100", "市场规模 100 7 8", "市场规模 300", "无", ""]  # numbers that no claim gives tell nothing apart
    assets = spark.createDataFrame([("p", n, "MARKET_RESEARCH", i % 7 != 6, False, False, False) for i, n in enumerate(names)], ASSET)
    corpus = spark.createDataFrame([("p", n, "EXTRACTED_TEXT", body[i % 5] + f" {1000 + i}" * (i % 5 == 1)) for i, n in enumerate(names)], TEXT)
    pairs = evidence.judged_classes(stated, assets, corpus, DEFAULT)
    assert pairs.count() == 4  # not to be read, with the number, with another, without any sign
    found = evidence.match_evidence(stated, assets, corpus, DEFAULT).first()
    fits = [n for i, n in enumerate(names) if i % 5 < 2 and i % 7 != 6]
    assert (found.status, found.evidence_files) == ("PARTIAL", fits[:24])


def test_only_another_file_than_its_own_proves_a_claim(spark):
    stated = spark.createDataFrame([("p", "CLM-001", "市场规模达到 100 亿元", "MarketScale", "a.md")], "project_id string, claim_id string, claim_text string, claim_type string, path string")
    for names, want in ((["a.md"], "PARTIAL"), (["a.md", "b.md"], "SUPPORTED")):
        assets = spark.createDataFrame([("p", n, "MARKET_RESEARCH", True, False, False, False) for n in names], ASSET)
        corpus = spark.createDataFrame([("p", n, "EXTRACTED_TEXT", "数据来源：年鉴，市场规模 100") for n in names], TEXT)
        found = evidence.match_evidence(stated, assets, corpus, DEFAULT).first()
        assert (found.status, found.evidence_files) == (want, names)


def test_words_and_numbers_seen_in_texts(spark):
    rng = random.Random(5)
    lists = {"": PROSE.contradictions, "a": ("mail", "a.b", "c+"), "b": ("专利", "kelvin"), "none": ()}
    parts = ["worthless", "SCUM", "MaIl", "a.b", "axb", "C+", "专利", "Kelvin", "Kelvin", "ſcum", "é", "\n", " ", "7", "1,000.5", "12.", "٣"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for i in range(600)] + [(600, None), (601, "")]
    frame = spark.createDataFrame(rows, "id int, x string")
    got = {r.id: r.seen for r in frame.select("id", evidence.seen_in(F.col("x"), lists).alias("seen")).collect()}
    want = frame.fillna("").select("id", t.numbers_in(F.col("x")).alias("numbers"), *[t.contains_any(t.lower_ascii(F.col("x")), w).alias(f"k{k}") for k, w in lists.items()])
    for row in want.collect():
        assert got[row.id].numbers == row.numbers, row
        assert got[row.id].kinds == [k for k in lists if row[f"k{k}"]], row


def test_every_letter_in_lower_case_to_find(spark):
    letters = spark.createDataFrame([(f"x{chr(c)}y",) for c in range(1, sys.maxunicode + 1, 1) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c > 0x1D000 and c < 0x1F000)], "x string")
    for words in (tuple("abcdefghijklmnopqrstuvwxyz"), ("专利", "x"), ("é", "y")):
        ours, theirs = t.lower_to_find(F.col("x"), words), t.lower_ascii(F.col("x"))
        assert letters.where(F.expr("false") | F.exists(F.array(*[ours.contains(w) != theirs.contains(w) for w in words]), lambda b: b)).count() == 0


def test_lengths_leave_out_no_line_that_counts(spark):
    pads = ["", " " * 400, "\t\x0b", "#" * 400 + " ", "- * > "]
    values = ["token version 3", "The answer", "und: du", "# Title", "x" * 400 + " token 3", "", "\n"]
    rows = [("p", f"{i}-{j}-{k}.md", a + v + b) for i, a in enumerate(pads) for j, v in enumerate(values) for k, b in enumerate(pads)]
    texts = spark.createDataFrame([*rows, ("p", "null.md", None)], "project_id string, path string, text string")
    lines = texts.select("project_id", "path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    kept = {(r.path, r.line_no) for r in reaudit.telling_lines(texts, PROSE).select("path", "line_no").collect()}
    line = t.trimmed(F.col("raw"))
    stated = lines.where(t.byte_length(line).between(6, 360) & claims.claim_type(line, PROSE).isNotNull())
    bare = t.without_markdown(line)
    titled = line.startswith("# ") & t.byte_length(line).between(3, 120)
    filled = lines.where(titled | (t.byte_length(bare).between(4, 300) & (F.size(profile.labels_found(bare, PROSE.profile_labels)) > 0)))
    want = {(r.path, r.line_no) for part in (stated, filled) for r in part.select("path", "line_no").collect()}
    assert len(want) > 40 and want <= kept < {(r.path, r.line_no) for r in lines.select("path", "line_no").collect()}


def test_texts_are_read_once_and_by_nothing_later(spark, tmp_path):
    for name in ("documents", "labels"):
        shutil.copy(f"{SMALL}/{name}.parquet", tmp_path)
    audit = whole_audit.driver_audit(spark, str(tmp_path))
    (tmp_path / "documents.parquet").unlink()  # whatever still asks for a text fails
    assert audit.evidence.count() > 0 and audit.scores.count() == 20
    assert audit.corpus.where("text_size is null").count() == 0


def test_facts_of_read_texts_are_those_of_lines_cut_by_spark(spark):
    pads = ["", " " * 400, "\t\x0b", "#" * 400 + " ", "- * > ", "x" * 400]
    values = ["token VERSION 3", "The answer", "und: du", "x y le： z", "# Title", "市场规模 达到 7", "已上线", "目标用户：学生", "专利 已申请", "暂无 专利 已申请", "Kelvin token =", "", "\n", "\n\n"]
    rows = [("p", f"{i}-{j}-{k}.md", a + v + b + "\n" + v + b) for i, a in enumerate(pads) for j, v in enumerate(values) for k, b in enumerate(pads)]
    rows += [("p", "null.md", None), ("p", "empty.md", "")]
    texts = spark.createDataFrame(rows, "project_id string, path string, text string")
    assets = texts.select("project_id", "path", F.lit("BUSINESS_PLAN").alias("role"), F.lit(True).alias("auditable"), *[F.lit(False).alias(c) for c in ("sensitive", "generated", "vendored")])
    statuses = texts.select("project_id", "path", F.lit("EXTRACTED_TEXT").alias("status"))
    for lexicon in (PROSE, DEFAULT):
        old = reaudit.facts_of(texts, assets, lexicon, statuses)
        read = reaudit.read_texts(texts, lexicon)
        new = reaudit.facts_of_read(read, statuses, lexicon)
        first = {"statements": reaudit._first_in_file(new.statements, ["claim_type", "key"], "line"), "fields": reaudit._first_in_file(new.fields, ["field"], "value"), "features": new.features}
        for name, frame in first.items():
            want = getattr(old, name)
            got, want = ({repr(r.asDict()) for r in f.select(sorted(want.columns)).collect()} for f in (frame, want))
            assert got == want and len(want) > 20, (name, got ^ want)
        sizes = {r.path: r.text_size for r in read.collect()}
        assert sizes == {p: len((x or "").encode()) for _, p, x in rows}


def test_one_pattern_of_paths_excludes_what_their_parts_names_and_extensions_do(spark):
    rng = random.Random(7)
    parts = ["a", "Vendor", ".GIT", "out", "x.test.py", "A_MOCK.js", ".css", "b.CSS", "c.css\n", "d\n.css", "e.lock", "Cargo.lock", "yarn.lock", "test", "tests2", "", ".", "é.map", "ſ.leſs", "K.LESS", "f.css.md", "g.mock.", "h\r.map", "i .map"]
    paths = {"/".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(1500)} | set(parts)
    low = t.lower_ascii(F.col("path"))
    name = t.file_name(low)
    want = (
        F.arrays_overlap(t.path_parts(low), F.array(*map(F.lit, trust.EXCLUDED_PARTS)))
        | t.contains_any(name, trust.EXCLUDED_NAMES)
        | t.extension_of(low).isin(*trust.STYLE_EXTENSIONS)
        | name.isin(*trust.LOCK_NAMES)
    )
    frame = spark.createDataFrame([(p,) for p in sorted(paths)], "path string").select("path", trust.excluded_path(F.col("path")).alias("ours"), want.alias("theirs"))
    assert [r.path for r in frame.where("not (ours <=> theirs)").collect()] == [] and 300 < frame.where("ours").count() < 1400


def test_a_package_is_parsed_once_whatever_its_metrics_are_used_for(spark):
    summary = {"total_score": 70, "trust_debt": 30, "blocker_count": 1, "warning_count": 2, "evidence_coverage": 12.5, "material_completeness": 9, "consistency_score": 8, "fix_task_count": 3}
    whole = json.dumps({"report_schema_version": 2, "summary": summary, "claims": [{"summary": {"total_score": 1}}]})
    texts = [whole, whole[:-1], "no JSON", "", None, "{}", "[]", '{"summary": null}', '{"summary": [1]}', '{"summary": {"total_score": 5}}', '{"other": 1, "summary": {"fix_task_count": "4", "trust_debt": 1e2}}']
    documents = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "project_id string, json string")
    got = report.metrics_of(documents)
    names = {"score": "total_score", "blockers": "blocker_count", "warnings": "warning_count"}
    want = documents.select("project_id", *[F.get_json_object("json", f"$.summary.{names.get(m, m)}").cast("double").alias(m) for m in diff.METRICS])
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    valid = got.where(diff.valid_metrics())
    assert [r.project_id for r in valid.collect()] == ["0"]
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_tuple(json") == 1 and "get_json_object" not in plan


def test_what_lines_say_is_found_where_they_are_cut(spark):
    texts = spark.createDataFrame([("p", "a.md", "The answer\nx the: y\n# A\n# B\ntoken version 3\nTOKEN, version 3\nlicen=\n" + "x" * 400 + " token 3"), ("p", "b.md", None)], "project_id string, path string, text string")
    said = {r.path: r.said for r in reaudit.read_texts(texts, PROSE).collect()}
    assert said["b.md"].statements == said["b.md"].fields == []
    assert [tuple(s) for s in said["a.md"].statements] == [("Revenue", "tokenversion3", 4, "token version 3"), ("Revenue", "tokenversion3", 5, "TOKEN, version 3")]
    assert sorted(tuple(f) for f in said["a.md"].fields) == [("solution", 0, "The answer"), ("title", 2, "A")]


def test_statuses_of_any_case_are_told_by_one_pattern(spark):
    rng = random.Random(3)
    parts = ["EXTRACTED", "extracted", "Need_Review", "need_re", "view", "TRUNCATED", "_TEXT", "EMPTY", "Limited", "ſ", "K", "İ", "é", "\n", " ", ""]
    values = {"".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(1500)}
    frame = spark.createDataFrame([(v,) for v in sorted(values)] + [(None,)], "status string")
    low = t.lower_ascii(F.coalesce("status", F.lit("")))
    review = (low == "") | t.contains_any(low, trust.REVIEW_WORDS)
    reliable = ~review & t.lower_ascii(F.col("status")).startswith("extracted")
    both = frame.select("status", (trust.needs_review(F.col("status")).eqNullSafe(review) & trust.reliable(F.col("status")).eqNullSafe(reliable)).alias("same"), reliable.alias("reliable"))
    assert both.where("not same").count() == 0 and 20 < both.where("reliable").count() < 1400
    plan = frame.select(trust.needs_review(F.col("status")), trust.reliable(F.col("status")))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan


def test_few_rows_are_few_ranges_and_fixed_tables_no_rows_of_python(spark, monkeypatch):
    written = []
    monkeypatch.setattr(histories, "materialize", lambda df, name: written.append(df) or df.localCheckpoint())
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(500).select((F.col("id") % 3).alias("k"), "id", F.lit(2).alias("size"))
        totals = {(r.k, r.id): r.before for r in histories.running_total(rows, "k", "id", "size").collect()}
        assert all(totals[k, i] == 2 * (i // 3) for k, i in totals) and len(totals) == 500
        assert written[0].rdd.getNumPartitions() < 64
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    roles = evidence.candidate_roles(rows, DEFAULT)
    assert {tuple(r) for r in roles.collect()} == {(k.name, r, r in k.proof_roles) for k in DEFAULT.claim_types for r in k.roles}
    assert "RDD" not in roles._jdf.queryExecution().executedPlan().toString()


def test_any_number_of_claims_is_numbered_in_order(spark):
    lines = {f"{i}.md": [f"注册用户达到 {i}{j:03d} 人" for j in range(600)] for i in range(2)}
    corpus = spark.createDataFrame([("p", n, "EXTRACTED_TEXT", "\n".join(body)) for n, body in lines.items()], TEXT)
    assets = spark.createDataFrame([("p", n, "BUSINESS_PLAN", True, False, False, False) for n in lines], ASSET)
    got = {r.claim_id: r.claim_text for r in claims.extract_claims(corpus, assets, most=None).collect()}
    assert got == {f"CLM-{n:03d}": line for n, line in enumerate(lines["0.md"] + lines["1.md"], 1)}
    assert claims.extract_claims(corpus, assets).count() == 120


def test_claims_that_meet_files_by_numbers_find_what_claims_of_classes_find(spark):
    rng = random.Random(11)
    parts = ["100", "7", "2024", "12345678", "市场规模", "行业年鉴", "专利号", "未授权", "营收", "发票号", "华星公司已", "盖章", "Kubernetes", "gateway", "无", ""]
    kinds = [k.name for k in DEFAULT.claim_types]
    roles = sorted({r for k in DEFAULT.claim_types for r in k.roles})
    claim = [(f"p{i % 3}", f"CLM-{i:03d}", " ".join(["与华星公司已签署"] * (i % 4 == 1) + rng.choices(parts, k=4)), kinds[i % len(kinds)], f"{i % 90:03d}.md") for i in range(400)]
    stated = spark.createDataFrame(claim, "project_id string, claim_id string, claim_text string, claim_type string, path string")
    places = [(f"p{p}", f"{i:03d}.md") for p in range(3) for i in range(600)]
    assets = spark.createDataFrame([(*at, rng.choice(roles), rng.random() < 0.9, False, False, False) for at in places], ASSET)
    corpus = spark.createDataFrame([(*at, rng.choice(["EXTRACTED_TEXT"] * 9 + ["NEED_REVIEW_PDF"]), " ".join(rng.choices(parts, k=6))) for at in places if rng.random() < 0.9], TEXT)
    found = {many: {r.project_id + r.claim_id: r for r in evidence.match_evidence(stated, assets, corpus, DEFAULT, many=many).collect()} for many in (False, True)}
    assert found[True] == found[False] and len(found[True]) == 400
    assert {r.status for r in found[True].values()} >= {"CONFLICTED", "SUPPORTED", "PARTIAL", "NEED_REVIEW"}
    assert max(len(r.evidence_files) for r in found[True].values()) == 24


def test_a_file_with_many_of_a_claims_numbers_hides_no_other_file(spark):
    numbers = [str(100 + i) for i in range(40)]
    claim = [("p", "CLM-001", "市场规模 " + " ".join(numbers), "MarketScale", "plan.md")]
    stated = spark.createDataFrame(claim, "project_id string, claim_id string, claim_text string, claim_type string, path string")
    bodies = {"00.md": "市场规模 " + " ".join(numbers)} | {f"{i + 1:02d}.md": f"市场规模 {n}" for i, n in enumerate(reversed(numbers))}
    assets = spark.createDataFrame([("p", n, "MARKET_RESEARCH", True, False, False, False) for n in bodies], ASSET)
    corpus = spark.createDataFrame([("p", n, "EXTRACTED_TEXT", b) for n, b in bodies.items()], TEXT)
    assert evidence.match_evidence(stated, assets, corpus, DEFAULT, many=True).first().evidence_files == sorted(bodies)[:24]


def test_a_repair_plan_counts_all_claims_of_a_project(spark, tmp_path):
    texts = ["\n".join([f"token {1000 * i + j} item" for j in range(60)] + ["with mail 7", "worthless token version"][: i % 3]) for i in range(42)]
    ids, source = pa.array(range(42), pa.int64()), ["a" if i < 35 else "b" for i in range(42)]
    pq.write_table(pa.table({"doc_id": ids, "text": texts, "source": source}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": ids, "quality": [int(i % 5 > 0) for i in range(42)], "toxic": [int(i % 11 == 0) for i in range(42)]}), tmp_path / "labels.parquet")
    assert whole_audit.whole_driver_audit(spark, str(tmp_path)).claims.where("project_id = 'a'").count() > 1000
    assert "n <= 120" not in whole_audit.ORACLE_SQL["audit_repair_plan"] and "n <= 120" in whole_audit.ORACLE_SQL["audit_fix_tasks"]
    same(whole_audit.QUERIES["audit_repair_plan"], whole_audit.ORACLE_SQL["audit_repair_plan"], spark, str(tmp_path))
