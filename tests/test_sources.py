"""Formats, archives, texts, imports and streams."""

import bz2
import datetime
import io
import tarfile
import time
import zipfile
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dossierlake.functions import messages
from dossierlake.functions.lexicon import DEFAULT
from dossierlake.operators import inventory
from dossierlake.sources import archives, extract, files, formats
from dossierlake.streaming import incremental


def zipped(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def tarred(entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def contents(spark, rows):
    return spark.createDataFrame([("p", n, bytearray(c)) for n, c in rows], "project_id string, path string, content binary")


def test_content_decides_over_names(spark):
    rows = [
        ("README.md", b"hello"), ("disguised.md", b"MZ\x90\x00"), ("blob", b"MZ\x00"), ("facts.custom", b"plain words"), ("empty.txt", b""),
        ("a.docx", zipped([("word/document.xml", "<a/>")])), ("b.docx", b"not a zip"), ("c.pdf", b"%PDF-1.4"), ("d.jpg", b"\x89PNG\r\n\x1a\n"),
        ("e.jpg", b"text"), ("f.bin", b"\x00\x01\x02"), ("g.mp3", b"ID3\x00"), ("h.mp4", b"OggS"), ("x.parquet", b"text only"),
    ]
    got = {r.path: r for r in formats.detect_formats(contents(spark, rows)).collect()}
    assert got["README.md"].auditable and got["empty.txt"].auditable and got["a.docx"].auditable and got["c.pdf"].auditable
    for bad in ("disguised.md", "b.docx", "e.jpg", "x.parquet"):
        assert not got[bad].auditable and "EXTENSION_CONTENT_MISMATCH" in got[bad].risk_flags
    assert got["disguised.md"].format == "pe" and got["blob"].risk_flags == ["CONTENT_FORMAT_DETECTED"]
    assert got["facts.custom"].auditable and got["facts.custom"].risk_flags == ["UNKNOWN_TEXT_EXTENSION"]
    for good in ("d.jpg", "f.bin", "g.mp3", "h.mp4"):
        assert got[good].risk_flags == [], good


def test_a_character_at_the_end_of_the_sample_is_no_fault(spark):
    cut = b"x" * (formats.SAMPLE - 1)
    rows = [("a.md", cut + "é".encode() + b"more"), ("b.md", cut[:-2] + "😀".encode()), ("c.md", cut + b"\xc3\x28 more"), ("d.md", cut + b"\xff")]
    got = {r.path: r.format for r in formats.detect_formats(contents(spark, rows)).collect()}
    assert got == {"a.md": "md", "b.md": "md", "c.md": "binary", "d.md": "binary"}


def test_a_table_of_part_files_is_one_table(spark, tmp_path):
    from dossierlake.plans import file_queries

    for name in ("nation.parquet", "documents.parquet/part-0.parquet", "documents.parquet/part-1.parquet", "notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = sorted(map(tuple, file_queries.folder_scan(spark, str(tmp_path)).collect()))
    assert got == [("documents.parquet", "documents.parquet", True), ("nation.parquet", "nation.parquet", True)]


def test_scan_prunes_and_defers(spark, tmp_path):
    for name, size in (("p1/a.txt", 10), ("p1/b.txt", 15), ("p1/c.txt", 5), ("p1/node_modules/x.js", 3), ("p1/deep/er/d.txt", 1), ("p1/big.bin", 99), ("p2/z.txt", 1)):
        target = tmp_path / "in" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x" * size)
    scanned = files.scan_projects(spark, f"{tmp_path}/in")
    assert {(r.project_id, r.path) for r in scanned.select("project_id", "path").collect()} >= {("p1", "deep/er/d.txt"), ("p2", "z.txt")}
    plan = files.import_plan(scanned, files.ImportLimits(file_bytes=50, total_bytes=16, depth=2))
    got = {(r.project_id, r.path): r.reason for r in plan.collect()}
    assert got == {
        ("p1", "a.txt"): None, ("p1", "b.txt"): "COPY_BUDGET_DEFERRED", ("p1", "c.txt"): None, ("p1", "deep/er/d.txt"): "PATH_DEPTH_LIMIT",
        ("p1", "big.bin"): "LARGE_BINARY_DEFERRED", ("p2", "z.txt"): None,
    }
    assert {(r.reason, r.files) for r in files.deferral_counts(plan).collect()} == {("COPY_BUDGET_DEFERRED", 1), ("PATH_DEPTH_LIMIT", 1), ("LARGE_BINARY_DEFERRED", 1)}
    with pytest.raises(ValueError):
        files.ImportLimits(ratio=0.5)


def test_names_below_a_root(spark, tmp_path):
    root = tmp_path / "in"
    names = [f"p1{root}/b.txt", "p1/a b%20c+d.txt", "p1/ü/x.txt", "lone.txt"]
    for name in names:
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x")
    want = {("p1", f"{root}/b.txt".lstrip("/")), ("p1", "a b%20c+d.txt"), ("p1", "ü/x.txt"), ("lone.txt", "lone.txt")}
    for given in (str(root), f"{root}/", f"file://{root}"):
        assert {(r.project_id, r.path) for r in files.scan_projects(spark, given).select("project_id", "path").collect()} == want
    alone = files.open_project(spark, f"{root}/lone.txt").first()
    assert (alone.project_id, alone.path, bytes(alone.content)) == ("lone.txt", "lone.txt", b"x")
    assert {r.path for r in files.open_project(spark, f"{root}/p1", "mine").collect()} == {p for k, p in want if k == "p1"}


def test_hostile_files_end_in_time():
    start = time.process_time()
    assert extract.pdf_text(b"%PDF-1.4" + b"<<" * 2_000_000)[1].startswith("NEED_REVIEW")
    assert extract.pdf_text(b"%PDF-1.4 stream " + b"BT " * 1_000_000 + b"endstream")[1].startswith("NEED_REVIEW")
    assert extract.flatten_json("[" * 200_000) is None and extract.flatten_json('{"a":' * 100_000 + "1" + "}" * 100_000) is None
    assert messages.sanitized(b"\xff" * 1_000_000) == "?" * 1_000_000
    bomb = bz2.compress(bytes(50_000_000))
    with pytest.raises(archives.ExpandedTooFar):
        list(archives.entries_of(bomb, "x.bz2", expanded=1_000_000))
    assert time.process_time() - start < 30


def test_archives_are_listed_checked_and_unpacked(spark):
    rows = [
        ("ok.zip", zipped([("readme.txt", "7 bytes"), ("payload.bin", bytes(range(128))), ("in.zip", "z")], zipfile.ZIP_STORED)),
        ("bomb.zip", zipped([("zeros", b"\0" * 100_000)])),
        ("evil.tar", tarred([("../evil.txt", b"x"), ("a", b"1"), ("a/b", b"2")])),
        ("one.gz", __import__("gzip").compress(b"single file " * 5)),
        ("broken.zip", b"nothing"),
    ]
    data = contents(spark, rows)
    listed = archives.list_entries(data).cache()
    assert {r.path for r in listed.where("archive = 'one.gz'").collect()} == {"one"}
    assert listed.where("archive = 'broken.zip'").first().error
    faults = {(r.archive, r.fault) for r in archives.archive_faults(listed).collect()}
    assert faults == {("bomb.zip", "ENTRY_RATIO"), ("bomb.zip", "TOTAL_RATIO"), ("evil.tar", "UNSAFE_PATH"), ("evil.tar", "FILE_FOLDER_CONFLICT")}
    plan = archives.extraction_plan(listed.where("archive = 'ok.zip'"), files.ImportLimits(file_bytes=32))
    assert {r.path: r.reason for r in plan.collect()} == {"readme.txt": None, "payload.bin": "LARGE_BINARY_DEFERRED", "in.zip": "NESTED_ARCHIVE_DEFERRED"}
    small = archives.extraction_plan(listed.where("archive = 'ok.zip'"), files.ImportLimits(files=2, total_bytes=100))
    assert {r.path: r.reason for r in small.collect()} == {"readme.txt": None, "payload.bin": "COPY_BUDGET_DEFERRED", "in.zip": "FILE_COUNT_DEFERRED"}
    unpacked = archives.unpack(data, plan).collect()
    assert [(r.path, bytes(r.content)) for r in unpacked] == [("ok.zip/readme.txt", b"7 bytes")]


def pdf_of(text):
    body = zlib.compress(b"BT /F1 12 Tf (" + text + b") Tj <48 69> Tj ET")
    return b"%PDF-1.4\n1 0 obj\n<< /Length 9 /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream\nendobj\n"


def test_texts_of_every_format(spark):
    slides = zipped([("ppt/slides/slide1.xml", "<p><t>one</t><t>two</t></p>"), ("ppt/other.xml", "<x>no</x>")])
    rows = [
        ("a.json", b'{"b": {"x": [1, true, null]}, "a": 1234567, "c": "text"}'), ("b.json", b"{nope"), ("c.yaml", b"# c\nname: demo\n"), ("d.yml", b"# only\n"),
        ("e.docx", zipped([("word/document.xml", "<w><t>Hello</t><t>World</t></w>")])), ("f.pptx", slides), ("g.docx", zipped([("word/other.xml", "<a/>")])),
        ("h.pdf", pdf_of(rb"Line \(1\)")), ("i.pdf", b"%PDF-1.4 nothing"), ("j.md", "# 标题\n正文".encode()), ("k.txt", b""), ("l.txt", b"y" * 600_000),
    ]
    known = formats.detect_formats(contents(spark, rows))
    got = {r.path: (r.status, r.text) for r in extract.extract_texts(known).collect()}
    assert len(got) == len(rows)
    assert got["a.json"] == ("EXTRACTED_STRUCTURED_JSON", "key: a\na: 1.23457e+06\nkey: b\nkey: b.x\nb.x[0]: 1\nb.x[1]: true\nkey: c\nc: text\n")
    assert got["b.json"][0] == "NEED_REVIEW_JSON_PARSE_FAILED"
    assert got["c.yaml"] == ("EXTRACTED_STRUCTURED_YAML", "key: name\nname: demo\n") and got["d.yml"][0] == "NEED_REVIEW_YAML_EMPTY"
    assert got["e.docx"] == ("EXTRACTED_OPENXML", "Hello World \n") and got["f.pptx"][1] == "one two \n"
    assert got["g.docx"][0] == got["i.pdf"][0].replace("PDF", "OPENXML") == "NEED_REVIEW_OPENXML_TEXT_EXTRACTION_LIMITED"
    assert got["h.pdf"] == ("EXTRACTED_PDF", "Line (1) Hi")
    assert got["j.md"] == ("EXTRACTED_TEXT", "# 标题\n正文") and got["k.txt"][0] == "EMPTY_OR_UNREADABLE"
    assert got["l.txt"][0] == "NEED_REVIEW_TEXT_TRUNCATED" and len(got["l.txt"][1]) == extract.PLAIN_BYTES


def test_drafts_count_as_generated(spark):
    assets = inventory.inventory_of_paths(spark.createDataFrame([("p", "README.md", 1), ("p", "notes.md", 1)], "project_id string, path string, size_bytes long"))
    marked = inventory.with_unverified(assets, spark.createDataFrame([("p", "notes.md")], "project_id string, path string"))
    assert {r.path: r.role for r in marked.collect()} == {"README.md": "PROJECT_DECLARATION", "notes.md": "GENERATED"}


def test_claims_of_a_stream_once(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    line = "市场规模：预计 TAM 达到 100 亿元\n"
    rows = [("p", "a.md", "EXTRACTED_TEXT", line * 2, at), ("p", "b.md", "EXTRACTED_TEXT", line, at), ("q", "a.md", "EXTRACTED_TEXT", "x\n", at)]
    spark.createDataFrame(rows, incremental.CORPUS).write.parquet(f"{tmp_path}/in")
    stream = incremental.new_claims(incremental.read_corpus(spark, f"{tmp_path}/in"), DEFAULT)
    seen = []
    query = incremental.each_batch(stream, lambda df, n: seen.extend(df.collect()), f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.project_id, r.claim_type) for r in seen] == [("p", "MarketScale")]


def test_windowed_counts(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 0, m), "view") for m in (1, 2, 11)]
    spark.createDataFrame(rows, "ts timestamp, kind string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(f"{tmp_path}/in")
    query = incremental.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.n for r in spark.table("counts").select(F.col("n")).collect()) == [1, 2]


def test_entries_past_the_limit_are_deferred_by_name(spark):
    from dossierlake.sources import archives
    from dossierlake.sources.files import ImportLimits

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for i in range(5):
            archive.writestr(f"{i}.txt", "x")
    rows = spark.createDataFrame([("p", "a.zip", out.getvalue())], "project_id string, path string, content binary")
    unpacked, deferred = archives.open_archive(rows, ImportLimits(files=3))
    assert sorted(r.path for r in unpacked.collect()) == ["a.zip/0.txt", "a.zip/1.txt", "a.zip/2.txt"]
    assert sorted((r.path, r.reason) for r in deferred.collect()) == [("a.zip/3.txt", "FILE_COUNT_DEFERRED"), ("a.zip/4.txt", "FILE_COUNT_DEFERRED")]


def test_many_archives_are_opened_in_small_batches(spark):
    rows = [(f"{i}.zip", zipped([("a.txt", f"text {i}"), ("b.txt", "x" * i)], zipfile.ZIP_STORED)) for i in range(30)]
    data = contents(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    unpacked, deferred = archives.open_archive(data)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    assert {r.path: len(r.content) for r in unpacked.collect()} == {f"{i}.zip/{n}": s for i in range(30) for n, s in (("a.txt", len(f"text {i}")), ("b.txt", i))}
    assert deferred.count() == 0


def test_texts_wrapped_as_files_come_out_as_their_sql_says(spark, tmp_path):
    from oracle import same

    from dossierlake.plans import derived_queries

    texts = [None, "", " ", "!!!", "日本語", "é 1", "BM first", "MZ", "%PDF-1.4 text", "BLENDER!!", "ID3", "PK\x03\x04", "x" * 4 + "ftyp", "a\0b", "\x01\x02\x03", "a\r\nb\n", "\ufeffa", "#", " a ",
             "y" * 600_000, "é" * 300_000, "x" * (formats.SAMPLE - 1) + "é", "BT (a) ET", "legendstream x", "x" * 257 + "ustar ", "\x80"]
    rows = [(8 * i + form, t) for i, t in enumerate(texts) for form in range(8)] + [(0, "again"), (None, "no id"), (2**40 + 4, "?")]
    ids, bodies = zip(*rows, strict=True)
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(bodies, pa.string()), "source": ["s"] * len(rows)})
    pq.write_table(table, tmp_path / "documents.parquet")
    same(derived_queries.QUERIES["text_extraction"], derived_queries.ORACLE_SQL["text_extraction"], spark, str(tmp_path))
