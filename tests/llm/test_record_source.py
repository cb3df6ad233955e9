"""Records by range against the records in order."""

from dossierlake.llm import record_files, record_source
from dossierlake.llm.common import tokenizer_path


def test_ranges_read_what_was_asked_for(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 5)) for i in range(120)] + [(None, None)], "doc_id long, text string")
    folder = record_files.new_folder(spark)
    files = record_files.write_token_files(docs, folder, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    whole = [(r.doc_id, bytes(r.ids)) for r in record_files.read_token_files(spark, folder, files).orderBy("start").collect()]
    source = record_source.records(spark, folder, files, most=7)
    got = sorted((r.place, r.doc_id, bytes(r.ids)) for r in source.collect())
    assert got == [(k, *r) for k, r in enumerate(whole)]
    part = source.where("place >= 30 and place < 45 and doc_id % 2 = 0")
    assert sorted(r.place for r in part.collect()) == [k for k in range(30, 45) if whole[k][0] % 2 == 0]
    assert [r.doc_id for r in source.where("place = 50").collect()] == [whole[50][0]]
    assert source.where("place > 500").count() == 0 and source.where("place <= 0").count() == 1
    assert record_source.records(spark, folder, files.limit(0)).count() == 0


def test_a_filter_leaves_no_range_outside_of_it():
    reader = record_source.RecordReader("folder", [("a", 10), ("b", 25), ("c", 5)], 10)
    rest = list(reader.pushFilters([record_source.GreaterThanOrEqual(("place",), 8), record_source.LessThan(("place",), 21), record_source.EqualTo(("doc_id",), 3)]))
    assert [type(f).__name__ for f in rest] == ["EqualTo"]
    assert [(p.path, p.first, p.last) for p in reader.partitions()] == [("a", 8, 10), ("b", 0, 10), ("b", 10, 11)]
