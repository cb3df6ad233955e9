"""The gram index against looking through the texts."""

import glob
import random

import pyarrow.parquet as pq
import pytest

from dossierlake.operators import text_index


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def test_needles_of_every_length_against_the_texts(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abAB é\n|ß") for _ in range(rng.randint(0, 60)))
    rows = [(f"p{i % 3}", f"{i}.md", word()) for i in range(60)] + [("p", "null.md", None), ("p", "empty.md", ""), ("p", "a.md", "a"), ("p", "rep.md", "ab" * 500)]
    corpus = spark.createDataFrame([(*r, 1) for r in rows], "project_id string, path string, text string, gram int")
    folder = f"file://{tmp_path}/index"
    text_index.build_index(corpus, folder)
    needles = {"a", "b", "é", "|", "ab", "ba", "a|", "abab", "aba", "bé", "ßa", "AB aB", "zzz", "z", "a\nb", "ab" * 40, "\n"}
    needles |= {t[i : i + n] for _, _, t in rows if t for i in (0, 3) for n in (1, 2, 3, 4, 7, 11) if len(t) > i + n}
    needles = sorted(needles)
    got = {(r.needle, r.project_id, r.path): list(r.places) for r in text_index.find_places(spark, folder, needles).collect()}
    want = {}
    for n in needles:
        key = lowered(n)
        for project, path, text in rows:
            data = lowered(text)
            places = [i for i in range(len(data)) if data.startswith(key, i)]
            if places:
                want[(n, project, path)] = places
    assert got == want
    lines = {(r.needle, r.project_id, r.path): list(r.lines) for r in text_index.find_lines(spark, folder, needles).collect()}
    want = {}
    for n in needles:
        for project, path, text in rows:
            found = [k + 1 for k, line in enumerate((text or "").split("\n")) if lowered(n) in lowered(line) and "\n" not in n]
            if found:
                want[(n, project, path)] = found
    assert lines == want


def test_a_search_reads_the_row_groups_of_its_grams(spark, tmp_path):
    corpus = spark.createDataFrame([("p", f"{i}", f"text {i * i} of words {chr(97 + i % 26)}{chr(98 + i % 25)}") for i in range(3000)], "project_id string, path string, text string")
    folder = f"{tmp_path}/index"
    text_index.build_index(corpus, f"file://{folder}", row_group=32 << 10)
    ranges = []
    for name in sorted(glob.glob(f"{folder}/*.parquet")):
        meta = pq.ParquetFile(name).metadata
        column = meta.schema.names.index("gram")
        ranges += [(s.min, s.max) for k in range(meta.num_row_groups) if (s := meta.row_group(k).column(column).statistics)]
    ranges.sort()
    assert len(ranges) > 4 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    [(gram, _, _)] = text_index.needle_parts("wor")
    assert sum(low <= gram <= high for low, high in ranges) < len(ranges) / 2
    plan = text_index.read_grams(spark, f"file://{folder}", [(gram, gram)])._jdf.queryExecution().toString()
    assert f"EqualTo(gram,{gram})" in plan


def test_needles_that_cannot_be_searched_and_many_ranges(spark):
    for bad in ("", "a\0b"):
        with pytest.raises(ValueError, match="not searchable"):
            text_index.needle_parts(bad)
    test = str(text_index.grams_within([(3 * k, 3 * k) for k in range(2000)]))
    assert test.count("gram") <= 2 * text_index.POINTS


def test_an_index_has_a_posting_a_gram_and_block_and_not_a_file(spark, tmp_path):
    words = [f"word{k}" for k in range(50)]
    rows = [("p", f"{i}", " ".join(random.Random(i).choices(words, k=200))) for i in range(400)]
    text_index.build_index(spark.createDataFrame(rows, "project_id string, path string, text string"), f"file://{tmp_path}/index")
    grams = {t[i : i + 3] for *_, t in rows for i in range(len(t))}
    assert spark.read.parquet(f"file://{tmp_path}/index").count() <= 2 * len(grams)


@pytest.mark.parametrize("block", [1, 500])
def test_files_of_many_blocks_are_found(monkeypatch, block):
    monkeypatch.setattr(text_index, "BLOCK", block)
    values = text_index.np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) - 1, 1 << 28, 1 << 31])
    assert text_index.unpacked(text_index.packed(values)[0]).tolist() == values.tolist()
    grams, places, starts = text_index.block_postings([b"Abab", b"", "né".encode() * block, b"b"])
    assert starts.tolist() == [0, 6, 8, 10 + 3 * block]
    found = text_index.places_in_block(grams.to_numpy(), places, text_index.needle_parts("b"))
    assert found.tolist() == [1, 3, 10 + 3 * block]
