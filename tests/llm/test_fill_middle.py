"""Fill-in-middle against the pattern of its units, in chunks of any size."""

import hashlib
import re

import numpy as np
import pytest

from dossierlake.llm import fill_middle as fm
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_form(i, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_functions_of_chunks_compose_to_the_whole():
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer("a é\t\n日".encode(), dtype=np.uint8), 400)
    cuts = [0, *sorted(rng.integers(0, 400, 20).tolist()), 400]
    found = [fm.transition(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    left, ends = fm.prefixes(np.stack([f[0] for f in found]), np.stack([f[1] for f in found]))
    for k, stop in enumerate(cuts[1:]):
        whole = fm.transition(data[:stop])
        assert left[k].tolist() == whole[0].tolist() and ends[k].tolist() == whole[1].tolist()


@pytest.mark.parametrize("chunk", [3, 50, fm.CHUNK])
def test_every_text_against_the_pattern(spark, chunk):
    texts = [(None, None), (1, ""), (2, " \t "), (3, " a "), (3, " a "), (3, "other"), (4, "<P>x y"), (5, "é ü " * 50), (None, "ab cd\x0bef"), (6, "a" * 900 + " \n" * 300)]
    texts += [(100 + i, "é" * (i % 7) + " " * (i % 4) + "日本 x" * i) for i in range(40)]
    docs = spark.createDataFrame([(*t, "kept") for t in texts], "doc_id long, text string, cut string").withColumnRenamed("cut", "__cut")
    done = fm.fill_in_middle(docs, chunk=chunk).select("doc_id", "text", "__cut", "fim.*")
    rows = done.withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(i), str(t)) for i, t in texts)
    assert {r["__cut"] for r in rows} == {"kept"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_form(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert len({r.form for r in rows}) == 3


def test_a_long_text_and_no_texts(spark):
    long = "word  \n" * 150_000
    docs = spark.createDataFrame([(i, long + str(i)) for i in range(4)], "doc_id long, text string")
    got = {r.doc_id: r for r in fm.fill_in_middle(docs).select("doc_id", "fim.*").collect()}
    assert all(tuple(got[i])[1:] == plain_form(i, long + str(i)) for i in range(4))
    assert fm.fill_in_middle(docs.limit(0)).count() == 0
