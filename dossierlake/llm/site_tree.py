"""Main texts of web pages through their sites' style trees.

The DOMs of one host's pages merge into one tree: elements of the same path (tags, classes and ids, digits aside) are
one node. Two entropies tell how much a node matters, both to the base of m, its number of pages. Presentation: that of
the styles (sequences of child elements) it comes in; a template's menu has one style, so none. Content: each distinct
text below it has 1 - log n / log m, n being the pages that have the text there: 0 on every page, 1 on a single one; a
branch has the mean of its texts. Together, with l styles, (1 - 0.9^l) presentation + 0.9^l content; and texts of links
don't count towards it. Branches below ``THRESHOLD`` go from each page; a site with under ``MIN_PAGES`` pages shows no
pattern, so there only links tell. What elements say of themselves comes first: menus, footers, forms, scripts and
elements whose class, id or role names an advert, notice, sidebar or comments are no part of any tree. Where a page has
an article (or else a main part), its text is looked for there alone. Plain paragraphs and headings of articles stay
however often a site repeats them, as do texts of pages that would have none left.

A page gives Spark one small row for each of its nodes and texts; sites are never gathered, so one with a third of all
pages is shared by all tasks. Keys of unimportant branches (a few a site) go to every task up to ``SENT`` of them;
beyond that each page meets its own keys in a salted join.

Null and empty pages have an empty text; a null or malformed URL is of the host ''. Repeated rows, also of one page_id,
are rows; ties don't matter; other columns pass through and a column of the result's name is replaced. Very long pages
are read in time that follows their length, in memory of a few times it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dossierlake.llm.common import free_name, slices, text_batches
from dossierlake.llm.html_pages import chosen, read, site_of, text_of
from dossierlake.workspace import materialize

DECAY, THRESHOLD, MIN_PAGES = 0.9, 0.15, 5
#: Keys that are sent to every task at most (8 bytes each), and parts of a hot key in the join that serves more.
SENT, SALTS = 1_000_000, 32
STYLE, TEXT = 0, 1


def observations(pages: DataFrame) -> DataFrame:
    """node, kind, value, chars, linked, path, free: what each page shows of its site's tree, each thing once a page."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            rows: list[tuple] = []
            for url, source in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = read(source, site_of(url))
                blocks = chosen(page)
                paths = {block.path[: k + 1] for block in blocks for k in range(len(block.path))}
                for path in paths:
                    style = xxhash.xxh3_64_intdigest("\n".join(page.children.get(path[-1], ())).encode("utf-8", "replace")) >> 1
                    rows.append((path[-1], STYLE, style, 0, 0, list(path), page.apart.get(path[-1], False)))
                texts = {(block.path[-1], xxhash.xxh3_64_intdigest(block.text.encode("utf-8", "replace")) >> 1): block for block in blocks if block.path}
                rows += [(node, TEXT, value, len(block.text), block.linked, None, None) for (node, value), block in texts.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
            names = ["node", "kind", "value", "chars", "linked", "path", "free"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return pages.mapInArrow(seen, "node long, kind int, value long, chars long, linked long, path array<long>, free boolean")


def importances(seen: DataFrame) -> DataFrame:
    """node, pages, free, presentation, content, unlinked, importance of each node of the merged trees."""
    counted = seen.groupBy("node", "kind", "value").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.any_value("path", True).alias("path"), F.any_value("free", True).alias("free"),
    )
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0))
    log_pages = F.log(F.col("pages").cast("double"))
    nodes = counted.groupBy("node").agg(
        of(STYLE, F.col("pages")).alias("pages"),
        of(STYLE, F.lit(1)).alias("styles"),
        of(STYLE, F.col("pages") * log_pages).alias("style_logs"),
        of(TEXT, F.lit(1)).alias("texts"),
        of(TEXT, log_pages).alias("text_logs"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
        F.any_value("path", True).alias("path"),
        F.any_value("free", True).alias("free"),
    )
    base = F.log(F.col("pages").cast("double"))
    several = F.col("pages") > 1
    nodes = nodes.withColumn(
        "presentation", F.when(several, 1 - F.col("style_logs") / (F.col("pages") * base)).otherwise(1.0)
    ).withColumn("content", F.col("texts") - F.when(several, F.col("text_logs") / base).otherwise(0.0))
    each = nodes.select("*", F.explode("path").alias("above"))
    own = lambda name: F.max(F.when(F.col("above") == F.col("node"), F.col(name))).alias(name)
    branches = each.groupBy("above").agg(
        *(own(c) for c in ("pages", "styles", "presentation", "free")),
        F.sum("texts").alias("texts"), F.sum("content").alias("content"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
    )
    content = F.when(F.col("texts") > 0, F.col("content") / F.col("texts")).otherwise(1.0)
    weight = F.pow(F.lit(DECAY), F.col("styles").cast("double"))
    unlinked = F.when(F.col("chars") > 0, 1 - F.col("linked") / F.col("chars")).otherwise(1.0)
    told = F.when(F.col("pages") >= MIN_PAGES, (1 - weight) * F.col("presentation") + weight * content).otherwise(1.0)
    return branches.select(
        F.col("above").alias("node"), "pages", "free", "presentation", content.alias("content"), unlinked.alias("unlinked"), (told * unlinked).alias("importance")
    )


def _texts(gone_everywhere: np.ndarray | None) -> object:
    """A function of (html, url), or of (html, url, keys to remove), that Spark applies to batches."""
    everywhere = frozenset() if gone_everywhere is None else frozenset(gone_everywhere.tolist())

    def of(sources: pa.Array, urls: pa.Array, *own: pa.Array) -> pa.Array:
        keys = own[0].to_pylist() if own else [None] * len(sources)
        out = []
        for source, url, gone in zip(sources, urls, keys, strict=True):
            blocks = chosen(read(source.as_py(), site_of(url.as_py())))
            out.append(text_of(blocks, everywhere if gone is None else frozenset(gone)))
        return pa.array(out, pa.string())

    if gone_everywhere is None:
        return F.arrow_udf(lambda s, u, k: of(s, u, k), StringType())
    return F.arrow_udf(lambda s, u: of(s, u), StringType())


def extract_text(pages: DataFrame, url_column: str = "url", html_column: str = "html", name: str = "text", sent: int = SENT) -> DataFrame:
    """``pages`` with the main text of each as ``name``."""
    text_batches(pages.sparkSession)
    plain = lambda df: df.select(F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    low = importances(observations(plain(pages))).where(F.col("free") & (F.col("importance") < THRESHOLD)).select("node")
    low = materialize(low, "branches")
    source, url = F.col(html_column).cast("string"), F.col(url_column).cast("string")
    kept = [c for c in pages.columns if c != name]
    if low.count() <= sent:
        keys = np.array(low.toArrow().column("node").to_numpy(), dtype=np.int64)
        return pages.select(*kept, _texts(keys)(source, url).alias(name))
    row, gone = free_name(pages, "__row"), free_name(pages, "__gone")
    named = materialize(pages.withColumn(row, F.expr("uuid()")), "pages")
    found = meeting(named.select(F.col(row).alias("row"), url.alias("url"), source.alias("html")), low)
    keyed = named.join(found.select(F.col("row").alias(row), F.col("gone").alias(gone)), row, "left")
    return keyed.select(*kept, _texts(None)(source, url, F.coalesce(F.col(gone), _no_keys())).alias(name))


def _no_keys() -> Column:
    return F.array().cast("array<bigint>")


def meeting(pages: DataFrame, low: DataFrame) -> DataFrame:
    """row, gone: the keys of ``low`` that each page has. A key that many pages share is joined in SALTS parts."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            rows, nodes = [], []
            for row, url, source in zip(*(b.column(c).to_pylist() for c in ("row", "url", "html")), strict=True):
                page = read(source, site_of(url))
                keys = {k for block in chosen(page) for k in block.path if page.apart.get(k)}
                rows += [row] * len(keys)
                nodes += keys
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(nodes, pa.int64())], names=["row", "node"])

    nodes = pages.mapInArrow(own, "row string, node long").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    salted = low.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return nodes.join(salted, ["node", "salt"]).groupBy("row").agg(F.collect_list("node").alias("gone"))
