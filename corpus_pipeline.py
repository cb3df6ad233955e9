"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that the stage before kept and returns the columns of documents, the last one the packed
pieces. ``run`` writes each stage as Parquet in the shared folder and reads it back, so a stage that is lost with an
executor starts from its predecessor's files.

All stages take null and repeated ids, null, empty and very long texts, ties and repeated rows (each row is a document),
empty tables (the result is empty) and further columns of any name, which they pass on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.llm import mixing, packing, pii, quality, resemblance
from dossierlake.llm.common import free_name, held_out, tokenizer_path, word_count
from dossierlake.llm.queries import QUALITY_FROM, SURROGATE_KEY
from dossierlake.workspace import materialize, spread_table, table

#: The byte-level tokenizer's end of text.
END_OF_TEXT = 50256
#: Pieces that a worker remembers here, where it has held other stages' data before.
PIECES = 20_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones among them.

    A null or empty text is scored like any other. Equal texts get equal scores, so copies stay or go together.
    """
    net = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", train_on=~held_out("doc_id", 5))
    name = free_name(docs, "__quality")
    return quality.score(docs, net, name=name).where(F.col(name) >= QUALITY_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of a Jaccard similarity of 0.8 or more over five-word shingles join.

    Links are the SimHash operator's, confirmed, and those that its fingerprints can't see (see ``resemblance``). Texts
    without words are one group.
    """
    return resemblance.one_of_each(docs, words=5).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data, and n_chars after that; null texts stay null."""
    done = pii.replace_entities(docs, SURROGATE_KEY, counted=free_name(docs, "__entities"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return done.select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: not at all, once or twice. A null source is one of its own."""
    copies, copy = free_name(docs, "__copies"), free_name(docs, "__copy")
    mixed = mixing.mix_sources(docs, word_count(F.col("text")), copies=copies, details=False).where(F.col(copies) > 0)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy)
    return mixed.select(*docs.columns, each).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian u16), sequence_id, offset of each packed piece.

    A null or empty text is its end token alone; other columns don't come along.
    """
    tokenizer = tokenizer_path("byte_bpe_50k.json")
    pieces, placed = packing.pack_documents(docs, tokenizer, END_OF_TEXT, drops_blanks=False, memory=PIECES, id_bytes=2)
    return pieces.join(placed, "piece").drop("piece")


STAGES = [
    ("quality", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", replace_personal_data),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: No SQL can express the network, the trees or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
