"""Projects as they arrive: new files audited batch by batch, and running counts over event time.

An extension: the batch operators are the reference semantics, and each micro-batch runs them as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from dossierlake.functions.lexicon import DEFAULT, Lexicon
from dossierlake.functions.text import byte_length, claim_key, lines_of, trimmed
from dossierlake.operators.claims import LONGEST, SHORTEST, claim_type

CORPUS = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("arrived", T.TimestampType()),
    ]
)


def read_corpus(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of CORPUS rows as they are put into ``folder``."""
    return spark.readStream.schema(CORPUS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def new_claims(corpus: DataFrame, lexicon: Lexicon = DEFAULT, delay: str = "1 hour") -> DataFrame:
    """Claims of arriving documents, each kind and wording of a project once within the watermark.

    State is one key a claim and is dropped behind the watermark, so it doesn't grow with the stream.
    """
    lines = corpus.withWatermark("arrived", delay).select("project_id", "path", "arrived", F.explode(lines_of(F.col("text"))).alias("raw"))
    stated = (
        lines.withColumn("claim_text", trimmed(F.col("raw")))
        .where(byte_length(F.col("claim_text")).between(SHORTEST, LONGEST))
        .withColumn("claim_type", claim_type(F.col("claim_text"), lexicon))
        .where(F.col("claim_type").isNotNull())
        .withColumn("key", claim_key(F.col("claim_text")))
    )
    return stated.dropDuplicatesWithinWatermark(["project_id", "claim_type", "key"]).drop("raw", "key")


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events of each kind in each window of event time; rows later than ``delay`` behind are left out."""
    windows = F.window(time, window)
    return events.withWatermark(time, delay).groupBy(windows.alias("w"), by).agg(F.count(time).alias("n")).select(F.col("w.start").alias("begin"), by, "n")


def each_batch(stream: DataFrame, audit: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Run ``audit`` on every micro-batch; a batch that is run again has the same number, for idempotent writes."""
    return stream.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint)
