"""Sessions in event time, as events arrive: late rows, restarts and an exact end.

A session is a key's events with gaps of less than ``gap``. A session is written once, when the watermark (the latest
event time less ``delay``) has passed its end; rows that come later than that are left out, and state of what is
written goes, so state follows open sessions alone. Checkpoint and sink make that exact over restarts: a run goes on
where the last one ended, and every session is in the sink once.

Events without a time are in no session; those without a key have sessions of their own; repeated rows are events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def sessions(events: DataFrame, key: str, time: str, gap: str, delay: str, *more: Column) -> DataFrame:
    """key, begin, ended, n and further aggregates of each session; of a stream or of a table alike."""
    window = F.session_window(time, gap).alias("session")
    found = events.where(F.col(time).isNotNull()).withWatermark(time, delay).groupBy(window, key).agg(F.count(time).alias("n"), *more)
    return found.select(key, F.col("session.start").alias("begin"), F.col("session.end").alias("ended"), *found.columns[2:])


def closing_row(events: DataFrame, key: str, time: str, after: str) -> DataFrame:
    """One row without a key, ``after`` behind the last event: what ends a bounded stream, so that all sessions close.

    Its own session stays open. No row for events without a time.
    """
    last = events.agg(F.max(time).alias("last")).where("last is not null")
    columns = [(F.col("last") + F.expr(f"interval {after}") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
    return last.select(*columns)


def run_available(folder: str, schema: StructType, make: object, sink: str, checkpoint: str, files: int = 1000) -> None:
    """Take what has come to ``folder`` since the last run through ``make`` to Parquet in ``sink``, and end."""
    from pyspark.sql import SparkSession

    stream = SparkSession.active().readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    writer = make(stream).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
