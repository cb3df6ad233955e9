"""What several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call a word: a run of anything but space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_column: str, folds: int) -> Column:
    """True for the fold that models don't learn from: crc32 of the id as text leaves 0. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds == 0


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of long texts that go to Python at once.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Let the session send at most TEXT_ROWS rows to Python at once.

    Spark's default of 10,000 is made for short rows: of documents it takes hundreds of megabytes outside the heap.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what a task makes of a batch of long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def parts_of(column: pa.Array, rows: int = 500) -> Iterator[list]:
    """A column's values as short lists, for the same reason."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, so that helpers never meet a user's column of their name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
