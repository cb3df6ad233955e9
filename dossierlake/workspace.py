"""Session and shared-storage helpers used by every part of the library."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Folders of applications without a shared one.
_OWN: dict[str, str] = {}


def build_session(app: str = "dossierlake", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings this library is tested with; a cluster's own settings win elsewhere."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (a local master), where the session has none, a temporary folder is made, one an application. On a
    cluster no such folder is shared, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = "file://" + tempfile.mkdtemp(prefix="dossierlake-")
        found = _OWN[application]
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage in a way that survives lost executors: the job commits as a whole, and every later
    reader sees the same committed rows, also where the plan that made them isn't deterministic.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    seen, schema = None, df.schema
    if (counts := _COUNTS.get()) is not None:
        seen, df = counted(df)
    df.write.option("compression", compression).parquet(path)
    if seen is not None:
        counts[name] = counts.get(name, 0) + seen.get["rows"]
    return spark.read.schema(schema).parquet(path)


#: Rows written by ``materialize`` by table name, where someone counts them.
_COUNTS: ContextVar[dict[str, int] | None] = ContextVar("counts", default=None)


def counted(df: DataFrame) -> tuple[Observation, DataFrame]:
    """``df`` with its rows counted by whatever job reads it first: no job of its own."""
    seen = Observation()
    return seen, df.observe(seen, F.count(F.lit(1)).alias("rows"))


@contextmanager
def row_counts() -> Iterator[dict[str, int]]:
    """Rows of each table that is materialized within, by its name, as the writing jobs see them."""
    counts: dict[str, int] = {}
    token = _COUNTS.set(counts)
    try:
        yield counts
    finally:
        _COUNTS.reset(token)


@contextmanager
def job_tag(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started within (in this thread) carry ``tag``, so that ``stop_jobs`` can end them from elsewhere."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def stop_jobs(spark: SparkSession, tag: str) -> None:
    """End all running jobs with ``tag``; their callers get an error. Tables that were committed before stay."""
    spark.sparkContext.cancelJobsWithTag(tag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as a literal of the plan: rows of a list would go from Python to all cores, which takes longer
    than most joins with them."""
    return spark.sql("SELECT inline(from_json(:rows, :schema))", {"rows": json.dumps(rows), "schema": f"array<struct<{schema}>>"})


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with much work a row: dealt to all cores where its files give fewer splits than there are cores.

    Such a table is small, so the shuffle is; one with enough splits is read as it lies.
    """
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Rows of long texts or files that go to Python at once.
TEXT_ROWS = 500


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Let the session send at most ``rows`` rows to Python at once: its default of 10,000 is made for short ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
