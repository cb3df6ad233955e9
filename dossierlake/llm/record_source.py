"""Record files as a data source of Spark: ranges of records by their place, read through the offset index.

``place`` numbers all records of a file list from 0. A partition is a range of places within one file; filters that
compare ``place`` with a number narrow the ranges before any file is opened, and a task seeks to its first record, so records
that nobody asked for aren't read. Reads in any order of ranges give the same rows. An empty file list gives no rows, and a
range that holds no record none either; damaged records and indexes raise, as they do in ``record_files``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from dossierlake.llm.record_files import RecordFile

#: Records of a partition at most, and bytes of ids that go to Spark at once.
RANGE, AT_ONCE = 10_000, 4 << 20
SCHEMA = "place long, doc_id long, ids binary"


class Range(InputPartition):
    """Records ``first`` to ``last`` (excluded) of a file whose first record has the place ``before``."""

    def __init__(self, path: str, before: int, first: int, last: int):
        super().__init__((path, before, first, last))
        self.path, self.before, self.first, self.last = path, before, first, last


class RecordReader(DataSourceReader):
    def __init__(self, folder: str, files: list[tuple[str, int]], most: int):
        self.folder, self.files, self.most = folder, files, most
        self.low, self.high = 0, sum(records for _, records in files)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        bounds = {EqualTo: (0, 1), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, 0), LessThanOrEqual: (None, 1)}
        for f in filters:
            kind = bounds.get(type(f))
            if kind is None or f.attribute != ("place",):
                yield f
                continue
            low, high = kind
            self.low = max(self.low, f.value + low) if low is not None else self.low
            self.high = min(self.high, f.value + high) if high is not None else self.high

    def partitions(self) -> list[Range]:
        found, before = [], 0
        for path, records in self.files:
            first, last = max(self.low - before, 0), min(self.high - before, records)
            found += [Range(path, before, at, min(at + self.most, last)) for at in range(first, last, self.most)]
            before += records
        return found or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        file = RecordFile(self.folder, partition.path) if partition.path else None
        for at in range(partition.first, partition.last):
            doc_id, ids = file[at]
            rows.append((partition.before + at, doc_id, ids.astype("<u4").tobytes()))
            held += len(rows[-1][2])
            if held > AT_ONCE:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in columns], names=["place", "doc_id", "ids"])


class RecordSource(DataSource):
    """Options: folder, files (JSON pairs of name and records), range (records of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> RecordReader:
        files = [(path, records) for path, records in json.loads(self.options["files"])]
        return RecordReader(self.options["folder"], files, int(self.options.get("range", RANGE)))


def records(spark: SparkSession, folder: str, files: DataFrame, most: int = RANGE) -> DataFrame:
    """place, doc_id, ids of the records of a file list; conditions on ``place`` decide what is read.

    The list has one row a file and goes through the driver.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)
    listed = [(r.path, r.records) for r in files.orderBy("part").select("path", "records").collect()]
    return spark.read.format("token_records").option("folder", folder).option("files", json.dumps(listed)).option("range", most).load()
