"""Token-id output as length-delimited binary records, with an offset index for shuffled reads.

A data file is a 16-byte header (``MAGIC``, then bytes of one id as u32, then zero) and records one after another:

    u64 length of payload | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of the payload

A payload is u8 (1 if the id isn't null), i64 document id, then token ids of 2 or 4 bytes. All integers are
little-endian. A checksum is CRC-32 masked as ``rotate-right-15 + 0xa282ead8``, so that a checksum over data that holds
checksums stays sound. Beside each data file lies an index: ``MAGIC``, u64 number of records, the u64 offset of each
record, and a masked checksum.

Files are written by tasks under names of their own attempt. What belongs to the output is what the file list says,
a small table that Spark commits as a whole: files of lost attempts are in no list, so a lost executor does no harm.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossierlake.llm.common import slices, text_batches
from dossierlake.llm.tokenizing import shared_tokenizer
from dossierlake.workspace import materialize, shared_dir

MAGIC = b"DLTREC01"
HEADER = struct.Struct("<8sII")
LENGTH = struct.Struct("<QI")
OWNER = struct.Struct("<Bq")
MASK = 0xA282EAD8
FILE_LIST = "part int, path string, records long, tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    payload = OWNER.pack(doc_id is not None, doc_id or 0) + ids
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


class RecordWriter:
    """Writes one data file and its index."""

    def __init__(self, folder: str, name: str, width: int):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.path = f"{root}/{name}.rec"
        self.width, self.offsets, self.tokens = width, [], 0
        self.out = self.store.open_output_stream(self.path)
        self.out.write(HEADER.pack(MAGIC, width, 0))
        self.at = HEADER.size

    def write(self, doc_id: int | None, ids: np.ndarray) -> None:
        record = frame(doc_id, ids.astype(f"<u{self.width}").tobytes())
        self.offsets.append(self.at)
        self.at += len(record)
        self.tokens += len(ids)
        self.out.write(record)

    def close(self) -> None:
        self.out.close()
        body = struct.pack("<Q", len(self.offsets)) + np.asarray(self.offsets, dtype="<u8").tobytes()
        with self.store.open_output_stream(f"{self.path}.idx") as out:
            out.write(MAGIC + body + struct.pack("<I", masked(body)))


class RecordFile:
    """Reads one data file: in order by iteration, or any record by its place through the index."""

    def __init__(self, folder: str, name: str):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.path = f"{root}/{name}"
        self._file = self._offsets = None

    @staticmethod
    def _header(raw: bytes) -> int:
        magic, width, _ = HEADER.unpack(raw)
        if magic != MAGIC or width not in (2, 4):
            raise ValueError("not a record file")
        return width

    @staticmethod
    def _record(stream, width: int) -> tuple[int | None, np.ndarray] | None:
        head = stream.read(LENGTH.size)
        if not head:
            return None
        if len(head) < LENGTH.size:
            raise ValueError("record cut short")
        size, check = LENGTH.unpack(head)
        if masked(head[:8]) != check:
            raise ValueError("damaged length")
        payload, tail = stream.read(size), stream.read(4)
        if len(payload) < size or len(tail) < 4 or masked(payload) != struct.unpack("<I", tail)[0]:
            raise ValueError("damaged record")
        known, doc_id = OWNER.unpack_from(payload)
        return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=OWNER.size)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        with self.store.open_input_stream(self.path, buffer_size=1 << 20) as stream:
            width = self._header(stream.read(HEADER.size))
            while (record := self._record(stream, width)) is not None:
                yield record

    def _open(self) -> None:
        if self._file is None:
            raw = self.store.open_input_file(f"{self.path}.idx").read()
            body = raw[8:-4]
            if raw[:8] != MAGIC or masked(body) != struct.unpack("<I", raw[-4:])[0]:
                raise ValueError("damaged index")
            self._offsets = np.frombuffer(body, "<u8", offset=8)
            self._file = self.store.open_input_file(self.path)
            self._width = self._header(self._file.read(HEADER.size))

    def __len__(self) -> int:
        self._open()
        return len(self._offsets)

    def __getitem__(self, place: int) -> tuple[int | None, np.ndarray]:
        self._open()
        self._file.seek(int(self._offsets[place]))
        return self._record(self._file, self._width)

    def shuffled(self, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
        for place in np.random.default_rng(seed).permutation(len(self)):
            yield self[place]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Encode every text, end it with ``end_id`` and write records in ascending order of ids (nulls first).

    Returns the file list: part, path (its name in ``folder``), records, tokens. Rows with one id are ordered by a
    hash of the text, then the text, so reruns write the same records; where one row is repeated very often its copies are
    spread over several ranges. A null or empty text is written as the end id alone. A very long text is encoded piece by
    piece and is one record, in memory at about 5 bytes a character. Other columns, whatever their names, don't come along.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).alias("text"),
        F.xxhash64(text_column).alias("hash"),
        F.monotonically_increasing_id().alias("tie"),
    )
    ordered = rows.repartitionByRange("id", "hash", "tie").sortWithinPartitions("id", "hash", "text").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        part, writer = TaskContext.get().partitionId(), None
        for batch in slices(batches):
            if writer is None and batch.num_rows:
                encoder = shared_tokenizer(tokenizer)
                largest = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                writer = RecordWriter(folder, name, 2 if largest <= 1 << 16 else 4)
            texts = batch.column("text").to_pylist()
            for doc_id, ids in zip(batch.column("id").to_pylist(), encoder.encode(texts), strict=True):
                writer.write(doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            name = writer.path.rpartition("/")[2]
            row = {"part": [part], "path": [name], "records": [len(writer.offsets)], "tokens": [writer.tokens]}
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types)], names=list(row))

    return materialize(ordered.mapInArrow(write, FILE_LIST), "token-files")


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all records before), ids (little-endian u32 bytes), checking every checksum.

    The running sum is over one row a file, not over records.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    spread = listed.repartition(max(1, files.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                rows, held = [], 0
                for doc_id, ids in RecordFile(folder, name):
                    rows.append((doc_id, start, ids.astype("<u4").tobytes()))
                    start += len(ids)
                    held += len(ids)
                    if held > 1 << 20:
                        yield _records(rows)
                        rows, held = [], 0
                yield _records(rows)

    return spread.mapInArrow(read, "doc_id long, start long, ids binary")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, tokens = (list(x) for x in zip(*rows)) if rows else ([], [], [])
    arrays = [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(tokens, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "ids"])


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared storage, with its scheme: without one, Spark and Arrow could differ on it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/records-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:///", store.makeQualified(path).toString())
