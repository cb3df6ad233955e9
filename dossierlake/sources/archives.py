"""Archives as tables of entries: listing in Python, one archive a row; checks and budgets on Spark."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import stat
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.text import lower_ascii, path_parts, safe_path
from dossierlake.operators.histories import greedy_budget
from dossierlake.sources.files import ImportLimits
from dossierlake.sources.formats import is_archive_path
from dossierlake.workspace import TEXT_ROWS, materialize, text_batches

ENTRIES = "project_id string, archive string, entry_seq int, path string, directory boolean, symlink boolean, size_bytes long, compressed_bytes long, method int, encrypted boolean, error string"
#: Bytes of unpacked entries that go back from Python at once; one entry may have more.
OPENED_BYTES = 8 << 20
#: ZIP's methods for stored and deflated data.
KNOWN_METHODS = (0, 8)


class Budget(io.RawIOBase):
    """A decompressed stream that may give so many bytes at most: a bomb ends here and not in memory."""

    def __init__(self, stream: io.BufferedIOBase, most: int):
        self.stream, self.left = stream, most

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        data = self.stream.read(min(self.left + 1, size if size >= 0 else 1 << 20))
        self.left -= len(data)
        if self.left < 0:
            raise ExpandedTooFar("more bytes than allowed")
        return data


class ExpandedTooFar(Exception):
    """An archive gives more bytes than its limit."""


#: First bytes of single compressed streams and what opens them.
STREAMS = (
    (b"\x1f\x8b", lambda b: gzip.GzipFile(fileobj=b)),
    (b"BZh", bz2.BZ2File),
    (b"\xfd7zXZ\x00", lzma.LZMAFile),
    (b"\x5d\x00\x00", lzma.LZMAFile),
)


def stream_of(content: bytes, most: int) -> io.RawIOBase | None:
    """The decompressed bytes of a single stream, or None if it isn't one."""
    for magic, opener in STREAMS:
        if content.startswith(magic):
            return Budget(opener(io.BytesIO(content)), most)
    return None


def tar_of(content: bytes, most: int) -> tarfile.TarFile | None:
    """A tar archive, compressed or not, read from front to back; None if it is none."""
    stream = stream_of(content, most)
    try:
        archive = tarfile.open(fileobj=stream or io.BytesIO(content), mode="r|")
    except (tarfile.ReadError, EOFError, OSError, lzma.LZMAError):
        if stream is None:
            raise
        return None
    # a stream of zeros would be an empty tar
    return None if stream is not None and archive.firstmember is None else archive


def entries_of(content: bytes, name: str, expanded: int = ImportLimits.expanded_bytes) -> Iterator[tuple]:
    """(path, directory, symlink, size, compressed size, method, encrypted) of all entries, as many as an archive's bytes hold.

    Streams are decompressed piece by piece and counted. A tar's entries share the archive's bytes by size.
    """
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                link = stat.S_ISLNK(info.external_attr >> 16)
                yield info.filename, info.is_dir(), link, info.file_size, info.compress_size, info.compress_type, bool(info.flag_bits & 1)
        return
    archive = tar_of(content, expanded)
    if archive is None:
        stream, size = stream_of(content, expanded), 0
        while data := stream.read(1 << 20):
            size += len(data)
        yield inner_name(name), False, False, size, len(content), 8, False
        return
    with archive:
        found = [(info.name, info.isdir(), info.issym() or info.islnk(), info.size) for info in archive]
    total = sum(size for *_, size in found)
    for path, folder, link, size in found:
        yield path, folder, link, size, -(-size * len(content) // total) if total else 0, 0, False


def inner_name(name: str) -> str:
    """What a single compressed stream holds, by the name of its file."""
    last = name.rpartition("/")[2]
    return last.rpartition(".")[0] or last


def list_entries(files: DataFrame, limits: ImportLimits | None = None) -> DataFrame:
    """ENTRIES of files with project_id, path, content; an archive that can't be read gives one row with its error.

    Archives above ``limits.archive_bytes`` are listed as too large.
    """
    limits = limits or ImportLimits()
    text_batches(files.sparkSession)

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in ENTRIES.split(", ")]
        for frame in frames:
            rows = []
            for project, path, content in zip(frame["project_id"], frame["path"], frame["content"], strict=True):
                if len(content) > limits.archive_bytes:
                    rows.append((project, path, 0, "", False, False, len(content), len(content), 0, False, "ARCHIVE_TOO_LARGE_FOR_INDEXING"))
                    continue
                try:
                    for n, entry in enumerate(entries_of(bytes(content), path, limits.expanded_bytes)):
                        rows.append((project, path, n, *entry, None))
                except Exception as error:  # noqa: BLE001  whatever a damaged archive raises is its row's error
                    rows.append((project, path, 0, "", False, False, 0, 0, 0, False, type(error).__name__))
            yield pd.DataFrame(rows, columns=names)

    return files.select("project_id", "path", "content").mapInPandas(listed, ENTRIES)


def ratio_exceeded(expanded: Column, compressed: Column, most: float) -> Column:
    """Nothing expands from nothing; something from nothing is too much."""
    return F.when(expanded == 0, False).when(compressed == 0, True).otherwise(expanded / compressed > most)


def entry_key(path: Column) -> Column:
    return lower_ascii(F.regexp_replace(path, "/$", ""))


def archive_faults(entries: DataFrame, limits: ImportLimits | None = None) -> DataFrame:
    """project_id, archive, fault, path: why an archive must not be unpacked. No rows for a sound one.

    A file that is another's folder is found by joining each file's ancestors with the files, on equality.
    """
    limits = limits or ImportLimits()
    keys = ["project_id", "archive"]
    marked = entries.where("error is null").withColumn("key", entry_key(F.col("path")))
    files = marked.where(~F.col("directory"))
    unsafe = marked.where(~safe_path(F.col("path"))).select(*keys, F.lit("UNSAFE_PATH").alias("fault"), "path")
    twice = marked.groupBy(*keys, "key").agg(F.count("path").alias("n"), F.min("path").alias("path")).where("n > 1")
    twice = twice.select(*keys, F.lit("DUPLICATE_ENTRY").alias("fault"), "path")
    dense = files.where(ratio_exceeded(F.col("size_bytes"), F.col("compressed_bytes"), limits.ratio))
    dense = dense.select(*keys, F.lit("ENTRY_RATIO").alias("fault"), "path")
    sums = files.groupBy(*keys).agg(F.sum("size_bytes").alias("e"), F.sum("compressed_bytes").alias("c"))
    whole = sums.where(ratio_exceeded(F.col("e"), F.col("c"), limits.ratio)).select(*keys, F.lit("TOTAL_RATIO").alias("fault"), F.lit("").alias("path"))
    parts = path_parts(F.col("key"))
    depth = F.size(parts) - 1
    ancestors = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    above = files.select(*keys, "path", F.explode(ancestors).alias("key"))
    clash = above.join(files.select(*keys, "key"), [*keys, "key"], "left_semi").select(*keys, F.lit("FILE_FOLDER_CONFLICT").alias("fault"), "path")
    return unsafe.unionByName(twice).unionByName(dense).unionByName(whole).unionByName(clash.distinct())


def archive_verdicts(entries: DataFrame) -> DataFrame:
    """project_id, archive, entries, safe: whether no entry has an unsafe path, is a link or is itself an archive."""
    sound = safe_path(F.col("path")) & ~F.col("symlink") & ~is_archive_path(F.col("path")) & F.col("error").isNull()
    return entries.groupBy("project_id", "archive").agg(F.count("path").alias("entries"), F.bool_and(sound).alias("safe"))


def extraction_plan(entries: DataFrame, limits: ImportLimits | None = None) -> DataFrame:
    """project_id, archive, path, size_bytes, reason (null: unpacked) of each file; those beyond an archive's first
    ``limits.files`` are deferred as FILE_COUNT_DEFERRED."""
    limits = limits or ImportLimits()
    files = entries.where("error is null and not directory").withColumn("owner", F.concat_ws("\0", "project_id", "archive"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("owner").orderBy("entry_seq"))
    early = (
        F.when(F.col("n") > limits.files, "FILE_COUNT_DEFERRED")
        .when(F.size(path_parts(F.col("path"))) > limits.depth, "PATH_DEPTH_LIMIT")
        .when(F.col("symlink"), "SYMLINK_DEFERRED")
        .when(is_archive_path(F.col("path")), "NESTED_ARCHIVE_DEFERRED")
        .when(F.col("encrypted"), "ENCRYPTED_ENTRY_DEFERRED")
        .when(~F.col("method").isin(*KNOWN_METHODS), "UNSUPPORTED_COMPRESSION_DEFERRED")
        .when(F.col("size_bytes") > limits.file_bytes, "LARGE_BINARY_DEFERRED")
    )
    marked = files.withColumn("n", place).withColumn("reason", early)
    room = min(limits.expanded_bytes, limits.total_bytes)
    fits = greedy_budget(marked.where("reason is null"), "owner", "n", "size_bytes", room).select("owner", "n", "kept")
    joined = marked.join(fits, ["owner", "n"], "left")
    late = F.when(F.col("reason").isNull() & ~F.coalesce("kept", F.lit(True)), "COPY_BUDGET_DEFERRED").otherwise(F.col("reason"))
    return joined.select("project_id", "archive", "path", "size_bytes", late.alias("reason"))


def unpack(files: DataFrame, plan: DataFrame, limits: ImportLimits | None = None) -> DataFrame:
    """project_id, path (archive and entry), content, error of the planned entries of ZIP, tar and single compressed files.

    Actual bytes count against the limits, whatever an archive declares: an entry above the limit of a file has the error
    RUNTIME_SINGLE_FILE_LIMIT_DEFERRED, those behind the limit of an archive RUNTIME_COPY_BUDGET_DEFERRED, and an archive that
    breaks one row with its own. Rows with an error have no content.
    """
    limits = limits or ImportLimits()
    wanted = plan.where("reason is null").groupBy("project_id", F.col("archive").alias("path")).agg(F.collect_list(F.col("path")).alias("entries"))
    names = ["project_id", "path", "content", "error"]

    def entries_in(row: tuple) -> Iterator[tuple]:
        left = limits.expanded_bytes
        try:
            for name, data in contents_of(bytes(row.content), row.path, set(row.entries), limits):
                left -= len(data)
                error = "RUNTIME_COPY_BUDGET_DEFERRED" if left < 0 else "RUNTIME_SINGLE_FILE_LIMIT_DEFERRED" if len(data) > limits.file_bytes else None
                yield row.project_id, f"{row.path}/{name}", None if error else data, error
                if left < 0:
                    break
        except Exception as error:  # noqa: BLE001  whatever a damaged archive raises is its row's error
            yield row.project_id, row.path, None, type(error).__name__

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                for entry in entries_in(row):
                    rows.append(entry)
                    size += len(entry[2] or b"")
                    if size >= OPENED_BYTES or len(rows) >= TEXT_ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    text_batches(files.sparkSession)
    return files.join(wanted, ["project_id", "path"]).select("project_id", "path", "content", "entries").mapInPandas(
        opened, "project_id string, path string, content binary, error string"
    )


def contents_of(content: bytes, name: str, wanted: set[str], limits: ImportLimits) -> Iterator[tuple[str, bytes]]:
    """(entry, bytes) of the wanted entries; one byte more than a file's limit where an entry has more."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for entry in archive.namelist():
                if entry in wanted:
                    with archive.open(entry) as stream:
                        yield entry, stream.read(limits.file_bytes + 1)
        return
    archive = tar_of(content, limits.expanded_bytes)
    if archive is None:
        yield inner_name(name), stream_of(content, limits.expanded_bytes).read(limits.file_bytes + 1)
        return
    with archive:
        for info in archive:
            if info.name in wanted and info.isfile():
                yield info.name, archive.extractfile(info).read(limits.file_bytes + 1)


def open_archive(files: DataFrame, limits: ImportLimits | None = None) -> tuple[DataFrame, DataFrame]:
    """(unpacked, deferred) of archives that are sound: see ``unpack``, and project_id, path, size_bytes, reason.

    Archives with faults are deferred as wholes, with the fault as their reason.
    """
    limits = limits or ImportLimits()
    entries = materialize(list_entries(files, limits), "archive-entries")
    faults = archive_faults(entries, limits).groupBy("project_id", "archive").agg(F.min("fault").alias("reason"))
    broken = entries.where("error is not null").select("project_id", "archive", F.col("error").alias("reason"))
    refused = materialize(faults.unionByName(broken), "archive-faults")
    plan = materialize(extraction_plan(entries.join(refused, ["project_id", "archive"], "left_anti"), limits), "archive-plan")
    late = plan.where("reason is not null").select("project_id", F.concat_ws("/", "archive", "path").alias("path"), "size_bytes", "reason")
    whole = refused.select("project_id", F.col("archive").alias("path"), F.lit(None).cast("long").alias("size_bytes"), "reason")
    return unpack(files, plan, limits), late.unionByName(whole)
