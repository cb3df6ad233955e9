"""Texts of files: plain texts as column expressions, formats with a structure by small functions of one file."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ElementTree
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.text import lines_of, trimmed

PLAIN_BYTES = STRUCTURED_BYTES = 512 * 1024
XML_ENTRIES, XML_ENTRY_BYTES, XML_TEXT_BYTES = 256, 1 << 20, 2 << 20
PDF_BYTES, PDF_STREAM_BYTES, PDF_TEXT_BYTES = 8 << 20, 4 << 20, 1 << 20


def number_text(value: float) -> str:
    """Six significant digits, as C++ streams print them."""
    return f"{value:g}"


def flatten_json(text: str) -> str | None:
    """A line for each key and each scalar, keys in order of their names, nulls left out.

    None if it isn't JSON, or is nested deeper than a parser can follow.
    """
    try:
        root = json.loads(text, parse_int=float)
    except (ValueError, RecursionError):
        return None
    out: list[str] = []

    def walk(value: object, path: str) -> None:
        if isinstance(value, dict):
            for key in sorted(value, key=str.encode):
                below = f"{path}.{key}" if path else key
                out.append(f"key: {below}")
                walk(value[key], below)
        elif isinstance(value, list):
            for i, item in enumerate(value):
                walk(item, f"{path}[{i}]")
        elif isinstance(value, bool):
            out.append(f"{path}: {'true' if value else 'false'}")
        elif isinstance(value, float):
            out.append(f"{path}: {number_text(value)}")
        elif isinstance(value, str):
            out.append(f"{path}: {value}")

    try:
        walk(root, "")
    except RecursionError:
        return None
    return "".join(line + "\n" for line in out)


def yaml_lines(text: Column) -> Column:
    """Lines of a YAML-like text as 'key: k' and 'k: v', without blank ones and comments."""
    lines = F.filter(F.transform(lines_of(text), trimmed), lambda x: (x != "") & ~x.startswith("#"))

    def split(line: Column) -> Column:
        at = F.instr(line, ":")
        key, value = trimmed(F.substring(line, F.lit(1), at - 1)), trimmed(F.substring(line, at + 1, F.length(line)))
        both = F.array(
            F.when(key != "", F.concat(F.lit("key: "), key)), F.when(value != "", F.concat(key, F.lit(": "), value))
        )
        return F.when(at == 0, F.array(line)).otherwise(F.array_compact(both))

    flat = F.flatten(F.transform(lines, split))
    return F.array_join(F.transform(flat, lambda x: F.concat(x, F.lit("\n"))), "")


def openxml_text(content: bytes, extension: str) -> tuple[str, str]:
    """Text and status of an Office file: the document, all slides, or shared strings and sheets."""
    review, parts, size = False, [], 0
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return "", "NEED_REVIEW_OPENXML_TEXT_EXTRACTION_LIMITED"
    names = archive.namelist()
    if extension in (".docx", ".docm", ".dotx", ".dotm"):
        wanted = ["word/document.xml"]
    elif extension in (".xlsx", ".xlsm", ".xltx", ".xltm"):
        wanted = ["xl/sharedStrings.xml", *(n for n in names if n.startswith("xl/worksheets/sheet") and ".xml" in n)]
    else:
        wanted = [n for n in names if n.startswith("ppt/slides/slide") and ".xml" in n]
    review = len(wanted) > XML_ENTRIES
    for name in wanted[:XML_ENTRIES]:
        try:
            with archive.open(name) as stream:
                raw = stream.read(XML_ENTRY_BYTES + 1)
            if not raw or len(raw) > XML_ENTRY_BYTES:
                raise ValueError(name)
            text = "".join(t + " " for t in ElementTree.fromstring(raw).itertext() if t.strip())
        except (KeyError, ValueError, ElementTree.ParseError, zipfile.BadZipFile, RuntimeError, zlib.error):
            review = True
            continue
        if text:
            cut = text.encode()[: XML_TEXT_BYTES - size].decode(errors="ignore")
            parts.append(cut + "\n")
            size += len(cut.encode()) + 1
            if cut != text or size >= XML_TEXT_BYTES:
                review = True
                break
    text = "".join(parts)
    return text, "NEED_REVIEW_OPENXML_TEXT_EXTRACTION_LIMITED" if review or not text else "EXTRACTED_OPENXML"


SHOWN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>", re.DOTALL)
#: How far before a stream its dictionary is looked for.
HEAD_BYTES = 64 * 1024
#: The marks of a text block, and strings, in which they mean nothing.
MARK = re.compile(rb"\((?:[^()\\]|\\.)*+\)|\b(?:BT|ET)\b", re.DOTALL)
#: The end of a stream: at the start of a line or before the object's end. Elsewhere the word may be one that is shown.
END = re.compile(rb"(?<=[\r\n])endstream|endstream(?=[\r\n]{1,2}endobj)")
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.DOTALL)
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _shown(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else ESCAPED.get(m[1], m[1]), raw[1:-1])
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", errors="ignore")
    return data.decode("utf-8", errors="replace")


def pdf_streams(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(what stands before it since the last one, body) of each stream, in one pass."""
    at = end = 0
    ends = (m.start() for m in END.finditer(content))
    while (start := content.find(b"stream", at)) >= 0:
        if content[start - 3 : start] == b"end":
            at = start + 6
            continue
        while 0 <= end < start + 6:
            end = next(ends, -1)
        close = end if end >= 0 else content.find(b"endstream", start + 6)
        if close < 0:
            return
        body = start + 6
        if content[body : body + 2] == b"\r\n":
            body += 2
        elif content[body : body + 1] in (b"\r", b"\n"):
            body += 1
        yield content[max(at, start - HEAD_BYTES) : start], content[body:close]
        at = close + 9


def text_blocks(body: bytes) -> Iterator[bytes]:
    """What stands between each BT and the next ET."""
    begin = -1
    for mark in MARK.finditer(body):
        if mark[0] == b"ET" and begin >= 0:
            yield body[begin : mark.start()]
            begin = -1
        elif mark[0] == b"BT" and begin < 0:
            begin = mark.end()


def pdf_text(content: bytes) -> tuple[str, str]:
    """Text and status: the strings shown between BT and ET in plain and deflated streams.

    A stream that can't be inflated within its limit, or text beyond its own, makes the whole need a review.
    """
    limited = "NEED_REVIEW_PDF_TEXT_EXTRACTION_LIMITED"
    if len(content) > PDF_BYTES:
        return "", "NEED_REVIEW_PDF_TRUNCATED"
    if b"%PDF" not in content[:1024]:
        return "", limited
    out: list[str] = []
    left_out = False
    for head, body in pdf_streams(content):
        if b"/FlateDecode" in head:
            try:
                reader = zlib.decompressobj()
                body = reader.decompress(body, PDF_STREAM_BYTES)
            except zlib.error:
                left_out = True
                continue
            if not reader.eof:
                left_out = True
                continue
        for block in text_blocks(body):
            words = [_shown(m) for m in SHOWN.findall(block)]
            if words:
                out.append(" ".join(words))
    whole = "\n".join(out).encode()
    text = whole[:PDF_TEXT_BYTES].decode(errors="ignore")
    if not text.strip():
        return "", limited
    return text, limited if left_out or len(whole) > PDF_TEXT_BYTES else "EXTRACTED_PDF"


def extract_texts(files: DataFrame, plain_bytes: int | None = PLAIN_BYTES) -> DataFrame:
    """project_id, path, title, text, status of auditable files with path, file_name, extension, kind and content.

    Of plain texts the first ``plain_bytes`` are taken, or all if that is None. They never leave the JVM; JSON, Office and PDF files go through Arrow to Python, the rest is of no use there.
    """
    content, extension = F.col("content"), F.col("extension")
    kind = F.when(extension == ".json", "json").when(extension.isin(".yaml", ".yml"), "yaml").otherwise(F.col("kind"))
    routed = files.where("auditable").withColumn("route", kind)
    size = F.octet_length(content)
    valid = lambda part: F.make_valid_utf8(part.cast("string"))
    head = valid(F.substring(content, 1, STRUCTURED_BYTES))
    cut = F.lit(False) if plain_bytes is None else size > plain_bytes
    columns = ["project_id", "path", F.col("file_name").alias("title")]

    plain = routed.where(F.col("route").isin("code", "text", "unknown")).select(
        *columns,
        valid(content if plain_bytes is None else F.substring(content, 1, plain_bytes)).alias("text"),
        F.when(size == 0, "EMPTY_OR_UNREADABLE").when(cut, "NEED_REVIEW_TEXT_TRUNCATED").otherwise("EXTRACTED_TEXT").alias("status"),
    )
    body = yaml_lines(head)
    too_long = size > STRUCTURED_BYTES
    yaml = routed.where("route = 'yaml'").select(
        *columns,
        F.when(too_long, head).otherwise(body).alias("text"),
        F.when(too_long, "NEED_REVIEW_STRUCTURED_TEXT_TRUNCATED")
        .when(size == 0, "EMPTY_OR_UNREADABLE")
        .when(body == "", "NEED_REVIEW_YAML_EMPTY")
        .otherwise("EXTRACTED_STRUCTURED_YAML")
        .alias("status"),
    )

    @F.pandas_udf("struct<text:string,status:string>")
    def read(contents: pd.Series, routes: pd.Series, extensions: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, route, ext in zip(contents, routes, extensions, strict=True):
            raw = bytes(raw or b"")
            if route == "json":
                text = raw[:STRUCTURED_BYTES].decode(errors="replace")
                flat = flatten_json(text) if len(raw) <= STRUCTURED_BYTES else None
                if len(raw) > STRUCTURED_BYTES:
                    rows.append((text, "NEED_REVIEW_STRUCTURED_TEXT_TRUNCATED"))
                elif not raw:
                    rows.append(("", "EMPTY_OR_UNREADABLE"))
                elif flat is None:
                    rows.append((text, "NEED_REVIEW_JSON_PARSE_FAILED"))
                else:
                    rows.append((flat, "EXTRACTED_STRUCTURED_JSON"))
            else:
                rows.append(openxml_text(raw, ext) if route == "office" else pdf_text(raw))
        return pd.DataFrame(rows, columns=["text", "status"])

    parsed = routed.where(F.col("route").isin("json", "office", "pdf")).select(*columns, read("content", "route", "extension").alias("r"))
    parsed = parsed.select("project_id", "path", "title", "r.text", "r.status")
    return plain.unionByName(yaml).unionByName(parsed)
