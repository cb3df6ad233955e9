"""Text functions of prompts, commands and tools: valid UTF-8, bounded texts and JSON, command lines, input checks."""

from __future__ import annotations

import codecs
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dossierlake.functions.text import first_match, lower_ascii, trimmed

# Commands of a session and the tool that each stands for.
COMMANDS = {
    "audit": "run_project_audit",
    "summary": "summarize_audit_session",
    "files": "list_project_files",
    "inspect": "inspect_project_file",
    "read": "read_text_file",
    "search": "search_project_text",
    "archive": "inspect_archive",
    "changes": "list_workspace_changes",
}
DEPTH, ITEMS, FIELDS, TEXT_BYTES = 8, 48, 64, 4096


def _one_mark(error: UnicodeDecodeError) -> tuple[str, int]:
    return "?", error.start + 1


codecs.register_error("dossierlake.one_mark", _one_mark)


def sanitized(raw: bytes) -> str:
    """Each byte that isn't part of valid UTF-8 becomes a question mark, in one pass."""
    codecs.register_error("dossierlake.one_mark", _one_mark)  # a worker may have this function without its module
    return raw.decode(errors="dossierlake.one_mark")


@F.pandas_udf(StringType())
def sanitize_utf8(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else sanitized(bytes(b)))


def bounded_utf8(text: str, most: int, suffix: str = "...") -> str:
    """At most ``most`` bytes with the suffix, cut where a character ends."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    mark = suffix.encode() if most > len(suffix.encode()) else b""
    return raw[: most - len(mark)].decode(errors="ignore") + mark.decode()


def bounded_text(text: Column, most: int, suffix: str = "...") -> Column:
    """As bounded_utf8, on the JVM: the longest prefix of valid characters."""
    room = most - (len(suffix.encode()) if most > len(suffix.encode()) else 0)
    cut = F.substring(F.encode(text, "UTF-8"), F.lit(1), F.lit(room))
    whole = F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "�+$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(whole, F.lit(suffix if most > len(suffix.encode()) else "")))


def bounded_value(value: object, depth: int = 0) -> object:
    """A JSON value without what is too deep, too many or too long, saying what it left out."""
    if isinstance(value, dict):
        if depth >= DEPTH:
            return {"_truncated": "depth"}
        out = {k: bounded_value(v, depth + 1) for k, v in list(value.items())[:FIELDS]}
        return out | ({"_omitted_fields": len(value) - FIELDS} if len(value) > FIELDS else {})
    if isinstance(value, list):
        if depth >= DEPTH:
            return ["_truncated"]
        out = [bounded_value(v, depth + 1) for v in value[:ITEMS]]
        return out + ([{"_omitted_items": len(value) - ITEMS}] if len(value) > ITEMS else [])
    return bounded_utf8(value, TEXT_BYTES) if isinstance(value, str) else value


@F.pandas_udf(StringType())
def bounded_json(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(bounded_value(json.loads(text)), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return texts.map(one)


def command_tool(line: Column) -> Column:
    """The tool of a line such as '/search words', or null."""
    word = lower_ascii(F.regexp_extract(trimmed(line), r"^/([A-Za-z_]+)", 1))
    return first_match([(word == k, v) for k, v in COMMANDS.items()], F.lit(None).cast("string"))


def command_arguments(line: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(line), r"^/[A-Za-z_]+", ""))


def quoted_path(path: Column) -> Column:
    """A path as patches write it: in quotes where it holds blanks, quotes or backslashes."""
    escaped = F.replace(F.replace(path, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(path.rlike(r'[\s"\\]'), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(path)


def hunk_range(start: Column, count: Column) -> Column:
    """The range of a hunk: one line needs no count."""
    return F.when(count == 1, start.cast("string")).otherwise(F.concat_ws(",", start.cast("string"), count.cast("string")))


def schema_faults(value: object, schema: dict, where: str = "") -> list[str]:
    """Why a tool's input isn't what its schema asks for: type, enum, bounds, required, unknown and nested fields."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float), "integer": int}
    kind = schema.get("type")
    if kind in kinds and (not isinstance(value, kinds[kind]) or (kind in ("number", "integer") and isinstance(value, bool))):
        return [f"{where or 'input'}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{where}: not one of the choices")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{where}: length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{where}: bounds")
    elif isinstance(value, list):
        if len(value) > schema.get("maxItems", len(value)):
            out.append(f"{where}: too many")
        out += [f for i, v in enumerate(value) for f in schema_faults(v, schema.get("items", {}), f"{where}[{i}]")]
    elif isinstance(value, dict):
        fields = schema.get("properties", {})
        out += [f"{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{k}: unknown" for k in value if k not in fields]
        out += [f for k, v in value.items() if k in fields for f in schema_faults(v, fields[k], f"{where}.{k}".lstrip("."))]
    return out


def input_faults(given: str, schema: dict) -> Column:
    """Faults of a column's JSON as a tool's input, in order and joined by semicolons; '' for none, null for null."""

    @F.pandas_udf("string")
    def checked(inputs: pd.Series) -> pd.Series:
        def faults(raw: str | None) -> str | None:
            if raw is None:
                return None
            try:
                return ";".join(schema_faults(json.loads(raw), schema))
            except ValueError:
                return "input: not JSON"

        return inputs.map(faults)

    return checked(given)
