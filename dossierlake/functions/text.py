"""Column helpers for texts and paths. Lengths are bytes, lower case is A-Z alone, blanks are the six of C."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\r\f\x0b"
NUMBER = "[0-9]+(?:[,.][0-9]+)*"
LATIN = "[A-Za-z][A-Za-z0-9_-]{2,}"
YEAR = "^(19|20)[0-9]{2}$"
UNKEYED = r"[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def lower_to_find(text: Column, words: Iterable[str]) -> Column:
    """A text that holds each of ``words`` (in lower case) exactly where lower_ascii's does; made for long texts.

    lower is many times as fast. It changes letters beyond ASCII too, which no word without such letters can tell, but for
    the Kelvin sign and the dotted I, which give ASCII letters.
    """
    if any(c > "\x7f" and (c.lower() != c or c.upper() != c or c == "\u0307") for word in words for c in word):
        return lower_ascii(text)
    return F.when(text.contains("\u212a") | text.contains("\u0130"), lower_ascii(text)).otherwise(F.lower(text))


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def lines_of(text: Column) -> Column:
    """Lines without a last empty one; no lines for an empty or null text. The text is split in one place, so only once."""
    body = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def numbered_lines(text: Column) -> Column:
    """A row a line, with its place and the line. An empty text has one row of nulls: without it Spark would first test
    each text for lines, which splits it once more for each test."""
    return F.posexplode_outer(lines_of(text))


def maybe_short(line: Column, most: int) -> Column:
    """True of every line of at most ``most`` bytes between the blanks around it, and of few longer ones."""
    return reduce(lambda a, b: a | b, (line.startswith(b) | line.endswith(b) for b in BLANKS), byte_length(line) <= most)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True where any of the words is a substring."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words), F.lit(False))


def any_case(words: Iterable[str]) -> str:
    """A pattern of texts that hold one of the words, whatever the case of A-Z."""
    return "(?i:" + "|".join(f"\\Q{w}\\E" for w in words) + ")"


def first_match(cases: Iterable[tuple[Column, object]], default: object) -> Column:
    """The value of the first true condition: an ordered decision list as one CASE."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    chain = None
    for condition, result in cases:
        chain = F.when(condition, value(result)) if chain is None else chain.when(condition, value(result))
    return value(default) if chain is None else chain.otherwise(value(default))


def numbers_in(text: Column) -> Column:
    """Distinct numbers, sorted, with thousands' commas taken out."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))))


def telling_numbers(numbers: Column) -> Column:
    """Numbers without years where there is more than one; that may leave none."""
    return F.when(F.size(numbers) > 1, F.filter(numbers, lambda x: ~x.rlike(YEAR))).otherwise(numbers)


def latin_words(text: Column, stop: Iterable[str]) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({LATIN})"), F.lit(1))
    lowered = F.array_sort(F.array_distinct(F.transform(found, lower_ascii)))
    return F.array_except(lowered, F.array(*[F.lit(w) for w in stop]).cast("array<string>"))


def claim_key(line: Column) -> Column:
    """What two wordings of one claim share: lower case without ASCII blanks and punctuation."""
    return F.regexp_replace(lower_ascii(trimmed(line)), UNKEYED, "")


def without_markdown(line: Column) -> Column:
    return trimmed(F.regexp_replace(line, r"^[\s#\-*>]+", ""))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    return (gone / len(needle.encode())).cast("long")


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def extension_of(path: Column) -> Column:
    """Lower-cased, with its dot; empty for names without one and for dot files."""
    return lower_ascii(F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1))


def stem_of(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def safe_path(path: Column) -> Column:
    """A relative path without backslashes, drive letters and empty, '.' or '..' parts; one last slash is a folder's."""
    bare = F.regexp_replace(path, "/$", "")
    parts = F.forall(path_parts(bare), lambda p: ~p.isin("", ".", ".."))
    return (path != "") & ~path.contains("\\") & ~path.rlike("^[A-Za-z]:") & parts


def shortened(text: Column, limit: int, suffix: str = "...") -> Column:
    """At most ``limit`` characters, then the suffix."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(suffix))).otherwise(text)


def normal_markdown(line: Column) -> Column:
    """Without blanks at its end, and with a blank after a heading's marks."""
    bare = F.regexp_replace(line, r"[ \t\n\r\f\x0B]+$", "")
    return F.regexp_replace(bare, "^(#+)([^ #])", "$1 $2")


def normal_lines(text: Column) -> Column:
    """Normal lines of a text, without those blank ones that follow a blank one; work follows the text's length."""
    lines = F.transform(F.split(text, "\n"), normal_markdown)
    before = F.concat(F.array(F.lit("-")), F.slice(lines, 1, F.size(lines) - 1))
    pairs = F.zip_with(lines, before, lambda line, ahead: F.struct(line.alias("line"), ahead.alias("ahead")))
    kept = F.filter(pairs, lambda x: (trimmed(x.line) != "") | (trimmed(x.ahead) != ""))
    return F.transform(kept, lambda x: x.line)
