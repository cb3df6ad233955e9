"""Which texts and files the audit relies on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierlake.functions.lexicon import DEFAULT, Lexicon

# Parts of paths and names that hold no statements of the project's own.
EXCLUDED_PARTS = ".git .workspaces node_modules vendor third_party external build dist out target generated __pycache__ .next coverage test tests mock mocks".split()
EXCLUDED_NAMES = (".mock.", "_mock.", ".test.", "_test.")
STYLE_EXTENSIONS = (".css", ".scss", ".less", ".map", ".lock")
LOCK_NAMES = "package-lock.json pnpm-lock.yaml yarn.lock cargo.lock poetry.lock composer.lock".split()
REVIEW_WORDS = ("need_review", "truncated", "parse_failed", "empty", "unreadable", "limited")


def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(f"\\Q{w}\\E" for w in words) + ")"


def needs_review(status: Column) -> Column:
    known = F.coalesce(status, F.lit(""))
    return (known == "") | known.rlike(f"(?i){_any(REVIEW_WORDS)}")


def reliable(status: Column) -> Column:
    return ~needs_review(status) & status.rlike("(?i)^extracted")


#: A part of a path; a part of its name; a name's extension, behind a character at least; a name. The case of A-Z is left out.
EXCLUDED = (
    rf"(?i)(?:^|/){_any(EXCLUDED_PARTS)}(?:/|\z)|{_any(EXCLUDED_NAMES)}[^/]*\z"
    rf"|(?:^|/)[^/\n\r\x{{85}}\x{{2028}}\x{{2029}}]+{_any(STYLE_EXTENSIONS)}\z|(?:^|/){_any(LOCK_NAMES)}\z"
)


def excluded_path(path: Column) -> Column:
    """One pattern: every stage asks this of every file."""
    return path.rlike(EXCLUDED)


def own_file(path: str = "path") -> Column:
    """Not sensitive, generated, vendored or excluded."""
    return ~F.col("sensitive") & ~F.col("generated") & ~F.col("vendored") & ~excluded_path(F.col(path))


def narrative(lexicon: Lexicon = DEFAULT) -> Column:
    return F.col("auditable") & F.col("role").isin(*lexicon.narrative_roles) & own_file()


def claim_source(lexicon: Lexicon = DEFAULT) -> Column:
    return ~F.col("role").isin(*lexicon.no_claim_roles) & narrative(lexicon)
