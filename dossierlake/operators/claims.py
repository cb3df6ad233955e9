"""Claims: lines of trusted documents that state facts, once each, at most so many a project or all of them."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.functions.lexicon import DEFAULT, Lexicon
from dossierlake.functions.text import LOWER, UNKEYED, UPPER, any_case, byte_length, claim_key, contains_any, first_match, lower_ascii, lower_to_find, maybe_short, numbered_lines, trimmed
from dossierlake.operators.histories import running_total
from dossierlake.operators.trust import claim_source, reliable

NO_LETTERS = {ord(c): None for c in UPPER + LOWER}
CLAIMS, SHORTEST, LONGEST = 120, 6, 360
RISK = "该声明需要内容相关且可独立复核的证据。"


def claim_type(line: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The first kind that the line fits, or null."""
    words = [w for kind in lexicon.claim_types for w in kind.topics + kind.signs] + list(lexicon.negations)
    low = lower_to_find(line, words)
    digit = low.rlike("[0-9]")
    cases: list[tuple[Column, object]] = [(contains_any(low, lexicon.negations), F.lit(None).cast("string"))]
    for kind in lexicon.claim_types:
        if kind.topics:
            sign = contains_any(low, kind.signs)
            cases.append((contains_any(low, kind.topics) & (sign | digit if kind.digit else sign), kind.name))
    return first_match(cases, F.lit(None).cast("string"))


def source_confidence(role: Column) -> Column:
    return first_match(
        [
            (role.isNull(), 0.70),
            (role.isin("PROJECT_DECLARATION", "BUSINESS_PLAN"), 0.84),
            (role == "RESEARCH_PAPER", 0.82),
        ],
        0.76,
    )


def trusted_lines(corpus: DataFrame, assets: DataFrame, source: Column) -> DataFrame:
    """project_id, path, role, line_no, line of reliable documents whose asset fulfils ``source``."""
    trusted = assets.where(source).select("project_id", "path", "role")
    documents = corpus.where(reliable(F.col("status"))).select("project_id", "path", "text")
    lines = numbered_lines(F.col("text")).alias("line_no", "line")
    return documents.join(trusted, ["project_id", "path"]).select("project_id", "path", "role", lines)


def may_state(line: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """True of every line of some kind, and of few others: it has a sign of any kind.

    Tests of the line as it is, one a sign (a pattern of all signs is slower by far), so that only what is left is put in
    lower case and compared word by word.
    """
    kinds = [kind for kind in lexicon.claim_types if kind.topics]
    signs = sorted({sign for kind in kinds for sign in kind.signs})
    digit = line.rlike("[0-9]") if any(kind.digit for kind in kinds) else F.lit(False)
    tests = (line.contains(s) if s.translate(NO_LETTERS) == s else line.rlike(any_case([s])) for s in signs)
    return reduce(lambda a, b: a | b, tests, digit)


def claim_candidate(line: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """True of every line that stated_lines keeps, and of few others; lengths first, as most of a text is in long lines."""
    return maybe_short(line, LONGEST) & may_state(line, lexicon)


def may_state_lines(heads: pa.Array, lexicon: Lexicon = DEFAULT) -> pa.Array:
    """claim_candidate of a column of trimmed lines without nulls, by patterns of all signs and of all topics."""
    kinds = [kind for kind in lexicon.claim_types if kind.topics]
    if not kinds:
        return pa.repeat(False, len(heads))
    size = pc.binary_length(heads)
    at = pc.indices_nonzero(pc.and_(pc.greater_equal(size, SHORTEST), pc.less_equal(size, LONGEST)))
    digit = ["[0-9]"] if any(kind.digit for kind in kinds) else []
    signs = sorted({re.escape(sign) for kind in kinds for sign in kind.signs}) + digit
    topics = sorted({re.escape(topic) for kind in kinds for topic in kind.topics})
    for words in (signs, topics):  # each looks only at what the one before left
        low = pc.ascii_lower(heads.take(at))
        at = at.filter(pc.match_substring_regex(low, "|".join(words)))
    return pc.is_in(pa.array(range(len(heads)), at.type), at)


def stated_in_lines(heads: pa.Array, lexicon: Lexicon = DEFAULT) -> tuple[pa.Array, pa.Array]:
    """(claim_type, key) of a column of trimmed lines that may_state_lines lets through, as stated_lines finds them; a null
    type for those that state nothing."""
    low = pc.ascii_lower(heads)
    has = lambda words: pc.match_substring_regex(low, "|".join(map(re.escape, words))) if words else pa.repeat(False, len(low))
    digit, key = pc.match_substring_regex(low, "[0-9]"), pc.replace_substring_regex(low, UNKEYED, "")
    size, found, nothing = pc.binary_length(key), pa.nulls(len(low), pa.string()), pa.scalar(None, pa.string())
    for i, kind in reversed(list(enumerate(lexicon.claim_types))):
        if kind.topics:
            sign = pc.or_(has(kind.signs), digit) if kind.digit else has(kind.signs)
            name = pc.if_else(pc.greater_equal(size, 7 - len(str(i))), kind.name, nothing)
            found = pc.if_else(pc.and_(has(kind.topics), sign), name, found)
    return pc.if_else(has(lexicon.negations), nothing, found), key


def stated_lines(lines: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """``lines`` that state something, trimmed, with claim_type and key."""
    line = trimmed(F.col("line"))
    stated = (
        lines.where(claim_candidate(F.col("line"), lexicon))
        .withColumn("line", line)
        .where(byte_length(F.col("line")).between(SHORTEST, LONGEST))
        .withColumn("claim_type", claim_type(F.col("line"), lexicon))
        .where(F.col("claim_type").isNotNull())
        .withColumn("key", claim_key(F.col("line")))
    )
    order = {kind.name: str(i) for i, kind in enumerate(lexicon.claim_types)}
    prefix = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("claim_type"))
    return stated.where(byte_length(prefix) + 1 + byte_length(F.col("key")) >= 8)


def first_claims(lines: DataFrame, lexicon: Lexicon = DEFAULT, most: int | None = CLAIMS) -> DataFrame:
    return numbered_claims(stated_lines(lines, lexicon), most)


def numbered_claims(stated: DataFrame, most: int | None = CLAIMS) -> DataFrame:
    """project_id, claim_id, claim_text, claim_type, path, line_no, confidence, initial_risk.

    Of lines with one kind and key the first by path and place counts: a minimum that is taken before the shuffle as
    well as after. Only then are the first ``most`` of a project numbered; or all, if that is None, by ranges of places, so
    that a project of any size is spread over tasks.
    """
    place = F.struct("path", "line_no", "line", "role")
    once = stated.groupBy("project_id", "claim_type", "key").agg(F.min(place).alias("first"))
    if most is None:
        numbered = running_total(once.withColumn("one", F.lit(1)), "project_id", "first", "one", "n").withColumn("n", F.col("n") + 1)
    else:
        number = F.row_number().over(Window.partitionBy("project_id").orderBy("first.path", "first.line_no"))
        numbered = once.withColumn("n", number).where(F.col("n") <= most)
    return numbered.select(
        "project_id",
        F.format_string("CLM-%03d", "n").alias("claim_id"),
        F.col("first.line").alias("claim_text"),
        "claim_type",
        F.col("first.path").alias("path"),
        F.col("first.line_no").alias("line_no"),
        source_confidence(F.col("first.role")).alias("confidence"),
        F.lit(RISK).alias("initial_risk"),
    )


def extract_claims(corpus: DataFrame, assets: DataFrame, lexicon: Lexicon = DEFAULT, most: int | None = CLAIMS) -> DataFrame:
    return first_claims(trusted_lines(corpus, assets, claim_source(lexicon)), lexicon, most)
