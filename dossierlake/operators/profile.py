"""What a project is: its type by points of roles and keywords, and the fields of its profile."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.lexicon import DEFAULT, PROJECT_TYPES, Lexicon
from dossierlake.functions.text import (
    BLANKS,
    any_case,
    byte_length,
    contains_any,
    lower_ascii,
    maybe_short,
    numbered_lines,
    path_parts,
    stem_of,
    trimmed,
    without_markdown,
)
from dossierlake.operators.histories import running_total
from dossierlake.operators.trust import narrative, needs_review, excluded_path, reliable

DOCUMENT_BYTES, TOTAL_BYTES = 64 * 1024, 512 * 1024
# A field's line that says nothing, and what may stand between a label and its value.
EMPTY_WORDS = ("暂无", "尚未", "暂未", "没有", "未确定", "待确定", "待补充", "不涉及", "unknown", "n/a", "todo", "tbd")
AFTER_LABEL = (":", "：", "是", "为", "-", "—")
LONGEST, MARKDOWN = 300, "#*>-"
REQUIRED = ("target_user", "solution", "business_model")


def trusted_documents(corpus: DataFrame, assets: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    known = assets.where(narrative(lexicon)).select("project_id", "path")
    return corpus.where(reliable(F.col("status"))).join(known, ["project_id", "path"], "left_semi")


def bounded_texts(documents: DataFrame, each: int = DOCUMENT_BYTES, total: int = TOTAL_BYTES) -> DataFrame:
    """project_id, path, kept (lower case): texts in order, cut to bytes a document and, by a running sum, a project."""
    raw = documents.withColumn("bytes", F.least(byte_length(F.col("text")), F.lit(each)).cast("long"))
    placed = running_total(raw.withColumn("taken", F.col("bytes") + 1), "project_id", "path", "taken", "used")
    room = F.least(F.col("bytes"), F.lit(total) - F.col("used"))
    cut = F.substring(F.encode("text", "UTF-8"), F.lit(1), room.cast("int"))
    return placed.where(F.col("used") < total).select("project_id", "path", room.alias("kept_bytes"), lower_ascii(F.make_valid_utf8(cut.cast("string"))).alias("kept"))


def type_points(assets: DataFrame, texts: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """project_id, type, score for every type of each project: a role or a group of keywords counts once."""
    roles = assets.sparkSession.createDataFrame(list(lexicon.role_points), "role string, type string, points int")
    by_role = assets.select("project_id", "role").distinct().join(F.broadcast(roles), "role").select("project_id", "type", "points")
    has = [F.max(contains_any(F.col("kept"), words).cast("int")).alias(f"g{i}") for i, (_, _, words) in enumerate(lexicon.type_words)]
    wide = texts.groupBy("project_id").agg(*has)
    groups = F.array(
        *[F.struct(F.lit(t).alias("type"), (F.col(f"g{i}") * p).alias("points")) for i, (t, p, _) in enumerate(lexicon.type_words)]
    )
    by_text = wide.select("project_id", F.explode(groups).alias("g")).select("project_id", "g.type", "g.points")
    types = F.explode(F.array(*map(F.lit, PROJECT_TYPES))).alias("type")
    zero = assets.select("project_id").distinct().select("project_id", types, F.lit(0).alias("points"))
    return by_role.unionByName(by_text).unionByName(zero).groupBy("project_id", "type").agg(F.sum("points").alias("score"))


def best_type(points: DataFrame) -> DataFrame:
    """project_id, type, confidence, reason: the best type if it is clear enough, else Unknown."""
    order = F.array_position(F.array(*map(F.lit, PROJECT_TYPES)), F.col("type"))
    ranked = points.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), order.alias("place"), "type"))).alias("r")
    )
    best, second = -F.col("r")[0]["minus"], -F.col("r")[1]["minus"]
    unclear = (best < 3) | ((best == second) & (best < 6))
    raw = F.lit(0.55) + F.least(best, F.lit(10)) * F.lit(0.03) + F.greatest(best - second, F.lit(0)) * F.lit(0.02)
    reason = F.concat(F.lit("可信材料对“"), F.col("r")[0]["type"], F.lit("”的特征得分为 "), best.cast("string"), F.lit("，次高得分为 "), second.cast("string"))
    return ranked.select(
        "project_id",
        F.when(unclear, F.lit("Unknown")).otherwise(F.col("r")[0]["type"]).alias("type"),
        F.when(unclear, F.lit(0.0)).otherwise(F.round(F.least(F.greatest(raw, F.lit(0.55)), F.lit(0.9)), 4)).alias("confidence"),
        F.when(unclear, F.lit("可信材料的赛道特征不足或存在并列，需要人工确认")).otherwise(reason).alias("reason"),
    )


def detect_type(assets: DataFrame, corpus: DataFrame, lexicon: Lexicon = DEFAULT, requested: str | None = None) -> DataFrame:
    if requested:
        return assets.select("project_id").distinct().select(
            "project_id", F.lit(requested).alias("type"), F.lit(1.0).alias("confidence"), F.lit("用户显式指定赛道").alias("reason")
        )
    return best_type(type_points(assets, bounded_texts(trusted_documents(corpus, assets, lexicon)), lexicon))


def labels_found(line: Column, labels: dict[str, tuple[str, ...]], low: Column | None = None) -> Column:
    """Fields one of whose labels stands in the first 12 bytes and a value after it, marked as one unless the label begins
    the line. One walk over a literal list, whatever the number of labels. ``low``: a column with the line in lower case,
    since the walk would lower it for each label anew."""
    low = lower_ascii(line) if low is None else low
    rows = [F.struct(F.lit(field).alias("field"), F.lit(label).alias("label")) for field, own in labels.items() for label in own]

    def found(x: Column) -> Column:
        at = F.position(x.label, low)
        ahead = byte_length(F.substring(low, F.lit(1), at - 1))
        rest = trimmed(F.substring(line, at + F.length(x.label), F.length(line)))
        marked = reduce(lambda a, b: a | b, [rest.startswith(m) for m in AFTER_LABEL])
        return (at > 0) & (ahead <= 12) & (rest != "") & (marked | (ahead == 0))

    return F.array_distinct(F.transform(F.filter(F.array(*rows), found), lambda x: x.field))


def may_fill(raw: Column, labels: dict[str, tuple[str, ...]]) -> Column:
    """True of every line that gives a title or has a label in its first 12 bytes with a value after it, and of few others.

    One pattern over the line as it is: a label at its beginning behind marks of Markdown, or one with a mark after it.
    """
    words, after = any_case(label for own in labels.values() for label in own), any_case(AFTER_LABEL)
    return raw.rlike(rf"(?s)^[\s#*>-]*+(?:{words}|.{{0,12}}?{words}\s*{after})|^\s*# ")


def field_candidate(raw: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """True of every line that field_lines keeps, and of few others: none is long, but for marks of Markdown before it."""
    marked = reduce(lambda a, b: a | b, (raw.startswith(m) for m in MARKDOWN))
    return (maybe_short(raw, LONGEST) | marked) & may_fill(raw, lexicon.profile_labels)


def may_fill_lines(heads: pa.Array, lexicon: Lexicon = DEFAULT) -> pa.Array:
    """field_candidate of a column of trimmed lines without nulls: a title, or a label where may_fill looks for one."""
    bare = pc.ascii_ltrim(heads, BLANKS + MARKDOWN)
    size = pc.binary_length(bare)
    short = pc.and_(pc.greater_equal(size, 4), pc.less_equal(size, LONGEST))
    words = "|".join(re.escape(label) for own in lexicon.profile_labels.values() for label in own)
    after = "|".join(map(re.escape, AFTER_LABEL))
    pattern = rf"(?s)^(?:(?:{words})|.{{0,12}}?(?:{words})[{BLANKS}]*(?:{after}))"
    filled = pc.match_substring_regex(pc.ascii_lower(pc.if_else(short, bare, "")), pattern)
    return pc.or_(pc.starts_with(heads, "# "), pc.and_(short, filled))


def fields_in_lines(heads: pa.Array, lexicon: Lexicon = DEFAULT) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(place in ``heads``, field, value) of a column of trimmed lines, as field_lines finds them, but that a field is told
    once for each of its labels."""
    bare = pc.ascii_ltrim(heads, BLANKS + MARKDOWN)
    low = pc.ascii_lower(bare)
    within = lambda lines, least, most: pc.and_(pc.greater_equal(pc.binary_length(lines), least), pc.less_equal(pc.binary_length(lines), most))
    empty = pc.match_substring_regex(low, "|".join(map(re.escape, EMPTY_WORDS)))
    usable = pc.indices_nonzero(pc.and_(within(bare, 4, LONGEST), pc.invert(empty)))
    titled = pc.indices_nonzero(pc.and_(pc.starts_with(heads, "# "), within(heads, 3, 120)))
    found = [(titled, "title", pc.ascii_trim(pc.utf8_slice_codeunits(heads.take(titled), 2), BLANKS))]
    low, bare, after = low.take(usable), bare.take(usable), "^(?:" + "|".join(map(re.escape, AFTER_LABEL)) + ")"
    for field, labels in lexicon.profile_labels.items():
        for label in labels:
            ahead = pc.find_substring(low, label)
            at = pc.indices_nonzero(pc.and_(pc.greater_equal(ahead, 0), pc.less_equal(ahead, 12)))
            rest = pc.ascii_ltrim(pc.list_element(pc.split_pattern(low.take(at), label, max_splits=1), 1), BLANKS)
            marked = pc.or_(pc.equal(ahead.take(at), 0), pc.match_substring_regex(rest, after))
            at = at.filter(pc.and_(pc.not_equal(rest, ""), marked))
            found.append((usable.take(at), field, bare.take(at)))
    places, fields, values = zip(*((at.to_numpy(), pa.repeat(field, len(at)), value) for at, field, value in found), strict=True)
    return np.concatenate(places), pa.concat_arrays(fields), pa.concat_arrays(values)


def field_lines(lines: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """project_id, path, line_no, value, field of ``lines`` (with a column raw) that give a title or fill a field."""
    lines = lines.where(field_candidate(F.col("raw"), lexicon))
    lines = lines.withColumn("head", trimmed(F.col("raw"))).withColumn("line", without_markdown(F.col("head")))
    lines = lines.withColumn("low", lower_ascii(F.col("line")))
    usable = byte_length(F.col("line")).between(4, LONGEST) & ~contains_any(F.col("low"), EMPTY_WORDS)
    title = F.col("head").startswith("# ") & (byte_length(F.col("head")) > 2) & (byte_length(F.col("head")) <= 120)
    nothing = F.array().cast("array<string>")
    names = F.concat(
        F.when(title, F.array(F.lit("title"))).otherwise(nothing),
        F.when(usable, labels_found(F.col("line"), lexicon.profile_labels, F.col("low"))).otherwise(nothing),
    )
    each = lines.select("project_id", "path", "line_no", "head", "line", F.explode(names).alias("field"))
    value = F.when(F.col("field") == "title", trimmed(F.substring("head", 3, 1_000_000))).otherwise(F.col("line"))
    return each.select("project_id", "path", "line_no", value.alias("value"), "field")


def profile_fields(corpus: DataFrame, assets: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    documents = trusted_documents(corpus, assets, lexicon)
    lines = documents.select("project_id", "path", numbered_lines(F.col("text")).alias("line_no", "raw"))
    return first_fields(field_lines(lines, lexicon), documents.select("project_id"), lexicon)


def first_fields(each: DataFrame, projects: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """project_id, title and the fields: of each the first fitting line by path and place, '' if none."""
    firsts = each.groupBy("project_id", "field").agg(F.min(F.struct("path", "line_no", "value")).alias("first"))
    found = firsts.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "first.value"))).alias("found"))
    wide = projects.distinct().join(found, "project_id", "left")
    value_of = lambda name: F.coalesce(F.try_element_at("found", F.lit(name)), F.lit("")).alias(name)
    return wide.select("project_id", value_of("title"), *map(value_of, lexicon.profile_labels))


def fallback_name(assets: DataFrame) -> DataFrame:
    """project_id, name: the stem of the first telling declaration, plan or deck, else a folder that all files share."""
    named = F.col("role").isin("PROJECT_DECLARATION", "BUSINESS_PLAN", "PITCH_DECK")
    telling = named & ~lower_ascii(stem_of(F.col("path"))).isin("", "readme", "project", "overview")
    top = F.when(F.col("path").contains("/"), path_parts(F.col("path"))[0])
    shared = F.when(F.bool_and(top.isNotNull()) & (F.min(top) == F.max(top)), F.min(top))
    first = assets.groupBy("project_id").agg(F.min(F.when(telling, F.col("path"))).alias("first"), shared.alias("shared"))
    return first.select("project_id", F.coalesce(stem_of(F.col("first")), "shared", F.lit("未命名项目")).alias("name"))


def build_profile(corpus: DataFrame, assets: DataFrame, types: DataFrame, lexicon: Lexicon = DEFAULT, found: DataFrame | None = None) -> DataFrame:
    """One row a project: name, type, fields, missing_fields, risk_items. ``found``: fields, where they are known."""
    fields = list(lexicon.profile_labels)
    unread = corpus.where(needs_review(F.col("status")) & ~excluded_path(F.col("path"))).groupBy("project_id").agg(F.count("path").alias("unread"))
    wide = (
        types.join(profile_fields(corpus, assets, lexicon) if found is None else found, "project_id", "left")
        .join(fallback_name(assets), "project_id", "left")
        .join(unread, "project_id", "left")
        .fillna("", ["title", *fields])
        .fillna(0, ["unread"])
    )
    missing = F.array_compact(F.array(*[F.when(F.col(f) == "", F.lit(f)) for f in REQUIRED if f in fields]).cast("array<string>"))
    risks = F.concat(
        F.transform(missing, lambda f: F.concat(F.lit("CPIR 字段缺失: "), f)),
        F.array_compact(
            F.array(
                F.when(F.col("unread") > 0, F.concat(F.lit("有 "), F.col("unread").cast("string"), F.lit(" 份材料的文本不完整或无法可靠抽取，未用于项目画像。"))),
                F.when(F.col("type") == "Unknown", F.lit("材料特征不足，赛道需要人工确认。")),
            )
        ),
    )
    name = F.when(F.col("title") != "", F.col("title")).otherwise(F.coalesce("name", F.lit("未命名项目")))
    return wide.select("project_id", name.alias("project_name"), "type", "confidence", "reason", *fields, missing.alias("missing_fields"), risks.alias("risk_items"))
