"""Evidence: each claim against the files whose role could prove it.

A document's numbers, words, markers, contradictions and partners are found once, whatever the number of claims. Files of
one project and role that no claim of theirs can tell apart are one class, with its first ``FILES`` paths; claims meet
classes, so their pairs don't grow with the files. Of a claim's classes at most ``FILES`` a kind are gathered, those with
the first paths, which hold its first files; both limits are on ranks, before the shuffle as well as after it.

That is for a bounded number of claims a project. Any number of them (``many``) meets files by equal numbers instead: a class is
of one number, so pairs grow with the numbers that claims give, and not with claims times classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.functions.lexicon import DEFAULT, Lexicon
from dossierlake.functions.text import (
    NUMBER,
    byte_length,
    first_match,
    latin_words,
    lower_ascii,
    numbers_in,
    telling_numbers,
    trimmed,
)
from dossierlake.operators.trust import needs_review, own_file
from dossierlake.workspace import literal_rows, text_batches

FILES = 24
#: What a claim looks for besides numbers: files that can't be read, and any that can.
UNREAD, ANY = "?", "*"
# Words too common to link a claim and a text.
STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "tam", "sam", "som")
REASONS = {
    "CONFLICTED": "候选证据中存在与声明相反的明确表述，需要核对原始材料。",
    "SUPPORTED": "独立材料中存在与声明关键数值或主体一致的可追溯证据。",
    "PARTIAL": "发现内容相关材料，但尚未达到独立、可追溯的强证据标准。",
    "NEED_REVIEW": "存在角色可能匹配的材料，但文本不可靠抽取或无法验证内容关联。",
    "UNSUPPORTED": "未发现与声明内容相关且可靠抽取的证据材料。",
}


def partner_name(claim: Column) -> Column:
    """What stands between 与 and the first of 签, 达成, 合作 (tried in this order): 6 to 72 bytes, else null."""
    rest = F.when(claim.contains("与"), F.substring_index(F.substring(claim, F.instr(claim, "与") + 1, F.length(claim)), "\0", 1))
    end = first_match([(rest.contains(w), F.substring_index(rest, w, 1)) for w in ("签", "达成", "合作")], F.lit(None).cast("string"))
    name = trimmed(end)
    return F.when((byte_length(end) <= 72) & (byte_length(name) >= 6), name)


def seen_in(text: Column, lists: dict[str, Iterable[str]]) -> Column:
    """kinds: names of the lists of which the text holds a word, whatever the case of A-Z; numbers: as numbers_in.

    Each list is one pattern, matched by whole columns of texts: one look at a text for all words of a list.
    """
    patterns = {name: "|".join(map(re.escape, words)) for name, words in lists.items() if words}

    @F.arrow_udf("kinds array<string>, numbers array<string>")
    def seen(texts: pa.Array) -> pa.Array:
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)
        found = {name: pc.match_substring_regex(low, pattern).to_pylist() for name, pattern in patterns.items()}
        kinds = [[name for name, hits in found.items() if hits[i]] for i in range(len(texts))]
        digits = pc.if_else(pc.match_substring_regex(texts, "[0-9]"), texts, "").to_pylist()
        numbers = [sorted({n.replace(",", "") for n in re.findall(NUMBER, t)}) for t in digits]
        words = pa.list_(pa.string())
        return pa.StructArray.from_arrays([pa.array(kinds, words), pa.array(numbers, words)], ["kinds", "numbers"])

    return seen(text)


def document_features(corpus: DataFrame, partners: DataFrame | None, lexicon: Lexicon = DEFAULT, also: dict[str, Column] | None = None) -> DataFrame:
    """``partners``: project_id and the names that its claims give, an array no longer than claims are; None for no names.
    ``also``: columns by name that the same pass over texts finds."""
    text_batches(corpus.sparkSession)
    kinds = [k.name for k in lexicon.claim_types]
    lists = {"": lexicon.contradictions} | {f"m {k.name}": k.markers for k in lexicon.claim_types} | {f"p {k.name}": k.proof_words for k in lexicon.claim_types}
    has = lambda name: F.array_contains("seen.kinds", name)
    with_ = lambda mark: F.array_compact(F.array(*[F.when(has(f"{mark} {k}"), F.lit(k)) for k in kinds]).cast("array<string>"))
    shares_words = any(k.name == "TechnicalCapability" for k in lexicon.claim_types)
    words = latin_words(F.col("text"), STOP_WORDS) if shares_words else F.array().cast("array<string>")
    names = F.lit(None).cast("array<string>")
    corpus = corpus.withColumn("partners", names) if partners is None else corpus.join(partners, "project_id", "left")
    also = also or {}
    return corpus.withColumns({"seen": seen_in(F.col("text"), lists)} | also).select(
        "project_id",
        "path",
        "status",
        F.coalesce(F.filter("partners", lambda p: F.col("text").contains(p)), F.array().cast("array<string>")).alias("doc_partners"),
        telling_numbers(F.col("seen.numbers")).alias("doc_numbers"),
        words.alias("doc_words"),
        has("").alias("doc_denies"),
        with_("m").alias("doc_markers"),
        with_("p").alias("doc_proofs"),
        *also,
    )


def candidate_roles(claims: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """claim_type, role, proves: a few dozen rows."""
    rows = [{"claim_type": k.name, "role": r, "proves": r in k.proof_roles} for k in lexicon.claim_types for r in k.roles]
    return literal_rows(claims.sparkSession, rows, "claim_type: string, role: string, proves: boolean")


def partner_names(claims: DataFrame) -> DataFrame:
    """project_id, partners: the names that a project's claims give."""
    named = claims.select("project_id", partner_name(F.col("claim_text")).alias("partner")).where("partner is not null")
    return named.groupBy("project_id").agg(F.collect_set("partner").alias("partners"))


def asking_claims(claims: DataFrame) -> DataFrame:
    """What each claim looks for in files."""
    text = F.col("claim_text")
    return claims.select(
        "project_id",
        "claim_id",
        "claim_type",
        F.col("path").alias("source"),
        telling_numbers(numbers_in(text)).alias("numbers"),
        partner_name(text).alias("partner"),
        latin_words(lower_ascii(text), STOP_WORDS).alias("words"),
    )


def asked_files(asking: DataFrame, assets: DataFrame, features: DataFrame, lexicon: Lexicon, many: bool = False) -> DataFrame:
    """project_id, path, role, unread, and the features of files that claims of the project ask for.

    Numbers, words and names that no claim of the project gives can't matter to any; nor does anything that is in a file that
    can't be read. ``many``: numbers are all of the file's, as those of all claims are too many to be looked up file by file.
    """
    each = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    technical = F.when(F.col("claim_type") == "TechnicalCapability", F.col("words"))
    numbers = F.array().cast("array<string>") if many else each("numbers")
    asked = asking.groupBy("project_id").agg(numbers.alias("numbers"), each(technical if many else "words").alias("words"), F.collect_set("partner").alias("partners"))
    roles = sorted({role for kind in lexicon.claim_types for role in kind.roles})
    own = assets.where(F.col("role").isin(*roles) & own_file()).select("project_id", "path", "role", "auditable")
    files = own.join(features, ["project_id", "path"], "left").join(asked, "project_id")
    unread = F.coalesce(F.col("status").isNull() | ~F.col("auditable") | needs_review(F.col("status")), F.lit(False))
    read = lambda value: F.when(~F.col("unread"), value)
    known = lambda value: F.coalesce(read(value), F.array().cast("array<string>"))
    return files.withColumn("unread", unread).select(
        "project_id",
        "path",
        "role",
        "unread",
        known(F.col("doc_numbers") if many else F.array_intersect("doc_numbers", "numbers")).alias("doc_numbers"),
        known(F.array_intersect("doc_words", "words")).alias("doc_words"),
        known(F.array_intersect("doc_partners", "partners")).alias("doc_partners"),
        F.coalesce(read(F.col("doc_denies")), F.lit(False)).alias("doc_denies"),
        known(F.col("doc_markers")).alias("doc_markers"),
        known(F.col("doc_proofs")).alias("doc_proofs"),
    )


def first_files(files: DataFrame) -> DataFrame:
    """The classes of files that only their paths tell apart, with the first ``FILES`` paths of each."""
    shared = [c for c in files.columns if c != "path"]
    rank = F.row_number().over(Window.partitionBy(*shared).orderBy("path"))
    first = files.withColumn("rank", rank).where(F.col("rank") <= FILES)
    return first.groupBy(*shared).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def file_classes(asking: DataFrame, assets: DataFrame, features: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """project_id, role, unread, the features that claims of the project ask for, and the first ``FILES`` paths that share them."""
    return first_files(asked_files(asking, assets, features, lexicon))


def judged(pairs: DataFrame, shared: Column, fits: Column) -> DataFrame:
    """The outcome of each pair of a claim and a class of files, which share a number, or fit the claim's numbers."""
    named = F.col("partner").isNull() | F.array_contains("doc_partners", F.col("partner"))
    marked = F.array_contains("doc_markers", F.col("claim_type"))
    conflict = marked & F.col("doc_denies") & fits & named
    topical = marked | ((F.col("claim_type") == "TechnicalCapability") & F.arrays_overlap("words", "doc_words"))
    relevant = fits & (named | (F.col("claim_type") != "Partnership")) & topical
    certificate = F.col("claim_type").isin("Patent", "Copyright")
    long_number = F.exists("numbers", lambda n: F.length(n) >= 6)
    same = F.when(F.col("claim_type") == "Partnership", F.col("partner").isNotNull() & named).otherwise(shared)
    strong = (
        F.col("proves")
        & ((F.size("paths") > 1) | (F.col("paths")[0] != F.col("source")))
        & F.array_contains("doc_proofs", F.col("claim_type"))
        & same
        & (~certificate | long_number)
    )
    outcome = first_match([(F.col("unread"), "review"), (conflict, "conflict"), (relevant, "relevant")], F.lit(None).cast("string"))
    return pairs.select("project_id", "claim_id", "paths", outcome.alias("outcome"), F.coalesce(strong, F.lit(False)).alias("strong"))


def judged_classes(claims: DataFrame, assets: DataFrame, corpus: DataFrame, lexicon: Lexicon = DEFAULT, features: DataFrame | None = None) -> DataFrame:
    """project_id, claim_id, paths, outcome (review, conflict, relevant, null), strong for each claim and class of files.

    ``features``: what document_features finds in the corpus, where it is known. A class is strong if one of its files is.
    """
    asking = asking_claims(claims)
    if features is None:
        features = document_features(corpus, partner_names(claims), lexicon)
    roles = F.broadcast(candidate_roles(claims, lexicon))  # a literal table
    pairs = asking.join(roles, "claim_type").join(file_classes(asking, assets, features, lexicon), ["project_id", "role"])
    shared = F.arrays_overlap("numbers", "doc_numbers")
    return judged(pairs, shared, (F.size("numbers") == 0) | shared)


def judged_by_number(claims: DataFrame, assets: DataFrame, corpus: DataFrame, lexicon: Lexicon = DEFAULT, features: DataFrame | None = None) -> DataFrame:
    """As judged_classes, of any number of claims: the pairs that share a number, or whose claim has none, and those to review.

    A file is in a class for each of its numbers that claims of the project give, so a claim may meet it more than once.
    """
    asking = asking_claims(claims)
    if features is None:
        features = document_features(corpus, partner_names(claims), lexicon)
    roles = F.broadcast(candidate_roles(claims, lexicon))  # a literal table
    wanted = F.when(F.size("numbers") == 0, F.array(F.lit(ANY))).otherwise(F.col("numbers"))
    asks = asking.withColumn("number", F.explode(F.concat(F.array(F.lit(UNREAD)), wanted)))
    offered = F.when(F.col("unread"), F.array(F.lit(UNREAD))).otherwise(F.concat(F.array(F.lit(ANY)), F.col("doc_numbers")))
    files = asked_files(asking, assets, features, lexicon, many=True).withColumn("number", F.explode(offered)).drop("doc_numbers")
    files = files.join(asks.select("project_id", "number").distinct(), ["project_id", "number"], "left_semi")
    pairs = asks.join(roles, "claim_type").join(first_files(files), ["project_id", "role", "number"])
    return judged(pairs, ~F.col("number").isin(UNREAD, ANY), F.lit(True))


def match_evidence(claims: DataFrame, assets: DataFrame, corpus: DataFrame, lexicon: Lexicon = DEFAULT, features: DataFrame | None = None, many: bool = False) -> DataFrame:
    """project_id, claim_id, status, evidence_files, missing_evidence, reason: one row a claim.

    The lists are cut at 24 files; the verdict looks at all of them. ``many``: projects may have any number of claims.
    """
    pairs = (judged_by_number if many else judged_classes)(claims, assets, corpus, lexicon, features).where("outcome is not null")
    # by strength as well, so that a strong file stays whatever its place; classes with one first path share a rank
    rank = F.dense_rank().over(Window.partitionBy("project_id", "claim_id", "outcome", "strong").orderBy(F.col("paths")[0]))
    pairs = pairs.withColumn("rank", rank).where(F.col("rank") <= FILES)
    files = lambda kind: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("outcome") == kind, F.col("paths")))))), 1, FILES)
    found = pairs.groupBy("project_id", "claim_id").agg(
        files("conflict").alias("conflicts"),
        files("relevant").alias("relevant"),
        files("review").alias("review"),
        F.bool_or((F.col("outcome") == "relevant") & F.col("strong")).alias("supported"),
    )
    status = first_match(
        [
            (F.size("conflicts") > 0, "CONFLICTED"),
            (F.col("supported"), "SUPPORTED"),
            (F.size("relevant") > 0, "PARTIAL"),
            (F.size("review") > 0, "NEED_REVIEW"),
        ],
        "UNSUPPORTED",
    )
    lookup = lambda pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    missing = lookup([(k.name, F.array(*map(F.lit, k.missing))) for k in lexicon.claim_types])
    reasons = lookup([(k, F.lit(v)) for k, v in REASONS.items()])
    nothing = F.array().cast("array<string>")
    listed = first_match(
        [(F.col("status") == "CONFLICTED", F.col("conflicts")), (F.col("status").isin("SUPPORTED", "PARTIAL"), F.col("relevant")), (F.col("status") == "NEED_REVIEW", F.col("review"))],
        nothing,
    )
    return (
        claims.select("project_id", "claim_id", "claim_type")
        .join(found, ["project_id", "claim_id"], "left")
        .withColumn("status", status)
        .select(
            "project_id",
            "claim_id",
            "status",
            listed.alias("evidence_files"),
            F.when(F.col("status") == "SUPPORTED", nothing).otherwise(missing[F.col("claim_type")]).alias("missing_evidence"),
            reasons[F.col("status")].alias("reason"),
        )
    )


def coverage(evidence: DataFrame) -> DataFrame:
    """project_id, claims, evidence_coverage: supported claims count whole, partly supported ones half."""
    worth = first_match([(F.col("status") == "SUPPORTED", 1.0), (F.col("status") == "PARTIAL", 0.5)], 0.0)
    return evidence.groupBy("project_id").agg(
        F.count("claim_id").alias("claims"), (F.sum(worth) * 100.0 / F.count("claim_id")).alias("evidence_coverage")
    )
