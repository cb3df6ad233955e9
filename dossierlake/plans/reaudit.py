"""Audits that go on from the last one: what a text says is kept by file, so an edit reads the edited files alone.

``FileFacts`` holds everything that the audit takes from texts, by file and its digest: its status, the lines that state
something, those that fill profile fields, and what evidence looks for. All later stages join such rows and never a
text. After an edit the facts of changed files replace the old ones; projects with a changed, new or deleted file are
audited anew from facts, and the rows of all other projects stay as they were.

A file counts as changed if its digest (SHA-256 of status and the text's own) differs. Repeated (project, path) rows aren't
allowed, as anywhere in the audit; a null text is an empty one. Two things can't be kept by file. Names of partners are
looked for in texts of projects whose claims give some, so lexicons with that kind of claim pass ``texts``; and
the type of a project is found in the texts of touched projects only where no track is given, also in ``texts``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.lexicon import Lexicon
from dossierlake.functions.text import BLANKS, numbered_lines
from dossierlake.operators import claims, evidence, profile
from dossierlake.operators.trust import claim_source, narrative, reliable
from dossierlake.plans.audit import AuditFrames, AuditOptions
from dossierlake.workspace import materialize

FILE = ["project_id", "path"]


def text_digest() -> F.Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def file_digest(body: F.Column) -> F.Column:
    """Of a corpus row with the digest of its text: what its facts depend on."""
    return F.sha2(F.concat(F.coalesce("status", F.lit("")), F.lit("\0"), body).cast("binary"), 256)


@dataclass(frozen=True)
class FileFacts:
    """files: project_id, path, status, digest; the others have rows of project_id, path and what was found there."""

    files: DataFrame
    statements: DataFrame
    fields: DataFrame
    features: DataFrame

    def replaced(self, gone: DataFrame, new: FileFacts) -> FileFacts:
        """Without the files of ``gone`` (project_id, path), and with those of ``new``."""
        parts = (f.name for f in fields(self))
        return FileFacts(*(getattr(self, n).join(gone, FILE, "left_anti").unionByName(getattr(new, n)) for n in parts))

    def of(self, projects: DataFrame) -> FileFacts:
        return FileFacts(*(getattr(self, f.name).join(projects, "project_id", "left_semi") for f in fields(self)))

    def written(self, name: str = "facts") -> FileFacts:
        return FileFacts(*(materialize(getattr(self, f.name), f"{name}-{f.name}") for f in fields(self)))


def _sifted(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, pa.Array]:
    """(text, place in it, line, whether it may state something, or fill a field) of all lines that may do either, and few others."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines, owners, starts = lists.flatten(), pc.list_parent_indices(lists), lists.offsets.to_numpy()
    heads = pc.ascii_trim(lines, BLANKS)
    states, fills = claims.may_state_lines(heads, lexicon), profile.may_fill_lines(heads, lexicon)
    kept = pc.indices_nonzero(pc.or_(states, fills))
    rows = owners.take(kept).to_numpy()
    return rows, (kept.to_numpy() - starts[rows]).astype("int32"), lines.take(kept), states.take(kept), fills.take(kept)


def _listed(rows: np.ndarray, texts: int, columns: dict[str, pa.Array]) -> pa.Array:
    """The rows of each text as a list of structs; ``rows`` rise."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=texts))])
    return pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def telling_in(text: Column, lexicon: Lexicon) -> Column:
    """All lines of a text that may state something or fill a field, and few others, with their places; low: trimmed, lower case.

    Lines are cut and sifted by whole columns of texts: lengths first, as most of a text is in long lines.
    """

    @F.arrow_udf("array<struct<line_no: int, raw: string, low: string, states: boolean, fills: boolean>>")
    def telling(texts: pa.Array) -> pa.Array:
        rows, places, lines, states, fills = _sifted(texts, lexicon)
        low = pc.ascii_lower(pc.ascii_trim(lines, BLANKS))
        return _listed(rows, len(texts), {"line_no": pa.array(places), "raw": lines, "low": low, "states": states, "fills": fills})

    return telling(text)


STATED = "claim_type: string, key: string, line_no: int, line: string"
FILLED = "field: string, line_no: int, value: string"


def said_in(text: Column, lexicon: Lexicon) -> Column:
    """statements and fields of a text, by whole columns of its lines; of each field only the first."""

    @F.arrow_udf(f"statements array<struct<{STATED}>>, fields array<struct<{FILLED}>>")
    def said(texts: pa.Array) -> pa.Array:
        rows, places, lines, states, fills = _sifted(texts, lexicon)
        heads = pc.ascii_trim(lines, BLANKS)
        at = pc.indices_nonzero(states)
        types, keys = claims.stated_in_lines(heads.take(at), lexicon)
        real = pc.is_valid(types)
        at = at.filter(real)
        stated = {"claim_type": types.filter(real), "key": keys.filter(real), "line_no": pa.array(places).take(at), "line": heads.take(at)}
        statements = _listed(rows[at.to_numpy()], len(texts), stated)
        at = pc.indices_nonzero(fills)
        found, fields, values = profile.fields_in_lines(heads.take(at), lexicon)
        line, name = at.to_numpy()[found], fields.dictionary_encode().indices.to_numpy()
        order = np.lexsort((line, name, rows[line]))
        new = np.diff(rows[line[order]], prepend=-1) | np.diff(name[order], prepend=-1)
        first = order[np.flatnonzero(new)]
        filled = {"field": fields.take(pa.array(first)), "line_no": pa.array(places[line[first]]), "value": values.take(pa.array(first))}
        return pa.StructArray.from_arrays([statements, _listed(rows[line[first]], len(texts), filled)], ["statements", "fields"])

    return said(text)


def read_texts(texts: DataFrame, lexicon: Lexicon, *own: str) -> DataFrame:
    """project_id, path, text_size, what evidence looks for (but names of partners), and what its lines say (said_in).

    One pass over texts for all that the audit takes from them. ``own``: further columns of ``texts`` to keep.
    """
    text = F.coalesce("text", F.lit(""))
    also = {"text_size": F.octet_length(text), "said": said_in(F.col("text"), lexicon)} | {c: F.col(c) for c in own}
    corpus = texts.withColumns({"text": text, "status": F.lit(None).cast("string")})
    return evidence.document_features(corpus, None, lexicon, also).drop("status")


def telling_lines(corpus: DataFrame, lexicon: Lexicon) -> DataFrame:
    """project_id, path, line_no, raw, low, states, fills of the lines that telling_in finds."""
    return corpus.select(*FILE, F.inline(telling_in(F.col("text"), lexicon)))


def facts_of(corpus: DataFrame, assets: DataFrame, lexicon: Lexicon, statuses: DataFrame | None = None) -> FileFacts:
    """One pass over texts for each kind of fact; nothing depends on any other file, and no text goes into a join.

    Of equal statements and fields a file keeps the first. ``statuses``: project_id, path, status of all files, where the
    corpus has none. What lines say is joined with them and the assets; that join is an inner one, on rows that are
    unique, since Spark would move a semi-join to before the lines, where the texts are.
    """
    corpus = corpus.withColumn("text", F.coalesce("text", F.lit("")))
    known = corpus.select(*FILE, "status") if statuses is None else statuses.select(*FILE, "status")
    told = known.where(reliable(F.col("status"))).join(assets.where(narrative(lexicon)).select(*FILE), FILE, "left_semi").select(*FILE)
    read = corpus.where(reliable(F.col("status"))) if statuses is None else corpus
    lines = read.select(*FILE, numbered_lines(F.col("text")).alias("line_no", "raw"))
    stated = claims.stated_lines(lines.withColumnRenamed("raw", "line"), lexicon)
    found = profile.field_lines(lines, lexicon)
    bodies = corpus.select(*FILE, text_digest().alias("body"))
    if statuses is None:
        files, features = corpus.select(*FILE, "status", text_digest().alias("body")), evidence.document_features(corpus, None, lexicon)
    else:
        files = bodies.join(known, FILE)
        features = evidence.document_features(corpus.withColumn("status", F.lit(None).cast("string")), None, lexicon).drop("status").join(known, FILE)
    return FileFacts(
        files.select(*FILE, "status", file_digest(F.col("body")).alias("digest")),
        _first_in_file(stated.join(told, FILE), ["claim_type", "key"], "line"),
        _first_in_file(found.join(told, FILE), ["field"], "value"),
        features.drop("doc_partners"),
    )


def _first_in_file(lines: DataFrame, keys: list[str], value: str) -> DataFrame:
    first = lines.groupBy(*FILE, *keys).agg(F.min(F.struct("line_no", value)).alias("first"))
    return first.select(*FILE, *keys, "first.line_no", f"first.{value}")


def facts_of_read(read: DataFrame, statuses: DataFrame, lexicon: Lexicon) -> FileFacts:
    """The facts for one audit, of read_texts and the files' statuses; its files have no digest.

    Lines are not yet those of trusted files: the audit's stages join them with the assets, as they do with kept facts, and
    only lines of files that can be relied on are here.
    """
    known = statuses.select(*FILE, "status")
    told = known.where(reliable(F.col("status"))).select(*FILE)
    return FileFacts(
        known,
        read.select(*FILE, F.inline("said.statements")).join(told, FILE),
        read.select(*FILE, F.inline("said.fields")).join(told, FILE),
        read.drop("said", "text_size", "doc_partners").join(known, FILE),
    )


class FactAudit(AuditFrames):
    """The audit's stages from facts. ``texts`` is a corpus, read only as the module's text says.

    ``corpus``: project_id, path, status and text_size of the files, where packages are asked for.
    """

    def __init__(self, assets: DataFrame, facts: FileFacts, options: AuditOptions | None = None, texts: DataFrame | None = None, corpus: DataFrame | None = None):
        super().__init__(assets, facts.files.select(*FILE, "status") if corpus is None else corpus, options)
        self.facts, self.texts = facts, texts

    @cached_property
    def types(self) -> DataFrame:
        if self.options.track is None and self.texts is None:
            raise ValueError("a project's type is found in texts: give a track or texts")
        return profile.detect_type(self.assets, self.texts, self.options.lexicon, self.options.track)

    @cached_property
    def profile(self) -> DataFrame:
        lexicon = self.options.lexicon
        projects = profile.trusted_documents(self.corpus, self.assets, lexicon).select("project_id")
        # the role of a file may have changed since its facts were found: only those count that are trusted now
        told = self.assets.where(narrative(lexicon)).select(*FILE)
        found = profile.first_fields(self.facts.fields.join(told, FILE, "left_semi"), projects, lexicon)
        return materialize(profile.build_profile(self.corpus, self.assets, self.types, lexicon, found), "profile")

    @cached_property
    def claims(self) -> DataFrame:
        sources = self.assets.where(claim_source(self.options.lexicon)).select(*FILE, "role")
        return materialize(claims.numbered_claims(self.facts.statements.join(sources, FILE), self.options.most_claims), "claims")

    @cached_property
    def evidence(self) -> DataFrame:
        lexicon, nobody = self.options.lexicon, F.array().cast("array<string>")
        features = self.facts.features.withColumn("doc_partners", nobody)
        if any(k.name == "Partnership" for k in lexicon.claim_types):
            if self.texts is None:
                raise ValueError("names of partners are looked for in texts")
            named = self.texts.join(evidence.partner_names(self.claims), "project_id")
            named = named.select(*FILE, F.filter("partners", lambda p: F.coalesce("text", F.lit("")).contains(p)).alias("named"))
            features = features.join(named, FILE, "left").withColumn("doc_partners", F.coalesce("named", nobody)).drop("named")
        return materialize(evidence.match_evidence(self.claims, self.assets, self.corpus, lexicon, features, self.options.most_claims is None), "evidence")


@dataclass(frozen=True)
class Audited:
    """Facts, and the rows of the stages that users read, for all projects."""

    facts: FileFacts
    claims: DataFrame
    evidence: DataFrame
    scores: DataFrame

    @classmethod
    def of(cls, audit: FactAudit) -> Audited:
        return cls(audit.facts, audit.claims, audit.evidence, materialize(audit.scores, "scores"))


def first_audit(assets: DataFrame, corpus: DataFrame, options: AuditOptions, statuses: DataFrame | None = None) -> Audited:
    """``statuses``: as for facts_of."""
    facts = facts_of(corpus, assets, options.lexicon, statuses).written()
    return Audited.of(FactAudit(assets, facts, options, corpus))


def reaudit(before: Audited, assets: DataFrame, changes: DataFrame, options: AuditOptions, gone: DataFrame | None = None, texts: DataFrame | None = None) -> tuple[Audited, DataFrame]:
    """The audit after an edit, and the projects that it touched.

    ``changes``: corpus rows of files that may have changed or are new; those with the digest they had are left alone.
    ``gone``: project_id, path of deleted files. ``assets``: all files as they are now.
    """
    known = before.facts.files.select(*FILE, F.col("digest").alias("known"))
    real = changes.withColumn("digest", file_digest(text_digest())).join(known, FILE, "left")
    real = materialize(real.where(F.col("known").isNull() | (F.col("known") != F.col("digest"))).drop("digest", "known"), "changes")
    left = real.select(*FILE) if gone is None else real.select(*FILE).unionByName(gone.select(*FILE))
    touched = materialize(left.select("project_id").distinct(), "touched")
    facts = before.facts.replaced(left.distinct(), facts_of(real, assets, options.lexicon)).written()
    own = lambda df: df.join(touched, "project_id", "left_semi")
    rest = lambda df: df.join(touched, "project_id", "left_anti")
    part = Audited.of(FactAudit(own(assets), facts.of(touched), options, None if texts is None else own(texts)))
    whole = lambda name: rest(getattr(before, name)).unionByName(getattr(part, name))
    return Audited(facts, whole("claims"), whole("evidence"), whole("scores")), touched
