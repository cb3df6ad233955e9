"""The audit as DataFrames, one a stage, built from assets and a corpus.

Nothing runs until a stage is asked for. What several stages read (profile, claims, evidence, findings) is then
written once to the shared folder, so that it isn't computed again for each of them and plans stay small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.lexicon import DEFAULT, Lexicon
from dossierlake.operators import claims, consistency, diff, evidence, fixes, inventory, profile, report, rules, scoring
from dossierlake.workspace import counted, job_tag, materialize, row_counts


@dataclass(frozen=True)
class AuditOptions:
    lexicon: Lexicon = DEFAULT
    track: str | None = None
    rules: tuple[rules.Rule, ...] = field(default_factory=lambda: tuple(rules.parse_pack(rules.DEFAULT_PACKS)))
    max_ratio: float = 0.4
    #: Claims of a project that are looked at; None for all.
    most_claims: int | None = claims.CLAIMS


class AuditFrames:
    """assets: project_id, path, role, auditable, sensitive, generated, vendored; corpus: project_id, path, status, text."""

    def __init__(self, assets: DataFrame, corpus: DataFrame, options: AuditOptions | None = None):
        self.assets, self.corpus, self.options = assets, corpus, options or AuditOptions()

    @cached_property
    def types(self) -> DataFrame:
        return profile.detect_type(self.assets, self.corpus, self.options.lexicon, self.options.track)

    @cached_property
    def profile(self) -> DataFrame:
        return materialize(profile.build_profile(self.corpus, self.assets, self.types, self.options.lexicon), "profile")

    @cached_property
    def claims(self) -> DataFrame:
        return materialize(claims.extract_claims(self.corpus, self.assets, self.options.lexicon, self.options.most_claims), "claims")

    @cached_property
    def evidence(self) -> DataFrame:
        found = evidence.match_evidence(self.claims, self.assets, self.corpus, self.options.lexicon, many=self.options.most_claims is None)
        return materialize(found, "evidence")

    @cached_property
    def issues(self) -> DataFrame:
        return materialize(consistency.check_consistency(self.assets, self.profile, self.claims), "issues")

    @cached_property
    def findings(self) -> DataFrame:
        packs = list(self.options.rules)
        facts = materialize(rules.project_facts(self.assets, self.profile, self.claims, self.evidence, self.issues), "facts")
        by_text = rules.text_findings(self.corpus, self.assets, len(packs))
        return materialize(rules.evaluate(facts, packs, self.assets).unionByName(by_text), "findings")

    @cached_property
    def penalties(self) -> DataFrame:
        ratios = inventory.generated_ratio(self.assets, self.options.max_ratio)
        return materialize(scoring.saturate(scoring.ledger(self.findings, self.evidence, self.issues, ratios)), "penalties")

    @cached_property
    def scores(self) -> DataFrame:
        return scoring.trust_scores(self.assets, self.penalties)

    def _candidates(self) -> DataFrame:
        return fixes.candidate_tasks(self.findings, self.evidence, self.claims)

    @cached_property
    def tasks(self) -> DataFrame:
        return materialize(fixes.group_tasks(self._candidates()), "tasks")

    @cached_property
    def plan(self) -> DataFrame:
        """From tasks without their lists where claims have no bound: a list of all claims of a project would be one row."""
        return fixes.repair_plan(self.tasks if self.options.most_claims is not None else fixes.group_tasks(self._candidates(), lists=False))

    @cached_property
    def metrics(self) -> DataFrame:
        return diff.audit_metrics(self.scores, self.findings, self.evidence, self.tasks)

    @cached_property
    def markdown(self) -> DataFrame:
        return report.report_markdown(self.profile, self.scores, self.claims, self.evidence, self.findings, self.tasks)

    @cached_property
    def summary(self) -> DataFrame:
        return report.summary_rows(self.profile, self.assets, self.corpus, self.scores, self.findings, self.evidence, self.tasks)

    @cached_property
    def parts(self) -> DataFrame:
        """The package by sections, an item a row; the way to write projects of any size."""
        return report.package_parts(
            self.summary, self.assets, self.corpus, self.profile, self.claims, self.evidence, self.issues,
            self.findings, self.scores, self.penalties, self.tasks, self.plan,
        )

    @cached_property
    def json(self) -> DataFrame:
        return report.package_documents(self.parts)

    def stages(self) -> Iterator[tuple[str, DataFrame]]:
        """Each stage's name and DataFrame in order, for step by step runs."""
        for name in ("assets", "corpus", "types", "profile", "claims", "evidence", "issues", "findings", "scores", "tasks", "plan"):
            yield name, getattr(self, name)

    def observed(self, run: str) -> dict[str, int]:
        """Rows of every stage from one run, seen by the jobs that write them; the jobs carry ``run`` as their tag."""
        spark, found = self.assets.sparkSession, {}
        with job_tag(spark, run), row_counts() as written:
            for name, stage in self.stages():
                if name not in written:  # a stage that is no table of its own is read through once
                    seen, stage = counted(stage)
                    stage.write.format("noop").mode("overwrite").save()
                    found[name] = seen.get["rows"]
        return {name: written.get(name, found.get(name)) for name, _ in self.stages()}

    def checked(self) -> DataFrame:
        """The scores, with an error in place of a score outside 0 to 100."""
        ok = F.col("total_score").between(0, 100)
        return self.scores.withColumn("total_score", F.when(ok, F.col("total_score")).otherwise(F.raise_error(F.lit("score out of range")).cast("long")))

    def checked_findings(self) -> DataFrame:
        """The findings, with an error in place of a missing rule id."""
        named = F.coalesce(F.col("rule_id"), F.lit("")) != ""
        return self.findings.withColumn("rule_id", F.when(named, F.col("rule_id")).otherwise(F.raise_error(F.lit("finding without a rule id")).cast("string")))
