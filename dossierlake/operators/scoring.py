"""The trust score: penalties in order, each dimension losing no more than it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.functions.lexicon import DIMENSIONS, EVIDENCE_POINTS, SEVERITY_POINTS
from dossierlake.functions.text import contains_any, first_match, lower_ascii

MATERIAL, LOGIC, CLAIMS, TRACK, FEASIBILITY, REALITY, DEFENCE = DIMENSIONS
TRACK_PREFIX = "^(biz|soft|res|soc|ecom|ai|eng)_"
RATIO_RULE, CONSISTENCY_RULE = "COMMON_GENERATED_RATIO_001", "COMMON_CONSISTENCY_001"
RATIO_REASON = "生成物或第三方依赖占比过高，会削弱自主贡献可信度。"


def points_of(key: Column, points: dict[str, int]) -> Column:
    return first_match([(key == k, v) for k, v in points.items()], 0)


def dimension_of(rule_id: Column) -> Column:
    low = lower_ascii(rule_id)
    return first_match(
        [
            (low.contains("secret"), REALITY),
            (contains_any(low, ("generated", "vendor")), FEASIBILITY),
            (low.startswith("evidence_"), CLAIMS),
            (low.rlike(TRACK_PREFIX), TRACK),
            (low.contains("consistency"), LOGIC),
        ],
        MATERIAL,
    )


def ledger(findings: DataFrame, evidence: DataFrame, issues: DataFrame, ratios: DataFrame) -> DataFrame:
    """project_id, part, seq, rule_id, points, dimension, reason: all penalties in their order, before any is capped."""
    entry = lambda part, seq, rule, points, dimension, reason: [F.col("project_id"), F.lit(part).alias("part"), seq.cast("long").alias("seq"), rule.alias("rule_id"), points.cast("long").alias("points"), dimension.alias("dimension"), reason.alias("reason")]  # noqa: E731,E501
    by_rule = findings.where(F.col("rule_id") != CONSISTENCY_RULE).select(
        *entry(0, F.col("seq"), F.col("rule_id"), points_of(F.col("severity"), SEVERITY_POINTS), dimension_of(F.col("rule_id")), F.col("reason"))
    )
    number = F.regexp_extract("claim_id", "([0-9]+)$", 1)
    reason = F.when(F.col("reason") == "", "声明证据尚未达到可独立复核标准").otherwise(F.col("reason"))
    by_claim = evidence.select(*entry(1, number, F.concat(F.lit("EVIDENCE_"), F.col("claim_id")), points_of(F.col("status"), EVIDENCE_POINTS), F.lit(CLAIMS), reason))
    by_issue = issues.select(*entry(2, F.col("seq"), F.col("issue_id"), points_of(F.col("severity"), SEVERITY_POINTS), F.lit(LOGIC), F.col("description")))
    listed = findings.where(F.col("rule_id") == RATIO_RULE).select("project_id").distinct()
    by_ratio = ratios.where("ratio > 0.4").join(listed, "project_id", "left_anti")
    by_ratio = by_ratio.select(*entry(3, F.lit(0), F.lit(RATIO_RULE), F.lit(5), F.lit(FEASIBILITY), F.lit(RATIO_REASON)))
    return by_rule.unionByName(by_claim).unionByName(by_issue).unionByName(by_ratio)


def saturate(entries: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Entries with points, actual: what each takes from what its dimension has left; a rule counts once a project.

    Entries that take nothing stay, with actual 0. The order is (part, seq, rule_id).
    """
    caps = caps or DIMENSIONS
    place = F.struct("part", "seq", "rule_id")
    once = Window.partitionBy("project_id", "rule_id").orderBy("part", "seq", "dimension")
    rows = Window.partitionBy("project_id", "dimension").orderBy(place)
    cap = points_of(F.col("dimension"), caps)
    counted = entries.where("points > 0").withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    # each entry has a point at least, so none behind the first few of a dimension can take anything; that limit is on the
    # rank, before the shuffle as well, so a project with millions of entries is no long task
    first = counted.withColumn("__n", F.row_number().over(rows)).where(F.col("__n") <= max(caps.values()))
    left = cap - F.coalesce(F.sum("points").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("project_id", "rule_id", F.least(F.col("points"), F.greatest(left, F.lit(0))).cast("long").alias("actual"))
    joined = counted.join(first, ["project_id", "rule_id"], "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    return joined.select(*counted.columns, "actual")


def trust_scores(projects: DataFrame, penalties: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """project_id, total_score, trust_debt, dimensions for every project, those without penalties too."""
    caps = caps or DIMENSIONS
    lost = penalties.groupBy("project_id").agg(
        *[F.sum(F.when(F.col("dimension") == d, F.col("actual")).otherwise(0)).alias(f"d{i}") for i, d in enumerate(caps)]
    )
    names = [f"d{i}" for i in range(len(caps))]
    wide = projects.select("project_id").distinct().join(lost, "project_id", "left").fillna(0, names)
    left = [F.lit(c) - F.col(n) for n, c in zip(names, caps.values(), strict=True)]
    total = F.least(F.greatest(sum(left[1:], left[0]), F.lit(0)), F.lit(100)).cast("long")
    dimensions = F.create_map(*[x for d, value in zip(caps, left, strict=True) for x in (F.lit(d), value.cast("long"))])
    return wide.select("project_id", total.alias("total_score"), (F.lit(100) - total).alias("trust_debt"), dimensions.alias("dimensions"))
