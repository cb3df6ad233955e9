"""Built-in consistency checks over one wide row a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Id, description and suggestion of each check.
CHECKS = (
    ("CONSISTENCY_SOFT_001", "项目包含源码，但缺少构建入口或依赖清单。", "补充 CMakeLists.txt、package.json、requirements.txt 或等价构建说明。"),
    ("CONSISTENCY_BIZ_001", "存在财务预测材料，但缺少商业计划书解释收入、成本和付费方。", "补充商业计划书或商业模式画布。"),
    ("CONSISTENCY_MARKET_001", "材料出现市场分析，但未抽取到目标用户或用户画像。", "在申报书或商业计划书中明确目标用户和样本来源。"),
    ("CONSISTENCY_REVENUE_001", "材料存在收入或订单声明，但缺少财务预测或交易证明。", "补充订单、合同、流水或收入测算表。"),
)


def project_facts(assets: DataFrame, profile: DataFrame, claims: DataFrame) -> DataFrame:
    """roles, revenue, market_analysis, target_user of each project."""
    by_role = assets.groupBy("project_id").agg(F.collect_set("role").alias("roles"))
    revenue = claims.groupBy("project_id").agg(F.bool_or(F.col("claim_type") == "Revenue").alias("revenue"))
    return (
        by_role.join(profile.select("project_id", "market_analysis", "target_user"), "project_id", "left")
        .join(revenue, "project_id", "left")
        .fillna("", ["market_analysis", "target_user"])
        .fillna(False, ["revenue"])
    )


def check_consistency(assets: DataFrame, profile: DataFrame, claims: DataFrame) -> DataFrame:
    """project_id, seq, issue_id, severity, description, affected_files, fix_suggestion.

    Checks look at one small row a project; only issues that speak of files meet the assets, to list them.
    """
    facts = project_facts(assets, profile, claims)
    has = lambda role: F.array_contains("roles", role)
    tests = (
        (has("SOURCE_CODE") & ~has("BUILD_SYSTEM") & ~has("DEPENDENCY_MANIFEST"), "SOURCE_CODE"),
        (has("FINANCIAL_PLAN") & ~has("BUSINESS_PLAN"), "FINANCIAL_PLAN"),
        ((F.col("market_analysis") != "") & (F.col("target_user") == ""), "MARKET_RESEARCH"),
        (F.col("revenue") & ~has("FINANCIAL_PLAN") & ~has("PROOF_MATERIAL"), None),
    )
    issues = [
        F.when(
            test,
            F.struct(
                F.lit(seq).alias("seq"),
                F.lit(name).alias("issue_id"),
                F.lit("WARNING").alias("severity"),
                F.lit(text).alias("description"),
                F.lit(role).alias("role"),
                F.lit(fix).alias("fix_suggestion"),
            ),
        )
        for seq, ((name, text, fix), (test, role)) in enumerate(zip(CHECKS, tests, strict=True))
    ]
    found = facts.select("project_id", F.explode(F.array_compact(F.array(*issues))).alias("i")).select("project_id", "i.*")
    listed = (
        found.select("project_id", "seq", "role")
        .join(assets.select("project_id", "role", "path"), ["project_id", "role"])
        .groupBy("project_id", "seq")
        .agg(F.array_sort(F.collect_list("path")).alias("affected_files"))
    )
    files = F.coalesce("affected_files", F.array().cast("array<string>")).alias("affected_files")
    joined = found.join(listed, ["project_id", "seq"], "left")
    return joined.select("project_id", "seq", "issue_id", "severity", "description", files, "fix_suggestion")
