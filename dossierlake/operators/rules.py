"""Declarative rule packs: JSON validated on the driver, whose demands are rows that meet the facts of projects."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions.lexicon import CLAIM_TYPES, PROFILE_LABELS
from dossierlake.operators.histories import running_total
from dossierlake.operators.trust import needs_review
from dossierlake.workspace import literal_rows

PACK_BYTES, RULES, FIELD_BYTES = 1 << 20, 10_000, 8192
# Roles, severities, and tracks of types.
ROLES = "PROJECT_DECLARATION BUSINESS_PLAN PITCH_DECK MARKET_RESEARCH COMPETITOR_ANALYSIS FINANCIAL_PLAN USER_RESEARCH SOURCE_CODE BUILD_SYSTEM DEPENDENCY_MANIFEST DEPLOYMENT_DOC EXPERIMENT_DATA RESEARCH_PAPER PATENT_COPYRIGHT SOCIAL_PRACTICE_PROOF PROOF_MATERIAL RESOURCE_ASSET MODEL_ARTIFACT BINARY_ARTIFACT ARCHIVE GENERATED VENDORED SECRET_RISK UNKNOWN".split()
SEVERITIES = ("INFO", "WARNING", "BLOCKER")
TRACKS = {
    "BusinessInnovation": ("business_innovation",),
    "SoftwareProject": ("software_project",),
    "EngineeringProduct": ("engineering_product", "software_project"),
    "ScientificResearch": ("scientific_research",),
    "SocialPractice": ("social_practice",),
    "PublicWelfare": ("public_welfare", "social_practice"),
    "Ecommerce": ("ecommerce",),
    "AiApplication": ("ai_application", "software_project"),
    "ComprehensiveInnovation": ("comprehensive_innovation", "business_innovation", "software_project"),
    "Unknown": (),
}
ROLE_LISTS = ("required_asset", "required_assets", "missing_asset", "missing_assets", "required_any_assets", "forbidden_roles")
SINGLE = ("required_asset", "missing_asset")
FLAGS = ("forbidden_sensitive_file", "consistency_check", "doc_code_support", "business_model_completeness", "technical_route_completeness", "research_reproducibility", "social_impact_evidence", "vendor_generated_ratio")
OTHER = ("minimum_asset_count", "max_ratio", "required_claim_evidence", "required_cpir_fields")
RULE_FIELDS = ("rule_id", "name", "track", "severity", "target", "description", "condition", "fail_reason", "fix_task")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    track: str
    severity: str
    target: str
    description: str
    condition: dict
    fail_reason: str
    fix_task: str


class RulePackError(ValueError):
    """A rule pack that can't be used."""


def severity_of(text: str) -> str:
    return text.upper() if text.upper() in SEVERITIES else "WARNING"


def parse_pack(raw: str) -> list[Rule]:
    """Rules of a JSON array or of an object's "rules"; unknown fields are errors."""
    if len(raw.encode()) > PACK_BYTES:
        raise RulePackError("rule pack larger than 1 MiB")
    try:
        data = json.loads(raw)
    except json.JSONDecodeError as error:
        raise RulePackError(str(error)) from error
    rows = data.get("rules") if isinstance(data, dict) else data
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise RulePackError("a pack is a list of rules")
    out = []
    for row in rows:
        if unknown := set(row) - set(RULE_FIELDS):
            raise RulePackError(f"unknown fields {sorted(unknown)}")
        texts = {k: row.get(k, "") for k in RULE_FIELDS if k != "condition"}
        if not all(isinstance(v, str) for v in texts.values()):
            raise RulePackError("a field isn't text")
        if texts["severity"].upper() not in SEVERITIES:
            raise RulePackError(f"unknown severity {texts['severity']!r}")
        out.append(Rule(**texts | {"severity": severity_of(texts["severity"])}, condition=row.get("condition", {})))
    return validate(out)


def load_packs(spark: SparkSession, paths: list[str]) -> list[Rule]:
    """Read packs (small files) through Spark's reader, so any store will do."""
    rows = spark.read.text(paths, wholetext=True).select("value").collect()
    rules = [r for row in rows for r in parse_pack(row["value"])]
    return validate(rules)


def _texts(key: str, value: object) -> list[str]:
    """The texts of a condition: one for a key in the singular, a list for the others."""
    found = [value] if key in SINGLE and isinstance(value, str) else value
    if not isinstance(found, list) or (key in SINGLE) is isinstance(value, list):
        raise RulePackError(f"{key} isn't of its kind")
    if not found or not all(isinstance(x, str) and x for x in found):
        raise RulePackError("a condition lists no texts")
    return found


def validate(rules: list[Rule]) -> list[Rule]:
    if len(rules) > RULES:
        raise RulePackError("too many rules")
    tracks = {"common", *(t for own in TRACKS.values() for t in own)}
    kinds = {k.name.lower() for k in CLAIM_TYPES}
    seen = set()
    for r in rules:
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_.-]{0,127}", r.rule_id) or r.rule_id in seen:
            raise RulePackError(f"bad or repeated id {r.rule_id!r}")
        seen.add(r.rule_id)
        if r.track not in tracks:
            raise RulePackError(f"{r.rule_id}: unknown track {r.track!r}")
        if not r.name or not (r.fail_reason or r.description) or not r.fix_task:
            raise RulePackError(f"{r.rule_id}: a rule says what to do")
        if any(len(getattr(r, k).encode()) > FIELD_BYTES for k in RULE_FIELDS if k != "condition"):
            raise RulePackError(f"{r.rule_id}: a text is too long")
        if not isinstance(r.condition, dict) or not r.condition:
            raise RulePackError(f"{r.rule_id}: no condition")
        actionable = False
        for key, value in r.condition.items():
            if key in ROLE_LISTS:
                if set(_texts(key, value)) - set(ROLES):
                    raise RulePackError(f"{r.rule_id}: unknown role")
                actionable = True
            elif key in FLAGS:
                if not isinstance(value, bool):
                    raise RulePackError(f"{r.rule_id}: {key} isn't true or false")
                actionable |= value
            elif key == "minimum_asset_count":
                if isinstance(value, bool) or not isinstance(value, (int, float)) or int(value) != value or not 1 <= value <= 1_000_000:
                    raise RulePackError(f"{r.rule_id}: bad count")
                actionable = True
            elif key == "max_ratio":
                if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
                    raise RulePackError(f"{r.rule_id}: bad ratio")
            elif key == "required_claim_evidence":
                if {t.lower() for t in _texts(key, value)} - kinds:
                    raise RulePackError(f"{r.rule_id}: unknown claim type")
                actionable = True
            elif key == "required_cpir_fields":
                if set(_texts(key, value)) - {"project_name", *PROFILE_LABELS}:
                    raise RulePackError(f"{r.rule_id}: unknown profile field")
                actionable = True
            else:
                raise RulePackError(f"{r.rule_id}: unknown condition {key!r}")
        if not actionable:
            raise RulePackError(f"{r.rule_id}: nothing to check")
    return rules


# The packs that come with the audit.
DEFAULT_PACKS = """[
{"rule_id": "COMMON_DECL_001", "name": "项目申报材料检查", "track": "common", "severity": "blocker", "target": "project_assets", "condition": {"required_assets": ["PROJECT_DECLARATION"]}, "fail_reason": "项目包缺少申报材料，无法确认项目基本信息。", "fix_task": "补充项目申报书或等价项目说明材料。"},
{"rule_id": "COMMON_SECRET_001", "name": "敏感文件检查", "track": "common", "severity": "blocker", "target": "project_assets", "condition": {"forbidden_sensitive_file": true}, "fail_reason": "项目包中存在敏感文件，不能直接作为竞赛提交材料。", "fix_task": "移除真实密钥文件，改为提供 .env.example 或配置说明。"},
{"rule_id": "COMMON_CONSISTENCY_001", "name": "材料一致性风险检查", "track": "common", "severity": "warning", "target": "consistency", "condition": {"consistency_check": true}, "fail_reason": "项目材料存在一致性风险，需要补充支撑材料或统一表述。", "fix_task": "根据一致性问题逐项统一材料口径并补充证据。"},
{"rule_id": "COMMON_GENERATED_RATIO_001", "name": "生成物和第三方依赖占比检查", "track": "common", "severity": "warning", "target": "project_assets", "condition": {"vendor_generated_ratio": true, "max_ratio": 0.4}, "fail_reason": "项目包中生成物或第三方依赖占比过高，会削弱项目自主贡献可信度。", "fix_task": "移除 build/dist/node_modules/vendor 等生成物或第三方依赖，保留源码和依赖清单。"},
{"rule_id": "BIZ_MODEL_001", "name": "商业模式闭环检查", "track": "business_innovation", "severity": "blocker", "target": "business_model", "condition": {"business_model_completeness": true}, "fail_reason": "项目商业模式缺少收入、成本或付费方说明。", "fix_task": "补充商业模式画布、收入来源、成本结构和财务预测假设。"},
{"rule_id": "BIZ_MARKET_001", "name": "市场规模证据检查", "track": "business_innovation", "severity": "blocker", "target": "market_analysis", "condition": {"required_assets": ["MARKET_RESEARCH"], "required_claim_evidence": ["MarketScale"]}, "fail_reason": "项目存在市场规模描述，但缺少可追溯数据来源。", "fix_task": "补充市场规模来源，并给出 TAM/SAM/SOM 拆解。"},
{"rule_id": "BIZ_COMPETITOR_001", "name": "竞品分析检查", "track": "business_innovation", "severity": "warning", "target": "competitor_analysis", "condition": {"required_assets": ["COMPETITOR_ANALYSIS"]}, "fail_reason": "项目缺少竞品分析材料，差异化优势难以复核。", "fix_task": "补充竞品分析表，列出竞品、来源、指标和差异化证据。"},
{"rule_id": "SOFT_SOURCE_001", "name": "源码材料检查", "track": "software_project", "severity": "blocker", "target": "source_code", "condition": {"required_assets": ["SOURCE_CODE"]}, "fail_reason": "软件项目缺少源码材料，无法复核技术实现。", "fix_task": "补充核心源码目录，并说明核心模块与功能对应关系。"},
{"rule_id": "SOFT_BUILD_001", "name": "构建入口检查", "track": "software_project", "severity": "blocker", "target": "source_code", "condition": {"doc_code_support": true}, "fail_reason": "项目存在源码但缺少构建或依赖入口。", "fix_task": "根据技术栈补充 CMakeLists.txt、package.json、requirements.txt 或等价说明。"},
{"rule_id": "SOFT_DEPLOY_001", "name": "部署说明检查", "track": "software_project", "severity": "warning", "target": "deployment", "condition": {"technical_route_completeness": true}, "fail_reason": "项目缺少部署说明，答辩复现风险较高。", "fix_task": "补充部署说明、运行截图和环境变量示例。"},
{"rule_id": "RES_EVAL_001", "name": "实验可复核性检查", "track": "scientific_research", "severity": "blocker", "target": "research_result", "condition": {"research_reproducibility": true}, "fail_reason": "项目存在研究结论，但缺少实验数据、评价指标或 baseline。", "fix_task": "补充实验数据、对比基线、评价指标和结果表。"},
{"rule_id": "RES_PAPER_001", "name": "论文或研究说明检查", "track": "scientific_research", "severity": "warning", "target": "research_paper", "condition": {"required_assets": ["RESEARCH_PAPER"]}, "fail_reason": "科研项目缺少论文或研究说明，方法来源和创新点难以复核。", "fix_task": "补充论文草稿、方法说明或实验设计文档。"},
{"rule_id": "SOC_IMPACT_001", "name": "社会影响证据检查", "track": "social_practice", "severity": "warning", "target": "social_value", "condition": {"social_impact_evidence": true}, "fail_reason": "项目存在社会影响描述，但缺少实践记录或影响数据。", "fix_task": "补充服务对象证明、活动记录、影响数据或合作单位证明。"},
{"rule_id": "ECOM_MODEL_001", "name": "电商三创闭环检查", "track": "ecommerce", "severity": "blocker", "target": "business_model", "condition": {"required_assets": ["BUSINESS_PLAN", "MARKET_RESEARCH", "FINANCIAL_PLAN"], "required_cpir_fields": ["target_user", "business_model", "financial_projection"]}, "fail_reason": "电商项目商业闭环材料不足。", "fix_task": "补充商品/服务、目标用户、交易流程、渠道策略和财务预测假设。"}
]"""  # fmt: skip


def project_facts(assets: DataFrame, profile: DataFrame, claims: DataFrame, evidence: DataFrame, issues: DataFrame) -> DataFrame:
    """One row a project with all that conditions look at: counts, and arrays bounded by roles, types and fields."""
    roles = assets.groupBy("project_id").agg(
        F.array_sort(F.collect_set("role")).alias("roles"),
        F.count("path").alias("assets"),
        F.count_if(F.col("role").isin("GENERATED", "VENDORED")).alias("foreign"),
    )
    judged = claims.join(evidence.select("project_id", "claim_id", "status"), ["project_id", "claim_id"], "left")
    types = judged.groupBy("project_id").agg(
        F.array_sort(F.collect_set("claim_type")).alias("claimed"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "SUPPORTED", F.col("claim_type")))).alias("proved"),
        F.array_sort(F.collect_set(F.when(F.coalesce(F.col("status"), F.lit("")) != "SUPPORTED", F.col("claim_type")))).alias("unproved"),
    )
    open_issues = issues.groupBy("project_id").agg(F.count("issue_id").alias("issues"))
    fields = ["project_name", *PROFILE_LABELS]
    filled = F.array_compact(F.array(*[F.when(F.col(f) != "", F.lit(f)) for f in fields]))
    facts = (
        profile.select("project_id", "type", filled.alias("filled"))
        .join(roles, "project_id", "left")
        .join(types, "project_id", "left")
        .join(open_issues, "project_id", "left")
        .fillna(0, ["assets", "foreign", "issues"])
    )
    nothing = F.array().cast("array<string>")
    return facts.withColumns({c: F.coalesce(c, nothing) for c in ("roles", "claimed", "proved", "unproved")})


@dataclass
class Demands:
    """What a rule's condition asks of a project's row. All of it has to hold; what doesn't is what the project lacks."""

    roles: list[str] = field(default_factory=list)
    any_roles: list[str] = field(default_factory=list)
    forbidden: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    claims: list[str] = field(default_factory=list)
    proofs: list[str] = field(default_factory=list)
    assets: int = 0
    consistent: bool = False
    built: bool = False
    ratio: float | None = None


DEMANDS = "roles array<string>, any_roles array<string>, forbidden array<string>, fields array<string>, claims array<string>, proofs array<string>, assets_least long, consistent boolean, built boolean, ratio double"


def demands_of(condition: dict) -> Demands:
    types = {k.name.lower(): k.name for k in CLAIM_TYPES}
    out = Demands()
    for key, value in condition.items():
        if key in ("required_asset", "required_assets", "missing_asset", "missing_assets"):
            out.roles += _texts(key, value)
        elif key == "required_any_assets":
            out.any_roles += _texts(key, value)
        elif key == "minimum_asset_count":
            out.assets = int(value)
        elif key == "forbidden_roles":
            out.forbidden += _texts(key, value)
        elif key == "required_claim_evidence":
            out.claims += [types[t.lower()] for t in _texts(key, value)]
        elif key == "required_cpir_fields":
            out.fields += _texts(key, value)
        elif value is not True:
            continue
        elif key == "forbidden_sensitive_file":
            out.forbidden.append("SECRET_RISK")
        elif key == "consistency_check":
            out.consistent = True
        elif key == "doc_code_support":
            out.built = True
        elif key == "business_model_completeness":
            out.fields += ["target_user", "business_model", "financial_projection"]
            out.roles += ["BUSINESS_PLAN", "FINANCIAL_PLAN"]
        elif key == "technical_route_completeness":
            out.fields.append("technical_route")
            out.roles += ["SOURCE_CODE", "DEPLOYMENT_DOC"]
        elif key == "research_reproducibility":
            out.roles.append("EXPERIMENT_DATA")
            out.proofs.append("ResearchResult")
        elif key == "social_impact_evidence":
            out.roles.append("SOCIAL_PRACTICE_PROOF")
            out.proofs.append("SocialImpact")
        elif key == "vendor_generated_ratio":
            out.ratio = float(condition.get("max_ratio", 0.4))
    return out


def lacking() -> tuple[Column, Column]:
    """(what a project lacks, the roles whose files stand against it) of a row with facts and a rule's demands as ``d``.

    One expression for all rules, whose demands are data: plans don't grow with the number of rules.
    """
    d = F.col("d")
    nothing = F.array().cast("array<string>")
    has = lambda role: F.array_contains("roles", role)
    fault = lambda test, text: F.when(test, F.array(text)).otherwise(nothing)
    over = F.coalesce(F.when(F.col("assets") > 0, F.col("foreign") / F.col("assets")) > d.ratio, F.lit(False))
    refused = F.array_intersect(d.forbidden, F.col("roles"))
    parts = [
        F.array_except(d.roles, F.col("roles")),
        F.when(~F.arrays_overlap(d.any_roles, F.col("roles")), d.any_roles).otherwise(nothing),
        F.transform(refused, lambda r: F.concat(F.lit("no "), r)),
        F.array_except(d.fields, F.col("filled")),
        F.filter(d.claims, lambda t: ~F.array_contains("claimed", t) | F.array_contains("unproved", t)),
        F.array_except(d.proofs, F.col("proved")),
        fault(F.col("assets") < d.assets_least, F.concat(F.lit("at least "), d.assets_least.cast("string"), F.lit(" assets"))),
        fault(d.consistent & (F.col("issues") > 0), F.lit("consistent materials")),
        fault(d.built & has("SOURCE_CODE") & ~has("BUILD_SYSTEM") & ~has("DEPENDENCY_MANIFEST"), F.lit("BUILD_SYSTEM")),
        fault(over, F.lit("own files")),
    ]
    foreign = F.array_intersect(F.array(F.lit("GENERATED"), F.lit("VENDORED")), F.col("roles"))
    return F.array_sort(F.array_distinct(F.concat(*parts))), F.concat(refused, F.when(over, foreign).otherwise(nothing))


def evaluate(facts: DataFrame, rules: list[Rule], assets: DataFrame) -> DataFrame:
    """project_id, seq, rule_id, severity, title, reason, evidence, missing_evidence, fix_suggestion of failed rules.

    Rules are rows of a literal table that meets projects by their type. Only the failed ones that speak of files meet the
    assets (project_id, path, role), to list them.
    """
    rows = []
    for seq, r in enumerate(rules):
        d = demands_of(r.condition)
        about = {"seq": seq, "rule_id": r.rule_id, "severity": r.severity, "title": r.name, "reason": r.fail_reason or r.description, "fix_suggestion": r.fix_task}
        types = [t for t, tracks in TRACKS.items() if r.track == "common" or r.track in tracks]
        rows += [{"type": t, "d": asdict(d) | {"assets_least": d.assets}} | about for t in types]
    schema = f"type: string, seq: int, rule_id: string, severity: string, title: string, reason: string, fix_suggestion: string, d: struct<{DEMANDS.replace(' ', ': ').replace(',:', ',')}>"
    table = literal_rows(facts.sparkSession, rows, schema)
    missing, against = lacking()
    every = facts.join(F.broadcast(table), "type").withColumn("missing_evidence", missing).withColumn("against", against)
    columns = ["project_id", "seq", "rule_id", "severity", "title", "reason", "missing_evidence", "fix_suggestion"]
    failed = every.where(F.size("missing_evidence") > 0).select(*columns, "against")
    listed = (
        failed.select("project_id", "seq", F.explode("against").alias("role"))
        .join(assets.select("project_id", "role", "path"), ["project_id", "role"])
        .groupBy("project_id", "seq")
        .agg(F.array_sort(F.collect_set("path")).alias("evidence"))
    )
    found = failed.join(listed, ["project_id", "seq"], "left")
    evidence = F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence")
    return found.select(*columns[:6], evidence, *columns[6:])


def applicable(types: DataFrame, rules: list[Rule]) -> DataFrame:
    """project_id, rule_id, track of the rules that a project's type asks for."""
    spark = types.sparkSession
    tracks = [(t, track) for t, own in TRACKS.items() for track in ("common", *own)]
    table = spark.createDataFrame(tracks, "type string, track string")
    listed = spark.createDataFrame([(r.rule_id, r.track) for r in rules], "rule_id string, track string")
    return types.join(F.broadcast(table.join(listed, "track")), "type").select("project_id", "rule_id", "track")


# What is said of a text that couldn't be read as a whole, by a part of its status.
TEXT_REVIEW = (
    ("TRUNCATED", " 比较大，这次只读取了前一部分。未读到的内容还没有核对，所以暂时不把这份文件当作关键证据。", "如果它是申报书或证明材料，请提供精简版或可完整读取的版本；普通源码可以保留原样。"),
    ("JSON_PARSE_FAILED", " 不是可正常解析的 JSON，里面的配置暂时无法可靠核对。", "检查 JSON 格式；如果它只是示例或构建产物，可以在材料说明中注明。"),
    ("EMPTY", " 没有读到可用文字，可能是空文件、编码不兼容或二进制内容。", "确认文件内容和编码；需要评审的材料请另存为可复制文本的版本。"),
    ("PDF", " 没有提取出足够完整的正文，可能是扫描件或使用了暂不支持的排版。", "提供可复制文字的原文件；扫描件请先做 OCR，并人工核对识别结果。"),
    ("OPENXML", " 没有提取出足够完整的正文，可能是扫描件或使用了暂不支持的排版。", "提供可复制文字的原文件；扫描件请先做 OCR，并人工核对识别结果。"),
    ("", " 的正文没有可靠读取完成，因此暂时不能用来支撑关键结论。", "请提供可正常打开、可复制文字的版本，并人工确认内容完整。"),
)
KEY_ROLES = ("PROJECT_DECLARATION", "BUSINESS_PLAN", "RESEARCH_PAPER", "PROOF_MATERIAL")


def text_findings(corpus: DataFrame, assets: DataFrame, after: int) -> DataFrame:
    """Findings for documents that have to be read by someone, numbered by path, behind ``after`` rules."""
    joined = corpus.where(needs_review(F.col("status"))).join(
        assets.where(~F.col("sensitive") & ~F.col("generated") & ~F.col("vendored")).select("project_id", "path", "role"), ["project_id", "path"]
    )
    joined = running_total(joined.select("project_id", "path", "status", "role", F.lit(1).alias("one")), "project_id", "path", "one", "n")
    n = F.col("n") + 1
    text = lambda k: reduce(lambda rest, row: F.when(F.col("status").contains(row[0]), F.lit(row[k])).otherwise(rest), reversed(TEXT_REVIEW), F.lit(""))
    return joined.withColumn("n", n).select(
        "project_id",
        (F.col("n") + after - 1).alias("seq"),
        F.concat(F.lit("TEXT_EXTRACTION_REVIEW_"), F.col("n").cast("string")).alias("rule_id"),
        F.when(F.col("role").isin(*KEY_ROLES), "BLOCKER").otherwise("WARNING").alias("severity"),
        F.lit("文本完整性复核").alias("title"),
        F.concat(F.col("path"), text(1)).alias("reason"),
        F.array("path").alias("evidence"),
        F.array(F.lit("可完整读取的文本")).alias("missing_evidence"),
        text(2).alias("fix_suggestion"),
    )


def sound_pack(pack: str) -> Column:
    """Whether a column's JSON is a rule pack that may be used; null for null. A pack is at most 1 MiB, so a row is small."""

    @F.pandas_udf("boolean")
    def checked(packs: pd.Series) -> pd.Series:
        def sound(raw: str | None) -> bool | None:
            if raw is None:
                return None
            try:
                return bool(parse_pack(raw))
            except RulePackError:
                return False

        return packs.map(sound)

    return checked(pack)
