"""Audit queries over small literal tables and over driver tables as ledgers, file states and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions import text
from dossierlake.functions.lexicon import DEFAULT, DIMENSIONS, PROJECT_TYPES
from dossierlake.operators import claims, consistency, diff, evidence, histories, inventory, profile, rules, scoring, search, sessions
from dossierlake.plans.driver import LOW, TRIM, sql_any, sql_claim_type, sql_rows
from dossierlake.sources import archives, extract, files, formats
from dossierlake.workspace import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


LINES = [
    (1, "市场规模：预计 TAM 达到 100 亿元"),
    (2, "未申请专利，禁止营收宣传"),
    (3, "与华星公司已签署合作协议"),
    (4, "已获得专利，专利号 12345678"),
    (5, "已有用户达到 99999 人"),
    (6, "商业模式：订阅"),
    (7, "实现营收 50 万元"),
    (8, "通过工艺优化降低成本 30%"),
    (9, "样机已完成"),
    (10, "识别准确率领先"),
    (11, "系统已上线"),
    (12, "社会影响：覆盖 1200 人"),
    (13, "核心技术 自主研发"),
    (14, "a plain line"),
    (15, "软件著作权 登记号 2023SR0001"),
    (16, "SAMPLE 7"),
]


@query(f"SELECT id, {sql_claim_type(LOW.format('line'), DEFAULT)} AS claim_type FROM (VALUES {sql_rows(LINES)}) AS t(id, line)")
def claim_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(LINES, "id int, line string").select("id", claims.claim_type(F.col("line")).alias("claim_type"))


PARTNERS = [(1, "与华星公司已签署合作协议"), (2, "与甲达成合作"), (3, "合作与签"), (4, "与北方研究院合作完成样机"), (5, "没有伙伴")]


@query(
    f"""SELECT id, CASE WHEN strlen(trim(n)) >= 6 AND strlen(n) <= 72 THEN trim(n) END AS partner FROM (
SELECT id, CASE WHEN contains(r, '签') THEN string_split(r, '签')[1] WHEN contains(r, '达成') THEN string_split(r, '达成')[1]
  WHEN contains(r, '合作') THEN string_split(r, '合作')[1] END AS n
FROM (SELECT id, CASE WHEN contains(line, '与') THEN substr(line, instr(line, '与') + 1) END AS r FROM (VALUES {sql_rows(PARTNERS)}) AS t(id, line)))"""
)
def partner_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(PARTNERS, "id int, line string").select("id", evidence.partner_name(F.col("line")).alias("partner"))


PATHS = [
    "README.md", "申报/申报书.pdf", "商业计划.md", "路演.pptx", "市场调研.md", "竞品.xlsx", "财务预测.xlsx", "用户访谈.docx", "部署说明.md",
    "实验/结果.csv", "论文.pdf", "专利说明.md", "活动记录.jpg", "证明.png", "src/main.cpp", "src/app.ts", "CMakeLists.txt", "Makefile",
    "requirements.txt", "go.mod", "build/out.o", "node_modules/x/index.js", "cmake-build-debug/a.txt", ".env.production", "keys/server.pem",
    "data/model.onnx", "assets/logo.svg", "clip.mp4", "a.tar.gz", "lib.so", "notes", "deploy/Dockerfile", "docs/proposal.docx", "LICENSE",
    "x.unknownext", "db.sql", "weights.h5", "scene.glb", "font.woff2",
]
ASSET_SQL = f"""files AS (SELECT path, string_split(path, '/')[-1] AS file_name, string_split({LOW.format('path')}, '/') AS parts, {LOW.format('path')} AS low
  FROM (VALUES {sql_rows([(p,) for p in PATHS])}) AS t(path)),
dotted AS (SELECT *, regexp_extract({LOW.format('file_name')}, '^.+(\\.[^.]*)$', 1) AS extension, {LOW.format('file_name')} AS low_name FROM files),
exts(extension, kind, format, mime, language) AS (VALUES {sql_rows(formats.extension_rows())}),
known AS (SELECT d.*, coalesce(e.kind, CASE WHEN d.low_name IN ({", ".join(repr(n) for n in formats.TEXT_NAMES)}) THEN 'text' ELSE 'unknown' END) AS kind,
    coalesce(e.mime, CASE WHEN d.low_name IN ({", ".join(repr(n) for n in formats.TEXT_NAMES)}) THEN 'text/plain' ELSE 'application/octet-stream' END) AS mime,
    coalesce(e.language, '') AS language
  FROM dotted d LEFT JOIN exts e USING (extension))"""


def _in(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def _folder(names) -> str:
    return f"len(list_filter(parts, lambda p: p IN {_in(names)} OR starts_with(p, 'cmake-build-'))) > 0"


def _role_case() -> str:
    extra = {
        "PROJECT_DECLARATION": f"low_name IN {_in(inventory.DECLARATION_NAMES)}",
        "PITCH_DECK": f"extension IN {_in(inventory.DECKS)}",
        "EXPERIMENT_DATA": f"mime IN {_in(inventory.DATA_MIMES)} OR extension IN {_in(inventory.DATA_EXTENSIONS)}",
    }
    secret = (
        f"starts_with(p, '.env') OR p IN {_in(inventory.SECRET_NAMES)} OR {sql_any('p', inventory.SECRET_WORDS)} "
        f"OR regexp_extract(p, '^.+(\\.[^.]*)$', 1) IN {_in(inventory.SECRET_EXTENSIONS)}"
    )
    cases = [
        f"WHEN len(list_filter(parts, lambda p: {secret})) > 0 THEN 'SECRET_RISK'",
        f"WHEN {_folder(inventory.GENERATED)} THEN 'GENERATED'",
        f"WHEN {_folder(inventory.VENDORED)} THEN 'VENDORED'",
        f"WHEN extension IN {_in(['.' + e for e in formats.ARCHIVES])} OR mime IN {_in(inventory.ARCHIVE_MIMES)} THEN 'ARCHIVE'",
        f"WHEN low_name IN {_in(inventory.BUILD_NAMES)} THEN 'BUILD_SYSTEM'",
        f"WHEN low_name IN {_in(inventory.MANIFEST_NAMES)} THEN 'DEPENDENCY_MANIFEST'",
        f"WHEN language <> '' OR extension IN {_in(['.' + e for e in formats.CODE])} THEN 'SOURCE_CODE'",
    ]
    for role, written, lowered in inventory.ROLE_WORDS:
        test = f"{sql_any('path', written)} OR {sql_any('low', lowered)}"
        cases.append(f"WHEN {test}{' OR ' + extra[role] if role in extra else ''} THEN '{role}'")
    cases += [
        "WHEN regexp_matches(mime, '^(image|video|audio|font)/') THEN 'RESOURCE_ASSET'",
        "WHEN mime = 'application/x-model-artifact' OR starts_with(mime, 'model/') THEN 'MODEL_ARTIFACT'",
        f"WHEN mime IN {_in(inventory.BINARY_MIMES)} THEN 'BINARY_ARTIFACT'",
    ]
    return "CASE " + " ".join(cases) + " ELSE 'UNKNOWN' END"


@query(f"WITH {ASSET_SQL} SELECT path, kind, mime, {_role_case()} AS role FROM known")
def asset_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("p", p, 42) for p in PATHS], "project_id string, path string, size_bytes long")
    return inventory.inventory_of_paths(rows).select("path", "kind", "mime", "role")


@query(f"WITH {ASSET_SQL}, roles AS (SELECT path, {_role_case()} AS role FROM known) SELECT role, count(*) AS n FROM roles GROUP BY role")
def role_count_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("p", p, 42) for p in PATHS], "project_id string, path string, size_bytes long")
    return inventory.role_counts(inventory.inventory_of_paths(rows)).select("role", "n")


GUARDED = [(1, "project/file.txt"), (2, "project/"), (3, "../evil.txt"), (4, "project//file.txt"), (5, "/abs"), (6, "a\\b"), (7, "C:/x"), (8, "./x"), (9, "a/.."), (10, "ok")]


@query(
    f"""SELECT id, path <> '' AND NOT contains(path, chr(92)) AND NOT regexp_matches(path, '^[A-Za-z]:')
AND len(list_filter(string_split(regexp_replace(path, '/$', ''), '/'), lambda p: p IN ('', '.', '..'))) = 0 AS safe FROM (VALUES {sql_rows(GUARDED)}) AS t(id, path)"""
)
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(GUARDED, "id int, path string").select("id", text.safe_path(F.col("path")).alias("safe"))


MAGIC = [
    (1, "a.pdf", "255044462D312E37"), (2, "b.docx", "504B0304" + "00" * 26 + "776F72642F646F63"), (3, "c.zip", "504B030400"), (4, "d.png", "89504E470D0A1A0A00"),
    (5, "e.bin", "4D5A9000"), (6, "f.wasm", "0061736D01"), (7, "g.tar", "00" * 257 + "757374617200"), (8, "h.txt", "68656C6C6F0A"), (9, "i.md", "4D5A90000300"),
    (10, "j", "68690A"), (11, "k", "00FF00FF"), (12, "l.mp4", "0000001866747970" + "69736F6D"), (13, "m.glb", "676C5446"), (14, "n.rar", "526172211A0701000000"),
    (15, "o.h5", "894844460D0A1A0A"), (16, "p.pdf", "68656C6C6F"), (17, "q.jpg", "FFD8FFE0"), (18, "r.py", "7072696E7428312900"),
]
MAGIC_SQL = " ".join(
    "WHEN " + " AND ".join(f"regexp_matches(substr(h, {2 * o + 1}, 32), '^{p}')" for o, p in parts) + f" THEN '{name}'"
    for parts, name, _, _ in formats.SIGNATURES
)


@query(
    f"""SELECT id, CASE WHEN regexp_matches(h, '^504B0(304|506|708)') AND contains(h, '776F72642F') THEN 'docx' {MAGIC_SQL} ELSE NULL END AS magic
FROM (VALUES {sql_rows(MAGIC)}) AS t(id, path, h)"""
)
def magic_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(MAGIC, "id int, path string, h string")
    return rows.select("id", formats.signature(F.unhex("h"))["format"].alias("magic"))


OFFICE_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MISMATCH = "EXTENSION_CONTENT_MISMATCH"
#: What name and content together say of each of MAGIC, written out.
RECONCILED = [
    (1, "pdf", "application/pdf", True, ""), (2, "docx", OFFICE_MIME, True, ""), (3, "zip", "application/zip", False, ""), (4, "png", "image/png", False, ""),
    (8, "txt", "text/plain", True, ""), (11, "binary", "application/octet-stream", False, "UNRECOGNIZED_BINARY_FORMAT"), (10, "text", "text/plain", True, "UNKNOWN_TEXT_EXTENSION"),
    (16, "text", "text/plain", False, MISMATCH), (17, "jpg", "image/jpeg", False, ""), (18, "binary", "application/octet-stream", False, MISMATCH),
]


@query(f"SELECT * FROM (VALUES {sql_rows(RECONCILED)}) AS t(id, format, mime, auditable, risk_flags)")
def content_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("p", *r) for r in MAGIC if r[0] in {x[0] for x in RECONCILED}], "project_id string, id int, path string, h string")
    found = formats.detect_formats(rows.withColumn("content", F.unhex("h")).withColumn("size_bytes", F.octet_length(F.unhex("h")).cast("long")))
    return found.select("id", "format", "mime", "auditable", F.array_join("risk_flags", ",").alias("risk_flags"))


PHRASES = [
    ("a", "商业模式：订阅"), ("b", "软件系统：校园服务平台"), ("c", "硬件样机：传感器工程设计"), ("d", "科学研究：对照实验与 baseline"), ("e", "社会实践：三下乡实地调研"),
    ("f", "公益项目：面向弱势群体的志愿服务"), ("g", "三创电子商务平台"), ("h", "人工智能大模型应用"), ("i", "挑战杯综合创新项目"), ("j", "没有特征"), ("k", "商业模式 软件系统"),
]
TYPE_SQL = " UNION ALL ".join(f"SELECT id, '{t}' AS type, CASE WHEN {sql_any('low', w)} THEN {p} ELSE 0 END AS points FROM low" for t, p, w in DEFAULT.type_words)


@query(
    f"""WITH low AS (SELECT id, {LOW.format('line')} AS low FROM (VALUES {sql_rows(PHRASES)}) AS t(id, line)),
points AS ({TYPE_SQL} UNION ALL SELECT id, unnest({list(PROJECT_TYPES)!r}), 0 FROM low),
scores AS (SELECT id, type, sum(points) AS score FROM points GROUP BY id, type),
ranked AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM scores WINDOW w AS (PARTITION BY id ORDER BY score DESC, list_position({list(PROJECT_TYPES)!r}, type)))
SELECT id, CASE WHEN score < 3 OR (score = second AND score < 6) THEN 'Unknown' ELSE type END AS type,
       CASE WHEN score < 3 OR (score = second AND score < 6) THEN 0.0::DOUBLE
            ELSE round(least(greatest(0.55::DOUBLE + least(score, 10) * 0.03::DOUBLE + greatest(score - second, 0) * 0.02::DOUBLE, 0.55::DOUBLE), 0.9::DOUBLE), 4) END AS confidence
FROM ranked WHERE n = 1"""
)
def type_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(PHRASES, "project_id string, text string")
    assets = rows.select("project_id", F.lit("notes.md").alias("path"), F.lit("PROJECT_DECLARATION").alias("role"))
    texts = profile.bounded_texts(rows.withColumn("path", F.lit("notes.md")))
    found = profile.best_type(profile.type_points(assets, texts))
    return found.select(F.col("project_id").alias("id"), "type", "confidence")


PROFILE_LINES = [
    ("b.md", 0, "## 目标用户：乡镇医生"), ("a.md", 3, "- 目标用户：县医院"), ("a.md", 5, "解决方案是远程读片"), ("a.md", 6, "商业模式：暂无"),
    ("b.md", 2, "商业模式：按次付费"), ("b.md", 3, "我们的长长长长长长目标用户：无效位置"), ("a.md", 0, "# 远程读片平台"), ("b.md", 4, "技术路线 图像算法"),
]


def _profile_text(path: str) -> str:
    rows = {n: line for p, n, line in PROFILE_LINES if p == path}
    return "\n".join(rows.get(n, "") for n in range(max(rows) + 1)) + "\n"


@query(
    """SELECT 'p' AS project_id, '远程读片平台' AS title, '目标用户：县医院' AS target_user, '解决方案是远程读片' AS solution,
'商业模式：按次付费' AS business_model, '技术路线 图像算法' AS technical_route, '' AS pain_point"""
)
def profile_first_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ("a.md", "b.md")
    corpus = spark.createDataFrame([("p", p, "EXTRACTED_TEXT", _profile_text(p)) for p in paths], "project_id string, path string, status string, text string")
    assets = spark.createDataFrame(
        [("p", p, "PROJECT_DECLARATION", True, False, False, False) for p in paths],
        "project_id string, path string, role string, auditable boolean, sensitive boolean, generated boolean, vendored boolean",
    )
    found = profile.profile_fields(corpus, assets)
    return found.select("project_id", "title", "target_user", "solution", "business_model", "technical_route", "pain_point")


TRACKED = [(t, track) for t, own in rules.TRACKS.items() for track in ("common", *own)]
PACK = rules.parse_pack(rules.DEFAULT_PACKS)


@query(
    f"""SELECT t.type, r.rule_id FROM (VALUES {sql_rows([(t,) for t in rules.TRACKS])}) AS t(type)
JOIN (VALUES {sql_rows(TRACKED)}) AS m(type, track) ON m.type = t.type
JOIN (VALUES {sql_rows([(r.rule_id, r.track) for r in PACK])}) AS r(rule_id, track) ON r.track = m.track"""
)
def rule_track_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.createDataFrame([(t, t) for t in rules.TRACKS], "project_id string, type string")
    return rules.applicable(types, PACK).select(F.col("project_id").alias("type"), "rule_id")


FACTS = [
    ("full", "BusinessInnovation", ["PROJECT_DECLARATION", "BUSINESS_PLAN", "FINANCIAL_PLAN", "MARKET_RESEARCH", "COMPETITOR_ANALYSIS"], 5, 0, 0, ["target_user", "business_model", "financial_projection"], ["MarketScale"], ["MarketScale"], []),
    ("bare", "BusinessInnovation", ["SECRET_RISK", "GENERATED"], 4, 2, 1, [], ["MarketScale"], [], ["MarketScale"]),
    ("soft", "SoftwareProject", ["PROJECT_DECLARATION", "SOURCE_CODE"], 3, 0, 0, ["technical_route"], [], [], []),
    ("ai", "AiApplication", [], 0, 0, 0, [], [], [], []),
    ("res", "ScientificResearch", ["PROJECT_DECLARATION", "EXPERIMENT_DATA", "RESEARCH_PAPER"], 3, 0, 0, [], ["ResearchResult"], ["ResearchResult"], []),
    ("soc", "PublicWelfare", ["PROJECT_DECLARATION"], 3, 2, 0, [], [], [], []),
    ("shop", "Ecommerce", ["PROJECT_DECLARATION", "BUSINESS_PLAN"], 2, 0, 0, ["target_user"], [], [], []),
]


def _has(role: str) -> str:
    return f"list_contains(roles, '{role}')"


def _lacks(*roles: str) -> str:
    return "[" + ", ".join(f"CASE WHEN NOT {_has(r)} THEN '{r}' END" for r in roles) + "]"


def _empty(*fields: str) -> str:
    return "[" + ", ".join(f"CASE WHEN NOT list_contains(filled, '{f}') THEN '{f}' END" for f in fields) + "]"


#: What each rule finds missing, and the roles whose files it lists; a rule fails where something is missing.
_RULE_TESTS = {
    "COMMON_DECL_001": (_lacks("PROJECT_DECLARATION"), "[]"),
    "COMMON_SECRET_001": (f"[CASE WHEN {_has('SECRET_RISK')} THEN 'no SECRET_RISK' END]", "['SECRET_RISK']"),
    "COMMON_CONSISTENCY_001": ("[CASE WHEN issues > 0 THEN 'consistent materials' END]", "[]"),
    "COMMON_GENERATED_RATIO_001": ("[CASE WHEN assets > 0 AND foreign_files / assets > 0.4 THEN 'own files' END]", "['GENERATED', 'VENDORED']"),
    "BIZ_MODEL_001": (f"list_concat({_empty('target_user', 'business_model', 'financial_projection')}, {_lacks('BUSINESS_PLAN', 'FINANCIAL_PLAN')})", "[]"),
    "BIZ_MARKET_001": (f"list_concat({_lacks('MARKET_RESEARCH')}, [CASE WHEN NOT list_contains(claimed, 'MarketScale') OR list_contains(unproved, 'MarketScale') THEN 'MarketScale' END])", "[]"),
    "BIZ_COMPETITOR_001": (_lacks("COMPETITOR_ANALYSIS"), "[]"),
    "SOFT_SOURCE_001": (_lacks("SOURCE_CODE"), "[]"),
    "SOFT_BUILD_001": (f"[CASE WHEN {_has('SOURCE_CODE')} AND NOT {_has('BUILD_SYSTEM')} AND NOT {_has('DEPENDENCY_MANIFEST')} THEN 'BUILD_SYSTEM' END]", "[]"),
    "SOFT_DEPLOY_001": (f"list_concat({_empty('technical_route')}, {_lacks('SOURCE_CODE', 'DEPLOYMENT_DOC')})", "[]"),
    "RES_EVAL_001": (f"list_concat({_lacks('EXPERIMENT_DATA')}, [CASE WHEN NOT list_contains(proved, 'ResearchResult') THEN 'ResearchResult' END])", "[]"),
    "RES_PAPER_001": (_lacks("RESEARCH_PAPER"), "[]"),
    "SOC_IMPACT_001": (f"list_concat({_lacks('SOCIAL_PRACTICE_PROOF')}, [CASE WHEN NOT list_contains(proved, 'SocialImpact') THEN 'SocialImpact' END])", "[]"),
    "ECOM_MODEL_001": (f"list_concat({_lacks('BUSINESS_PLAN', 'MARKET_RESEARCH', 'FINANCIAL_PLAN')}, {_empty('target_user', 'business_model', 'financial_projection')})", "[]"),
}


def findings_sql(facts: str = "facts", assets: str = "listed_assets") -> str:
    """CTEs up to ``rule_findings``: project_id, rule_id, severity, missing, files from a table of facts and one of files."""
    failed = " UNION ALL ".join(f"SELECT project_id, type, '{k}' AS rule_id, list_filter({m}, lambda x: x IS NOT NULL) AS missing, {r}::VARCHAR[] AS against FROM {facts}" for k, (m, r) in _RULE_TESTS.items())
    return f"""tracks(type, track) AS (VALUES {sql_rows(TRACKED)}), listed(seq, rule_id, track, severity) AS (VALUES {sql_rows([(i, r.rule_id, r.track, r.severity) for i, r in enumerate(PACK)])}),
failed AS ({failed}),
rule_findings AS (
  SELECT f.project_id, l.seq, f.rule_id, l.severity, array_to_string(list_sort(list_distinct(f.missing)), ',') AS missing,
         coalesce((SELECT string_agg(DISTINCT a.path, ',' ORDER BY a.path) FROM {assets} a WHERE a.project_id = f.project_id AND list_contains(f.against, a.role)), '') AS files
  FROM failed f JOIN listed l USING (rule_id) JOIN tracks t ON t.type = f.type AND t.track = l.track WHERE len(f.missing) > 0)"""


@query(
    f"""WITH facts(project_id, type, roles, assets, foreign_files, issues, filled, claimed, proved, unproved) AS (VALUES {sql_rows(FACTS)}),
listed_assets AS (SELECT project_id, role, lower(role) || '.md' AS path FROM (SELECT project_id, unnest(roles) AS role FROM facts)),
{findings_sql()} SELECT project_id, rule_id, severity, missing, files FROM rule_findings"""
)
def rule_findings_all_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "project_id string, type string, roles array<string>, assets long, foreign long, issues long, filled array<string>, claimed array<string>, proved array<string>, unproved array<string>"
    facts = spark.createDataFrame(FACTS, schema)
    assets = facts.select("project_id", F.explode("roles").alias("role")).withColumn("path", F.concat(F.lower("role"), F.lit(".md")))
    found = rules.evaluate(facts, PACK, assets)
    return found.select("project_id", "rule_id", "severity", F.array_join("missing_evidence", ",").alias("missing"), F.array_join("evidence", ",").alias("files"))


CHECKED = [
    ("a", ["SOURCE_CODE"], "", "", False), ("b", ["SOURCE_CODE", "BUILD_SYSTEM"], "big", "", True), ("c", ["FINANCIAL_PLAN"], "", "", True),
    ("d", ["FINANCIAL_PLAN", "BUSINESS_PLAN", "MARKET_RESEARCH"], "big", "", False), ("e", ["PROOF_MATERIAL"], "x", "y", True), ("f", ["README"], "", "", True),
]


@query(
    f"""WITH p(project_id, roles, market, target, revenue) AS (VALUES {sql_rows(CHECKED)})
SELECT project_id, 'CONSISTENCY_SOFT_001' AS issue_id, 'source_code' AS files FROM p WHERE {_has('SOURCE_CODE')} AND NOT {_has('BUILD_SYSTEM')} AND NOT {_has('DEPENDENCY_MANIFEST')}
UNION ALL SELECT project_id, 'CONSISTENCY_BIZ_001', 'financial_plan' FROM p WHERE {_has('FINANCIAL_PLAN')} AND NOT {_has('BUSINESS_PLAN')}
UNION ALL SELECT project_id, 'CONSISTENCY_MARKET_001', CASE WHEN {_has('MARKET_RESEARCH')} THEN 'market_research' ELSE '' END FROM p WHERE market <> '' AND target = ''
UNION ALL SELECT project_id, 'CONSISTENCY_REVENUE_001', '' FROM p WHERE revenue AND NOT {_has('FINANCIAL_PLAN')} AND NOT {_has('PROOF_MATERIAL')}"""
)
def consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(CHECKED, "project_id string, roles array<string>, market_analysis string, target_user string, revenue boolean")
    assets = rows.select("project_id", F.explode("roles").alias("role")).withColumn("path", F.lower("role"))
    stated = rows.where("revenue").select("project_id", F.lit("CLM-001").alias("claim_id"), F.lit("Revenue").alias("claim_type"))
    found = consistency.check_consistency(assets, rows, stated)
    return found.select("project_id", "issue_id", F.array_join("affected_files", ",").alias("files"))


CAP_SQL = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DIMENSIONS))
CAPS_SQL = " ".join(f"WHEN '{d}' THEN {c}" for d, c in DIMENSIONS.items())


@query(
    f"""WITH e AS (SELECT o_custkey AS project_id, o_orderkey AS seq, CASE o_orderkey % 7 {CAP_SQL} END AS dimension,
  CASE WHEN starts_with(o_orderpriority, '1') THEN 10 WHEN starts_with(o_orderpriority, '2') THEN 5 ELSE 2 END AS points FROM orders),
r AS (SELECT *, coalesce(sum(points) OVER (PARTITION BY project_id, dimension ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
p AS (SELECT project_id, sum(least(points, greatest(CASE dimension {CAPS_SQL} END - before, 0))) AS lost FROM r GROUP BY 1)
SELECT project_id, (100 - lost)::BIGINT AS total_score, lost::BIGINT AS trust_debt FROM p"""
)
def penalty_ledger_saturating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a ledger: customers are projects, priorities severities."""
    orders = table(spark, sf_dir, "orders")
    severity = F.when(F.col("o_orderpriority").startswith("1"), "BLOCKER").when(F.col("o_orderpriority").startswith("2"), "WARNING").otherwise("INFO")
    dimension = F.element_at(F.array(*map(F.lit, DIMENSIONS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    entries = orders.select(
        F.col("o_custkey").alias("project_id"),
        F.lit(0).alias("part"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderkey").cast("string").alias("rule_id"),
        scoring.points_of(severity, {"BLOCKER": 10, "WARNING": 5, "INFO": 2}).cast("long").alias("points"),
        dimension.alias("dimension"),
    )
    penalties = scoring.saturate(entries)
    return scoring.trust_scores(entries, penalties).select("project_id", "total_score", "trust_debt")


SEVERITY_SQL = "CASE event_type WHEN 'purchase' THEN 'BLOCKER' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END"


def _event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "purchase", "BLOCKER").when(F.col("event_type") == "click", "WARNING").otherwise("INFO")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), severity.alias("severity"))


@query(f"SELECT user_id AS project_id, count(*) FILTER (s = 'BLOCKER') AS blockers, count(*) FILTER (s = 'WARNING') AS warnings, count(*) FILTER (s = 'INFO') AS infos FROM (SELECT *, {SEVERITY_SQL} AS s FROM events) GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    return _event_findings(spark, sf_dir).groupBy("project_id").agg(count("BLOCKER").alias("blockers"), count("WARNING").alias("warnings"), count("INFO").alias("infos"))


@query(
    f"""SELECT project_id, seq, severity, place::INT AS place FROM (SELECT user_id AS project_id, event_id AS seq, {SEVERITY_SQL} AS severity,
row_number() OVER (PARTITION BY user_id ORDER BY CASE {SEVERITY_SQL} WHEN 'BLOCKER' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END, event_id) AS place FROM events) WHERE place <= 6"""
)
def finding_priority_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_findings(_event_findings(spark, sf_dir), 6)


def _half(half: int) -> str:
    return f"""SELECT user_id AS project_id, (count(*) % 101)::BIGINT AS score, (100 - count(*) % 101)::BIGINT AS trust_debt, count(*) FILTER (event_type = 'purchase') AS blockers,
  count(*) FILTER (event_type = 'click') AS warnings, 50.0::DOUBLE AS evidence_coverage, 15 AS material_completeness, 10 AS consistency_score, count(DISTINCT event_type) AS fix_task_count
  FROM events WHERE event_id % 2 = {half} GROUP BY 1"""


@query(
    f"""WITH o AS ({_half(0)}), n AS ({_half(1)})
SELECT o.project_id, o.score AS old_score, n.score AS new_score, o.blockers AS old_blockers, n.blockers AS new_blockers, o.fix_task_count AS old_fix_task_count, n.fix_task_count AS new_fix_task_count,
'分数从 ' || o.score || ' 分变为 ' || n.score || ' 分；提交前要处理的问题从 ' || o.blockers || ' 个变为 ' || n.blockers || ' 个，建议补齐的地方从 ' || o.warnings || ' 个变为 ' || n.warnings
|| ' 个；修改任务从 ' || o.fix_task_count || ' 项变为 ' || n.fix_task_count || ' 项。' AS summary
FROM o JOIN n USING (project_id)"""
)
def audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    def half(k: int) -> DataFrame:
        n = F.count("event_id")
        return table(spark, sf_dir, "events").where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("project_id")).agg(
            (n % 101).alias("score"),
            (F.lit(100) - n % 101).alias("trust_debt"),
            F.count_if(F.col("event_type") == "purchase").alias("blockers"),
            F.count_if(F.col("event_type") == "click").alias("warnings"),
            F.lit(50.0).alias("evidence_coverage"),
            F.lit(15).alias("material_completeness"),
            F.lit(10).alias("consistency_score"),
            F.countDistinct("event_type").alias("fix_task_count"),
        )

    wanted = ["project_id", *[f"{side}_{m}" for m in ("score", "blockers", "fix_task_count") for side in ("old", "new")], "summary"]
    return diff.audit_diff(half(0), half(1)).select(*wanted)


@query(
    """WITH o AS (SELECT source, doc_id, md5(text) AS d FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT source, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS d FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(o.source, n.source) AS project_id, coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.d IS NULL THEN 'created' WHEN n.d IS NULL THEN 'deleted' ELSE 'modified' END AS kind
FROM o FULL OUTER JOIN n ON o.source = n.source AND o.doc_id = n.doc_id WHERE o.d IS DISTINCT FROM n.d"""
)
def workspace_full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("digest"))
    new = docs.where("path % 4 <> 0").withColumn("digest", F.when(F.col("path") % 7 == 0, "x").otherwise(F.col("digest")))
    return diff.file_changes(docs.where("path % 5 <> 0"), new)


ENTRIES = [
    ("a", 0, "docs", False, 10, 10), ("a", 1, "docs/readme.md", False, 10, 5), ("b", 0, "x/y.txt", False, 1000, 5), ("b", 1, "X/Y.TXT", False, 3, 3), ("c", 0, "../evil", False, 1, 1),
    ("d", 0, "fine/a.txt", False, 10, 9), ("d", 1, "fine/", True, 0, 0), ("e", 0, "z.bin", False, 5, 0),
]


@query(
    f"""WITH e AS (SELECT *, {LOW.format("regexp_replace(path, '/$', '')")} AS key FROM (VALUES {sql_rows(ENTRIES)}) AS t(archive, n, path, directory, size, packed)),
f AS (SELECT * FROM e WHERE NOT directory), s AS (SELECT archive, sum(size) AS s, sum(packed) AS p FROM f GROUP BY 1)
SELECT archive, 'UNSAFE_PATH' AS fault, path FROM e WHERE len(list_filter(string_split(key, '/'), lambda p: p IN ('', '.', '..'))) > 0
UNION ALL SELECT archive, 'DUPLICATE_ENTRY', min(path) FROM e GROUP BY archive, key HAVING count(*) > 1
UNION ALL SELECT archive, 'ENTRY_RATIO', path FROM f WHERE size > 0 AND (packed = 0 OR size / packed > 100)
UNION ALL SELECT archive, 'TOTAL_RATIO', '' FROM s WHERE s > 0 AND (p = 0 OR s / p > 100)
UNION ALL SELECT DISTINCT a.archive, 'FILE_FOLDER_CONFLICT', a.path FROM f a JOIN f b ON a.archive = b.archive AND starts_with(a.key, b.key || '/')"""
)
def archive_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(ENTRIES, "archive string, entry_seq int, path string, directory boolean, size_bytes long, compressed_bytes long")
    whole = rows.withColumn("project_id", F.lit("p")).withColumn("error", F.lit(None).cast("string"))
    return archives.archive_faults(whole).select("archive", "fault", "path")


@query(
    """WITH a AS (SELECT source, doc_id, n_chars FROM documents WHERE n_chars <= 3000), d AS (SELECT source, doc_id, n_chars FROM documents WHERE n_chars > 2500)
SELECT source AS project_id, count(*) AS assets, count(*) FILTER (deferred) AS deferred FROM (
  SELECT source, doc_id, FALSE AS deferred FROM a UNION ALL SELECT source, doc_id, TRUE FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = d.doc_id)) GROUP BY 1"""
)
def deferred_anti_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.format_string("%d.md", "doc_id").alias("path"), F.col("n_chars").alias("size_bytes"))
    assets = inventory.inventory_of_paths(docs.where("size_bytes <= 3000"))
    whole = inventory.with_deferred(assets, docs.where("size_bytes > 2500").withColumn("reason", F.lit("LARGE_BINARY_DEFERRED")))
    return whole.groupBy("project_id").agg(F.count("path").alias("assets"), F.count_if(F.array_contains("risk_flags", "CONTENT_DEFERRED")).alias("deferred"))


@query(
    """WITH RECURSIVE p AS (SELECT source AS project_id, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY lpad(doc_id::VARCHAR, 9, '0')) AS n FROM documents),
f AS (SELECT *, CASE WHEN n > 100000 THEN 'FILE_COUNT_DEFERRED' WHEN n_chars > 67108864 THEN 'LARGE_BINARY_DEFERRED' END AS early FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n) AS k FROM f WHERE early IS NULL),
g AS (SELECT project_id, k, n_chars <= 536870912 AS kept, CASE WHEN n_chars <= 536870912 THEN n_chars ELSE 0 END AS used FROM r WHERE k = 1
  UNION ALL SELECT r.project_id, r.k, g.used + r.n_chars <= 536870912, g.used + CASE WHEN g.used + r.n_chars <= 536870912 THEN r.n_chars ELSE 0 END FROM g JOIN r ON r.project_id = g.project_id AND r.k = g.k + 1)
SELECT project_id, reason, count(*) AS files FROM (
  SELECT project_id, early AS reason FROM f WHERE early IS NOT NULL UNION ALL SELECT project_id, CASE WHEN NOT kept THEN 'COPY_BUDGET_DEFERRED' END FROM g) GROUP BY 1, 2"""
)
def import_deferrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files, under the limits that an import has."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.format_string("%09d.md", "doc_id").alias("path"), F.col("n_chars").alias("size_bytes"))
    return files.import_plan(docs).groupBy("project_id", "reason").agg(F.count("path").alias("files"))


YAML = [(1, "# note\nname: demo\n\nports:\n  - 80\nurl: http://x:1\n: odd\nplain"), (2, ""), (3, "a:\nb: 2\n")]


@query(
    f"""WITH l AS (SELECT id, t.pos, {TRIM.format('t.line')} AS line FROM (VALUES {sql_rows(YAML)}) AS y(id, body), unnest(string_split(body, chr(10))) WITH ORDINALITY AS t(line, pos)),
k AS (SELECT id, pos, line, instr(line, ':') AS c, trim(substr(line, 1, greatest(instr(line, ':') - 1, 0))) AS k, trim(substr(line, instr(line, ':') + 1)) AS v FROM l WHERE line <> '' AND NOT starts_with(line, '#')),
o AS (SELECT id, pos, 1 AS part, line AS text FROM k WHERE c = 0 UNION ALL SELECT id, pos, 1, 'key: ' || k FROM k WHERE c > 0 AND k <> '' UNION ALL SELECT id, pos, 2, k || ': ' || v FROM k WHERE c > 0 AND v <> '')
SELECT y.id, coalesce((SELECT string_agg(text || chr(10), '' ORDER BY pos, part) FROM o WHERE o.id = y.id), '') AS body FROM (VALUES {sql_rows(YAML)}) AS y(id, b)"""
)
def yaml_like_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(YAML, "id int, body string").select("id", extract.yaml_lines(F.col("body")).alias("body"))


@query(
    r"""WITH l AS (SELECT doc_id, t.pos, regexp_replace(regexp_replace(t.line, '[ \t\n\r\f\x0B]+$', ''), '^(#+)([^ #])', '\1 \2') AS line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, pos)),
b AS (SELECT *, lag(trim(line) = '') OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM l)
SELECT doc_id, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM b WHERE NOT (trim(line) = '' AND coalesce(after, FALSE)) GROUP BY 1"""
)
def markdown_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", text.normal_lines(F.col("text")).alias("kept"))
    return lines.select("doc_id", F.size("kept").cast("long").alias("lines"), F.md5(F.array_join("kept", "\n").cast("binary")).alias("digest"))


TOOLS = [("view", "READ", True), ("click", "READ", True), ("purchase", "WRITE", False), ("signup", "WRITE", False)]


@query(
    f"""WITH tools(name, permission, granted) AS (VALUES {sql_rows(TOOLS)})
SELECT e.event_type AS tool, count(*) AS calls, count(*) FILTER (t.granted) AS allowed FROM events e LEFT JOIN tools t ON t.name = e.event_type GROUP BY 1"""
)
def observation_tool_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = spark.createDataFrame(TOOLS, "event_type string, permission string, granted boolean")
    return sessions.tool_calls(table(spark, sf_dir, "events"), tools, "event_type").withColumnRenamed("event_type", "tool")


@query(
    """SELECT event_id || '.json' AS path, string_agg('key: ' || k || chr(10) || k || ': ' || json_extract_string(props, '$.' || k) || chr(10), '' ORDER BY k) AS text,
'EXTRACTED_STRUCTURED_JSON' AS status FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) GROUP BY event_id"""
)
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as JSON files, flattened to lines."""
    events = table(spark, sf_dir, "events").select(
        F.lit("p").alias("project_id"), F.format_string("%d.json", "event_id").alias("path"), F.lit("x").alias("file_name"), F.lit(".json").alias("extension"), F.lit("text").alias("kind"), F.lit(True).alias("auditable"), F.col("props").cast("binary").alias("content")
    )
    return extract.extract_texts(events).select("path", "text", "status")


@query(
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS stage,
CASE WHEN turn < m THEN 'done' WHEN turn = m THEN 'running' ELSE 'waiting' END AS status
FROM (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS m FROM conversations)"""
)
def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps before, at and after the active one, which is a conversation's last user message."""
    staged = sessions.stage_status(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return staged.select("conv_id", "turn", "stage", "status")
