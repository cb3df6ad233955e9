"""Word lists and tables of the audit, with their default values. Pass another Lexicon for another language."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ClaimType:
    """A line states a claim of this kind if it has one of ``topics`` and one of ``signs`` (or a digit, if that will do)."""

    name: str
    topics: tuple[str, ...]
    signs: tuple[str, ...] = ()
    digit: bool = False
    roles: tuple[str, ...] = ()
    markers: tuple[str, ...] = ()
    proof_roles: tuple[str, ...] = ()
    proof_words: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()


def _w(words: str) -> tuple[str, ...]:
    return tuple(words.split())


# What lines, evidence and proof of each kind of claim hold; the first kind that fits a line counts.
CLAIM_TYPES = (
    ClaimType("Patent", _w("专利"), _w("已申请 已授权 获得 拥有 取得 申请号 专利号"), False, _w("PATENT_COPYRIGHT PROOF_MATERIAL"), _w("专利"), _w("PATENT_COPYRIGHT"), _w("授权通知 专利号 申请号"), ("专利申请受理或授权材料",)),
    ClaimType("Copyright", _w("软著 软件著作权"), _w("已申请 已登记 获得 拥有 取得 登记号 证书号"), False, _w("PATENT_COPYRIGHT PROOF_MATERIAL"), _w("软著 软件著作权"), _w("PATENT_COPYRIGHT"), _w("登记号 软件著作权证书"), ("软著证书或受理材料",)),
    ClaimType("Partnership", _w("合作 协议"), _w("已签署 已签订 达成合作 建立合作 合作协议 合同编号"), False, _w("PROOF_MATERIAL SOCIAL_PRACTICE_PROOF"), _w("合作 协议 合同"), _w("PROOF_MATERIAL"), _w("盖章 合同编号 协议签署 签约"), ("合作协议", "盖章证明", "邮件记录")),
    ClaimType("MarketScale", _w("市场规模 tam sam som"), _w("预计 达到 约为 规模为 很大"), True, _w("MARKET_RESEARCH"), _w("市场规模 行业规模 tam sam som"), _w("MARKET_RESEARCH"), _w("数据来源 报告显示 统计年鉴 引用"), ("行业报告", "统计数据", "TAM/SAM/SOM 拆解")),
    ClaimType("UserTraction", _w("已有用户 注册用户 活跃用户 累计用户 付费用户"), _w("超过 达到 累计 已有"), True, _w("USER_RESEARCH PROOF_MATERIAL"), _w("用户 注册 活跃 付费"), _w("USER_RESEARCH PROOF_MATERIAL"), _w("后台数据 调查样本 访谈记录 数据导出"), ("用户数据", "后台截图", "问卷样本", "访谈记录")),
    ClaimType("Revenue", _w("营收 营业收入 销售收入 实现收入"), _w("实现 预计 达到"), True, _w("FINANCIAL_PLAN PROOF_MATERIAL"), _w("营收 收入 订单 合同 流水 发票"), _w("PROOF_MATERIAL"), _w("订单编号 合同编号 银行流水 发票号"), ("订单", "合同", "流水", "收入测算表")),
    ClaimType("CostReduction", _w("降低成本 降本 节省成本 成本下降"), (), True, _w("FINANCIAL_PLAN EXPERIMENT_DATA PROOF_MATERIAL"), _w("降低成本 降本 节省 成本下降"), _w("EXPERIMENT_DATA PROOF_MATERIAL"), _w("对照 测算 原始成本 实际成本"), ("成本口径", "对照数据", "降本测算表")),
    ClaimType("Prototype", _w("原型 样机"), _w("已完成 已开发 已制作 形成 完成"), False, _w("PROOF_MATERIAL DEPLOYMENT_DOC"), _w("原型 样机 prototype"), (), (), ("原型运行记录", "样机测试材料")),
    ClaimType("ResearchResult", _w("实验结果 测试结果 baseline 准确率 召回率 提升"), _w("优于 达到 验证"), True, _w("EXPERIMENT_DATA RESEARCH_PAPER"), _w("实验 测试结果 baseline 准确率 召回率"), _w("EXPERIMENT_DATA RESEARCH_PAPER"), _w("baseline 评价指标 对照实验 原始数据"), ("实验数据", "评价指标", "baseline")),
    ClaimType("Deployment", _w("已部署 已上线 正式上线 投入运行 生产环境"), ("",), False, _w("DEPLOYMENT_DOC"), _w("部署 上线 生产环境 health url"), (), (), ("部署说明", "运行截图")),
    ClaimType("SocialImpact", _w("社会影响 受益人数 服务对象 覆盖人群"), _w("覆盖 服务 受益"), True, _w("SOCIAL_PRACTICE_PROOF USER_RESEARCH"), _w("社会影响 服务对象 受益 活动记录"), _w("SOCIAL_PRACTICE_PROOF"), _w("活动记录 签到 名单 日期"), ("服务对象证明", "活动记录", "影响数据")),
    ClaimType("TechnicalCapability", _w("技术创新 技术领先 性能提升 识别准确率 核心技术"), _w("实现 达到 领先 自主研发"), True, _w("SOURCE_CODE BUILD_SYSTEM DEPLOYMENT_DOC RESEARCH_PAPER"), _w("技术 算法 模型 architecture implementation"), (), (), ("源码", "构建入口", "部署说明")),
    ClaimType("BusinessModel", _w("商业模式"), _w("： : 为 采用 通过 收入来源"), False, _w("BUSINESS_PLAN FINANCIAL_PLAN"), _w("商业模式 付费 订阅 收入来源"), (), (), ("商业模式画布", "财务预测假设", "成本结构")),
    ClaimType("Unknown", (), (), False, _w("PROOF_MATERIAL"), (), (), (), ("可追溯证明材料",)),
)

NEGATIONS = _w("未申请 未获得 未授权 未取得 未签署 未合作 未上线 未部署 未实现 未产生 未形成 没有营收 没有收入 无营收 无收入 无专利 无软著 暂无 尚未 暂未 不具备 不涉及 不代表 不承诺 禁止 不得 取消合作 计划申请 拟申请 计划上线 拟上线 拟合作 寻求合作")
CONTRADICTIONS = _w("未申请 未授权 未获得 未签署 未上线 未部署 未实现 没有营收 无营收 数据不一致 无法验证 已取消")
SECRET_MARKERS = (
    "-----begin private key", "-----begin rsa private key", "-----begin openssh private key", "client_secret", "api_key=",
    "api-key:", "apikey=", "access_token", "refresh_token", "authorization: bearer", "aws_secret_access_key", "password=",
    '"password":', '"secret":',
)
NARRATIVE_ROLES = _w("PROJECT_DECLARATION BUSINESS_PLAN PITCH_DECK MARKET_RESEARCH COMPETITOR_ANALYSIS FINANCIAL_PLAN USER_RESEARCH DEPLOYMENT_DOC RESEARCH_PAPER SOCIAL_PRACTICE_PROOF")
#: Narrative roles whose lines state no claims of the project's own.
NO_CLAIM_ROLES = _w("COMPETITOR_ANALYSIS USER_RESEARCH")

# Points of roles and of keyword groups for each type of project, in the types' own order.
PROJECT_TYPES = _w("BusinessInnovation SoftwareProject EngineeringProduct ScientificResearch SocialPractice Ecommerce AiApplication PublicWelfare ComprehensiveInnovation")
ROLE_POINTS = (
    ("BUSINESS_PLAN", "BusinessInnovation", 2), ("FINANCIAL_PLAN", "BusinessInnovation", 2), ("MARKET_RESEARCH", "BusinessInnovation", 2),
    ("SOURCE_CODE", "SoftwareProject", 2), ("BUILD_SYSTEM", "SoftwareProject", 2), ("DEPLOYMENT_DOC", "SoftwareProject", 1),
    ("RESEARCH_PAPER", "ScientificResearch", 3), ("EXPERIMENT_DATA", "ScientificResearch", 2),
    ("SOCIAL_PRACTICE_PROOF", "SocialPractice", 3), ("MODEL_ARTIFACT", "AiApplication", 4),
)
TYPE_WORDS = (
    ("Ecommerce", 5, _w("三创 电子商务 电商平台 直播带货 跨境电商")),
    ("AiApplication", 4, _w("人工智能 机器学习 深度学习 大模型 神经网络 智能体")),
    ("EngineeringProduct", 4, _w("硬件样机 工程设计 机械结构 电路板 传感器 制造工艺")),
    ("ScientificResearch", 4, _w("科学研究 实验设计 对照实验 baseline 论文 研究方法")),
    ("SocialPractice", 4, _w("社会实践 实地调研 三下乡 社区服务 实践团队")),
    ("PublicWelfare", 5, _w("公益项目 志愿服务 无偿服务 弱势群体 公益慈善")),
    ("ComprehensiveInnovation", 4, _w("挑战杯 综合创新 创新创业大赛 科技发明制作")),
    ("BusinessInnovation", 3, _w("商业计划 商业模式 营收预测 市场规模 客户获取")),
    ("SoftwareProject", 3, _w("软件系统 应用程序 技术架构 部署说明 系统平台")),
)

# Labels of the profile's fields.
PROFILE_LABELS = {
    "target_user": _w("目标用户 用户画像 服务对象 target_user"),
    "pain_point": _w("用户痛点 核心痛点 实际问题 pain_point"),
    "solution": _w("解决方案 解决路径 solution"),
    "product_or_service": _w("产品或服务 核心产品 产品形态 product_service"),
    "technical_route": _w("技术路线 技术架构 核心算法 technical_route"),
    "business_model": _w("商业模式 收入模式 付费方 business_model"),
    "market_analysis": _w("市场规模 市场分析 tam sam som market_analysis"),
    "competitor_analysis": _w("竞品分析 竞争分析 差异化 competitor_analysis"),
    "financial_projection": _w("财务预测 营收预测 成本结构 financial_projection"),
    "team_structure": _w("团队结构 团队分工 核心成员 team_structure"),
    "current_results": _w("当前成果 已取得成果 项目进展 current_results"),
    "social_value": _w("社会价值 社会影响 公益价值 social_value"),
}

# Caps of the score's dimensions.
DIMENSIONS = {
    "材料完整性": 15,
    "项目逻辑自洽性": 15,
    "声明-证据匹配度": 20,
    "赛道规则匹配度": 15,
    "技术/商业/科研可行性": 15,
    "成果真实性": 10,
    "答辩风险控制": 10,
}
SEVERITY_POINTS = {"BLOCKER": 10, "WARNING": 5, "INFO": 2}
EVIDENCE_POINTS = {"SUPPORTED": 0, "PARTIAL": 2, "NEED_REVIEW": 2, "UNSUPPORTED": 4, "CONFLICTED": 5}


@dataclass(frozen=True)
class Lexicon:
    claim_types: tuple[ClaimType, ...] = CLAIM_TYPES
    negations: tuple[str, ...] = NEGATIONS
    contradictions: tuple[str, ...] = CONTRADICTIONS
    secret_markers: tuple[str, ...] = SECRET_MARKERS
    narrative_roles: tuple[str, ...] = NARRATIVE_ROLES
    no_claim_roles: tuple[str, ...] = NO_CLAIM_ROLES
    stop_words: tuple[str, ...] = ()
    profile_labels: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PROFILE_LABELS))
    type_words: tuple[tuple[str, int, tuple[str, ...]], ...] = TYPE_WORDS
    role_points: tuple[tuple[str, str, int], ...] = ROLE_POINTS


DEFAULT = Lexicon()
