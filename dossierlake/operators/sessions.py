"""Sessions, tools, model lists and labels as small tables beside the audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossierlake.functions.text import byte_length, trimmed

INACTIVE_SESSIONS, QUEUED, SHOWN_WARNINGS, MODELS, MODEL_BYTES = 12, 8, 6, 4096, 256

# How roles, severities, claim types, evidence states and risk flags are called.
LABELS = {
    "role": {
        "PROJECT_DECLARATION": "项目申报材料", "BUSINESS_PLAN": "商业计划书", "PITCH_DECK": "路演材料", "MARKET_RESEARCH": "市场调研",
        "COMPETITOR_ANALYSIS": "竞品分析", "FINANCIAL_PLAN": "财务预测", "USER_RESEARCH": "用户调研", "SOURCE_CODE": "源码",
        "BUILD_SYSTEM": "构建入口", "DEPENDENCY_MANIFEST": "依赖清单", "DEPLOYMENT_DOC": "部署说明", "EXPERIMENT_DATA": "实验数据",
        "RESEARCH_PAPER": "论文或研究说明", "PATENT_COPYRIGHT": "知识产权证明", "PROOF_MATERIAL": "成果证明", "SOCIAL_PRACTICE_PROOF": "实践证明",
        "RESOURCE_ASSET": "资源素材", "MODEL_ARTIFACT": "模型产物", "BINARY_ARTIFACT": "二进制产物", "ARCHIVE": "压缩包",
        "GENERATED": "生成物", "VENDORED": "第三方依赖", "SECRET_RISK": "敏感文件", "UNKNOWN": "未归类",
    },
    "severity": {"INFO": "提示", "WARNING": "需要关注", "BLOCKER": "必须处理"},
    "claim_type": {
        "UserTraction": "用户与使用数据", "MarketScale": "市场规模", "TechnicalCapability": "技术能力", "BusinessModel": "商业模式", "Revenue": "收入",
        "CostReduction": "降本增效", "Patent": "专利", "Copyright": "软著", "Partnership": "合作", "Prototype": "原型",
        "ResearchResult": "研究结果", "SocialImpact": "社会影响", "Deployment": "部署上线", "Unknown": "其他声明",
    },
    "evidence": {"SUPPORTED": "证据充分", "PARTIAL": "证据不足", "UNSUPPORTED": "缺少证据", "CONFLICTED": "存在冲突", "NEED_REVIEW": "需要复核"},
    "risk_flag": {
        "SECRET_RISK": "可能包含敏感信息", "GENERATED": "生成物", "VENDORED": "第三方依赖", "NESTED_ARCHIVE_NEEDS_REVIEW": "嵌套压缩包待复核",
        "CONTENT_DEFERRED": "内容未自动载入", "LARGE_BINARY_DEFERRED": "文件超过自动读取预算", "COPY_BUDGET_DEFERRED": "工作副本容量受限，暂保留元数据",
        "PATH_DEPTH_LIMIT": "路径层级过深，暂保留元数据", "SYMLINK_DEFERRED": "符号链接未跟随，等待确认",
        **dict.fromkeys(("FIFO_DEFERRED", "SOCKET_DEFERRED", "BLOCK_DEVICE_DEFERRED", "CHARACTER_DEVICE_DEFERRED", "NON_REGULAR_FILE_DEFERRED", "NON_REGULAR_ENTRY_DEFERRED"), "非普通文件已识别，未打开内容"),
        "NESTED_ARCHIVE_DEFERRED": "嵌套归档已识别，暂未继续展开", "ENCRYPTED_ENTRY_DEFERRED": "加密条目已识别，需要解密后读取",
        "ENCRYPTION_STATUS_UNKNOWN_DEFERRED": "无法确认条目加密状态，未读取内容",
        **dict.fromkeys(("UNSUPPORTED_COMPRESSION_DEFERRED", "UNSUPPORTED_ARCHIVE_FORMAT"), "格式已识别，当前解析器暂不支持内容读取"),
        "ARCHIVE_TOO_LARGE_FOR_INDEXING": "归档超过自动展开预算，暂保留元数据",
        **dict.fromkeys(("RUNTIME_SINGLE_FILE_LIMIT_DEFERRED", "RUNTIME_SIZE_LIMIT_DEFERRED"), "条目实际大小超限，暂保留元数据"),
        "RUNTIME_COPY_BUDGET_DEFERRED": "展开时达到工作副本预算，暂保留元数据",
        **dict.fromkeys(("FILE_METADATA_UNREADABLE", "COPY_FAILED"), "文件暂不可读取，元数据已保留"),
        "CONTENT_UNREADABLE": "文件内容暂不可读取", "CONTENT_FORMAT_DETECTED": "已根据文件内容识别格式", "WORKSPACE_DRAFT_UNVERIFIED": "修复草稿，等待人工确认",
    },
}


def label_table(spark: SparkSession) -> DataFrame:
    """kind, value, label: a literal table of some eighty rows."""
    return spark.createDataFrame([(k, v, t) for k, own in LABELS.items() for v, t in own.items()], "kind string, value string, label string")


def with_label(rows: DataFrame, column: str, kind: str, name: str = "label") -> DataFrame:
    """``rows`` with what a value is called; a value without a label is called by itself."""
    labels = label_table(rows.sparkSession).where(F.col("kind") == kind).select(F.col("value").alias(column), F.col("label").alias(name))
    return rows.join(F.broadcast(labels), column, "left").withColumn(name, F.coalesce(name, column))


def available_tools(tools: DataFrame, permissions: DataFrame) -> DataFrame:
    """Tools whose permission is among those that a request has: a semi-join, so repeated permissions do no harm."""
    return tools.join(permissions, "permission", "left_semi")


def _newest(rows: DataFrame, order: list[str | Column], most: int, key: str | None = None) -> DataFrame:
    if key is None:
        return rows.orderBy(*order).limit(most)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__place", rank).where(F.col("__place") <= most).drop("__place")


def kept_sessions(sessions: DataFrame, order: str, key: str | None = None, most: int = INACTIVE_SESSIONS) -> DataFrame:
    """The newest inactive sessions, of each ``key`` if there is one."""
    return _newest(sessions, [F.desc(order)], most, key)


def accepted_messages(messages: DataFrame, order: str, key: str, most: int = QUEUED) -> DataFrame:
    """Messages with accepted: whether they found room in their session's queue."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return messages.withColumn("accepted", rank <= most)


def shown_warnings(warnings: DataFrame, order: str, key: str, most: int = SHOWN_WARNINGS) -> DataFrame:
    return _newest(warnings, [order], most, key)


def model_ids(models: DataFrame, order: str, column: str = "id", most: int = MODELS) -> DataFrame:
    """The distinct usable ids among the first ``most`` usable ones, in order: trimmed, 1 to 256 bytes, no controls."""
    own = trimmed(F.col(column))
    good = (own != "") & (byte_length(own) <= MODEL_BYTES) & ~own.rlike(r"[\x00-\x1F\x7F]")
    return models.where(good).orderBy(order).limit(most).select(own.alias(column)).distinct().orderBy(column)


def omitted_counts(rows: DataFrame, key: str, most: int = 48) -> DataFrame:
    """key, total, shown, omitted: what a list bounded to ``most`` items leaves out."""
    total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("shown", F.least("total", F.lit(most))).withColumn("omitted", F.col("total") - F.col("shown"))


def with_session_id(rows: DataFrame, name: str = "session_id") -> DataFrame:
    """A new id a row; another one each time it is computed, so write it down before it's used twice."""
    millis = F.unix_millis(F.current_timestamp()).cast("string")
    return rows.withColumn(name, F.concat(F.lit("session-"), millis, F.lit("-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)))


def stage_status(rows: DataFrame, key: str, order: str, active: Column) -> DataFrame:
    """``rows`` with stage (place in its key) and status: done before its key's last active row, running there, waiting
    behind it; waiting all along in a key without one."""
    own = Window.partitionBy(key)
    last = F.max(F.when(active, F.col(order))).over(own)
    status = F.when(F.col(order) < last, "done").when(F.col(order) == last, "running").otherwise("waiting")
    return rows.withColumn("stage", F.row_number().over(own.orderBy(order))).withColumn("status", status)


def tool_calls(calls: DataFrame, tools: DataFrame, tool: str) -> DataFrame:
    """``tool``, calls, allowed of each tool that is called; calls of unknown tools and of those without a grant aren't allowed.

    ``tools``: one row a tool, with granted. It is joined as Spark sees fit: counts of calls are taken first, so a tool that
    everyone calls is one row.
    """
    counted = calls.groupBy(tool).agg(F.count(F.lit(1)).alias("calls"))
    known = tools.select(F.col(tool).alias("__tool"), "granted")
    joined = counted.join(known, F.col(tool) == F.col("__tool"), "left").drop("__tool")
    return joined.select(tool, "calls", F.when(F.coalesce("granted", F.lit(False)), F.col("calls")).otherwise(0).cast("long").alias("allowed"))
