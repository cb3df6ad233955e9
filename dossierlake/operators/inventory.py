"""Inventory: what each file of a project is and what it is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.lexicon import SECRET_MARKERS
from dossierlake.functions.text import contains_any, extension_of, first_match, lower_ascii, path_parts
from dossierlake.operators.histories import running_total
from dossierlake.sources.formats import CODE, is_archive_path, with_format

# Folders of generated and of third-party files.
GENERATED = "build dist out target .next coverage __pycache__ generated .cache .pytest_cache".split()
VENDORED = "node_modules vendor third_party external .venv venv .tox site-packages bower_components".split()
PRUNED = (".git", ".workspaces")
# Names that say what a file is for.
BUILD_NAMES = "cmakelists.txt makefile dockerfile package.json pyproject.toml pom.xml build.gradle settings.gradle vite.config.js webpack.config.js tsconfig.json".split()
MANIFEST_NAMES = "requirements.txt package-lock.json pnpm-lock.yaml yarn.lock cargo.toml cargo.lock go.mod go.sum poetry.lock composer.json gemfile gemfile.lock".split()
DECLARATION_NAMES = "readme.md readme.txt project.md overview.md".split()
#: Role, words of the path as written, words of the path in lower case; tried in order.
ROLE_WORDS = (
    ("PROJECT_DECLARATION", ("项目介绍", "项目说明", "申报"), ("declaration", "proposal")),
    ("BUSINESS_PLAN", ("商业计划",), ("business_plan",)),
    ("PITCH_DECK", ("路演",), ("pitch",)),
    ("MARKET_RESEARCH", ("市场", "调研"), ("market",)),
    ("COMPETITOR_ANALYSIS", ("竞品",), ("competitor",)),
    ("FINANCIAL_PLAN", ("财务",), ("financial",)),
    ("USER_RESEARCH", ("用户", "问卷", "访谈"), ("survey",)),
    ("DEPLOYMENT_DOC", ("部署",), ("deploy",)),
    ("EXPERIMENT_DATA", ("实验",), ("baseline",)),
    ("RESEARCH_PAPER", ("论文",), ("paper",)),
    ("PATENT_COPYRIGHT", ("专利", "软著"), ()),
    ("SOCIAL_PRACTICE_PROOF", ("社会实践", "活动"), ()),
    ("PROOF_MATERIAL", ("证明", "成果"), ()),
)
DECKS = (".pptx", ".pptm", ".ppsx", ".odp")
DATA_MIMES = "application/x-data-artifact application/vnd.apache.parquet application/avro application/x-numpy application/x-hdf5 application/x-sqlite3".split()
DATA_EXTENSIONS = (".csv", ".tsv", ".jsonl", ".ndjson")
ARCHIVE_MIMES = "application/archive application/zip application/gzip application/zstd application/x-7z-compressed application/vnd.rar application/x-tar application/x-bzip2 application/x-xz application/x-cpio application/x-archive application/vnd.ms-cab-compressed application/x-lz4 application/x-iso9660-image application/x-rpm application/vnd.debian.binary-package application/vnd.android.package-archive application/java-archive".split()
BINARY_MIMES = "application/octet-stream application/wasm application/x-executable application/java-vm application/vnd.android.dex application/x-mach-binary application/x-plist".split()
SECRET_NAMES = ".npmrc .pypirc .netrc id_rsa id_ed25519 credentials credentials.json service-account.json".split()
SECRET_EXTENSIONS = (".pem", ".key", ".p12", ".pfx")
SECRET_WORDS = ("credential", "private-key", "private_key", "secret", "access-token", "access_token")
CONTENT_SAMPLE = 32 * 1024


def _in_folder(path: Column, names: list[str]) -> Column:
    parts = path_parts(lower_ascii(path))
    return F.exists(parts, lambda p: p.isin(*names) | p.startswith("cmake-build-"))


def is_generated(path: Column) -> Column:
    return _in_folder(path, GENERATED)


def is_vendored(path: Column) -> Column:
    return _in_folder(path, VENDORED)


def is_pruned(path: Column) -> Column:
    """In a folder that a scan doesn't enter: the file's own name may be such a name."""
    folders = lambda p: F.slice(path_parts(p), 1, F.size(path_parts(p)) - 1)
    names = [*PRUNED, *GENERATED, *VENDORED]
    return F.exists(folders(lower_ascii(path)), lambda p: p.isin(*names) | p.startswith("cmake-build-"))


def is_sensitive(path: Column, content: Column | None = None, sample: int | None = CONTENT_SAMPLE) -> Column:
    """By a part of the path, or by a marker in the first ``sample`` characters of the text; in all of it for None."""
    parts = path_parts(lower_ascii(path))
    by_name = F.exists(
        parts,
        lambda p: p.startswith(".env")
        | p.isin(*SECRET_NAMES)
        | contains_any(p, SECRET_WORDS)
        | F.regexp_extract(p, r"^.+(\.[^.]*)$", 1).isin(*SECRET_EXTENSIONS),
    )
    if content is None:
        return by_name
    seen = content if sample is None else F.substring(content, 1, sample)
    return by_name | F.coalesce(contains_any(lower_ascii(seen), SECRET_MARKERS), F.lit(False))


def role_of() -> Column:
    """The role by sensitive, generated, vendored, path, file_name, extension, mime and language."""
    path, name, extension, mime = (F.col(c) for c in ("path", "file_name", "extension", "mime"))
    low, low_name = lower_ascii(path), lower_ascii(name)
    data = mime.isin(*DATA_MIMES) | extension.isin(*DATA_EXTENSIONS)
    extra = {"PROJECT_DECLARATION": low_name.isin(*DECLARATION_NAMES), "PITCH_DECK": extension.isin(*DECKS), "EXPERIMENT_DATA": data}
    cases: list[tuple[Column, object]] = [
        (F.col("sensitive"), "SECRET_RISK"),
        (F.col("generated"), "GENERATED"),
        (F.col("vendored"), "VENDORED"),
        (is_archive_path(path) | mime.isin(*ARCHIVE_MIMES), "ARCHIVE"),
        (low_name.isin(*BUILD_NAMES), "BUILD_SYSTEM"),
        (low_name.isin(*MANIFEST_NAMES), "DEPENDENCY_MANIFEST"),
        ((F.col("language") != "") | extension.isin(*["." + e for e in CODE]), "SOURCE_CODE"),
    ]
    for role, written, lowered in ROLE_WORDS:
        test = contains_any(path, written) | contains_any(low, lowered)
        cases.append((test | extra[role] if role in extra else test, role))
    cases += [
        (mime.rlike("^(image|video|audio|font)/"), "RESOURCE_ASSET"),
        ((mime == "application/x-model-artifact") | mime.startswith("model/"), "MODEL_ARTIFACT"),
        (mime.isin(*BINARY_MIMES), "BINARY_ARTIFACT"),
    ]
    return first_match(cases, "UNKNOWN")


def classify(files: DataFrame, text: str | None = None) -> DataFrame:
    """Add generated, vendored, sensitive, role, importance and flags to files with their format columns."""
    flagged = (
        files.withColumn("generated", is_generated(F.col("path")))
        .withColumn("vendored", is_vendored(F.col("path")))
        .withColumn("sensitive", is_sensitive(F.col("path"), F.col(text) if text else None))
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("sensitive"), F.lit("SECRET_RISK")),
            F.when(F.col("generated"), F.lit("GENERATED")),
            F.when(F.col("vendored"), F.lit("VENDORED")),
            F.when(F.col("role") == "ARCHIVE", F.lit("NESTED_ARCHIVE_NEEDS_REVIEW")),
        )
    )
    own = F.col("risk_flags") if "risk_flags" in files.columns else F.array().cast("array<string>")
    return (
        flagged.withColumn("role", role_of())
        .withColumn("importance", F.when(F.col("role") == "UNKNOWN", 1).otherwise(3))
        .withColumn("risk_flags", F.array_distinct(F.concat(own, flags)))
    )


def inventory_of_paths(paths: DataFrame) -> DataFrame:
    """Assets of project_id, path, size_bytes by name alone; never auditable."""
    return classify(with_format(paths)).withColumn("auditable", F.lit(False))


def with_deferred(assets: DataFrame, deferred: DataFrame) -> DataFrame:
    """Assets and those deferred files that aren't among them, marked with their reason."""
    new = deferred.join(assets.select("project_id", "path"), ["project_id", "path"], "left_anti")
    marked = inventory_of_paths(new.select("project_id", "path", "size_bytes", "reason"))
    flags = F.array_union(F.col("risk_flags"), F.array(F.lit("CONTENT_DEFERRED"), F.col("reason")))
    marked = marked.withColumn("risk_flags", flags).drop("reason")
    return assets.unionByName(marked.select(*assets.columns))


def with_unverified(assets: DataFrame, unverified: DataFrame) -> DataFrame:
    """Files that a workspace drafted count as generated until someone has checked them."""
    listed = unverified.select("project_id", "path").distinct().withColumn("__draft", F.lit(True))
    joined = assets.join(listed, ["project_id", "path"], "left")
    draft = F.coalesce(F.col("__draft"), F.lit(False))
    changed = {
        "generated": F.col("generated") | draft,
        "auditable": F.col("auditable") & ~draft,
        "role": F.when(draft, F.lit("GENERATED")).otherwise(F.col("role")),
        "risk_flags": F.when(draft, F.array_union("risk_flags", F.array(F.lit("WORKSPACE_DRAFT_UNVERIFIED")))).otherwise(F.col("risk_flags")),
    }
    return joined.withColumns(changed).drop("__draft")


def role_counts(assets: DataFrame) -> DataFrame:
    return assets.groupBy("project_id", "role").agg(F.count("path").alias("n"))


def generated_ratio(assets: DataFrame, most: float = 0.4) -> DataFrame:
    """project_id, files, foreign (generated or vendored), ratio, over."""
    foreign = F.count_if(F.col("role").isin("GENERATED", "VENDORED"))
    counted = assets.groupBy("project_id").agg(F.count("path").alias("files"), foreign.alias("foreign"))
    ratio = F.col("foreign") / F.col("files")
    return counted.withColumn("ratio", ratio).withColumn("over", F.col("ratio") > most)


def extension_language(path: Column) -> Column:
    return F.when(extension_of(path).isin(*["." + e for e in CODE]), F.substring(extension_of(path), 2, 100)).otherwise("")


def inventory_warnings(assets: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """project_id, warnings: what an inventory says of itself, in a fixed order. skipped: project_id, folders left out."""
    flag = lambda f: F.array_contains("risk_flags", f)
    counts = assets.groupBy("project_id").agg(
        F.count_if(flag("EXTENSION_CONTENT_MISMATCH")).alias("mismatches"),
        F.count_if(flag("CONTENT_DEFERRED")).alias("deferred"),
        F.bool_or(F.col("role") == "PROJECT_DECLARATION").alias("declared"),
        F.bool_or(F.col("role") == "SECRET_RISK").alias("secret"),
    )
    counts = counts.join(skipped, "project_id", "left") if skipped is not None else counts.withColumn("folders", F.lit(0))
    counts = counts.fillna(0, ["folders"])
    says = lambda n, before, after: F.when(F.col(n) > 0, F.concat(F.lit(before), F.col(n).cast("string"), F.lit(after)))
    lines = [
        says("folders", "已跳过 ", " 个生成物或第三方依赖目录。"),
        says("mismatches", "发现 ", " 个扩展名与文件内容不一致的材料，已停止自动抽取。"),
        says("deferred", "已在文件树中保留 ", " 个未复制的大型或受限文件；可查看元数据，但不会自动读取全部内容"),
        F.when(~F.col("declared"), F.lit("未发现项目申报材料。")),
        F.when(F.col("secret"), F.lit("发现敏感文件风险。")),
    ]
    return counts.select("project_id", F.array_compact(F.array(*lines)).alias("warnings"))


def skipped_folders(files: DataFrame) -> DataFrame:
    """project_id, folders: how many folders a scan doesn't enter, each counted where it begins."""
    names = F.array(*map(F.lit, [*PRUNED, *GENERATED, *VENDORED]))
    parts = path_parts(F.col("path"))
    folders = F.slice(parts, 1, F.size(parts) - 1)
    pruned = lambda p: F.array_contains(names, lower_ascii(p)) | lower_ascii(p).startswith("cmake-build-")
    first = F.array_min(F.filter(F.transform(folders, lambda p, i: F.when(pruned(p), i)), lambda i: i.isNotNull()))
    begun = files.withColumn("__at", first).where("__at is not null")
    folder = F.array_join(F.slice(path_parts(F.col("path")), F.lit(1), F.col("__at") + 1), "/")
    return begun.groupBy("project_id").agg(F.countDistinct(folder).alias("folders"))


def asset_view(assets: DataFrame) -> DataFrame:
    """project_id, path, json: an asset as tools see it."""
    deferred = F.array_contains("risk_flags", "CONTENT_DEFERRED")
    readable = F.col("auditable") & ~F.col("sensitive") & F.col("kind").isin("text", "code", "office", "pdf")
    body = F.struct(
        "path",
        F.col("file_name").alias("name"),
        *[F.col(c) for c in ("extension", "size_bytes", "format", "mime", "language", "role")],
        readable.alias("text_readable"),
        "auditable",
        deferred.alias("content_deferred"),
        F.lit(False).alias("on_demand_text_candidate"),
        "risk_flags",
    )
    return assets.select("project_id", "path", F.to_json(body).alias("json"))


def files_with_role(assets: DataFrame, role: str) -> DataFrame:
    """project_id, has, n, files (sorted) of one role, for every project."""
    own = F.col("role") == role
    found = assets.groupBy("project_id").agg(F.count_if(own).alias("n"), F.array_sort(F.collect_list(F.when(own, F.col("path")))).alias("files"))
    return found.select("project_id", (F.col("n") > 0).alias("has"), "n", "files")


def ordered_assets(assets: DataFrame) -> DataFrame:
    """Assets with their place by path, from 1; counted in ranges, so a project of any size is spread over tasks."""
    placed = running_total(assets.withColumn("__one", F.lit(1)), "project_id", "path", "__one", "__place")
    return placed.withColumn("place", (F.col("__place") + 1).cast("int")).drop("__one", "__place")
