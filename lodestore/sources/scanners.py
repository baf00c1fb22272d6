"""Asset scanners: files and folders of a tree as entries of the store.

All of them take (path, value) rows of whole files, as :func:`~lodestore.sources.files.read_texts` gives them, and return
:data:`ENTRY` columns; which files of a deployment are rules, monitors and so on is a table of the caller's, with the columns
:data:`WANTED`. Files that are listed and missing give no entry; a null value is an empty file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, or_empty
from .files import first_doc, headings

ENTRY = ("type", "name", "summary", "content", "source_ref")
WANTED = "type string, name string, path string, hint string"
# How entries word what they tell; folders, files and words that are left out; extensions and words that type a document.
PATH, ABOUT, EXCERPT, POINTS = "路径: ", "\n说明: ", "\n摘要: ", "\n章节要点: "
FOLDER = "（目录级）"
RUN_WORDS = ("备份", "日志", "log", "审计")
SKIP_WORDS = ("backup", "备份", "审计", "执行日志", "archive", "日志", "承重墙", "快照", "snapshot", "temp", "tmp", ".git", ".learnings", ".bak")
EXTENSIONS = ("md", "sh", "yaml", "yml", "html", "json")
DESIGN_WORDS = ("方案", "设计", "计划", "规划", "落地", "路线", "架构", "v1", "v2", "v3", "v4", "v5", "v6", "版本")
RESEARCH_WORDS = ("调研", "研究", "报告", "分析", "总结", "对标", "盘点", "评估", "评测", "审计报告")


def _holds(col: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def _or(col: Column, default: Column | str) -> Column:
    """col, or the default where it is empty or null."""
    return F.when(or_empty(col) != "", col).otherwise(F.lit(default) if isinstance(default, str) else default)


def _entry(df: DataFrame, kind: Column, name: Column, lead: Column, *told: Column) -> DataFrame:
    return df.select(kind.alias("type"), name.alias("name"), clip(F.concat(name, F.lit("："), lead)).alias("summary"), F.concat(F.lit(PATH), F.col("path"), *told).alias("content"), F.col("path").alias("source_ref"))


def located(texts: DataFrame) -> DataFrame:
    """(path, folder, file, value): plain paths without a file scheme."""
    path = F.regexp_replace("path", "^file:/+", "/")
    return texts.select(path.alias("path"), F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(path, "([^/]*)$", 1).alias("file"), or_empty(F.col("value")).alias("value"))


def under(texts: DataFrame, root: str) -> DataFrame:
    """Files anywhere below a folder, with ``inner``, their path from there."""
    start = root.rstrip("/") + "/"
    return located(texts).where(F.col("path").startswith(start)).withColumn("inner", F.substr("path", F.lit(len(start) + 1)))


def front_value(text: Column, key: str) -> Column:
    """A key's value in a fenced head; empty if there is none."""
    head = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    return F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^{key}\s*:(.*)$", 1)), "^[\"']|[\"']$", "")


def _lead(text: Column) -> Column:
    """First line that tells something, after a fenced head."""
    return first_doc(F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---[^\n]*\n?", ""))


def skills(texts: DataFrame, root: str, kind: str = "skill", only: tuple[str, ...] = (), default: str = "技能包") -> DataFrame:
    """SKILL.md of each folder directly below root, hidden and set-aside ones left out; ``only`` names the folders wanted."""
    own = under(texts, root).withColumn("dir", F.regexp_extract("inner", r"^([^/]+)/SKILL\.md$", 1))
    own = own.where((F.col("dir") != "") & ~F.col("dir").rlike(r"^[._]|\.bak"))
    own = own.where(F.col("dir").isin(*only)) if only else own
    name, about = _or(front_value(F.col("value"), "name"), F.col("dir")), _or(front_value(F.col("value"), "description"), _or(_lead(F.col("value")), default))
    return _entry(own, F.lit(kind), name, about, F.lit(ABOUT), about)


def workflows(texts: DataFrame, skill_root: str, names: tuple[str, ...], folder: str) -> DataFrame:
    """Named skills that describe a way of working, and the Markdown files directly in one folder."""
    docs = under(texts, folder).where(F.col("inner").rlike(r"^[^/]+\.md$"))
    about = _or(_lead(F.col("value")), "流程文档")
    flows = _entry(docs, F.lit("workflow"), F.regexp_replace("file", r"\.md$", ""), about, F.lit(ABOUT), about)
    return skills(texts, skill_root, "workflow", names, "协作流程").unionByName(flows) if names else flows


def specs(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Listed documents with their first headings, or their first line."""
    own = located(texts).drop("file", "folder").join(wanted, "path")
    points = _or(headings(F.col("value")), F.substring(_lead(F.col("value")), 1, 150))
    return _entry(own, F.col("type"), F.col("name"), F.col("hint"), F.lit(POINTS), points)


def listed(texts: DataFrame, wanted: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Listed files that exist: rules, monitors, designs, research, references, scripts, configurations, benchmarks.

    A benchmark in JSON tells how many cases it holds. Paths of ``taken`` (source_ref) have an entry of another type already and get none.
    """
    own = located(texts).drop("file", "folder").join(wanted, "path")
    if taken is not None:
        own = own.join(taken.select(F.col("source_ref").alias("path")).distinct(), "path", "left_anti")
    cases = F.coalesce(F.json_array_length(F.get_json_object("value", "$.cases")), F.json_array_length("value"))
    counted = (F.col("type") == "benchmark") & F.col("path").endswith(".json") & cases.isNotNull()
    hint = F.concat(F.col("hint"), F.when(counted, F.concat(F.lit("；用例数 "), cases.cast("string"))).otherwise(""))
    return _entry(own, F.col("type"), F.col("name"), hint, F.lit(ABOUT), hint, F.lit(EXCERPT), _or(_lead(F.col("value")), F.col("hint")))


def children(texts: DataFrame) -> DataFrame:
    """(path, n) of every folder that holds files: how many files and folders stand directly in it, hidden ones left out."""
    parts = F.split(F.col("path"), "/")
    at = located(texts).select(parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("i"))
    direct = at.select(F.array_join(F.slice("p", F.lit(1), F.col("i")), "/").alias("path"), F.get("p", F.col("i")).alias("child")).distinct()
    return direct.groupBy("path").agg(F.count_if(~F.col("child").startswith(".")).alias("n"))


def folders(texts: DataFrame, wanted: DataFrame, unit: str = "个文件") -> DataFrame:
    """Listed folders that exist, with the number of what stands directly in them."""
    own = children(texts).join(wanted, "path")
    hint = F.concat(F.col("hint"), F.when(F.col("n") > 0, F.concat(F.lit("；含 "), F.col("n").cast("string"), F.lit(f" {unit}"))).otherwise(""))
    return _entry(own, F.col("type"), F.col("name"), F.concat(hint, F.lit(FOLDER)), F.lit(ABOUT), hint)


def profiles(texts: DataFrame, root: str, name: str, file: str = "config.yaml") -> DataFrame:
    """One entry for the configurations of all folders directly below root, with their number; none if root holds no file."""
    found = under(texts, root).agg(F.count("*").alias("any"), F.count_if(F.col("inner").rlike(f"^[^/]+/{file.replace('.', '[.]')}$")).alias("n")).where("any > 0")
    hint = F.concat(F.lit(file), F.when(F.col("n") > 0, F.concat(F.lit("；含 "), F.col("n").cast("string"), F.lit(" 个 profile config"))).otherwise(""))
    return _entry(found.withColumn("path", F.lit(root.rstrip("/"))), F.lit("config"), F.lit(name), F.concat(hint, F.lit(FOLDER)), F.lit(ABOUT), hint)


def models(texts: DataFrame, root: str) -> DataFrame:
    """Documents and shell scripts directly in root, and its folders but those of runs, each told by its README."""
    own = under(texts, root)
    files = own.where(F.col("inner").rlike(r"^[^./][^/]*\.(md|sh)$"))
    about = _or(_lead(F.col("value")), "模型训练资产文档")
    first = _entry(files, F.lit("asset"), F.regexp_replace("file", r"\.md$", ""), F.substring(about, 1, 60), F.lit(ABOUT), about)
    dirs = own.withColumn("dir", F.regexp_extract("inner", "^([^/]+)/", 1)).where((F.col("dir") != "") & ~F.col("dir").startswith(".") & ~_holds(F.col("dir"), RUN_WORDS))
    readme = F.max(F.when(F.col("inner") == F.concat("dir", F.lit("/README.md")), _lead(F.col("value"))))
    dirs = dirs.groupBy("dir").agg(readme.alias("lead")).withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "dir"))
    about = _or(F.col("lead"), "模型训练资产目录")
    return first.unionByName(_entry(dirs, F.lit("asset"), F.col("dir"), F.substring(about, 1, 60), F.lit(ABOUT), about))


def config_documents(texts: DataFrame, root: str) -> DataFrame:
    """Documents of six extensions anywhere below root, typed by extension and words of their names; set-aside folders and files are left out."""
    low, ext = F.lower("inner"), F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1))
    inside = F.regexp_extract(low, "^(.*/)?[^/]*$", 1)
    own = under(texts, root).where(~_holds(inside, SKIP_WORDS) & ext.isin(*EXTENSIONS) & ~F.col("file").startswith(".") & ~F.lower("file").contains(".bak"))
    kind = F.when(ext.isin("yaml", "yml", "sh"), "config").when(_holds(F.col("file"), DESIGN_WORDS), "design").when(_holds(F.col("file"), RESEARCH_WORDS), "research").otherwise("reference")
    about = _or(_lead(F.col("value")), "配置目录文档")
    return _entry(own, kind, F.substring(F.regexp_replace("file", r"\.[^.]*$", ""), 1, 60), about, F.lit(ABOUT), about)
