"""Key and value rows of a report, and exports of scanned and learned items, as frames; ``folioscan.sinks`` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan import sinks

#: Labels of categories and sources, headers and fixed rows of a report.
CATEGORY_LABELS = {"invalid": "无效", "duplicate": "重复", "normal": "正常"}
SOURCE_LABELS = {"rule": "自定义规则", "entry": "自定义词库", "bank": "内置词库"}
BACKUP_HEADER = ("分类", "来源", "分组/文件", "条目", "匹配式", "建议", "原因", "学习来源")
RULE_HEADER, WORD_HEADER = ("规则名", "匹配模式", "匹配式", "级别", "建议替换", "启用"), ("错误表述", "修订后标准表述", "启用")
TOOL = [("检测工具", "文档低级错误检查工具（本地离线版 v1.0）"), ("运行模式", "纯本地离线运行，零联网、零数据上传、零云端接口")]
WAYS = [("检测方式", "本地规则校验（不调用任何 AI 云端服务、不解析上传）"), ("原文档处理", "只读检测，不对原始文档做任何写入或修改")]


def _rows(one: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
    """(no, key, value) of one row."""
    return one.select(F.posexplode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs))).alias("no", "x")).select("no", "x.*")


def _count(name: str, unit: str) -> Column:
    return F.concat(F.col(name).cast("string"), F.lit(f" {unit}"))


def cover(totals: DataFrame, at: Column, operator: str = "", org: str = "") -> DataFrame:
    """(no, key, value): the table on a report's cover, of the one row of ``issues.summary``."""
    pairs = [("检测文件总数", _count("total_files", "个")), ("存在问题文件", _count("issue_files", "个")), ("无法解析文件", _count("error_files", "个")), ("发现问题总数", _count("total_issues", "处"))]
    return _rows(totals, [*pairs, ("检测时间", F.date_format(at, "yyyy 年 MM 月 dd 日 HH:mm")), ("检测人", F.lit(operator)), ("所属单位", F.lit(org))])


def basic_info(types: DataFrame, enabled: DataFrame, at: Column, operator: str = "", org: str = "") -> DataFrame:
    """(no, key, value) of ``issues.by_type`` and ``rules.enabled_by_section``, a handful of rows each."""
    n = lambda t: F.coalesce(F.sum(F.when(F.col("file_type") == t, F.col("files"))), F.lit(0)).alias(t)
    live = lambda s: F.coalesce(F.max(F.when(F.col("section") == s, F.concat_ws("/", F.col("enabled").cast("string"), F.col("total").cast("string")))), F.lit("—"))
    text = lambda c: F.col(c).cast("string")
    scope = F.concat(F.lit("Word 文档 "), text("Word"), F.lit(" 个、Excel 文档 "), text("Excel"), F.lit(" 个、PDF 文档 "), text("PDF"), F.lit(" 个"), F.when(F.col("不支持") > 0, F.concat(F.lit("、不支持格式 "), text("不支持"), F.lit(" 个"))).otherwise(""))
    # names of columns have no case in Spark, so those of the sections get a mark
    said = F.concat(F.lit("Word 规则 "), F.col("_word"), F.lit("；Excel 规则 "), F.col("_excel"), F.lit("；文字规范规则 "), F.col("_textnorm"), F.lit("；PDF 规则 "), F.col("_pdf"))
    one = types.agg(*map(n, ("Word", "Excel", "PDF", "不支持"))).join(enabled.agg(*(live(s).alias(f"_{s}") for s in ("word", "excel", "textnorm", "pdf"))))  # one row each
    fixed = lambda pairs: [(k, F.lit(v)) for k, v in pairs]
    return _rows(one, [*fixed(TOOL), ("检测时间", F.date_format(at, "yyyy-MM-dd HH:mm:ss")), ("检测范围", scope), ("启用规则", said), *fixed(WAYS), ("检测人", F.lit(operator)), ("所属单位", F.lit(org))])


def _label(c: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(c == k, v) for k, v in labels.items()), c)


def backup_table(items: DataFrame) -> DataFrame:
    """Scanned items as a table under ``BACKUP_HEADER``. ``items``: category, source, group, name, pattern, suggestion, reason, source_tag."""
    text = lambda c: F.coalesce(c, F.lit(""))
    cols = [_label(F.col("category"), CATEGORY_LABELS), _label(F.col("source"), SOURCE_LABELS), text("group"), text("name"), text("pattern"), text("suggestion"), text("reason"), text("source_tag")]
    return items.select(*(c.alias(h) for c, h in zip(cols, BACKUP_HEADER, strict=True)))


def backup_lines(items: DataFrame) -> DataFrame:
    """(value): scanned items as blocks of lines, one row an item; what is empty is left out."""
    text = lambda c: F.coalesce(c, F.lit(""))
    some = lambda head, c: F.when(text(c) != "", F.concat(F.lit(f"    {head}："), F.col(c)))
    head = F.concat(F.lit("["), _label(F.col("category"), CATEGORY_LABELS), F.lit("] "), _label(F.col("source"), SOURCE_LABELS), F.lit("｜"), text("group"), F.lit("｜"), text("name"), F.when(text("source_tag") != "", F.concat(F.lit("（"), F.col("source_tag"), F.lit("）"))).otherwise(""))
    return items.select(F.concat_ws("\n", head, some("匹配式", "pattern"), some("建议", "suggestion"), some("原因", "reason")).alias("value"))


def learned_table(records: DataFrame, kind: str) -> DataFrame:
    """Learned rules or words as a table. ``records``: kind, name, match_mode, pattern, severity, suggestion, enabled."""
    own = records.where(F.col("kind") == ("rule" if kind == "rules" else "wordbank"))
    value = lambda c, other="": F.coalesce(c, F.lit(other))
    live = F.coalesce("enabled", F.lit(True))
    cols = [value("name"), value("match_mode", "keyword"), value("pattern"), value("severity", "medium"), value("suggestion"), live] if kind == "rules" else [value("pattern"), value("suggestion"), live]
    return own.select(*(c.alias(h) for c, h in zip(cols, RULE_HEADER if kind == "rules" else WORD_HEADER, strict=True)))


def learned_lines(records: DataFrame, kind: str) -> DataFrame:
    """(value): learned rules as blocks of lines, or words with an arrow."""
    table = learned_table(records, kind)
    if kind == "rules":
        parts = [F.concat(F.lit(f"{h}："), F.when(F.col(h), "是").otherwise("否") if h == "启用" else F.col(h)) for h in RULE_HEADER]
        return table.select(F.concat_ws("\n", *parts, F.lit("---")).alias("value"))
    return table.select(F.concat(F.col(WORD_HEADER[0]), F.lit(" → "), F.col(WORD_HEADER[1]), F.lit("（"), F.when(F.col("启用"), "启用").otherwise("禁用"), F.lit("）")).alias("value"))


def table_rows(table: DataFrame, file: str, *order: str) -> DataFrame:
    """A table as rows of a file (``folioscan.sinks``), its head first; booleans are True and False. ``order`` are columns of the table, in which its rows stand."""
    head = table.sparkSession.createDataFrame([(file, 0, "head", list(table.columns))], "file string, part int, kind string, cells array<string>")
    said = [F.initcap(F.col(c).cast("string")) if t == "boolean" else F.col(c).cast("string") for c, t in table.dtypes]
    body = table.select(F.lit(file).alias("file"), F.lit(1).alias("part"), F.lit("row").alias("kind"), F.array(*said).alias("cells"), F.struct(*order or table.columns).alias("at"))
    return head.withColumn("at", F.lit(None).cast(body.schema["at"].dataType)).unionByName(body)


def line_rows(lines: DataFrame, file: str) -> DataFrame:
    """Blocks of lines (value) as rows of a file."""
    return lines.select(F.lit(file).alias("file"), F.lit(1).alias("part"), F.lit("p").alias("kind"), F.array("value").alias("cells"), F.struct("value").alias("at"))


def write_table(table: DataFrame, path: str, file: str = "table.csv", *order: str) -> None:
    """As one CSV file with a head and a byte-order mark; a file of that name is replaced."""
    sinks.write(table_rows(table, file, *order), path, "csv", "part", "at", overwrite=True)


def write_lines(lines: DataFrame, path: str, file: str = "lines.txt") -> None:
    sinks.write(line_rows(lines, file), path, "txt", "part", "at", overwrite=True)
