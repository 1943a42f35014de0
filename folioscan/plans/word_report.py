"""The rows of a Word report (``folioscan.sinks``): one over all files, or one for each file with findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.config import SEVERITY_LABELS
from folioscan.functions.text import human_size
from folioscan.plans import issues as views
from folioscan.plans import report
from folioscan.skew import numbered

ORDER = ["section", "part", "no", "line"]

#: Titles, heads and fixed lines of a report, in their order.
TITLE = "文档低级错误检查报告"
COVER = ["Document Quality Inspection Report", "— 本地离线检测 · 保密模式 —"]
COVER_END = ["本报告由本地离线检测工具自动生成，全过程无网络连接、无数据外发，", "所有文档内容仅在本机内存与本地磁盘处理，报告仅供内部核查使用。"]
HEADINGS = ["一、检测基本信息", "二、整体统计汇总", "三、问题类型分布", "四、分文件错误明细", "五、异常文件清单（无法解析）", "六、整改建议"]
FILE_HEAD, ISSUE_HEAD = ["文件总数", "检测通过", "存在问题", "无法解析", "通过率"], ["问题总数", "严重", "一般", "轻微", "已忽略 / 已核查"]
RULE_HEAD, BAD_HEAD, ADVICE_HEAD = ["序号", "问题类型", "出现次数", "占比"], ["序号", "文件名", "类型", "大小", "无法解析原因"], ["序号", "问题类型", "次数", "整改建议"]
COLUMNS = {"index": "序号", "location": "位置", "type": "问题类型", "severity": "级别", "detail": "问题说明 / 原文", "suggestion": "整改建议"}
NO_RULES, NO_DETAILS, NO_BAD = "本次检测未发现任何问题，无问题类型分布数据。", "所有可解析文件均未发现低级错误，无明细清单。", "本次检测所有文件均成功解析，无异常文件。"
CUT = "注：该文件问题数量已达单文件上限，仅列出前述部分，建议整改后重新检测。"
GENERAL = [
    "按「严重 → 一般 → 轻微」的顺序推进整改，严重问题应在归档前全部清零。",
    "整改应在原始文档副本上进行，保留修改痕迹与版本记录，便于复核与追溯。",
    "整改完成后使用本工具重新检测，确认问题闭环后再进入归档或报送流程。",
    "涉密文档整改全过程应在本机离线环境完成，禁止通过网络传输或外发。",
]
ADVICE = "请按规范人工复核修正。"
GRAVE, LIGHT, NONE = "本次检测发现严重级别问题，相关文档暂不具备归档 / 报送条件，请优先完成严重问题整改并重新检测。", "本次检测未发现严重级别问题，但存在一般与轻微问题，建议在正式归档 / 报送前完成规范化整理。", "本次检测未发现低级错误，文档规范性良好，具备归档 / 报送条件。"
END = ["— 报告结束 —", "生成工具：文档低级错误检查工具（本地离线版）", "保密声明：本报告及检测过程全程离线，未产生任何网络传输记录。"]


def text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def _put(rows: DataFrame, section: int, kind: str, cells: list, part: Column | int = 0, no: Column | int = 0, line: int = 0) -> DataFrame:
    """One report row for each row of a frame; cells that are text stand as they are."""
    said = F.array(*(F.lit(c) if isinstance(c, str) else c for c in cells)).cast("array<string>")
    number = lambda n: (n if isinstance(n, Column) else F.lit(n)).cast("long")
    return rows.select(F.lit(section).alias("section"), number(part).alias("part"), number(no).alias("no"), F.lit(line).alias("line"), F.lit(kind).alias("kind"), said.alias("cells"))


def _detail(columns: list[str]) -> list[Column]:
    label = F.coalesce(*(F.when(F.col("severity") == s, t) for s, t in SEVERITY_LABELS.items()), F.col("severity"))
    snippet = F.coalesce("snippet", F.lit(""))
    detail = F.concat("detail", F.when(snippet != "", F.concat(F.lit("\n原文："), snippet)).otherwise(""))
    suggestion = F.when(F.coalesce("suggestion", F.lit("")) != "", F.col("suggestion")).otherwise("—")
    cells = {"index": text("no"), "location": F.col("location"), "type": F.col("rule_title"), "severity": label, "detail": detail, "suggestion": suggestion}
    return [cells[c] for c in columns]


def _about(size: Column) -> Column:
    severe = [F.concat(F.lit(f"{SEVERITY_LABELS[s]} "), text(s)) for s in SEVERITY_LABELS]
    return F.concat(F.lit("文件类型："), "file_type", F.lit("    文件大小："), size, F.lit("    问题总数："), text("active_issue_count"), F.lit(" 处（"), F.concat_ws(" / ", *severe), F.lit("）"))


def _details(results: DataFrame, found: DataFrame, columns: list[str], part: Column, heading: Column) -> list[DataFrame]:
    """Section four for files (with the number ``part``) and their issues: heading, lines about the file, table and note."""
    live = views.file_details(found).select("doc_id", "no", "location", "rule_title", "severity", "detail", "snippet", "suggestion")
    return [
        _put(results, 4, "h2", [heading], part, 0, 0),
        _put(results, 4, "p", [_about(human_size(F.col("file_size")))], part, 0, 1),
        _put(results, 4, "head", [COLUMNS[c] for c in columns], part, 0, 2),
        _put(live.join(results.select("doc_id", part.alias("_part")), "doc_id"), 4, "row", _detail(columns), F.col("_part"), F.col("no")),
        _put(results.where("truncated"), 4, "p", [CUT], part, 1 << 40),
    ]


def rows(results: DataFrame, found: DataFrame, types: DataFrame, enabled: DataFrame, at: Column, operator: str = "", org: str = "", with_cover: bool = True, columns: list[str] | None = None) -> DataFrame:
    """section, part, no, line (their order), kind and cells of the report over all files.

    ``results`` and ``found`` are file results and issues, ``types`` and ``enabled`` as ``report.basic_info`` takes them. Sections with lists that are empty say so.
    """
    columns, operator, org = columns or list(COLUMNS), operator or "—", org or "—"
    totals = views.summary(results, found)
    one = totals.select(F.lit(0).alias("_"))  # the row that fixed lines hang on
    fixed = lambda section, kind, lines, part=0: [_put(one, section, kind, [x], part, 0, n) for n, x in enumerate(lines)]
    pairs = lambda section, frame: [_put(frame, section, "row", [F.col("key"), F.col("value")], 1, F.col("no"))]
    out = []
    if with_cover:
        out += [*fixed(0, "title", [TITLE]), *[_put(one, 0, "p", [x], 0, 0, n) for n, x in enumerate(COVER, 1)], *pairs(0, report.cover(totals, at, operator, org)), *fixed(0, "p", COVER_END, 2), *fixed(0, "page", [""], 3)]
    out += [*fixed(1, "h1", HEADINGS[:1]), *pairs(1, report.basic_info(types, enabled, at, operator, org))]

    n = {c: text(c) for c in ("total_files", "pass_files", "issue_files", "error_files", "total_issues", "high_issues", "medium_issues", "low_issues", "ignored_count", "checked_count")}
    rate = F.when(F.col("total_files") > 0, F.format_string("%.1f%%", 100 * F.col("pass_files") / F.col("total_files"))).otherwise("—")
    whole = F.concat(
        F.lit("本次共检测 "), n["total_files"], F.lit(" 个文件，其中 "), n["pass_files"], F.lit(" 个未发现低级错误，"), n["issue_files"], F.lit(" 个存在待整改问题，"), n["error_files"], F.lit(" 个无法解析；累计发现问题 "),
        n["total_issues"], F.lit(" 处（严重 "), n["high_issues"], F.lit(" 处、一般 "), n["medium_issues"], F.lit(" 处、轻微 "), n["low_issues"], F.lit(" 处）。"),
    )
    out += [*fixed(2, "h1", HEADINGS[1:2]), *fixed(2, "h2", ["2.1 文件维度统计"], 1), *[_put(one, 2, "head", FILE_HEAD, 2)], _put(totals, 2, "row", [n["total_files"], n["pass_files"], n["issue_files"], n["error_files"], rate], 3)]
    out += [*fixed(2, "h2", ["2.2 问题维度统计"], 4), _put(one, 2, "head", ISSUE_HEAD, 5), _put(totals, 2, "row", [n["total_issues"], n["high_issues"], n["medium_issues"], n["low_issues"], F.concat(n["ignored_count"], F.lit(" / "), n["checked_count"])], 6), _put(totals, 2, "p", [whole], 7)]

    by_rule, some, none = views.by_rule(found), totals.where("total_issues > 0"), totals.where("total_issues = 0")
    out += [*fixed(3, "h1", HEADINGS[2:3]), _put(none, 3, "p", [NO_RULES], 1), _put(some, 3, "head", RULE_HEAD, 1), _put(by_rule, 3, "row", [text("place"), F.col("rule_title"), text("issues"), F.format_string("%.1f%%", F.col("share"))], 2, F.col("place"))]

    hit = numbered(results.where((F.col("status") != views.ERROR) & (F.col("active_issue_count") > 0)), "k", "file_name", "doc_id")
    out += [*fixed(4, "page", [""]), *[_put(one, 4, "h1", [HEADINGS[3]], 0, 0, 1)], _put(totals.where("issue_files = 0"), 4, "p", [NO_DETAILS], 0, 1)]
    out += _details(hit, found, columns, F.col("k"), F.concat(F.lit("4."), text("k"), F.lit(" "), F.col("file_name")))

    bad = numbered(results.where(F.col("status") == views.ERROR), "k", "file_name", "doc_id")
    out += [*fixed(5, "h1", HEADINGS[4:5]), _put(totals.where("error_files = 0"), 5, "p", [NO_BAD], 1), _put(totals.where("error_files > 0"), 5, "head", BAD_HEAD, 1), _put(bad, 5, "row", [text("k"), F.col("file_name"), F.col("file_type"), human_size(F.col("file_size")), F.col("error_message")], 2, F.col("k"))]

    top = views.top_rules(found).withColumn("place", F.row_number().over(W.orderBy(F.desc("issues"), "rule_title")))  # eight rows
    verdict = F.when(F.col("high_issues") > 0, GRAVE).when(F.col("total_issues") > 0, LIGHT).otherwise(NONE)
    out += [*fixed(6, "h1", HEADINGS[5:6]), *fixed(6, "h2", ["6.1 总体整改要求"], 1), *fixed(6, "p", [f"{k}. {x}" for k, x in enumerate(GENERAL, 1)], 2), _put(some, 6, "h2", ["6.2 高频问题针对性建议"], 3), _put(some, 6, "head", ADVICE_HEAD, 4)]
    out += [_put(top, 6, "row", [text("place"), F.col("rule_title"), text("issues"), F.coalesce("suggestion", F.lit(ADVICE))], 5, F.col("place")), *fixed(6, "h2", ["6.3 结论"], 6), _put(totals, 6, "p", [verdict], 7)]
    made = F.concat(F.lit("报告生成时间："), F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    out += [_put(one, 7, "p", [END[0]], 0), _put(one, 7, "p", [made], 1), *fixed(7, "p", END[1:], 2)]
    return reduce(DataFrame.unionByName, out)


def file_rows(results: DataFrame, found: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows of one report for each file with findings, named by the file: file, and what ``rows`` has."""
    hit = results.where((F.col("status") != views.ERROR) & (F.col("active_issue_count") > 0))
    parts = reduce(DataFrame.unionByName, _details(hit, found, columns or list(COLUMNS), F.col("doc_id"), F.col("file_name")))
    names = hit.select(F.col("doc_id").alias("part"), F.concat("file_name", F.lit(".docx")).alias("file"))
    return parts.join(names, "part")
