"""Tables of documents and sheets of workbooks, as long frames of cells.

Document tables: doc_id, tbl, row, col, text, header_repeat. Sheets: doc_id, sheet, sheet_idx, row, col, value_str, value_type (文本, 数字, 日期,
布尔), number_format, formula. Everything is grouped by table, row or column, so one large table is spread over its rows and columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.config import Config
from folioscan.functions.text import clip, column_letter, joined, let, strip
from folioscan.model import HITS, hit, sheet_location

#: Numbers kept as text, and default sheet names.
NUMERIC_TEXT = r"^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?%?$"
DEFAULT_NAME = r"^(Sheet|sheet|工作表|表)\s*\d*$"


def _text(n: Column) -> Column:
    return n.cast("string")


def _upto(values: Column, n: int, by: str = "、") -> Column:
    return F.array_join(F.slice(values, 1, n), by)


def document_tables(cells: DataFrame, config: Config | None = None) -> DataFrame:
    """(doc_id, tbl, location, hits) of blank rows, blank columns, blank header cells and headers that do not repeat."""
    config = config or Config()
    cells = cells.withColumn("text", strip(F.coalesce("text", F.lit(""))))
    blank, name = F.col("text") == "", F.concat(F.lit("表 "), _text(F.col("tbl")))
    out = []
    if config.on("table_empty_row"):
        rows = cells.groupBy("doc_id", "tbl", "row").agg(F.every(blank).alias("all"), F.count("*").alias("n")).where("all")
        out.append(rows.select("doc_id", "tbl", F.concat(name, F.lit(" 第 "), _text(F.col("row")), F.lit(" 行")).alias("location"), F.array(hit("table_empty_row", F.col("row"), F.concat(F.lit("该行 "), _text(F.col("n")), F.lit(" 个单元格全部为空")), F.lit(""), config)).alias("hits")))
    if config.on("table_empty_col"):
        cols = cells.groupBy("doc_id", "tbl", "col").agg(F.every(blank).alias("all"), F.count("*").alias("n")).where("all")
        out.append(cols.select("doc_id", "tbl", F.concat(name, F.lit(" 第 "), _text(F.col("col")), F.lit(" 列")).alias("location"), F.array(hit("table_empty_col", F.col("col") + 100_000, F.concat(F.lit("该列 "), _text(F.col("n")), F.lit(" 个单元格全部为空")), F.lit(""), config)).alias("hits")))
    header = F.array_sort(F.collect_list(F.when(F.col("row") == 1, F.struct("col", "text"))))
    tables = cells.groupBy("doc_id", "tbl").agg(F.max("row").alias("rows"), header.alias("head"), F.max(F.coalesce("header_repeat", F.lit(False))).alias("repeats"))
    texts, empty = F.transform("head", lambda x: x["text"]), F.filter("head", lambda x: x["text"] == "")
    if config.on("table_empty_header_cell"):
        shown = F.transform(empty, lambda x: F.concat(F.lit("第 "), _text(x["col"]), F.lit(" 列")))
        some = tables.where((F.size(empty) > 0) & (F.size(empty) < F.size("head")))
        out.append(some.select("doc_id", "tbl", F.concat(name, F.lit(" 首行")).alias("location"), F.array(hit("table_empty_header_cell", 200_000, F.concat(F.lit("表头存在 "), _text(F.size(empty)), F.lit(" 个空单元格（"), _upto(shown, 6), F.lit("）")), _upto(texts, 6, " | "), config)).alias("hits")))
    if config.on("table_no_header_repeat"):
        least = int(config.param("table_no_header_repeat", "min_rows"))
        long = tables.where((F.col("rows") >= least) & ~F.col("repeats"))
        out.append(long.select("doc_id", "tbl", name.alias("location"), F.array(hit("table_no_header_repeat", 200_001, F.concat(F.lit("表格共 "), _text(F.col("rows")), F.lit(f" 行（≥{least} 行易跨页），首行未设置「标题行重复」，跨页后将无表头")), _upto(texts, 6, " | "), config)).alias("hits")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole


def trimmed(cells: DataFrame) -> DataFrame:
    """Cells with the last row of their sheet that is not blank."""
    last = F.max(F.when(F.col("text") != "", F.col("row"))).over(W.partitionBy("doc_id", "sheet_idx"))
    return _stripped(cells).withColumn("real_rows", last)


def _stripped(cells: DataFrame) -> DataFrame:
    return cells.withColumn("text", strip(F.coalesce("value_str", F.lit(""))))


def sheet_names(sheets: DataFrame, config: Config | None = None) -> DataFrame:
    """(doc_id, sheet, location, hits), names with nothing wrong having no hits; ``sheets``: doc_id, sheet_idx, sheet."""
    config = config or Config()
    illegal, default = config.param("sheet_name_invalid", "illegal_chars"), config.param("sheet_name_invalid", "flag_default_name")

    def detail(name: Column, bare: Column) -> Column:
        bad = joined([F.when(F.contains(name, F.lit(c)), F.lit(c)) for c in illegal], " ")
        problems = [
            F.when(bare == "", F.lit("名称为空或全为空白")),
            F.when(name != bare, F.lit("名称首尾存在空格")),
            let(bad, lambda b: F.when(b != "", F.concat(F.lit("含非法字符："), b))),
            F.when(F.contains(name, F.lit("\u3000")), F.lit("含全角空格")),
            F.when(bare.rlike("(?U)" + DEFAULT_NAME), F.lit("使用系统默认名称，语义不明确")) if default else F.lit(None).cast("string"),
            F.when(F.length(name) > 31, F.concat(F.lit("名称长度 "), _text(F.length(name)), F.lit(" 超过 Excel 上限 31 字符"))),
        ]
        return joined(problems, "；")

    # names are worked out once: a filter on what is said of them would go below, with a name's whole expression wherever it is used
    said = lambda name, d: F.when(d != "", F.array(hit("sheet_name_invalid", 0, d, name, config))).otherwise(F.array().cast(HITS))
    found = let(F.col("sheet"), lambda name: let(let(strip(name), lambda bare: detail(name, bare)), lambda d: said(name, d)))
    return sheets.select("doc_id", "sheet", F.concat(F.lit("工作表「"), "sheet", F.lit("」")).alias("location"), found.alias("hits"))


def numeric_text(value: Column) -> Column:
    """Text that is a number, but for codes with leading zeros and numbers of 15 digits or more."""
    plain = strip(value)
    digits = F.regexp_replace(F.translate(plain, ",%", ""), "^[+-]+", "")
    coded = F.startswith(digits, F.lit("0")) & ~digits.isin("0", "0.0") & ~F.startswith(digits, F.lit("0."))
    return plain.rlike("(?U)" + NUMERIC_TEXT) & ~coded & (F.length(F.replace(digits, F.lit("."), F.lit(""))) < 15)


def sheet_cells(cells: DataFrame, config: Config | None = None) -> DataFrame:
    """(doc_id, sheet, location, hits): error values, the forty first of each sheet, and how many cells are numbers kept as text, have spaces at their ends, or wide spaces."""
    config = config or Config()
    rows = trimmed(cells).where("text <> '' or value_str <> ''")
    place, sheet = F.concat(column_letter(F.col("col")), _text(F.col("row"))), F.concat(F.lit("工作表「"), "sheet", F.lit("」"))
    out = []

    def first(rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "sheet_idx", "sheet").orderBy("row", "col"))).where(F.col("_n") <= n)

    if config.on("formula_error"):
        wrong = first(rows.where(F.upper("text").isin([e.upper() for e in config.param("formula_error", "error_values")])), 40)
        formula = F.coalesce("formula", F.lit(""))
        detail = F.concat(F.lit("单元格计算结果为错误值 "), "text", F.when(formula != "", F.concat(F.lit("，公式："), clip(formula, 60))).otherwise(""))
        out.append(wrong.select("doc_id", "sheet", sheet_location(F.col("sheet"), F.col("row"), F.col("col")).alias("location"), F.array(hit("formula_error", F.col("_n"), detail, F.when(formula != "", formula).otherwise(F.col("text")), config)).alias("hits")))
    value, is_text = F.col("value_str"), F.col("value_type") == "文本"
    fmt = F.coalesce("number_format", F.lit(""))
    kinds = [
        ("number_stored_as_text", numeric_text(value) & ~F.coalesce(F.startswith(F.col("formula"), F.lit("=")), F.lit(False)), F.concat(place, F.lit("="), strip(value), F.lit("（格式："), F.when(fmt.isin("", "General"), "常规").otherwise(fmt), F.lit("）")), 8, "检测到 ", " 个「数字以文本形式存储」的单元格："),
        ("trailing_space_cell", value.rlike("^[ \\t\u3000\u00a0]|[ \\t\u3000\u00a0]$"), place, 10, "共 ", " 个单元格首尾含多余空格："),
        ("full_width_space_cell", F.contains(value, F.lit("\u3000")), place, 10, "共 ", " 个单元格含全角空格："),
    ]
    for n, (rule, test, said, most, lead, after) in enumerate(kinds):
        if config.on(rule):
            some = first(rows.where(is_text & test).withColumn("_said", said), 30).groupBy("doc_id", "sheet_idx", "sheet").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_said"))), lambda x: x["_said"]).alias("s"))
            detail = F.concat(F.lit(lead), _text(F.size("s")), F.lit(after), _upto(F.col("s"), most), F.when(F.size("s") > most, "…").otherwise(""))
            out.append(some.select("doc_id", "sheet", sheet.alias("location"), F.array(hit(rule, 300 + n, detail, _upto(F.col("s"), most), config)).alias("hits")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole


def sheet_shape(cells: DataFrame, config: Config | None = None) -> DataFrame:
    """(doc_id, sheet, location, hits): empty sheets; blank and repeated header cells, blank rows and blank columns of the others.

    A row without any cell in the frame counts as blank. Blank rows are what lies between rows that are not, so a sheet may have any number of them: they are
    counted, and those that are named are at most the first ten stretches.
    """
    config = config or Config()
    key, sheet = ["doc_id", "sheet_idx", "sheet"], F.concat(F.lit("工作表「"), "sheet", F.lit("」"))
    rows = _stripped(cells)
    full = rows.where(F.col("text") != "")
    heads = full.where("row = 1").withColumn("first", F.min("col").over(W.partitionBy(*key, "text"))).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("col", "text", "first"))).alias("head"))
    by_row = W.partitionBy(*key).orderBy("row")
    gaps = full.where("row >= 2").select(*key, "row").distinct().withColumn("_prev", F.lag("row", 1, 1).over(by_row)).where(F.col("row") - F.col("_prev") > 1)
    gaps = gaps.withColumn("_n", F.row_number().over(by_row)).groupBy(*key).agg(
        F.sum(F.col("row") - F.col("_prev") - 1).alias("blank"), F.array_sort(F.collect_list(F.when(F.col("_n") <= 10, F.struct(F.col("_prev").alias("lo"), F.col("row").alias("hi"))))).alias("gaps")
    )
    shape = rows.groupBy(*key).agg(F.collect_set(F.when(F.col("text") != "", F.col("col"))).alias("cols"), F.max(F.when(F.col("text") != "", F.col("row"))).alias("real_rows"))
    for more in (heads, gaps):
        more = more.withColumnsRenamed({k: f"_{k}" for k in key})
        shape = shape.join(more, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key)), "left").drop(*(f"_{k}" for k in key))
    shape = shape.withColumns({"head": F.coalesce("head", F.array().cast("array<struct<col:int,text:string,first:int>>")), "blank": F.coalesce("blank", F.lit(0)), "gaps": F.coalesce("gaps", F.array().cast("array<struct<lo:int,hi:int>>"))})
    shape = shape.withColumn("last", F.when(F.size("head") > 0, F.element_at(F.transform("head", lambda x: x["col"]), -1)).otherwise(0))
    letters = lambda cols, n, tail=" 列": _upto(F.transform(cols, lambda c: F.concat(column_letter(c), F.lit(tail))), n)
    numbers = lambda lo, hi: F.when(hi >= lo, F.sequence(F.lit(lo), hi)).otherwise(F.array().cast("array<int>"))
    spread = F.transform(numbers(1, F.least("last", F.lit(8))), lambda c: F.coalesce(F.get(F.transform(F.filter("head", lambda h: h["col"] == c), lambda h: h["text"]), 0), F.lit("")))
    title = F.concat("sheet", F.lit("!第 1 行"))
    empty_cols = F.array_except(numbers(1, F.col("last")), F.transform("head", lambda h: h["col"]))
    again = F.filter("head", lambda h: h["first"] < h["col"])
    repeats = F.transform(F.slice(again, 1, 5), lambda h: F.concat(h["text"], F.lit("（"), column_letter(h["first"]), F.lit(" 列 与 "), column_letter(h["col"]), F.lit(" 列）")))
    blank_rows = F.flatten(F.transform("gaps", lambda g: F.sequence(g["lo"] + 1, F.least(g["hi"] - 1, g["lo"] + 10))))  # ten of each stretch at most
    blank_cols = F.array_except(numbers(1, F.col("last")), F.col("cols"))
    live, headed = F.col("real_rows").isNotNull(), F.col("last") > 1
    rules = [
        ("empty_sheet", ~live, sheet, F.lit("工作表无任何有效内容（全部单元格为空），属冗余空白表"), F.lit("")),
        ("empty_header_cell", headed & (F.size(empty_cols) > 0), title, F.concat(F.lit("表头存在 "), _text(F.size(empty_cols)), F.lit(" 个空单元格（"), letters(empty_cols, 8), F.lit("）")), _upto(spread, 8, " | ")),
        ("duplicate_header", headed & (F.size(again) > 0), title, F.concat(F.lit("表头存在 "), _text(F.size(again)), F.lit(" 组重复字段："), _upto(repeats, 5, "；")), _upto(spread, 8, " | ")),
        ("empty_row", live & (F.col("blank") > 0), sheet, F.concat(F.lit("数据区域中存在整行空白："), _upto(F.transform(blank_rows, lambda r: F.concat(F.lit("第 "), _text(r), F.lit(" 行"))), 10), F.when(F.col("blank") > 10, F.concat(F.lit(" 等共 "), _text(F.col("blank")), F.lit(" 行"))).otherwise(""), F.lit("，会打断数据连续性")), F.lit("")),
        ("empty_col", headed & (F.size(blank_cols) > 0), sheet, F.concat(F.lit("数据区域中存在整列空白："), letters(blank_cols, 10), F.lit("（共 "), _text(F.size(blank_cols)), F.lit(" 列）")), F.lit("")),
    ]
    found = [F.when(test, F.struct(where.alias("location"), F.array(hit(rule, 100 + n, detail, snippet, config)).alias("hits"))) for n, (rule, test, where, detail, snippet) in enumerate(rules) if config.on(rule)]
    return shape.select("doc_id", "sheet", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def mixed_columns(cells: DataFrame, config: Config | None = None, scan_rows: int = 500) -> DataFrame:
    """(doc_id, sheet, location, hits): columns that mix text with other types, or else have three number formats or more; names in alphabetical order."""
    config = config or Config()
    rows = trimmed(cells).where((F.col("real_rows") >= 3) & F.col("row").between(2, scan_rows) & (F.col("text") != "") & (F.col("row") <= F.col("real_rows")))
    rows = rows.where(~F.coalesce(F.startswith(F.col("formula"), F.lit("=")), F.lit(False)))
    key = ["doc_id", "sheet_idx", "sheet", "col"]
    counts = rows.groupBy(*key, F.col("value_type").alias("t"), F.coalesce("number_format", F.lit("General")).alias("f")).agg(F.count("*").alias("n"))
    types = counts.groupBy(*key, "t").agg(F.sum("n").alias("n"))
    types = types.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("types"), F.sum("n").alias("samples"))
    formats = counts.groupBy(*key, "f").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("f", "n"))).alias("formats"))
    both = types.join(formats, key).where(F.col("samples") >= int(config.param("format_chaos", "min_samples")))
    mixed = F.exists("types", lambda x: x["t"] == "文本") & (F.size("types") >= 2)
    told = F.when(mixed, F.concat(F.lit("该列数据类型混排（"), F.array_join(F.transform("types", lambda x: F.concat(x["t"], F.lit(" "), _text(x["n"]), F.lit(" 个"))), "、"), F.lit("），统计与排序易出错"))).when(
        F.size("formats") >= 3, F.concat(F.lit("该列存在 "), _text(F.size("formats")), F.lit(" 种不同的单元格数字格式："), _upto(F.transform("formats", lambda x: F.concat(x["f"], F.lit("("), _text(x["n"]), F.lit(")"))), 4))
    )
    place = F.concat("sheet", F.lit("!"), column_letter(F.col("col")), F.lit(" 列"))
    return both.withColumn("detail", told).where("detail is not null").select("doc_id", "sheet", place.alias("location"), F.array(hit("format_chaos", F.col("col") + 400, F.col("detail"), F.lit(""), config)).alias("hits"))


def merged_and_hidden(merged: DataFrame, hidden: DataFrame, cells: DataFrame, config: Config | None = None) -> DataFrame:
    """(doc_id, sheet, location, hits) of merged ranges and of hidden rows and columns. merged: doc_id, sheet, min_row, min_col, ref; hidden: doc_id, sheet, kind (row or col), key."""
    config = config or Config()
    corner = cells.where("trim(value_str) <> ''").select("doc_id", "sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.lit(True).alias("full"))
    ranges = merged.join(corner, ["doc_id", "sheet", "min_row", "min_col"], "left").withColumn("kind", F.when(F.col("full").isNull(), 0).when(F.col("min_row") > 1, 1)).where("kind is not null")
    refs = ranges.groupBy("doc_id", "sheet", "kind").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    n, tail = _text(F.size("refs")), F.concat(_upto(F.col("refs"), 8), F.when(F.size("refs") > 8, "…").otherwise(""))
    said = F.when(F.col("kind") == 0, F.concat(F.lit("存在 "), n, F.lit(" 处内容为空的合并单元格："), tail)).otherwise(F.concat(F.lit("数据区域内存在 "), n, F.lit(" 处合并单元格，将影响排序、筛选与公式引用："), tail))
    sheet = F.concat(F.lit("工作表「"), "sheet", F.lit("」")).alias("location")
    one = refs.select("doc_id", "sheet", sheet, F.array(hit("redundant_merged_cells", F.col("kind") + 700, said, F.lit(""), config)).alias("hits"))
    keys = hidden.groupBy("doc_id", "sheet").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "row", F.col("key").cast("int")))).alias("r"), F.array_sort(F.collect_list(F.when(F.col("kind") == "col", F.col("key")))).alias("c"))
    part = lambda c, name: F.when(F.size(c) > 0, F.concat(F.lit(f"隐藏{name} "), _text(F.size(c)), F.lit(" 个（"), _upto(F.transform(c, lambda x: x.cast("string")), 8), F.lit("）")))
    two = keys.select("doc_id", "sheet", sheet, F.array(hit("hidden_row_col", 710, F.concat(F.lit("存在被隐藏的行列："), joined([part("r", "行"), part("c", "列")], "；")), F.lit(""), config)).alias("hits"))
    return one.union(two) if config.on("redundant_merged_cells") and config.on("hidden_row_col") else one if config.on("redundant_merged_cells") else two


def formula_count(cells: DataFrame) -> DataFrame:
    """(doc_id, formulas): cells that hold a formula; documents without one have 0."""
    return cells.groupBy("doc_id").agg(F.count_if(F.startswith(F.coalesce("formula", F.lit("")), F.lit("="))).alias("formulas"))
