"""A folder of files in, units, issues and file results out.

Every file is read once and parsed once: the parsed parts are written to the shared folder, all rules run over what was written, and so are their issues,
from which file results and all views of a report are plans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.config import Config
from folioscan.model import ISSUES, page_location, sheet_location, to_issues
from folioscan.operators import custom, fluency, numbering, paragraphs, tables, textnorm
from folioscan.plans import issues
from folioscan.sources import files as sources
from folioscan.sources import office, pdf
from folioscan.staging import stage


@dataclass
class CheckResult:
    units: DataFrame
    issues: DataFrame
    file_results: DataFrame


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for more in frames[1:]:
        whole = whole.unionByName(more)
    return whole


def text_issues(units: DataFrame, config: Config, rules: list[dict] | None = None, wordbank: DataFrame | None = None) -> DataFrame:
    """Findings that any text can have, in the order wording, sentences, user rules, word bank."""
    found = [to_issues(textnorm.check(units, config), 0), to_issues(fluency.check(units, config), 1)]
    if rules:
        found.append(custom.check_rules(units, rules).withColumn("ord", F.col("ord") + 200_000))
    if wordbank is not None:
        found.append(custom.check_wordbank(units, wordbank).withColumn("ord", F.col("ord") + 300_000))
    return _union(found)


def _structural(found: DataFrame, doc_type: str) -> DataFrame:
    """Findings about the order or shape of a document, behind those of its units."""
    if "unit_idx" not in found.columns:
        found = found.withColumn("unit_idx", F.lit(1 << 30))
    return to_issues(found.select("doc_id", F.lit(doc_type).alias("doc_type"), F.col("unit_idx").cast("int").alias("unit_idx"), "location", "hits"), 4)


def check_word(parts: DataFrame, config: Config) -> tuple[DataFrame, list[DataFrame]]:
    """Units of documents and their structural findings."""
    own = paragraphs.check(office.paragraphs(parts), config)
    cells = parts.where("part = 'cell'").select("doc_id", "tbl", "row", "col", "text", "header_repeat")
    cell_place = F.concat(F.lit("第 "), F.col("page").cast("string"), F.lit(" 页"), F.when(F.col("estimated"), "（估算）").otherwise(""), F.lit(" · 表 "), F.col("tbl").cast("string"), F.lit(" 第 "), F.col("row").cast("string"), F.lit(" 行第 "), F.col("col").cast("string"), F.lit(" 列"))
    units = own.select("doc_id", F.lit("word").alias("doc_type"), F.lit("paragraph").alias("unit_kind"), "unit_idx", "location", "text").unionByName(
        cells.where("trim(text) <> ''").join(paragraphs.table_pages(own, cells), ["doc_id", "tbl"]).select("doc_id", F.lit("word").alias("doc_type"), F.lit("cell").alias("unit_kind"), (F.lit(1 << 20) + F.col("tbl") * 4096 + F.col("row")).cast("int").alias("unit_idx"), cell_place.alias("location"), "text")
    )
    rows = office.paragraphs(parts)
    found = [own.select("doc_id", "unit_idx", "location", "hits"), tables.document_tables(cells, config).select("doc_id", "location", "hits")]
    gates = {"manual_number_sequence": numbering.sequences, "number_format_mixed": numbering.mixed_styles, "numbering_break": numbering.broken_lists, "blank_redundant_content": paragraphs.tail_blank}
    found += [f(rows, config) for rule, f in gates.items() if config.on(rule)]
    if config.on("image_broken"):
        found.append(office.broken_images(parts, config))
    return units, [_structural(f, "word") for f in found]


def check_excel(parts: DataFrame, config: Config) -> tuple[DataFrame, list[DataFrame]]:
    cells = parts.where("part = 'cell'")
    place = sheet_location(F.col("sheet"), F.col("row"), F.col("col"))
    units = tables.trimmed(cells).where("value_type = '文本' and text <> ''").select("doc_id", F.lit("excel").alias("doc_type"), F.lit("cell").alias("unit_kind"), (F.col("sheet_idx") * 4096 + F.col("row")).cast("int").alias("unit_idx"), place.alias("location"), F.col("value_str").alias("text"))
    sheets = parts.where("part = 'sheet'").select("doc_id", "sheet_idx", "sheet")
    padded = cells.drop("part", "ref").unionByName(sheets.select("doc_id", "sheet", "sheet_idx", F.lit(1).alias("row"), F.lit(1).alias("col"), *(F.lit(None).cast("string").alias(c) for c in ("value_str", "value_type", "number_format", "formula"))))
    merged = parts.where("part = 'merged'").select("doc_id", "sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), "ref")
    from folioscan.functions.text import column_letter

    hidden = parts.where("part in ('hidden_row', 'hidden_col')").select("doc_id", "sheet", F.regexp_replace("part", "hidden_", "").alias("kind"), F.coalesce(F.col("row").cast("string"), column_letter(F.col("col"))).alias("key"))
    found = [tables.sheet_names(sheets, config)] if config.on("sheet_name_invalid") else []
    found += [tables.sheet_cells(cells, config), tables.sheet_shape(padded, config)]
    found += [tables.mixed_columns(cells, config)] if config.on("format_chaos") else []
    found += [tables.merged_and_hidden(merged, hidden, cells, config)]
    return units, [_structural(f, "excel") for f in found]


@dataclass
class Parsed:
    """What is in a folder's files: the files and why some can't be read, parts of documents and workbooks, pages."""

    files: DataFrame
    word: DataFrame
    excel: DataFrame
    pages: DataFrame


def parse(spark: SparkSession, path: str, config: Config | None = None) -> Parsed:
    """The files of a folder, read once and staged by kind, and the parts of those that can be read, parsed once and staged."""
    found = sources.guarded(sources.list_files(spark, path), config or Config())
    held = stage(found.withColumn("content", F.when(F.col("error_message").isNull(), F.col("content"))), "files", ("file_type",)).select(*found.columns)
    return Parsed(held.drop("content"), *(stage(rows(held), name) for rows, name in ((office.word_rows, "word"), (office.excel_rows, "excel"), (pdf.page_rows, "pages"))))


def check(spark: SparkSession, path: str, config: Config | None = None, rules: list[dict] | None = None, wordbank: DataFrame | None = None) -> CheckResult:
    """Check every file of a folder. Files that can't be read have an error and no issues."""
    config = config or Config()
    parsed = parse(spark, path, config)
    files, word, excel, pages = parsed.files, parsed.word, parsed.excel, parsed.pages
    word_units, word_found = check_word(word, config)
    excel_units, excel_found = check_excel(excel, config)
    pdf_units = pages.where("text <> ''").select("doc_id", F.lit("pdf").alias("doc_type"), F.lit("page").alias("unit_kind"), F.col("page").alias("unit_idx"), page_location(F.col("page")).alias("location"), "text")
    units = _union([word_units, excel_units, pdf_units])
    notes = office.engine_notes(word).unionByName(office.engine_notes(excel, "value_str")).unionByName(pages.where("error is not null").select("doc_id", F.col("error").alias("note")))
    note_rows = notes.join(files.select("doc_id", "file_type"), "doc_id").select(
        "doc_id", F.lower("file_type").alias("doc_type"), F.lit(1 << 30).alias("unit_idx"), F.lit(0).alias("ord"), F.lit("engine_note").alias("rule_key"), F.lit("检测引擎提示").alias("rule_title"), F.lit("low").alias("severity"), F.lit("—").alias("location"), F.col("note").alias("detail"),
        *(F.lit(v).alias(k) for k, v in (("snippet", ""), ("suggestion", ""), ("state", "normal"), ("category", ""), ("source", "builtin"), ("group", ""), ("tag", ""))),
    )
    names = [x.split()[0] for x in ISSUES.split(", ")]
    found = _union([*[f.select(*names) for f in [text_issues(units, config, rules, wordbank), *word_found, *excel_found]], note_rows.select(*names)])
    scans = pdf.scanned(pages).withColumn("scan", F.lit("PDF 无文本层（疑似扫描件），无法检测"))
    listed = files.join(scans, "doc_id", "left").withColumn("error_message", F.coalesce("error_message", "scan")).drop("scan")
    kept = stage(issues.capped(found, config), "issues")
    # what a document holds: paragraphs and tables, or cells
    contents = word.where("part in ('paragraph', 'cell')").select("doc_id").union(excel.where("part = 'cell' and value_str is not null").select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("content_count"))
    return CheckResult(units, kept, issues.without_blank(issues.file_results(listed, kept, config), contents))
