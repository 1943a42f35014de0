"""Texts of parsed files for other uses: blocks for a reviewer, chunks to mine rules from, reference texts.

All start from what ``plans.check.parse`` has staged, so no file is read again; order within a document comes from windows over its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions.text import strip
from folioscan.operators.paragraphs import PAGE_LINES, line_count
from folioscan.plans.check import Parsed
from folioscan.sources import files as sources

BLOCK = ("doc_id", "seq", "location", "text")
#: The least characters of a block and of a reference text, and what is said of the latter.
LEAST_TEXT, LEAST_ROW, LEAST_REFERENCE = 4, 2, 10
TOO_SHORT = "参考资料内容过少（提取不足 10 字符），请确认文件含有效文本"


def _no(n: Column | str) -> Column:
    return (F.col(n) if isinstance(n, str) else n).cast("string")


def _line(cells: DataFrame, value: str, *row: str) -> DataFrame:
    """One text for each row of cells: those that are not blank, in order, with bars between."""
    full = cells.withColumn("_t", strip(F.coalesce(value, F.lit("")))).where("_t <> ''")
    rows = full.groupBy("doc_id", *row).agg(F.array_sort(F.collect_list(F.struct("col", "_t"))).alias("c"))  # the cells of one row of a sheet
    return rows.withColumn("text", F.array_join(F.transform("c", lambda x: x["_t"]), " | ")).where(F.length("text") >= LEAST_ROW).drop("c")


def word_blocks(parts: DataFrame) -> DataFrame:
    """(doc_id, seq, location, text): paragraphs of four characters or more, then the rows of tables."""
    paras = parts.where("part = 'paragraph'").withColumn("text", strip(F.coalesce("text", F.lit("")))).where(F.length("text") >= LEAST_TEXT)
    own = paras.select("doc_id", F.struct(F.lit(0).alias("tbl"), F.col("idx").alias("n")).alias("seq"), F.concat(F.lit("第 "), _no("idx"), F.lit(" 段")).alias("location"), "text")
    rows = _line(parts.where("part = 'cell'"), "text", "tbl", "row")
    return own.union(rows.select("doc_id", F.struct("tbl", F.col("row").alias("n")).alias("seq"), F.concat(F.lit("表 "), _no("tbl"), F.lit(" 第 "), _no("row"), F.lit(" 行")).alias("location"), "text"))


def excel_blocks(parts: DataFrame) -> DataFrame:
    """(doc_id, seq, location, text): the rows of sheets."""
    rows = _line(parts.where("part = 'cell'"), "value_str", "sheet_idx", "sheet", "row")
    return rows.select("doc_id", F.struct(F.col("sheet_idx").alias("tbl"), F.col("row").alias("n")).alias("seq"), F.concat(F.lit("「"), "sheet", F.lit("」第 "), _no("row"), F.lit(" 行")).alias("location"), "text")


def page_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, seq, location, text): pages of four characters or more."""
    rows = pages.withColumn("text", strip(F.coalesce("text", F.lit("")))).where(F.length("text") >= LEAST_TEXT)
    return rows.select("doc_id", F.struct(F.lit(0).alias("tbl"), F.col("page").alias("n")).alias("seq"), F.concat(F.lit("第 "), _no("page"), F.lit(" 页")).alias("location"), "text")


def review_blocks(parsed: Parsed) -> DataFrame:
    """What a reviewer is shown of every file: the input of ``review.chunks``."""
    return word_blocks(parsed.word).union(excel_blocks(parsed.excel)).union(page_blocks(parsed.pages))


def template_chunks(parts: DataFrame) -> DataFrame:
    """(doc, page, chunk_idx, text) of documents to mine: paragraphs that are not blank, then the cells of tables, repeats within a table left out.

    Pages are estimated by lines, as ``paragraphs.pages`` does it before the first explicit break.
    """
    rows = parts.where("part in ('paragraph', 'cell')").withColumn("text", strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    rows = rows.select(F.col("doc_id").alias("doc"), F.coalesce("tbl", F.lit(0)).alias("tbl"), F.coalesce("row", "idx").alias("row"), F.coalesce("col", F.lit(0)).alias("col"), "text")
    first = F.row_number().over(W.partitionBy("doc", "tbl", "text").orderBy("row", "col"))
    rows = rows.withColumn("_n", first).where("tbl = 0 or _n = 1")
    order = W.partitionBy("doc").orderBy("tbl", "row", "col")
    page = 1 + F.floor(F.sum(line_count(F.col("text"))).over(order.rowsBetween(W.unboundedPreceding, 0)) / PAGE_LINES)
    return rows.select("doc", page.cast("int").alias("page"), F.row_number().over(order).alias("chunk_idx"), "text")


def page_chunks(pages: DataFrame) -> DataFrame:
    """(doc, page, chunk_idx, text) of PDF pages that are not blank."""
    return pages.withColumn("text", strip(F.coalesce("text", F.lit("")))).where("text <> ''").select(F.col("doc_id").alias("doc"), "page", F.col("page").alias("chunk_idx"), "text")


def reference_texts(parsed: Parsed, plain: DataFrame) -> DataFrame:
    """(doc_id, name, text, error) of reference files: Word paragraphs and cells, PDF pages, and ``plain`` (files with their content) as UTF-8."""
    lines = parsed.word.where("part in ('paragraph', 'cell')").select("doc_id", F.struct(F.coalesce("tbl", F.lit(0)).alias("tbl"), F.coalesce("row", "idx").alias("row"), F.coalesce("col", F.lit(0)).alias("col"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    pages = parsed.pages.select("doc_id", F.struct(F.lit(0).alias("tbl"), F.col("page").alias("row"), F.lit(0).alias("col"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    whole = lines.union(pages).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n").alias("text"))  # one text a file
    own = plain.where(sources.extension(F.col("file_name")).isin("txt", "md", "csv")).select("doc_id", "file_name", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    every = parsed.files.select("doc_id", "file_name").join(whole, "doc_id").unionByName(own).withColumn("text", strip(F.col("text")))
    return every.select("doc_id", F.concat(F.regexp_replace("file_name", r"\.[^.]*$", ""), F.lit(".txt")).alias("name"), "text", F.when(F.length("text") < LEAST_REFERENCE, TOO_SHORT).alias("error"))
