"""Sheets of any length, and names that are worked out once."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscan.model import told
from folioscan.operators import tables


def _sheet(spark, rows: int, blank: set[int]):
    cells = spark.range(1, rows + 1).select(F.lit(1).cast("long").alias("doc_id"), F.lit("s").alias("sheet"), F.lit(1).alias("sheet_idx"), F.col("id").cast("int").alias("row"), F.lit(1).alias("col"), F.when(F.col("id").isin(blank), " ").otherwise("x").alias("value_str"))
    return cells.withColumns({"value_type": F.lit("文本"), "number_format": F.lit("General"), "formula": F.lit(None).cast("string")})


def test_blank_rows_are_found_behind_any_number_of_rows(spark):
    found = told(tables.sheet_shape(_sheet(spark, 3400, {5, 6, 3100, *range(3200, 3212)})), "doc_id").where("rule_key = 'empty_row'").collect()
    named = [5, 6, 3100, *range(3200, 3207)]
    assert [r.detail for r in found] == ["数据区域中存在整行空白：" + "、".join(f"第 {n} 行" for n in named) + " 等共 15 行，会打断数据连续性"]


def test_rows_without_cells_are_blank_and_blank_ends_are_not(spark):
    cells = _sheet(spark, 40, {38, 39, 40}).where("row not between 10 and 12")
    found = told(tables.sheet_shape(cells), "doc_id").where("rule_key = 'empty_row'").collect()
    assert [r.detail for r in found] == ["数据区域中存在整行空白：第 10 行、第 11 行、第 12 行，会打断数据连续性"]


def test_errors_far_down_are_found(spark):
    cells = _sheet(spark, 3100, set()).withColumn("value_str", F.when(F.col("row") == 3050, "#DIV/0!").otherwise("x"))
    assert told(tables.sheet_cells(cells), "doc_id").where("rule_key = 'formula_error'").count() == 1


def test_a_sheets_name_is_worked_out_once(spark):
    name = F.concat(F.lit("marked/"), F.col("id").cast("string"))
    named = told(tables.sheet_names(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(1).alias("sheet_idx"), name.alias("sheet"))), "doc_id").select("doc_id", "detail")
    assert {r.detail for r in named.collect()} == {"含非法字符：/"}
    assert named._jdf.queryExecution().optimizedPlan().toString().count("marked/") <= 2
