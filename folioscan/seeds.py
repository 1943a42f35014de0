"""Inputs of the registered queries: paragraphs of ``documents``, the same with planted findings, and tables as sheets; each also as SQL.

What is planted depends on ids alone, so Spark and SQL plant the same. Every row of every table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import lexicon

#: Sentences that the pattern banks are meant to find, and some that they are not.
SENTENCES = [
    " 数据的的来源非常非常多。根据调查结果显示，该项通过审查使其合规。", "只要努力才能成功；只有认真就可以。不但没有减少反而增加。", "虽然有难度而且时间紧。因为下雨因此延期。", " you was late and he are here, she am ok. They is away.", " I is fine; we is done. Is you there? Was we right? Has they gone?",
    " are he and have she. He should has gone; they have went. He teached and goed. It is more better.", " a apple and an book, a university, an hour, a unique idea.", " I don't have any no money. between you and I. according with it, depend of it, consist with it, based of it.",
    "改善生活水平，加大管理水平，提高工作力度，扩大宣传力度，发挥技术水平，增强影响范围。", "因为天气的原因延期，由于设备的原因停工。原因是由于疏忽。多次反复，再次重复，可以能够。", " irregardless of it, despite of it, could of been, comprised of parts. the fact that very unique anyways. regardless if each people.",
    " fewer money and less people.", "采用现金流折现法与收益现值法，评估基准日期由委托方确认，股东权益总价值。", " 共 5 KM，重 3kg，高 20 cm，宽 7 mm，容积 2 L，功率 9 W，电压 5 V，占 30 %。合同价100万元，另付30元。", "总额2亿元，其中500万元。", " ABC 与 API、XYZQ 及 ABC。NASA/GDP;",
    "因为项目延期了。由于资金不足。如果条件允许。虽然困难较大。即使时间紧张。", "然而但是。但是了吗！因此需要调整。通过市场调查。在实际工作中。对相关问题分析。", "而且价格合理不仅如此。不是质量问题而且服务。不但完成任务但是超支。再进行总结先汇报。", "为了提高质量为了降本。特别是北京特别是上海。重点工作是重点。进一步加强并进一步落实。必须完成必须按时。",
    "既要发展而且要稳定。尽管下雨而且刮风。即使失败但是努力。无论何时就可以。", "原因是由于管理不善。是因为天气的原因。为了发展的目的。由于失误所致。通过改革从而提升。", "，，中文,标点!!混用(测试)。。结束", "（未配对【括号", "“引号不配对”“", "　中间　全角　", "  行尾空格  ", "含 不换行​零宽", "连续   多个空格",
]


def planted() -> list[str]:
    """What is put behind paragraphs, one after the other: every entry of the literal banks, six at a time, then the sentences, and often nothing."""
    words = [p for bank in ("colloquial", "redundant", "ambiguous", "typo", "en_typo") for p, _ in lexicon.pairs(bank)] + [w for a, b, _ in lexicon.confusables() for w in (a, b)] + [a for a, _ in lexicon.abbreviations()[0]]
    groups = [" " + " ，".join(words[i : i + 6]) + " 。" for i in range(0, len(words), 6)]
    out = []
    for s in groups + SENTENCES:
        out += [s, ""]
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PARAGRAPHS_SQL = "paras AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS unit_idx, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"
SEEDED_SQL = PARAGRAPHS_SQL.replace("paras AS", "plain AS") + f", paras AS (SELECT doc_id, unit_idx, text || list_extract([{', '.join(map(quoted, planted()))}], CAST((doc_id * 7 + unit_idx) % {len(planted())} + 1 AS BIGINT)) AS text FROM plain)"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, doc_type, unit_kind, unit_idx (from 1), location, text: the lines of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return rows.select("doc_id", F.lit("word").alias("doc_type"), F.lit("paragraph").alias("unit_kind"), (F.col("n") + 1).alias("unit_idx"), F.concat(F.lit("第 "), (F.col("n") + 1).cast("string"), F.lit(" 段")).alias("location"), "text")


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs with what is planted behind them."""
    more = planted()
    return paragraphs(spark, sf_dir).withColumn("text", F.concat("text", F.get(F.array(*map(F.lit, more)), F.pmod(F.col("doc_id") * 7 + F.col("unit_idx"), F.lit(len(more))).cast("int"))))


#: Numbers typed before paragraphs, blank paragraphs and wide indents, for the rules on order.
NUMBERED_SQL = PARAGRAPHS_SQL.replace("paras AS", "plain AS") + """, paras AS (SELECT doc_id, unit_idx, CASE
  WHEN (doc_id + unit_idx) % 5 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN '   ' ELSE '' END
  WHEN (doc_id + unit_idx) % 5 = 1 THEN CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END
  WHEN unit_idx % 3 = 0 THEN (unit_idx // 3 + CASE WHEN doc_id % 4 = 1 THEN unit_idx % 2 ELSE 0 END) || CASE WHEN doc_id % 7 = 2 AND unit_idx > 5 THEN '、' ELSE '. ' END || text
  WHEN unit_idx % 3 = 1 AND doc_id % 2 = 0 THEN list_extract(['一', '二', '三', '五', '十', '十二', '二十三'], CAST(unit_idx // 3 % 7 + 1 AS BIGINT)) || '、' || text
  ELSE text END AS text FROM plain)"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs with blank ones and typed numbers among them."""
    d, i, text = F.col("doc_id"), F.col("unit_idx"), F.col("text")
    third = F.floor(i / 3).cast("int")
    arabic = F.concat((third + F.when(d % 4 == 1, i % 2).otherwise(0)).cast("string"), F.when((d % 7 == 2) & (i > 5), "、").otherwise(". "), text)
    chinese = F.concat(F.get(F.array(*map(F.lit, ["一", "二", "三", "五", "十", "十二", "二十三"])), third % 7), F.lit("、"), text)
    value = F.when((d + i) % 5 == 0, F.when(d % 3 == 0, "   ").otherwise("")).when((d + i) % 5 == 1, F.when(d % 3 == 0, "").otherwise(text)).when(i % 3 == 0, arabic).when((i % 3 == 1) & (d % 2 == 0), chinese).otherwise(text)
    return paragraphs(spark, sf_dir).withColumn("text", value)


CELLS_SQL = """base AS (SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS r, c_custkey AS k, c_name, c_acctbal, c_mktsegment FROM customer),
cells AS (
  SELECT doc_id, 1 AS row, unnest([1, 2, 3, 4, 5, 6]) AS col, unnest(['编号', '名称', '', '余额', '名称', '备注']) AS value_str, '文本' AS value_type, 'General' AS number_format FROM (SELECT DISTINCT doc_id FROM base)
  UNION ALL SELECT doc_id, r, 1, CASE WHEN k % 13 = 0 THEN '' ELSE CAST(k AS VARCHAR) END, '数字', CASE WHEN k % 3 = 0 THEN '0' WHEN k % 3 = 1 THEN '0.0' ELSE 'General' END FROM base
  UNION ALL SELECT doc_id, r, 2, CASE WHEN k % 13 = 0 THEN '' WHEN k % 7 = 0 THEN c_name || ' ' WHEN k % 11 = 0 THEN '　' || c_name ELSE c_name END, '文本', 'General' FROM base
  UNION ALL SELECT doc_id, r, 3, '', '文本', 'General' FROM base
  UNION ALL SELECT doc_id, r, 4, CASE WHEN k % 13 = 0 THEN '' WHEN k % 5 = 0 THEN '1,' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') WHEN k % 17 = 0 THEN '#DIV/0!' WHEN k % 19 = 0 THEN '0' || k ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END, CASE WHEN k % 5 = 0 OR k % 17 = 0 OR k % 19 = 0 THEN '文本' ELSE '数字' END, 'General' FROM base
  UNION ALL SELECT doc_id, r, 5, CASE WHEN k % 13 = 0 THEN ' ' ELSE c_mktsegment END, '文本', 'General' FROM base)"""


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as one sheet per nation, with findings planted: doc_id, sheet, sheet_idx, row, col, value_str, value_type, number_format, formula."""
    from pyspark.sql import Window as W

    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    c = c.withColumn("row", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) + 1)
    k, none = F.col("c_custkey"), F.col("c_custkey") % 13 == 0
    cell = lambda col, value, kind, fmt: F.struct(F.lit(col).alias("col"), value.alias("value_str"), kind.alias("value_type"), fmt.alias("number_format"))
    text, number, general = F.lit("文本"), F.lit("数字"), F.lit("General")
    money = F.when(none, "").when(k % 5 == 0, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 17 == 0, "#DIV/0!").when(k % 19 == 0, F.concat(F.lit("0"), k.cast("string"))).otherwise(F.floor("c_acctbal").cast("string"))
    body = F.array(
        cell(1, F.when(none, "").otherwise(k.cast("string")), number, F.when(k % 3 == 0, "0").when(k % 3 == 1, "0.0").otherwise("General")),
        cell(2, F.when(none, "").when(k % 7 == 0, F.concat("c_name", F.lit(" "))).when(k % 11 == 0, F.concat(F.lit("　"), "c_name")).otherwise(F.col("c_name")), text, general),
        cell(3, F.lit(""), text, general), cell(4, money, F.when((k % 5 == 0) | (k % 17 == 0) | (k % 19 == 0), "文本").otherwise("数字"), general), cell(5, F.when(none, " ").otherwise(F.col("c_mktsegment")), text, general),
    )
    head = F.array(*(cell(n, F.lit(t), text, general) for n, t in enumerate(["编号", "名称", "", "余额", "名称", "备注"], 1)))
    doc = F.col("c_nationkey").cast("long").alias("doc_id")
    rows = c.select(doc, "row", F.inline(body)).unionByName(c.select(doc).distinct().select("doc_id", F.lit(1).alias("row"), F.inline(head)))
    return rows.select("doc_id", F.concat(F.lit("国"), F.col("doc_id").cast("string")).alias("sheet"), F.lit(1).alias("sheet_idx"), "row", "col", "value_str", "value_type", "number_format", F.lit(None).cast("string").alias("formula"))
