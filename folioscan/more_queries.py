"""More registered queries of the document rules: pages and headings, sheets, hygiene of rules, mining, report views, answers, texts for a reviewer.

Registered by ``folioscan.queries``, which imports this module last.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import seeds
from folioscan.config import RULES, Config
from folioscan.functions.text import visualize
from folioscan.model import told
from folioscan.operators import paragraphs, tables
from folioscan.plans import extract, issues, mine, review, rules
from folioscan.queries import _ISSUES_SQL, _RULES_SQL, _chunks, _files, _issues, _rules, only, query, rows_sql
from folioscan.seeds import CELLS_SQL, NUMBERED_SQL, PARAGRAPHS_SQL, SEEDED_SQL, quoted

# E: pages and headings -------------------------------------------------------------------------------------------------------------------

_BREAKS_SQL = f"""{NUMBERED_SQL}, marked AS (SELECT *, unit_idx % 17 = 0 AS br_page, unit_idx % 11 = 0 AND doc_id % 2 = 0 AS br_last,
  1 + length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 THEN (length(text) - 1) // 36 ELSE 0 END AS n FROM paras),
broken AS (SELECT *, bool_or(br_page OR br_last) OVER w AS b FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY unit_idx ROWS UNBOUNDED PRECEDING)),
turned AS (SELECT *, b AND NOT coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY unit_idx), false) AS f FROM broken)"""


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    rows, i = seeds.numbered(spark, sf), F.col("unit_idx")
    style = F.when(i % 9 == 0, "Heading 2").when(i % 13 == 0, "标题 1")
    return rows.withColumns({"br_page": i % 17 == 0, "br_last_rendered": (i % 11 == 0) & (F.col("doc_id") % 2 == 0), "style": style, "br_count": (i % 6).cast("int")})


@query(f"""WITH {_BREAKS_SQL} SELECT doc_id, unit_idx, CAST(1 + sum(CASE WHEN b THEN 0 ELSE n END) OVER w // 38 + sum(CASE WHEN f OR b AND br_page THEN 1 ELSE 0 END) OVER w AS INT) AS page, NOT b AS estimated
FROM turned WINDOW w AS (PARTITION BY doc_id ORDER BY unit_idx ROWS UNBOUNDED PRECEDING)""")
def e_page_breaks(spark, sf):
    return paragraphs.pages(paragraphs.complete(_broken(spark, sf))).select("doc_id", "unit_idx", "page", "estimated")


@query(f"""WITH {NUMBERED_SQL}, p AS (SELECT *, CASE WHEN unit_idx % 9 = 0 THEN 'Heading 2' WHEN unit_idx % 13 = 0 THEN '标题 1' END AS style, unit_idx % 6 AS k, trim(text) = '' AS blank FROM paras)
SELECT doc_id, unit_idx, 'empty_heading' AS rule_key, '标题样式「' || style || '」段落内容为空' AS detail FROM p WHERE blank AND style IS NOT NULL
UNION ALL SELECT doc_id, unit_idx, 'manual_line_break', '同一段落内含 ' || k || ' 个手动换行符（阈值 3）' FROM p WHERE NOT blank AND k > 3""")
def e_headings_and_line_breaks(spark, sf):
    return told(paragraphs.check(_broken(spark, sf), only("empty_heading", "manual_line_break")), "doc_id", "unit_idx").select("doc_id", "unit_idx", "rule_key", "detail")


@query(f"WITH {SEEDED_SQL} SELECT doc_id, unit_idx, replace(replace(replace(text, chr(12288), '␣(全角空格)'), chr(160), '␣(不换行空格)'), chr(8203), '·(零宽空格)') AS shown FROM paras WHERE contains(text, chr(12288)) OR contains(text, chr(160)) OR contains(text, chr(8203))")
def b_visible_marks(spark, sf):
    rows, text = seeds.seeded(spark, sf), F.col("text")
    return rows.where(F.contains(text, F.lit("　")) | F.contains(text, F.lit(" ")) | F.contains(text, F.lit("​"))).select("doc_id", "unit_idx", visualize(text).alias("shown"))


# G: sheets --------------------------------------------------------------------------------------------------------------------------------

_NAMES = ["{n}", "Sheet{k}", " {n}", "{n}/{k}", "{n}　表", "工作表{k}", "  ", "{n}" + "年度报告汇总" * 5]


def _named(k: Column, n: Column) -> Column:
    parts = lambda t: [n if p == "{n}" else k.cast("string") if p == "{k}" else F.lit(p) for p in re.split(r"(\{[nk]\})", t) if p]
    turn, name = F.pmod(k, F.lit(len(_NAMES))), F.lit(None).cast("string")
    for i, t in reversed(list(enumerate(_NAMES))):
        name = F.when(turn == i, F.concat(*parts(t))).otherwise(name)
    return name


_NAMED_SQL = "CASE p_partkey % " + str(len(_NAMES)) + " " + " ".join(f"WHEN {i} THEN {' || '.join(filter(None, [quoted(t).replace('{n}', chr(39) + ' || p_brand || ' + chr(39)).replace('{k}', chr(39) + ' || p_partkey || ' + chr(39))]))}" for i, t in enumerate(_NAMES)) + " END"


@query(f"""WITH s AS (SELECT p_partkey AS doc_id, {_NAMED_SQL} AS sheet FROM part), t AS (SELECT *, regexp_replace(sheet, '^[\\s\\x{{3000}}\\x{{a0}}]+|[\\s\\x{{3000}}\\x{{a0}}]+$', '', 'g') AS bare FROM s),
d AS (SELECT doc_id, concat_ws('；', CASE WHEN bare = '' THEN '名称为空或全为空白' END, CASE WHEN sheet <> bare THEN '名称首尾存在空格' END, CASE WHEN contains(sheet, '/') THEN '含非法字符：/' END, CASE WHEN contains(sheet, chr(12288)) THEN '含全角空格' END,
  CASE WHEN regexp_matches(bare, '^(Sheet|工作表)\\d+$') THEN '使用系统默认名称，语义不明确' END, CASE WHEN length(sheet) > 31 THEN '名称长度 ' || length(sheet) || ' 超过 Excel 上限 31 字符' END) AS detail FROM t)
SELECT doc_id, detail FROM d WHERE detail <> ''""")
def g_sheet_names(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    sheets = p.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("sheet_idx"), _named(F.col("p_partkey"), F.col("p_brand")).alias("sheet"))
    return told(tables.sheet_names(sheets), "doc_id").select("doc_id", "detail")


_MERGED_SQL = f"""WITH {CELLS_SQL}, held AS (SELECT doc_id, row, col FROM cells WHERE trim(replace(value_str, '　', ' ')) <> '' AND row > 0),
m AS (SELECT DISTINCT doc_id, row AS r, col AS c, chr(CAST(64 + col AS INT)) || row || ':' || chr(CAST(65 + col AS INT)) || row AS ref FROM cells WHERE row % 7 = 1 AND col IN (2, 3)),
k AS (SELECT m.doc_id, ref, CASE WHEN held.doc_id IS NULL THEN 0 WHEN r > 1 THEN 1 END AS kind FROM m LEFT JOIN held ON held.doc_id = m.doc_id AND held.row = r AND held.col = c)"""


@query(f"""{_MERGED_SQL}, l AS (SELECT doc_id, kind, list_sort(list(ref)) AS refs FROM k WHERE kind IS NOT NULL GROUP BY ALL)
SELECT doc_id, 'redundant_merged_cells' AS rule_key, CASE kind WHEN 0 THEN '存在 ' || len(refs) || ' 处内容为空的合并单元格：' ELSE '数据区域内存在 ' || len(refs) || ' 处合并单元格，将影响排序、筛选与公式引用：' END || array_to_string(refs[1:8], '、') || CASE WHEN len(refs) > 8 THEN '…' ELSE '' END AS detail FROM l
UNION ALL SELECT doc_id, 'hidden_row_col', '存在被隐藏的行列：隐藏行 ' || len(rs) || ' 个（' || array_to_string(list_sort(rs)[1:8], '、') || '）；隐藏列 1 个（C）' FROM (SELECT doc_id, list(DISTINCT row) AS rs FROM cells WHERE row % 10 = 2 GROUP BY doc_id)""")
def g_merged_and_hidden(spark, sf):
    cells = seeds.sheet_cells(spark, sf)
    letter = lambda c: F.char(F.lit(64) + c)
    merged = cells.where("row % 7 = 1 and col in (2, 3)").select("doc_id", "sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.concat(letter(F.col("col")), F.col("row").cast("string"), F.lit(":"), letter(F.col("col") + 1), F.col("row").cast("string")).alias("ref")).distinct()
    hidden = cells.where("row % 10 = 2").select("doc_id", "sheet", F.lit("row").alias("kind"), F.col("row").cast("string").alias("key")).distinct()
    hidden = hidden.union(cells.select("doc_id", "sheet", F.lit("col"), F.lit("C")).distinct())
    return told(tables.merged_and_hidden(merged, hidden, cells), "doc_id").select("doc_id", "rule_key", "detail")


@query("SELECT c_nationkey AS doc_id, count(*) FILTER (c_custkey % 5 = 0) AS formulas FROM customer GROUP BY 1")
def g_formulas(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    cells = c.select(F.col("c_nationkey").alias("doc_id"), F.lit(2).alias("row"), F.lit(1).alias("col"), F.when(F.col("c_custkey") % 5 == 0, "=A1+1").when(F.col("c_custkey") % 7 == 0, "A1").alias("formula"))
    return tables.formula_count(cells)


# H: batches of rules, mining ---------------------------------------------------------------------------------------------------------------

_BAD = "CASE WHEN p = '' THEN 1 WHEN s = '' THEN 2 WHEN p = s THEN 3 WHEN p = '的' THEN 4 WHEN mode = 'regex' AND p = '(' THEN 5 END"


@query(f"""WITH {_RULES_SQL}, e AS (SELECT *, CASE WHEN k % 9 = 0 THEN NULL ELSE {_BAD} END AS bad FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY coalesce(mode, ''), p, bad IS NULL ORDER BY k) AS i FROM e) SELECT CAST(k AS VARCHAR) AS entity_id, bad IS NULL AND i = 1 AS kept FROM n""")
def h_filtered_batch(spark, sf):
    items = _rules(spark, sf)
    none = items.where("false").select(F.lit("pattern").alias("kind"), F.lit("").alias("match_mode"), F.lit("").alias("value"))
    known = items.where("ord % 9 = 0").select("entity_id")
    return rules.filter_batch(items, none, known, dedup=True).select("entity_id", "kept")


@query(f"""WITH {_RULES_SQL}, e AS (SELECT *, CASE WHEN p = '' OR s = '' OR p = s OR p = '的' OR mode = 'regex' AND p = '(' OR coalesce(mode, '') <> 'regex' AND p IN (SELECT s FROM r WHERE s <> '') THEN 1 END AS bad FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN mode = 'regex' THEN 'regex' ELSE 'keyword' END, p, bad IS NULL ORDER BY CASE WHEN source = 'rule' THEN 0 ELSE 1 END, k) AS i FROM e)
SELECT source, CAST(k AS VARCHAR) AS entity_id FROM n WHERE NOT ((bad IS NOT NULL OR i > 1) AND k % 3 = 0)""")
def h_cleaned(spark, sf):
    items = _rules(spark, sf)
    scanned = rules.scan(items, rules.bank_lines(spark))
    return rules.clean(items, scanned, items.where("ord % 3 = 0").select("entity_id")).select("source", "entity_id")


_ON = Config(disabled={"tn_typo", "multi_space", "fl_logic"})


@query(f"""WITH {_ISSUES_SQL}, r AS (SELECT * FROM {rows_sql([(r.key, r.section, int(_ON.on(r.key))) for r in RULES.values()], 'rule_key, section, live')}), hit AS (SELECT rule_key, count(*) AS n FROM issues GROUP BY 1)
SELECT section, sum(live)::BIGINT AS enabled, count(*) AS total, count(n) AS hit, count(n) FILTER (live = 1) AS enabled_hit, coalesce(sum(n), 0)::BIGINT AS issues FROM r LEFT JOIN hit USING (rule_key) GROUP BY section""")
def i_enabled_rules(spark, sf):
    """Rules by section, those that are switched on, and those that found something in the documents."""
    return rules.hits_by_section(_issues(spark, sf), _ON)


_PLANT = ["不得擅自变更 合同条款，违者", "严禁泄露客户信息。", "应当按照准则执行全部评估程序。", "没有", "必须依据合同约定履行各项义务；遵循独立原则"]
_PLANTED_SQL = f"{PARAGRAPHS_SQL}, said AS (SELECT doc_id, unit_idx, list_extract([{', '.join(map(quoted, _PLANT))}], CAST((doc_id + unit_idx) % {len(_PLANT)} + 1 AS BIGINT)) || '第' || doc_id % 30 || '号' AS text FROM paras)"


def _said(spark: SparkSession, sf: str) -> DataFrame:
    d, i = F.col("doc_id"), F.col("unit_idx")
    text = F.concat(F.get(F.array(*map(F.lit, _PLANT)), F.pmod(d + i, F.lit(len(_PLANT))).cast("int")), F.lit("第"), (d % 30).cast("string"), F.lit("号"))
    return seeds.paragraphs(spark, sf).select(d.alias("doc"), F.lit(1).alias("page"), i.alias("chunk_idx"), text.alias("text"))


_SENTS = "SELECT doc_id, unit_idx, unnest(s) AS sent, unnest(range(len(s))) AS n FROM (SELECT doc_id, unit_idx, list_filter(list_transform(regexp_split_to_array(text, '[。！？；\\n\\r]+'), lambda x: regexp_replace(trim(x), '[　 ]+', '', 'g')), lambda x: length(x) BETWEEN 4 AND 80) AS s FROM said)"


@query(f"""WITH {_PLANTED_SQL}, z AS ({_SENTS}), f AS (SELECT *, regexp_extract(sent, '(?:不得|严禁|禁止|不应|不能)\\s*([^，。；,!！?？、\\n]{{2,16}})', 1) AS phrase FROM z),
o AS (SELECT phrase, doc_id AS doc, unit_idx, n FROM f WHERE length(phrase) >= 2 QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY doc_id, unit_idx, n) = 1) SELECT phrase, doc FROM o ORDER BY doc, unit_idx, n LIMIT 200""")
def h_forbidden(spark, sf):
    return mine.forbidden(_said(spark, sf)).select("phrase", "doc")


@query(f"""WITH {_PLANTED_SQL}, z AS ({_SENTS}), f AS (SELECT * FROM z WHERE length(sent) BETWEEN 8 AND 60 AND regexp_matches(sent, '应当|必须|应|按照|依据|根据|遵循')),
o AS (SELECT sent AS sentence, doc_id AS doc, unit_idx, n FROM f QUALIFY row_number() OVER (PARTITION BY sent ORDER BY doc_id, unit_idx, n) = 1) SELECT sentence, doc FROM o ORDER BY doc, unit_idx, n LIMIT 60""")
def h_references(spark, sf):
    return mine.references(_said(spark, sf)).select("sentence", "doc")


# I: views of a report -----------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_ISSUES_SQL} SELECT doc_id, unit_idx, severity, state FROM issues WHERE severity = 'high' AND state = 'normal'")
def i_filtered(spark, sf):
    return issues.filtered(_issues(spark, sf), "high", "normal").select("doc_id", "unit_idx", "severity", "state")


@query(f"WITH {_ISSUES_SQL} SELECT doc_id, count(*) AS issues, max(n) AS last FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY unit_idx) AS n FROM issues WHERE state <> 'ignored') GROUP BY doc_id")
def i_file_details(spark, sf):
    return issues.file_details(_issues(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("issues"), F.max("no").cast("long").alias("last"))


@query(f"WITH {_ISSUES_SQL} SELECT row_number() OVER (ORDER BY 'f' || doc_id, doc_id) AS no, 'f' || doc_id AS file_name, file_type, 'bad' AS error_message FROM per WHERE bad")
def i_unreadable(spark, sf):
    return issues.unreadable(issues.file_results(_files(spark, sf), _issues(spark, sf))).withColumn("no", F.col("no").cast("long"))


@query(f"WITH {_ISSUES_SQL} SELECT rule_key, count(*) AS issues, count(DISTINCT doc_id) AS files FROM issues WHERE starts_with(rule_key, 'fl_') GROUP BY 1")
def i_report_mode(spark, sf):
    _, own = issues.report_mode(issues.file_results(_files(spark, sf), _issues(spark, sf)), _issues(spark, sf), "fluency")
    return own.groupBy("rule_key").agg(F.count("*").alias("issues"), F.countDistinct("doc_id").alias("files"))


@query(f"WITH {_ISSUES_SQL} SELECT count(*) AS total_files, (SELECT count(*) FROM issues WHERE state <> 'ignored') AS total_issues, CASE WHEN (SELECT count(*) FROM issues WHERE state <> 'ignored' AND severity = 'high') > 0 THEN '存在 ' || (SELECT count(*) FROM issues WHERE state <> 'ignored' AND severity = 'high') || ' 处严重问题，建议优先整改' WHEN (SELECT count(*) FROM issues WHERE state <> 'ignored') > 0 THEN '未发现严重问题，建议按清单逐项复核' ELSE '未发现问题' END AS conclusion FROM per")
def i_conclusion(spark, sf):
    found = _issues(spark, sf)
    return issues.conclusion(issues.summary(issues.file_results(_files(spark, sf), found), found))


@query(f"WITH {_ISSUES_SQL} SELECT doc_id, status FROM (SELECT doc_id, file_type, CASE WHEN bad THEN 'error' WHEN issue_count > 0 THEN 'issue' ELSE 'pass' END AS status, issue_count FROM per) WHERE NOT (status = 'pass' AND issue_count = 0 AND doc_id % 4 = 0 AND file_type IN ('Word', 'Excel'))")
def a_without_blank(spark, sf):
    files = _files(spark, sf)
    contents = files.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(5).alias("content_count"))
    return issues.without_blank(issues.file_results(files, _issues(spark, sf)), contents).select("doc_id", "status")


@query("SELECT event_type AS event, ts, event_id FROM events ORDER BY ts DESC, event DESC, event_id LIMIT 50 OFFSET 50")
def b_log_page(spark, sf):
    log = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("event"), "ts", "event_id")
    return issues.page_of_log(log, 50, 50)


# J: blocks and answers ------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {PARAGRAPHS_SQL}, own AS (SELECT doc_id, 0 AS tbl, unit_idx AS n, '第 ' || unit_idx || ' 段' AS location, trim(text) AS text FROM paras WHERE length(trim(text)) >= 4),
cells AS (SELECT doc_id, unit_idx // 3 AS r, unit_idx % 3 + 1 AS c, substr(trim(text), 1, 7) AS t FROM paras), rws AS (SELECT doc_id, 1 AS tbl, r AS n, '表 1 第 ' || r || ' 行' AS location, string_agg(trim(t), ' | ' ORDER BY c) FILTER (trim(t) <> '') AS text FROM cells GROUP BY doc_id, r)
SELECT doc_id, tbl, n, location, text FROM own UNION ALL SELECT * FROM rws WHERE length(text) >= 2""")
def j_review_blocks(spark, sf):
    return extract.word_blocks(_parts(spark, sf)).select("doc_id", "seq.tbl", "seq.n", "location", "text")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """The paragraphs as parts of a document, and the starts of every three as a row of a table."""
    p = seeds.paragraphs(spark, sf)
    shape = lambda part, idx, tbl, row, col, text: p.select("doc_id", F.lit(part).alias("part"), idx.alias("idx"), tbl.cast("int").alias("tbl"), row.cast("int").alias("row"), col.cast("int").alias("col"), text.alias("text"))
    i, none = F.col("unit_idx"), F.lit(None)
    return shape("paragraph", i, none, none, none, F.col("text")).union(shape("cell", F.lit(0), F.lit(1), F.floor(i / 3), i % 3 + 1, F.substring(F.trim("text"), 1, 7)))


@query(f"""WITH {PARAGRAPHS_SQL}, own AS (SELECT doc_id AS doc, 0 AS tbl, unit_idx AS r, 0 AS c, trim(text) AS text FROM paras WHERE trim(text) <> '' UNION ALL
  SELECT doc_id, 1, unit_idx // 3, unit_idx % 3 + 1, trim(substr(trim(text), 1, 7)) FROM paras WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, trim(substr(trim(text), 1, 7)) ORDER BY unit_idx) = 1)
SELECT doc, CAST(1 + sum(1 + (length(text) - 1) // 36) OVER w // 38 AS INT) AS page, CAST(row_number() OVER w AS INT) AS chunk_idx, text FROM own WINDOW w AS (PARTITION BY doc ORDER BY tbl, r, c ROWS UNBOUNDED PRECEDING)""")
def h_template_chunks(spark, sf):
    return extract.template_chunks(_parts(spark, sf)).select("doc", "page", "chunk_idx", "text")


@query(r"""WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE length(text) >= 12),
a AS (SELECT conv_id, turn, regexp_replace(text, '^[\s\x85\x{a0}\x{2028}\x{2029}\x{3000}]+|[\s\x85\x{a0}\x{2028}\x{2029}\x{3000}]+$', '', 'g') AS q, CASE turn % 3 WHEN 2 THEN '其他' ELSE '错别字' END AS category, CASE WHEN turn % 2 = 0 THEN 'high' ELSE 'medium' END AS severity FROM c),
k AS (SELECT *, regexp_replace(q, '[^\p{L}\p{N}_]', '', 'g') AS b, replace(replace(replace(q, chr(13), ' '), chr(10), '⏎'), chr(9), '→') AS flat FROM a)
SELECT conv_id AS doc_id, turn AS chunk, CASE WHEN length(flat) > 120 THEN flat[:120] || '…' ELSE flat END AS quote, category, severity FROM k WHERE b <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, b ORDER BY turn) = 1""")
def j_answers(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where(F.length("text") >= 12)
    t = F.col("turn")
    category = F.when(t % 3 == 0, "错别字").when(t % 3 == 1, "其它错别字类").otherwise("odd")
    item = lambda quote: F.struct(quote.alias("quote"), category.alias("category"), F.lit("疑点").alias("issue"), F.lit("d").alias("detail"), F.lit("s").alias("suggestion"), F.when(t % 2 == 0, "high").otherwise("grave").alias("severity"))
    quote = F.col("text")
    content = F.concat(F.lit("answer: "), F.to_json(F.array(item(quote), item(quote), item(F.lit("qqxxzzqqxxzz")))), F.lit(" end"))
    answers = c.select(F.col("conv_id").alias("doc_id"), t.alias("chunk"), content.alias("content"), F.col("text").alias("source"))
    return review.parse_answers(answers).select("doc_id", "chunk", "quote", "category", "severity")


@query("SELECT conv_id AS doc_id, 'TimeoutError: t' AS note FROM conversations GROUP BY conv_id HAVING count(*) FILTER (conv_id % 3 <> 0) = 0")
def j_failed_notes(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    failed = F.col("conv_id") % 3 == 0
    return review.failed_note(c.select(F.col("conv_id").alias("doc_id"), F.when(~failed, "[]").alias("content"), F.when(failed, "TimeoutError: t").alias("error")))


@query(f"SELECT conv_id AS doc_id, turn AS chunk, length('role' || chr(10) || chr(10) || 'base' || chr(10) || chr(10) || text) AS n, md5('role' || chr(10) || chr(10) || 'base' || chr(10) || chr(10) || text) AS digest FROM conversations WHERE text IS NOT NULL")
def j_prompts(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), "text")
    return review.prompts(c, "base", role="role").select("doc_id", "chunk", F.length("prompt").cast("long").alias("n"), F.md5("prompt").alias("digest"))
