"""Registered queries of what is stored and written: answers that are kept, learned records, report files, and of SQL over the views. Registered by ``folioscan.queries``."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import seeds, sinks, sql
from folioscan.plans import answers, issues, learned, word_report
from folioscan.config import Config
from folioscan.queries import _BARE, _ISSUES_SQL, _TITLES, LITERALS, _files, _issues, only, query, rows_sql
from folioscan.seeds import SEEDED_SQL
from folioscan.sources import files, office
from folioscan.staging import shared_dir, stage


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH p AS (SELECT conv_id, turn, role || ': ' || split_part(coalesce(text, ''), ' ', 1) AS prompt FROM conversations),
first AS (SELECT DISTINCT prompt FROM p WHERE turn % 2 = 0 AND NOT prompt LIKE '%ss%')
SELECT conv_id, turn, prompt, CASE WHEN NOT contains(prompt, 'ss') THEN reverse(prompt) END AS content, CASE WHEN contains(prompt, 'ss') THEN 'ValueError: ss' END AS error, prompt IN (SELECT prompt FROM first) AS known FROM p""")
def j_kept_answers(spark, sf):
    """Every turn as a request, after those with even numbers have been asked in a run before; prompts with ss are never answered."""

    def reviewer(prompt: str) -> str:
        if "ss" in prompt:
            raise ValueError("ss")
        return prompt[::-1]

    c = spark.read.parquet(f"{sf}/conversations.parquet")
    asked = c.select("conv_id", "turn", F.concat("role", F.lit(": "), F.substring_index(F.coalesce("text", F.lit("")), " ", 1)).alias("prompt"))
    kept, now = answers.store(spark, _fresh(spark, "answers")), datetime(2024, 1, 1, tzinfo=timezone.utc)
    tasks = spark.sparkContext.defaultParallelism
    answers.ask(asked.where("turn % 2 = 0"), reviewer, kept, now=now, tasks=tasks)
    return answers.ask(asked, reviewer, kept, now=now + timedelta(minutes=5), tasks=tasks)


_LEARNED_SQL = """i AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'rule' ELSE 'wordbank' END AS kind, 'g' || p_size AS gid, p_partkey % 3 > 0 AS mine FROM part),
g AS (SELECT kind, gid, bool_or(k % 4 = 0) AS own FROM i GROUP BY ALL),
kept AS (SELECT * FROM i WHERE NOT (mine AND k % 5 < 4 AND k % 7 < 6)),
held AS (SELECT kind, gid FROM g WHERE (kind, gid) IN (SELECT (kind, gid) FROM kept) OR (kind, gid) NOT IN (SELECT (kind, gid) FROM i WHERE mine AND k % 5 < 4 AND k % 7 < 6))"""


def _learned(spark: SparkSession, sf: str) -> learned.Store:
    """Parts as items in groups by size, two of three learned; every second learned one is switched off, and most of them are deleted."""
    k = F.col("p_partkey")
    kind = F.when(k % 2 == 0, "rule").otherwise("wordbank")
    base = spark.read.parquet(f"{sf}/part.parquet").select(k.alias("k"), kind.alias("kind"), F.concat(F.lit("g"), F.col("p_size").cast("string")).alias("gid"), k.cast("string").alias("iid"), (k % 3 > 0).alias("mine"), F.col("p_name").alias("name"), F.col("p_type").alias("pattern"))
    blank = F.lit("")
    items = base.select("kind", "gid", "iid", "name", F.lit("keyword").alias("match_mode"), "pattern", blank.alias("suggestion"), F.lit("low").alias("severity"), F.when(F.col("mine"), "learned").otherwise("user").alias("source"), F.lit(True).alias("enabled"))
    groups = base.groupBy("kind", "gid").agg(F.bool_or(F.col("k") % 4 == 0).alias("own")).select("kind", "gid", F.col("gid").alias("name"), F.when(F.col("own"), "learned").otherwise("user").alias("source"), F.lit(True).alias("enabled"))
    records = base.where("mine").select(F.concat(F.lit("r"), "iid").alias("id"), F.lit("s").alias("sample_id"), "kind", "gid", "iid", F.lit(True).alias("enabled"))
    kept = learned.store(spark, _fresh(spark, "learned"))
    learned.add(kept, records, items, groups)
    number = F.expr("bigint(substr(id, 2))")
    learned.toggle(kept, records.where(number % 11 < 5).select("id"), False)
    learned.delete(kept, records.where((number % 5 < 4) & (number % 7 < 6)).select("id"))
    return kept


@query(f"WITH {_LEARNED_SQL} SELECT CAST(k AS VARCHAR) AS iid, kind, gid, NOT (mine AND k % 11 < 5) AS enabled, mine AS learned FROM kept")
def j_learned_items(spark, sf):
    """What is left in word banks and rules, and whether a record of it is left."""
    kept = _learned(spark, sf)
    records = kept.read("records").select("kind", "gid", "iid", F.lit(True).alias("learned"))
    return kept.read("items").join(records, learned.ITEM, "left").select("iid", "kind", "gid", "enabled", F.coalesce("learned", F.lit(False)).alias("learned"))


@query(f"WITH {_LEARNED_SQL} SELECT 'deleted' AS after, kind, gid FROM held UNION ALL SELECT 'cleared', kind, gid FROM g WHERE NOT own AND (kind, gid) IN (SELECT (kind, gid) FROM kept WHERE NOT mine)")
def j_learned_groups(spark, sf):
    """The groups that are left after the deletions, and after all that was learned is cleared."""
    kept = _learned(spark, sf)
    before: DataFrame = kept.read("groups").select(F.lit("deleted").alias("after"), "kind", "gid")
    learned.clear(kept, "learned")
    return before.unionByName(kept.read("groups").select(F.lit("cleared").alias("after"), "kind", "gid"))


@query(f"""WITH {_ISSUES_SQL}, live AS (SELECT doc_id, severity, {_TITLES} AS title FROM issues JOIN per USING (doc_id) WHERE NOT bad AND state <> 'ignored')
SELECT 'f' || doc_id || '.docx' AS file_name, count(*) AS rows, md5(string_agg(title, ',' ORDER BY title)) AS titles, count(*) FILTER (severity = 'high') AS high FROM live GROUP BY doc_id""")
def i_report_files(spark, sf):
    """A Word report for each file with findings, written as files and read back."""
    found, path = stage(_issues(spark, sf), "issues"), _fresh(spark, "reports")  # read by every part of the reports
    results = stage(issues.file_results(_files(spark, sf), found), "results")
    written = sinks.write(word_report.file_rows(results, found), path, "docx", *word_report.ORDER)
    cells = office.word_rows(files.guarded(files.read_files(written))).where("part = 'cell' and row > 1")
    told = cells.groupBy("doc_id").agg(F.count_if(F.col("col") == 1).alias("rows"), F.md5(F.array_join(F.array_sort(F.collect_list(F.when(F.col("col") == 3, F.col("text")))), ",")).alias("titles"), F.count_if((F.col("col") == 4) & (F.col("text") == "严重")).alias("high"))
    return told.join(written.select(F.xxhash64("path").alias("doc_id"), F.col("file").alias("file_name")), "doc_id").drop("doc_id")


@query(f"WITH {_ISSUES_SQL}, c AS (SELECT {_TITLES} AS rule_title, count(*) AS issues FROM issues WHERE state <> 'ignored' GROUP BY 1) SELECT rule_title, issues, round(100.0 * issues / sum(issues) OVER (), 1) AS share, row_number() OVER (ORDER BY issues DESC, rule_title) AS place FROM c")
def s_by_rule(spark, sf):
    """``i_by_rule`` as SQL over the views."""
    sql.register(spark, seeds.seeded(spark, sf), _issues(spark, sf), _files(spark, sf))
    return spark.sql("""
        SELECT rule_title, issues, round(100 * issues / sum(issues) OVER (), 1) AS share, row_number() OVER (ORDER BY issues DESC, rule_title) AS place
        FROM (SELECT rule_title, count(*) AS issues FROM issues WHERE state <> 'ignored' GROUP BY rule_title)""")


_FOUND = [x for x in LITERALS if x[0] in ("tn_colloquial", "tn_typo")]


@query(f"WITH {SEEDED_SQL} SELECT rule_key, doc_id % 3 AS third, count(*) AS issues, count(DISTINCT doc_id) AS files FROM paras JOIN {rows_sql([(r, p) for r, p, _ in _FOUND], 'rule_key, phrase')} ON contains(text, phrase) GROUP BY ALL")
def s_rules_over_a_view(spark, sf):
    """Rules run over a view that was made in SQL; their findings are grouped with the rules' settings."""
    seeds.seeded(spark, sf).createOrReplaceTempView("paragraphs_of_documents")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW my_units AS SELECT * FROM paragraphs_of_documents WHERE text <> ''")
    sql.register(spark, "my_units", config=only("tn_colloquial", "tn_typo"))
    return spark.sql("""
        SELECT rule_key, doc_id % 3 AS third, count(*) AS issues, count(DISTINCT doc_id) AS files
        FROM issues JOIN rules_cfg USING (rule_key) WHERE enabled AND section = 'textnorm' GROUP BY ALL""")


@query(f"SELECT conv_id, turn, {_BARE.format('text')} <> '' AS ok, length({_BARE.format('text')}) AS letters FROM conversations WHERE text <> ''")
def s_functions(spark, sf):
    """Each turn against itself by the functions of SQL."""
    sql.register(spark, seeds.seeded(spark, sf), config=Config())
    spark.read.parquet(f"{sf}/conversations.parquet").createOrReplaceTempView("turns")
    return spark.sql("SELECT conv_id, turn, folio_grounded(text, concat('x ', text, ' y')) AS ok, CAST(length(folio_bare(text)) AS BIGINT) AS letters FROM turns WHERE text <> ''")
