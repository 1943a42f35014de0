"""Views and functions of SQL against the library's own columns, and totals that are counted while issues are written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscan import lexicon, queries, sql
from folioscan.functions.text import clip, strip
from folioscan.plans import check, issues, review

SF = "/root/testdata/sf0.001"
WORD, TYPO = lexicon.pairs("colloquial")[0][0], lexicon.pairs("typo")[0][0]
UNITS = "doc_id long, doc_type string, unit_kind string, unit_idx int, location string, text string"


def rows(df):
    return sorted(map(str, df.collect()))


def test_views_over_units_of_ones_own(spark):
    units = spark.createDataFrame([(1, "word", "paragraph", 1, "p", f"{WORD}看{TYPO}。"), (2, "word", "paragraph", 1, "q", "没有"), (2, "word", "paragraph", 2, "r", None)], UNITS)
    units.createOrReplaceTempView("own")
    sql.register(spark, "own", own_rules=[{"gid": "g", "gname": "n", "rid": "r", "name": "x", "match_mode": "keyword", "pattern": "没", "severity": "low"}])
    want = check.text_issues(units, check.Config(), [{"gid": "g", "gname": "n", "rid": "r", "name": "x", "match_mode": "keyword", "pattern": "没", "severity": "low"}])
    assert rows(spark.sql("SELECT * FROM issues")) == rows(want) and want.count() >= 3
    assert spark.sql("SELECT count(*) FROM units").first()[0] == 3
    assert spark.sql("SELECT count(*), count_if(enabled) FROM rules_cfg").first()[0] == 50
    assert spark.sql(f"SELECT pattern, note FROM lexicon WHERE bank = 'typo' AND contains('{TYPO}', pattern)").count() >= 1
    files = spark.createDataFrame([(1, "a", "Word", 5, None), (2, "b", "Word", 5, None)], "doc_id long, file_name string, file_type string, file_size long, error_message string")
    sql.register(spark, "own", files=files)
    assert {(r.doc_id, r.status) for r in spark.sql("SELECT doc_id, status FROM file_results").collect()} == {(1, "issue"), (2, "pass")}


@pytest.mark.parametrize("text", ["  a b　", " x ", "", None, "line\r\nnext\ttab" * 3, "é的_1 !", "abcdefgh ijkl", "zzz"])
def test_functions(spark, text):
    sql.register(spark, spark.createDataFrame([], UNITS))
    df = spark.createDataFrame([(text, "x ABCDEFGH, abcdefgh; ijkl é的_1  x")], "t string, s string")
    df.createOrReplaceTempView("given")
    got = spark.sql("SELECT folio_strip(t), folio_bare(t), folio_clip(t, 8), folio_grounded(t, s) FROM given").first()
    t, s = F.col("t"), F.col("s")
    assert tuple(got) == tuple(df.select(strip(t), review.bare(t), clip(t, 8), review.grounded(t, s)).first())


def test_totals_are_counted_while_issues_are_written(spark):
    found = queries._issues(spark, SF)
    kept, totals = issues.written(found)
    results = issues.file_results(queries._files(spark, SF), found)
    assert rows(kept) == rows(found) and rows(issues.summary(results, None, totals)) == rows(issues.summary(results, found))
    assert issues.written(found.where("false"))[1] == dict.fromkeys(totals, 0)
    # neither texts nor patterns are in what is left to run
    plan = queries.QUERIES["i_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 0 and plan.count("regexp") == 0 and plan.count("Relation") <= 3
