"""Files written by tasks: all of them or none, and read back as they were."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from folioscan import sinks
from folioscan.plans import issues, report, rules, word_report
from folioscan.config import Config
from folioscan.skew import numbered
from folioscan.sources import files, office

SHAPE = "file string, n int, kind string, cells array<string>"


def names(path):
    return sorted(p.relative_to(path).as_posix() for p in path.rglob("*")) if path.exists() else []


def parts(spark, path):
    """Word files of a folder, read by the library's own source."""
    return office.word_rows(files.guarded(files.list_files(spark, str(path)))).join(files.list_files(spark, str(path)).select("doc_id", "file_name"), "doc_id")


def test_word_files_are_read_back(spark, tmp_path):
    rng = random.Random(1)
    said = lambda: "".join(rng.choices("ab <>&\"'\n\t的\U0001f600\x01", k=rng.randint(0, 20)))
    rows, want = [], {}
    for f in range(12):
        name, tables, cells = f"f{f} é.docx", 0, []
        paras, inside = [], False
        for n in range(rng.randint(1, 40)):
            kind = rng.choice(sinks.KINDS)
            row = [said() for _ in range(rng.randint(1, 4) if kind in ("head", "row") else 1)]
            rows.append((name, n, kind, row))
            clean = [c.replace("\x01", "") for c in row]
            if kind in ("head", "row"):
                if kind == "head" or not inside:
                    if kind == "head" and inside:
                        paras.append((None, ""))
                    tables, inside, line = tables + 1, True, 0
                line += 1
                cells += [(tables, line, c + 1, x) for c, x in enumerate(clean)]
            else:
                if inside:
                    paras.append((None, ""))
                inside = False
                paras.append((sinks._STYLES[kind][0] if kind in sinks._STYLES else None, "" if kind == "page" else clean[0]))
        if inside:
            paras.append((None, ""))
        want[name] = (paras, sorted(cells))
    rng.shuffle(rows)
    out = tmp_path / "out"
    sinks.write(spark.createDataFrame(rows, SHAPE).repartition(5), str(out), "docx", "n")
    assert names(out) == sorted(want)
    found = parts(spark, out)
    got = {name: ([], []) for name in want}
    for r in found.orderBy("idx").collect():
        if r.part == "paragraph":
            got[r.file_name][0].append((r.style or None, r.text))
        else:
            got[r.file_name][1].append((r.tbl, r.row, r.col, r.text))
    assert {k: (p, sorted(c)) for k, (p, c) in got.items()} == want


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("f"), (F.col("id") % 20).cast("string")).alias("file"), F.col("id").cast("int").alias("n"), F.lit("row").alias("kind"), F.array(F.when(F.col("id") < 199, "x").otherwise(F.raise_error(F.lit("broken")))).alias("cells"))
    out = tmp_path / "out"
    with pytest.raises(Exception, match="broken"):
        sinks.write(rows, str(out), "txt", "n")
    assert names(out) == []
    # what was there before stays
    sinks.write(rows.where("id < 40"), str(out), "txt", "n")
    before = {n: (out / n).read_bytes() for n in names(out)}
    assert len(before) == 20
    for df in (rows, rows.where("id < 40"), rows.where("id < 40").withColumn("kind", F.lit("odd")), rows.where("id < 40").withColumn("file", F.lit("../x"))):
        with pytest.raises(Exception, match="broken|exists|odd|plain"):
            sinks.write(df, str(out), "txt", "n")
    assert {n: (out / n).read_bytes() for n in names(out)} == before
    sinks.write(rows.where("id < 20"), str(out), "txt", "n", overwrite=True)
    assert len(names(out)) == 20 and (out / "f3").read_text() == "x\n"


def test_rows_of_a_file_from_several_tasks(spark, tmp_path):
    spark.dataSource.register(sinks.FolioFiles)
    rows = spark.range(8, numPartitions=4).select(F.lit("same").alias("file"), F.lit("row").alias("kind"), F.array(F.lit("x")).alias("cells"))
    with pytest.raises(Exception, match="several tasks"):
        rows.write.format("folio_files").option("form", "csv").mode("append").save(str(tmp_path / "out"))
    assert names(tmp_path / "out") == []
    with pytest.raises(Exception, match="form is one of"):
        rows.write.format("folio_files").option("form", "odd").mode("append").save(str(tmp_path / "out"))


def test_tables_and_lines(spark, tmp_path):
    table = spark.createDataFrame([(2, 'say "x", y', True), (1, "a\nb", None), (3, None, False)], "k int, `文字` string, on boolean")
    report.write_table(table, str(tmp_path), "t.csv", "k")
    raw = (tmp_path / "t.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfk,") and raw.count(b"\xef\xbb\xbf") == 1
    assert list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""))) == [["k", "文字", "on"], ["1", "a\nb", ""], ["2", 'say "x", y', "True"], ["3", "", "False"]]
    report.write_table(table.where("false"), str(tmp_path), "none.csv")
    assert (tmp_path / "none.csv").read_bytes() == "﻿k,文字,on\r\n".encode()
    report.write_lines(spark.createDataFrame([("b\nc",), ("a",)], "value string"), str(tmp_path))
    assert (tmp_path / "lines.txt").read_text() == "a\nb\nc\n"


def test_rows_are_numbered_over_tasks(spark):
    rows = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 3 > 0, "same").otherwise("x").alias("s")).repartition(7)
    got = [(r.s, r.k) for r in numbered(rows, "n", "s", "k").orderBy("n").collect()]
    assert got == sorted(got) and sorted(r.n for r in numbered(rows, "n", "s", "k").select("n").collect()) == list(range(1, 5001))
    assert numbered(rows.where("false"), "n", "k").collect() == []


def result(spark, kinds):
    """Files, each with (severity, state) of its issues, or what is wrong with it."""
    listed, found = [], []
    for d, (name, what) in enumerate(kinds):
        listed.append((d, name, "Word", 2048, what if isinstance(what, str) else None))
        for n, (severity, state) in enumerate([] if isinstance(what, str) else what):
            found.append((d, "word", n, 0, f"k{n % 3}", f"类{n % 3}", severity, f"第 {n} 段", f"d{n}", "原句" if n % 2 else "", "改" if n % 3 else "", state))
    shape = "doc_id long, doc_type string, unit_idx int, ord int, rule_key string, rule_title string, severity string, location string, detail string, snippet string, suggestion string, state string"
    rows = spark.createDataFrame(found, shape)
    return issues.file_results(spark.createDataFrame(listed, "doc_id long, file_name string, file_type string, file_size long, error_message string"), rows, Config(max_issues_per_file=5)), rows


def lines(spark, results, found, **more):
    got = word_report.rows(results, found, issues.by_type(results), rules.enabled_by_section(spark, Config()), F.lit("2024-01-02 03:04:05").cast("timestamp"), **more)
    return [(r.kind, r.cells) for r in got.orderBy(*word_report.ORDER).collect()]


def test_a_report(spark, tmp_path):
    results, found = result(spark, [("b.docx", [("high", "normal"), ("low", "checked"), ("medium", "ignored"), ("low", "normal")]), ("a.docx", [("medium", "normal")] * 5), ("ok.docx", []), ("bad.docx", "已损坏")])
    got = lines(spark, results, found, operator="某人")
    assert [c[0] for k, c in got if k == "h1"] == word_report.HEADINGS and got[0] == ("title", [word_report.TITLE])
    assert ("row", ["检测人", "某人"]) in got and ("row", ["所属单位", "—"]) in got
    at = got.index(("head", word_report.FILE_HEAD))
    assert got[at + 1] == ("row", ["4", "1", "2", "1", "25.0%"])
    at = got.index(("head", word_report.ISSUE_HEAD))
    assert got[at + 1] == ("row", ["8", "1", "5", "2", "1 / 1"])
    at = got.index(("h2", ["4.1 a.docx"]))
    assert got[at + 1][1] == ["文件类型：Word    文件大小：2.0 KB    问题总数：5 处（严重 0 / 一般 5 / 轻微 0）"]
    assert got[at + 3][1] == ["1", "第 0 段", "类0", "一般", "d0", "—"] and got[at + 4][1][4:] == ["d1\n原文：原句", "改"]
    assert got[at + 8] == ("p", [word_report.CUT]) and got[at + 9] == ("h2", ["4.2 b.docx"])
    assert [c[2] for k, c in got[at + 12 : at + 15]] == ["类0", "类1", "类0"]  # what is ignored is not told
    assert ("row", ["1", "bad.docx", "Word", "2.0 KB", "已损坏"]) in got and ("p", [word_report.GRAVE]) in got
    at = got.index(("head", word_report.RULE_HEAD))
    assert got[at + 1] == ("row", ["1", "类0", "4", "50.0%"])
    at = got.index(("head", word_report.ADVICE_HEAD))
    assert got[at + 1][1] == ["1", "类0", "4", word_report.ADVICE] and got[at + 2][1][3] == "改"
    assert [k for k, _ in lines(spark, results, found, with_cover=False, columns=["index", "detail"])][0] == "h1"

    again = word_report.rows(results, found, issues.by_type(results), rules.enabled_by_section(spark, Config()), F.lit("2024-01-02 03:04:05").cast("timestamp"), operator="某人")
    sinks.write(again.withColumn("file", F.lit("report.docx")), str(tmp_path), "docx", *word_report.ORDER)
    read = parts(spark, tmp_path)
    assert read.where("part = 'error'").count() == 0
    cells = [r.text for r in read.where("part = 'cell'").orderBy("tbl", "row", "col").collect()]
    assert cells == [c for k, row in got if k in ("head", "row") for c in row]
    assert read.where("style = 'heading 1'").count() == 6


def test_an_empty_report(spark):
    results, found = result(spark, [("ok.docx", [])])
    got = lines(spark, results, found)
    assert [c for k, (c, *_) in got if c in (word_report.NO_RULES, word_report.NO_DETAILS, word_report.NO_BAD, word_report.NONE)] == [word_report.NO_RULES, word_report.NO_DETAILS, word_report.NO_BAD, word_report.NONE]
    results, found = result(spark, [])
    assert ("row", ["0", "0", "0", "0", "—"]) in lines(spark, results, found)


def test_a_report_for_each_file(spark, tmp_path):
    results, found = result(spark, [(f"f{d}.xlsx", [("low", "normal")] * (d % 4)) for d in range(30)] + [("bad", "x")])
    sinks.write(word_report.file_rows(results, found), str(tmp_path), "docx", *word_report.ORDER)
    assert names(tmp_path) == sorted(f"f{d}.xlsx.docx" for d in range(30) if d % 4)
    cells = parts(spark, tmp_path).where("part = 'cell'").groupBy("file_name").agg(F.max("row").alias("n")).collect()
    assert {r.file_name: r.n - 1 for r in cells} == {f"f{d}.xlsx.docx": d % 4 for d in range(30) if d % 4}
