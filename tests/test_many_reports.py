"""Many written files: their names, moves and reading back are the tasks' work, and the driver lists none of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscan import kept_queries, sinks
from folioscan.sources import files, office


def rows(spark, n):
    return spark.range(n).select(F.concat(F.lit("f +%"), F.col("id").cast("string"), F.lit(".docx")).alias("file"), F.lit("row").alias("kind"), F.array(F.col("id").cast("string")).alias("cells"))


def test_written_files_are_read_back_without_a_listing(spark, tmp_path, monkeypatch):
    def listed(*_, **__):
        raise AssertionError("listed")

    monkeypatch.setattr(files, "list_files", listed)
    monkeypatch.setattr(sinks.FilesWriter, "commit", listed)
    written = sinks.write(rows(spark, 400), str(tmp_path), "docx")
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"f +%{k}.docx" for k in range(400))
    read = files.read_files(written)
    got = {r.file_name: r for r in read.drop("content").collect()}
    assert set(got) == {f"f +%{k}.docx" for k in range(400)} and {r.file_type for r in got.values()} == {"Word"}
    assert all(r.file_size == (tmp_path / r.file_name).stat().st_size and r.path == f"{tmp_path}/{r.file_name}" for r in got.values())
    cells = office.word_rows(files.guarded(read)).where("part = 'cell'")
    assert sorted(int(r.text) for r in cells.select("text").collect()) == list(range(400))
    assert cells.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism  # not a task for each file
    again = sinks.write(rows(spark, 500).where("id % 100 = 0").withColumn("cells", F.array(F.lit("new"))), str(tmp_path), "txt", overwrite=True)
    assert {bytes(r.content) for r in files.read_files(again).collect()} == {b"new\n"} and len(list(tmp_path.iterdir())) == 401


def test_a_move_that_is_done_again(spark, tmp_path):
    """A task that is lost after some of its moves is run again, and what it has moved stays."""
    (tmp_path / "job").mkdir()
    (tmp_path / "job" / "b").write_text("b")
    (tmp_path / "a").write_text("a")
    todo = spark.createDataFrame([("job", "a"), ("job", "b")], "folder string, file string")
    for _ in range(2):
        assert sinks._in_tasks(todo, str(tmp_path), sinks._move).collect() == []
    assert {p.name: p.read_text() for p in tmp_path.iterdir() if p.is_file()} == {"a": "a", "b": "b"}


def test_the_reports_query_lists_nothing(spark, monkeypatch):
    monkeypatch.setattr(files, "list_files", lambda *_, **__: pytest.fail("listed"))
    found = kept_queries.i_report_files(spark, "/root/testdata/sf0.001")
    assert found.columns == ["rows", "titles", "high", "file_name"] and found.count() > 50
