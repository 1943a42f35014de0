"""The data source of Word and Excel files against the parsers of whole files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tests.test_files import docx, packed, para, xlsx

from folioscan.sources import office, office_reader


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("office")
    sheet = lambda k: f'<cols><col min="2" max="3" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c t="inlineStr"><is><t>in {k}</t></is></c></row><row hidden="1"><c><f>A1+{k}</f><v>{k}</v></c><c s="1"><v>45000</v></c></row><row r="7"><c r="AB7" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells>'
    strings, styles = ["shared <b/> text".replace("<b/>", "")], '<numFmts><numFmt numFmtId="200" formatCode="yyyy/mm/dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="200"/></cellXfs>'
    (d / "many.xlsx").write_bytes(xlsx([(f"s{k}", sheet(k)) for k in range(50)], strings, styles))
    (d / "sub").mkdir()
    (d / "sub" / "one é.xlsm").write_bytes(xlsx([("数据", sheet(7)), ("empty", "<sheetData/>")], strings, styles))
    (d / "torn.xlsx").write_bytes(xlsx([("ok", sheet(1)), ("bad", "<sheetData><row r='1'><c r='A1'><v>1</v></c></row><row>")], strings, styles))
    (d / "no.xlsx").write_bytes(b"PK no zip")
    (d / "bare.xlsx").write_bytes(packed({"x": "y"}))
    (d / "~$many.xlsx").write_bytes(b"")
    (d / "a.docx").write_bytes(docx(para("one") + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>" + para("two")))
    (d / "bad.docx").write_bytes(b"PK")
    return d


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_sheets_as_tasks(spark, folder):
    office_reader.register(spark)
    df = spark.read.format("folio").load(str(folder / "many.xlsx"))
    assert df.rdd.getNumPartitions() == 50
    want = sorted(((str(folder / "many.xlsx"), office_reader.named(str(folder / "many.xlsx")), *p) for p in office.excel_parts((folder / "many.xlsx").read_bytes())), key=str)
    assert rows(df) == want and len(want) == 50 * 10
    assert df.select("path", "doc_id").distinct().where(F.xxhash64("path") == F.col("doc_id")).count() == 1
    assert df.select("sheet", F.spark_partition_id().alias("p")).groupBy("sheet").agg(F.countDistinct("p").alias("n")).where("n <> 1").count() == 0


def test_a_folder_with_files_that_are_broken(spark, folder):
    office_reader.register(spark)
    df = spark.read.format("folio").load(str(folder))
    said = {r.path.rsplit("/", 1)[-1]: r.value_str for r in df.where("part = 'error'").collect()}
    assert set(said) == {"torn.xlsx", "no.xlsx", "bare.xlsx"} and all(said.values()) and "ParseError" in said["torn.xlsx"]
    assert df.where("part = 'cell' and sheet = 'ok'").count() == 5 and df.where("sheet = '数据' and value_type = '日期'").count() == 1
    assert df.where("path like '%~$%'").count() == 0
    assert spark.read.format("folio").load(str(folder / "sub")).select("sheet").distinct().count() == 2


def test_documents(spark, folder):
    office_reader.register(spark)
    df = spark.read.format("folio").option("kind", "word").load(str(folder))
    assert [(r.part, r.text) for r in df.where("path like '%a.docx'").orderBy("part", "idx").collect()] == [("cell", "cell"), ("paragraph", "one"), ("paragraph", "two")]
    assert "BadZipFile" in df.where("part = 'error'").first().text
    with pytest.raises(Exception, match="kind is one of"):
        spark.read.format("folio").option("kind", "odd").load(str(folder)).count()


def test_nothing_there(spark, tmp_path):
    office_reader.register(spark)
    assert spark.read.format("folio").load(str(tmp_path)).count() == 0


def test_a_long_sheet_is_streamed(tmp_path):
    """Memory does not follow the rows of a sheet."""
    import tracemalloc
    import zipfile

    body = "<sheetData>" + "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c><c r="B{k}"><v>{k}</v></c></row>' for k in range(1, 60_001)) + "</sheetData>"
    path = tmp_path / "long.xlsx"
    path.write_bytes(xlsx([("s", body)]))
    with zipfile.ZipFile(path) as z:
        name = office.sheet_names(z)[0]
        tracemalloc.start()
        n = sum(1 for _ in office.sheet_parts(z, *name, [], ["General"]))
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
    assert n > 1000 and peak < 8 << 20
