"""Files built here: documents, workbooks, PDF pages, broken ones, rule files and word lists."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioscan.config import Config
from folioscan.plans import issues
from folioscan.plans.check import check
from folioscan.sources import files, office, pdf, rule_files
from folioscan.streaming import folder

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def para(text, style=None, num=None, extra=""):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:numId w:val="{num}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r>{extra}<w:t xml:space='preserve'>{text}</w:t></w:r></w:p>"


def docx(body: str, rels: str = "", media: dict | None = None) -> bytes:
    styles = f'<w:styles {NS}><w:style w:styleId="h1"><w:name w:val="Heading 1"/></w:style><w:style w:styleId="base"><w:name w:val="L"/><w:pPr><w:numPr><w:numId w:val="9"/></w:numPr></w:pPr></w:style><w:style w:styleId="li"><w:name w:val="List"/><w:basedOn w:val="base"/></w:style></w:styles>'
    return packed({"[Content_Types].xml": "<x/>", "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/_rels/document.xml.rels": f"<Relationships>{rels}</Relationships>", **(media or {})})


def xlsx(sheets: list[tuple[str, str]], strings=(), styles="") -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1))
    parts = {"[Content_Types].xml": "<x/>", "xl/workbook.xml": f"<workbook {ns}><sheets>{book}</sheets></workbook>", "xl/_rels/workbook.xml.rels": "<R>" + "".join(f'<x Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</R>"}
    parts |= {"xl/sharedStrings.xml": f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>", "xl/styles.xml": f"<styleSheet {ns}>{styles}</styleSheet>"}
    return packed(parts | {f"xl/worksheets/s{i}.xml": f"<worksheet {ns}>{x}</worksheet>" for i, (_, x) in enumerate(sheets, 1)})


def pdf_file(pages: list[bytes], encrypted=False) -> bytes:
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    cmap = b"1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange"
    objects = [b"1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj", f"2 0 obj<</Type/Pages/Kids[{kids}]/Resources<</Font<</F1 3 0 R/F2 4 0 R>>>>>>endobj".encode(), b"3 0 obj<</Type/Font>>endobj", b"4 0 obj<</Type/Font/ToUnicode 5 0 R>>endobj"]
    objects.append(b"5 0 obj<</Filter/FlateDecode>>stream\n" + zlib.compress(cmap) + b"\nendstream endobj")
    for i, content in enumerate(pages):
        objects.append(f"{10 + 2 * i} 0 obj<</Type/Page/Contents {11 + 2 * i} 0 R>>endobj".encode())
        objects.append(f"{11 + 2 * i} 0 obj<</Filter/FlateDecode>>stream\n".encode() + zlib.compress(content) + b"\nendstream endobj")
    return b"%PDF-1.4\n" + b"\n".join(objects) + (b"\ntrailer<</Encrypt 9 0 R>>" if encrypted else b"") + b"\n%%EOF"


@pytest.fixture(scope="module")
def folder_of_files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    cell = lambda *texts, mark="": "<w:tr>" + mark + "".join(f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>" for t in texts) + "</w:tr>"
    body = para("", "h1") + para("1. 首先，，开始") + para("2. 其次") + para("4. 跳号") + para("列表一", num="7") + para("普通段落") + para("列表二", num="7") + para("续", "li") + para("页", extra='<w:br w:type="page"/>') + para("多行", extra="<w:br/>" * 4) + para("搞定了布署") + para("") + para("") + para("")
    body += "<w:tbl>" + cell("名称", "", "数") + cell("", "", "") + "".join(cell("a", "", str(i)) for i in range(11)) + '</w:tbl><w:p><w:r><w:drawing r:embed="gone"/></w:r></w:p>' + para("") * 3
    rels = '<Relationship Id="i1" Type="x/image" Target="media/a.png"/><Relationship Id="i2" Type="x/image" TargetMode="External" Target="http://x"/>'
    (d / "bad.docx").write_bytes(docx(body, rels, {"word/media/a.png": b""}))
    (d / "good.docx").write_bytes(docx(para("内容清楚完整。")))
    strings = ["编号", "名称", "名称", "001", "1,234", " x ", "甲　乙", "文"]
    s = lambda ref, i: f'<c r="{ref}" t="s"><v>{i}</v></c>'
    rows = f'<row r="1">{s("A1", 0)}{s("B1", 1)}{s("D1", 2)}</row><row r="2">{s("A2", 3)}{s("B2", 4)}<c r="D2"><v>5</v></c></row><row r="4" hidden="1">{s("A4", 5)}{s("B4", 6)}<c r="D4" s="1"><v>45000</v></c></row><row r="5">{s("A5", 7)}<c r="B5" t="e"><f>1/0</f><v>#DIV/0!</v></c>{s("D5", 7)}</row>'
    sheet = f'<cols><col min="7" max="7" hidden="1"/></cols><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A2:B2"/><mergeCell ref="F9:G9"/></mergeCells>'
    (d / "book.xlsx").write_bytes(xlsx([("数据", sheet), ("Sheet2", "<sheetData/>")], strings, '<numFmts><numFmt numFmtId="200" formatCode="yyyy/mm/dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="200"/></cellXfs>'))
    (d / "text.pdf").write_bytes(pdf_file([b"BT /F1 12 Tf (Hello \\(PDF\\) page) Tj T* [(se) -20 (cond)] TJ ET", b"BT /F2 9 Tf <000100020003> Tj ET"]))
    (d / "scan.pdf").write_bytes(pdf_file([b"q Q", b""]))
    (d / "locked.pdf").write_bytes(pdf_file([b""], True))
    (d / "broken.docx").write_bytes(b"PK\x03\x04 no zip")
    (d / "empty.xlsx").write_bytes(b"")
    (d / "renamed.xlsx").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x" * 50)
    (d / "bare.docx").write_bytes(packed({"a": "b"}))
    (d / "no.docx").write_bytes(packed({"[Content_Types].xml": "<x/>"}))
    (d / "old.doc").write_bytes(b"x")
    (d / "notes.md").write_bytes(b"x")
    (d / "noext").write_bytes(b"x")
    (d / "~$bad.docx").write_bytes(b"x")
    return str(d)


def test_guards(spark, folder_of_files):
    rows = {r["file_name"]: r for r in files.guarded(files.list_files(spark, folder_of_files)).drop("content").collect()}
    assert len(rows) == 14 and rows["bad.docx"]["error_message"] is None and rows["text.pdf"]["file_type"] == "PDF"
    said = {n: rows[n]["error_message"] for n in rows if rows[n]["error_message"]}
    assert "0 字节" in said["empty.xlsx"] and "OLE" in said["renamed.xlsx"] and "[Content_Types]" in said["bare.docx"] and "压缩包" in said["broken.docx"]
    assert "加密" in said["locked.pdf"] and ".docx / .xlsx" in said["old.doc"] and "无扩展名" in said["noext"] and ".md" in said["notes.md"]
    off = {r["file_name"]: r["error_message"] for r in files.guarded(files.list_files(spark, folder_of_files), Config(enable_pdf=False, enable_legacy=True, max_file_size_mb=0)).drop("content").collect()}
    assert "关闭" in off["text.pdf"] and "未集成" in off["old.doc"] and "超过配置上限" in off["good.docx"]


def test_word_and_excel_rows(spark, folder_of_files):
    listed = files.guarded(files.list_files(spark, folder_of_files))
    names = {r["doc_id"]: r["file_name"] for r in listed.select("doc_id", "file_name").collect()}
    parts = [r for r in office.word_rows(listed).collect() if names[r["doc_id"]] == "bad.docx"]
    ps = [r for r in parts if r["part"] == "paragraph"]
    assert [p["num_id"] for p in ps[4:8]] == ["7", None, "7", "style:9"] and ps[8]["br_page"] and ps[9]["br_count"] == 4 and ps[0]["style"] == "Heading 1"
    assert sum(r["part"] == "cell" for r in parts) == 39 and {r["text"][:4] for r in parts if r["part"] == "broken"} == {"i1（图", "i2（外", "gone", "a.pn"}
    cells = {(r["row"], r["col"]): r for r in office.excel_rows(listed).collect() if r["part"] == "cell" and r["sheet"] == "数据"}
    assert (cells[4, 4]["value_type"], cells[4, 4]["number_format"], cells[5, 2]["formula"], cells[2, 1]["value_str"]) == ("日期", "yyyy/mm/dd", "=1/0", "001")
    errors = office.engine_notes(office.word_rows(listed)).collect()
    assert [names[r["doc_id"]] for r in errors] == ["no.docx"]


def test_pdf_pages(spark, folder_of_files):
    pages = pdf.page_rows(files.guarded(files.list_files(spark, folder_of_files)))
    texts = [r["text"] for r in pages.where("text <> ''").orderBy("page").collect()]
    assert texts == ["Hello (PDF) page\nsecond", "中AB"]
    assert pdf.scanned(pages).count() == 1


def test_whole_check(spark, folder_of_files):
    result = check(spark, folder_of_files)
    results = {r["file_name"]: r for r in result.file_results.collect()}
    rows = result.issues.join(result.file_results.select("doc_id", "file_name"), "doc_id").collect()
    keys = lambda name: {r["rule_key"] for r in rows if r["file_name"] == name}
    assert {"empty_heading", "punct_repeat", "manual_number_sequence", "numbering_break", "manual_line_break", "tn_colloquial", "tn_typo", "empty_paragraph", "blank_redundant_content", "table_empty_row", "table_empty_col", "table_empty_header_cell", "table_no_header_repeat", "image_broken"} <= keys("bad.docx")
    assert {"formula_error", "number_stored_as_text", "trailing_space_cell", "full_width_space_cell", "empty_header_cell", "duplicate_header", "empty_row", "empty_col", "format_chaos", "redundant_merged_cells", "hidden_row_col", "empty_sheet", "sheet_name_invalid"} <= keys("book.xlsx")
    assert results["good.docx"]["status"] == "pass" and results["scan.pdf"]["status"] == "error" and results["broken.docx"]["status"] == "error" and results["no.docx"]["status"] == "issue"
    locations = {r["rule_key"]: r["location"] for r in rows if r["file_name"] == "bad.docx"}
    assert locations["punct_repeat"] == "第 1 页（估算） · 第 2 段" and locations["numbering_break"] == "第 5 段 → 第 7 段" and locations["manual_line_break"] == "第 2 页 · 第 10 段"
    total = issues.summary(result.file_results, result.issues).first()
    assert total["total_files"] == 14 and total["error_files"] == 9
    assert {n for n, r in results.items() if r["status"] == "error"} == {"scan.pdf", "locked.pdf", "broken.docx", "empty.xlsx", "renamed.xlsx", "bare.docx", "old.doc", "notes.md", "noext"}
    capped = check(spark, folder_of_files, Config(max_issues_per_file=2)).file_results.collect()
    assert {r["issue_count"] for r in capped if r["file_name"] in ("bad.docx", "book.xlsx")} == {2} and all(r["truncated"] for r in capped if r["issue_count"] == 2)


def test_rule_lines(spark):
    lines = ["# no", "安祥=>安详", "/\\d{3}/::三位", "错词,对词,说明", "普通词", "x" * 201, "a", "布署→部署", "foo(bar)"]
    got = {r["pattern"]: (r["kind"], r["suggestion"]) for r in rule_files.classify_lines(spark.createDataFrame(list(enumerate(lines)), "ord long, line string")).collect()}
    assert got == {"安祥": ("pair", "外部纠错基准：标准写法为「安详」"), "\\d{3}": ("regex", "三位"), "错词": ("pair", "说明"), "普通词": ("entry", ""), "布署": ("pair", "外部纠错基准：标准写法为「部署」"), "foo(bar)": ("regex", "")}
    again = rule_files.capped_draft(rule_files.classify_lines(spark.createDataFrame([(i, f"词语{i % 7}") for i in range(30)], "ord long, line string")), entries=5)
    assert sorted(r["ord"] for r in again.collect()) == [0, 1, 2, 3, 4]


def test_rule_table_and_word_bank(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿错误词,正确词,风险级别,整改建议\n安祥,安详,笔误,\n布署,部署,,请改\n", encoding="utf-8")
    got = [(r["pattern"], r["suggestion"], r["tag_text"]) for r in rule_files.csv_rules(spark, str(tmp_path / "r.csv")).orderBy("ord").collect()]
    assert got == [("安祥", "标准写法为「安详」", "笔误"), ("布署", "请改", "")]
    bank = rule_files.wordbank_lines(spark.createDataFrame([(0, "# x"), (1, "词|t|s"), (2, "only"), (3, "|x")], "ord long, line string"))
    assert [tuple(r)[1:] for r in bank.orderBy("ord").collect()] == [("词", "t", "s"), ("only", "", "")]


def test_word_lists_and_decoding(spark):
    record = lambda w: struct.pack("<HH", 4, 2 * len(w)) + w.encode("utf-16-le") + struct.pack("<IIH", 1, 0, 2) + b"abcd" + b"\0"
    raw = b"\0" * 0x3B60 + b"".join(map(record, ["评估基准", "资产", "单"])) + b"\0" * 20
    assert rule_files.binary_words(raw) == ["评估基准", "资产"]
    words = [f"词条{chr(0x4E00 + i)}{chr(0x4E50 + i)}" for i in range(60)]
    stream = b"".join((struct.pack("<HH", 1, 4) + b"\x01\0\x02\0" if i % 2 else b"") + struct.pack("<H", 2 * len(w)) + w.encode("utf-16-le") + b"\x0a\0\x05\0" + b"\0" * (2 + 2 * (i % 3)) for i, w in enumerate(words))
    assert rule_files.binary_words(b"\0\0\0\0DCS" + b"\0" * 0x200 + stream) == words
    df = spark.createDataFrame([(0, bytearray("中文".encode("gb18030"))), (1, bytearray("﻿中".encode())), (2, bytearray(raw))], "n int, content binary")
    assert [r[0] for r in df.where("n < 2").orderBy("n").select(files.decoded("content")).collect()] == ["中文", "中"]
    assert df.where("n = 2").select(rule_files.words_of("content")).first()[0] == ["评估基准", "资产"]


def test_stream_of_units(spark, tmp_path):
    units = spark.createDataFrame([(1, "word", "paragraph", 1, "第 1 段", "搞定了"), (2, "word", "paragraph", 1, "第 1 段", "清楚")], "doc_id long, doc_type string, unit_kind string, unit_idx int, location string, text string")
    units.write.parquet(str(tmp_path / "in"))
    folder.write_issues(folder.unit_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where(F.col("rule_key") == "tn_colloquial").collect()
    assert [r["doc_id"] for r in got] == [1]
