"""Word and Excel files as rows of paragraphs, cells and references, read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioscan.config import Config
from folioscan.model import hit

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PARTS = "doc_id long, part string, idx int, tbl int, row int, col int, text string, style string, num_id string, br_count int, br_page boolean, br_last_rendered boolean, header_repeat boolean"
CELLS = "doc_id long, part string, sheet string, sheet_idx int, row int, col int, value_str string, value_type string, number_format string, formula string, ref string"
#: How much of a sheet in a file is looked at.
SCAN_ROWS, SCAN_COLS = 3000, 200
PASSED_ROWS = 10_000
#: Number formats by their built-in number.
FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 49: "@"}


_T, _TAB, _BREAKS = W + "t", W + "tab", (W + "br", W + "cr")


def _text(p: ET.Element) -> str:
    out = []
    for node in p.iter():
        tag = node.tag
        if tag == _T:
            out.append(node.text or "")
        elif tag == _TAB:
            out.append("\t")
        elif tag in _BREAKS and node.get(W + "type") not in ("page", "column"):
            out.append("\n")
    return "".join(out)


def _styles(z: zipfile.ZipFile) -> dict[str, tuple[str, str | None, str | None]]:
    """id -> (name, parent, number of the list that the style belongs to)."""
    if "word/styles.xml" not in z.namelist():
        return {}
    found = {}
    for s in ET.fromstring(z.read("word/styles.xml")).iter(W + "style"):
        name, parent, num = s.find(W + "name"), s.find(W + "basedOn"), s.find(f"{W}pPr/{W}numPr/{W}numId")
        found[s.get(W + "styleId")] = (name.get(W + "val") if name is not None else "", parent.get(W + "val") if parent is not None else None, num.get(W + "val") if num is not None else None)
    return found


def word_parts(raw: bytes) -> Iterator[tuple]:
    """Paragraphs, table cells, references to images and broken parts of a document."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        xml, styles, names = z.read("word/document.xml"), _styles(z), set(z.namelist())
        rels = {}
        if "word/_rels/document.xml.rels" in names:
            for r in ET.fromstring(z.read("word/_rels/document.xml.rels")):
                rels[r.get("Id")] = (r.get("Type", ""), r.get("TargetMode") == "External", r.get("Target", ""))
        body, idx, tbl = ET.fromstring(xml).find(W + "body"), 0, 0
        for node in body if body is not None else ():
            if node.tag == W + "p":
                idx += 1
                props = node.find(W + "pPr")
                style = props.find(W + "pStyle") if props is not None else None
                style_id = style.get(W + "val") if style is not None else None
                own = props.find(f"{W}numPr/{W}numId") if props is not None else None
                num, at, steps = own.get(W + "val") if own is not None else None, style_id, 0
                while num is None and at in styles and steps < 5:
                    if styles[at][2]:
                        num = f"style:{styles[at][2]}"
                    at, steps = styles[at][1], steps + 1
                breaks = [b.get(W + "type") for b in node.iter(W + "br")]
                yield ("paragraph", idx, None, None, None, _text(node), styles.get(style_id, (style_id or "", None, None))[0], num, len(breaks), "page" in breaks, next(node.iter(W + "lastRenderedPageBreak"), None) is not None, None)
            elif node.tag == W + "tbl":
                tbl += 1
                for r, row in enumerate(node.findall(W + "tr"), 1):
                    mark = row.find(f"{W}trPr/{W}tblHeader")
                    repeat = r == 1 and mark is not None and mark.get(W + "val") not in ("0", "false", "off")
                    for c, cell in enumerate(row.findall(W + "tc"), 1):
                        yield ("cell", 0, tbl, r, c, "\n".join(_text(p) for p in cell.findall(W + "p")), None, None, None, None, None, repeat)
        broken = []
        for key, (kind, external, target) in rels.items():
            if "image" in kind:
                part = "word/" + target.lstrip("/").removeprefix("word/")
                if external:
                    broken.append(f"{key}（外部链接图片，离线环境无法显示）")
                elif part not in names:
                    broken.append(f"{key}（图片部件读取失败）")
                elif not z.getinfo(part).file_size:
                    broken.append(f"{key}（图片数据为 0 字节）")
        used = set(re.findall(rb'r:(?:embed|link|id)="([^"]+)"', xml))
        broken += [f"{i}（正文引用的关系 ID 在关系表中缺失，图片/对象断链）" for i in sorted(u.decode() for u in used) if i not in rels][:5]
        broken += [f"{n.rsplit('/', 1)[-1]}（媒体文件为空）" for n in sorted(names) if n.startswith("word/media/") and not z.getinfo(n).file_size]
        for n, what in enumerate(dict.fromkeys(broken)):
            yield ("broken", n, None, None, None, what, None, None, None, None, None, None)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def _streamed(z: zipfile.ZipFile, part: str, *tags: str) -> Iterator[ET.Element]:
    """Elements of a part as they end, one at a time; each is dropped before the next is read."""
    with z.open(part) as source:
        around = []
        for event, node in ET.iterparse(source, ("start", "end")):
            if event == "start":
                around.append(node)
                continue
            around.pop()
            if node.tag in tags and not any(n.tag in tags for n in around):
                yield node
                node.clear()
                if around:
                    around[-1].remove(node)


def sheet_names(z: zipfile.ZipFile) -> list[tuple[str, int, str]]:
    """(name, number from 1, part) of a workbook's sheets."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    parts = [(s.get("name") or "", targets[s.get(R + "id")]) for s in ET.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet")]
    return [(name, n, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for n, (name, t) in enumerate(parts, 1)]


def cell_formats(z: zipfile.ZipFile) -> list[str]:
    if "xl/styles.xml" not in z.namelist():
        return ["General"]
    styles = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(S + "numFmt")}
    xfs = styles.find(S + "cellXfs")
    return [own.get(i := int(x.get("numFmtId", 0)), FORMATS.get(i, "General")) for x in (xfs if xfs is not None else ())] or ["General"]


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    return ["".join(t.text or "" for t in si.iter(S + "t")) for si in _streamed(z, "xl/sharedStrings.xml", S + "si")] if "xl/sharedStrings.xml" in z.namelist() else []


def sheet_parts(z: zipfile.ZipFile, name: str, n: int, part: str, strings: list[str], formats: list[str]) -> Iterator[tuple]:
    """One sheet: itself, its cells, merged ranges and hidden rows and columns, read row by row."""
    yield ("sheet", name, n, None, None, None, None, None, None, None)
    at = 0
    for node in _streamed(z, part, S + "col", S + "mergeCell", S + "row"):
        if node.tag == S + "col":
            if node.get("hidden") in ("1", "true"):
                for k in range(int(node.get("min")), min(int(node.get("max")), 16384) + 1):
                    yield ("hidden_col", name, n, None, k, None, None, None, None, None)
            continue
        if node.tag == S + "mergeCell":
            first = node.get("ref").split(":")[0]
            yield ("merged", name, n, int(re.search(r"\d+", first)[0]), _column(first), None, None, None, None, node.get("ref"))
            continue
        at = int(node.get("r") or at + 1)
        if node.get("hidden") in ("1", "true"):
            yield ("hidden_row", name, n, at, None, None, None, None, None, None)
        col = 0
        for c in node.findall(S + "c"):
            col = _column(c.get("r")) if c.get("r") else col + 1
            if at > SCAN_ROWS or col > SCAN_COLS:
                continue
            v, f, kind = c.find(S + "v"), c.find(S + "f"), c.get("t", "n")
            fmt = formats[i] if (i := int(c.get("s", 0))) < len(formats) else "General"
            value = v.text if v is not None else None
            if kind == "s" and value is not None:
                value = strings[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(S + "t"))
            dated = kind == "n" and re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|General', "", fmt), re.IGNORECASE)
            what = {"s": "文本", "str": "文本", "inlineStr": "文本", "b": "布尔", "e": "文本"}.get(kind, "日期" if dated else "数字")
            if value is not None or f is not None:
                yield ("cell", name, n, at, col, value, what, fmt, None if f is None else "=" + (f.text or ""), None)


def excel_parts(raw: bytes) -> Iterator[tuple]:
    """Sheets, cells, merged ranges and hidden rows and columns of a workbook."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        strings, formats = shared_strings(z), cell_formats(z)
        for name, n, part in sheet_names(z):
            yield from sheet_parts(z, name, n, part, strings, formats)


def _parsed(files: DataFrame, parts: Callable[[bytes], Iterator[tuple]], shape: str, blank: int) -> DataFrame:
    names, types = [x.split()[0] for x in shape.split(", ")], T.StructType.fromDDL(shape)
    schema = to_arrow_schema(types)

    def rows(doc: int, raw: bytes) -> list[tuple]:
        try:
            return [(doc, *p) for p in parts(raw)]
        except Exception as e:  # a file that can't be parsed becomes one row that says so
            row = (doc, "error", *[None] * (blank - 2))
            return [tuple(f"{type(e).__name__} - {str(e)[:120]}" if n in ("text", "value_str") else x for n, x in zip(names, row, strict=True))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out += rows(doc, raw.as_py() or b"")
                if len(out) >= PASSED_ROWS:  # rows of many small files go on together
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return files.select("doc_id", "content").mapInArrow(run, types)


def word_rows(files: DataFrame) -> DataFrame:
    """Parts of the Word files among ``files`` that can be read."""
    return _parsed(files.where("file_type = 'Word' and error_message is null"), word_parts, PARTS, 13)


def excel_rows(files: DataFrame) -> DataFrame:
    return _parsed(files.where("file_type = 'Excel' and error_message is null"), excel_parts, CELLS, 11)


def paragraphs(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'paragraph'").select("doc_id", F.col("idx").alias("unit_idx"), "text", "style", "num_id", "br_count", "br_page", "br_last_rendered")


def broken_images(parts: DataFrame, config: Config | None = None, most: int = 8) -> DataFrame:
    """(doc_id, location, hits): external, empty, missing and dangling images of each document."""
    found = parts.where("part = 'broken'").groupBy("doc_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), 1, most).alias("b"))
    detail = F.concat(F.lit("检测到 "), F.size("b").cast("string"), F.lit(" 处图片或对象异常："), F.array_join("b", "；"))
    return found.select("doc_id", F.lit("文档图片/嵌入对象").alias("location"), F.array(hit("image_broken", 91, detail, F.lit(""), config or Config())).alias("hits"))


def engine_notes(parts: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, note): what went wrong while a file was parsed."""
    return parts.where("part = 'error'").select("doc_id", F.col(column).alias("note"))
