"""Reports and exports as files, one per key, by a Python data source: Word files, tables as CSV with a byte-order mark, and lines.

A row is a part of a file: its name, its kind and its cells. The rows of a file must be in one task and in order (``write`` sees to that); a task streams them into files of
its own below a folder of the job, so no file is ever whole in memory. Only when all tasks have ended are the files moved to their places, by name; a job that
fails deletes its folder and leaves nothing. ``write`` moves them in tasks; the data source, which has tasks for writing only, sends their names to the driver. Paths may be of any store that pyarrow knows.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from folioscan.staging import stage

#: Kinds of rows: paragraphs, a page's end, and a table's head and rows. Other forms than Word files know heads and rows, and take the rest as lines.
KINDS = ("title", "h1", "h2", "p", "page", "head", "row")
SHAPE = "file string, kind string, cells array<string>"
BOM = "﻿"

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_STYLES = {"title": ("Title", 60), "h1": ("heading 1", 32), "h2": ("heading 2", 26)}
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "word/styles.xml": f"<w:styles {_NS}>" + "".join(f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{name}"/><w:rPr><w:b/><w:sz w:val="{size}"/></w:rPr></w:style>' for k, (name, size) in _STYLES.items()) + "</w:styles>",
}
_BORDERS = "<w:tblPr><w:tblBorders>" + "".join(f'<w:{side} w:val="single" w:sz="4"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV")) + "</w:tblBorders></w:tblPr>"
#: Characters that XML has no way to write.
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _run(text: str) -> str:
    said = escape(_NO_XML.sub("", text)).replace("\r\n", "\n").replace("\r", "\n")
    return '<w:r><w:t xml:space="preserve">' + said.replace("\n", '</w:t><w:br/><w:t xml:space="preserve">').replace("\t", '</w:t><w:tab/><w:t xml:space="preserve">') + "</w:t></w:r>"


class WordFile:
    """A Word file, written row by row."""

    def __init__(self, out: io.RawIOBase) -> None:
        self._zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        for name, text in _PARTS.items():
            self._zip.writestr(name, _XML + text)
        self._body, self._table = self._zip.open("word/document.xml", "w", force_zip64=True), False
        self._put(f"{_XML}<w:document {_NS}><w:body>")

    def _put(self, text: str) -> None:
        self._body.write(text.encode())

    def _end_table(self) -> None:
        if self._table:
            self._put("</w:tbl><w:p/>")  # tables side by side would become one
            self._table = False

    def add(self, kind: str, cells: list[str]) -> None:
        if kind in ("head", "row"):
            if kind == "head":
                self._end_table()
            if not self._table:
                self._put(f"<w:tbl>{_BORDERS}")
                self._table = True
            head = "<w:trPr><w:tblHeader/></w:trPr>" if kind == "head" else ""
            self._put(f"<w:tr>{head}" + "".join(f"<w:tc><w:p>{_run(c)}</w:p></w:tc>" for c in cells) + "</w:tr>")
            return
        self._end_table()
        style = f'<w:pPr><w:pStyle w:val="{kind}"/></w:pPr>' if kind in _STYLES else ""
        self._put('<w:p><w:r><w:br w:type="page"/></w:r></w:p>' if kind == "page" else f"<w:p>{style}{''.join(map(_run, cells))}</w:p>")

    def close(self) -> None:
        self._end_table()
        self._put("</w:body></w:document>")
        self._body.close()
        self._zip.close()


class TableFile:
    """Comma-separated cells; a mark before them lets spreadsheets read them as UTF-8."""

    def __init__(self, out: io.RawIOBase) -> None:
        self._out, self._line = out, io.StringIO(newline="")
        self._csv = csv.writer(self._line)
        out.write(BOM.encode())

    def add(self, _kind: str, cells: list[str]) -> None:
        self._csv.writerow(cells)
        self._out.write(self._line.getvalue().encode())
        self._line.seek(0)
        self._line.truncate()

    def close(self) -> None:
        pass


class LinesFile:
    def __init__(self, out: io.RawIOBase) -> None:
        self._out = out

    def add(self, _kind: str, cells: list[str]) -> None:
        self._out.write(("\t".join(cells) + "\n").encode())

    def close(self) -> None:
        pass


FORMS = {"docx": WordFile, "csv": TableFile, "txt": LinesFile}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(rows: Iterable[tuple[str, str, list[str] | None]], path: str, folder: str, form: str) -> list[str]:
    """Write the files of one task below ``folder``; their names."""
    store, root = _store(path)
    done, name, made = {}, None, None
    store.create_dir(f"{root}/{folder}", recursive=True)
    with ExitStack() as open_:
        for file, kind, cells in rows:
            if file != name:
                if not file or "/" in file or file.startswith(("_", ".")) or file in done:
                    raise ValueError(f"a file's name is plain and its rows follow each other: {file!r}")
                if made:
                    made.close()
                open_.close()
                name, made = file, FORMS[form](open_.enter_context(store.open_output_stream(f"{root}/{folder}/{file}")))
                done[file] = True
            if kind not in KINDS:
                raise ValueError(f"unknown kind {kind!r}")
            made.add(kind, [c if c is not None else "" for c in cells or []])
        if made:
            made.close()
    return list(done)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, form: str, overwrite: bool) -> None:
        if form not in FORMS:
            raise ValueError(f"form is one of {', '.join(FORMS)}, not {form!r}")
        self.path, self.form, self.overwrite, self.job = path.rstrip("/"), form, overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        folder = f"{self.job}/{uuid.uuid4().hex}"
        return Written(folder, _put(((r["file"], r["kind"], r["cells"]) for r in rows), self.path, folder, self.form))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        files = [(m.folder, f) for m in messages if m for f in m.files]
        names = [f for _, f in files]
        twice = [f for f, n in Counter(names).items() if n > 1]
        there = [] if self.overwrite or not names else [i.path for i in store.get_file_info([f"{root}/{f}" for f in names]) if i.type != fs.FileType.NotFound]
        if twice or there:
            self.abort(messages)
            raise ValueError(f"rows of {twice[0]!r} came from several tasks" if twice else f"{there[0]!r} exists")
        for folder, f in files:
            store.move(f"{root}/{folder}/{f}", f"{root}/{f}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class FolioFiles(DataSource):
    """``df.write.format("folio_files").option("form", "docx").save(folder)``; rows as in ``SHAPE``."""

    @classmethod
    def name(cls) -> str:
        return "folio_files"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        missing = {"file", "kind", "cells"} - set(schema.names)
        if missing:
            raise ValueError(f"rows need columns {sorted(missing)}")
        return FilesWriter(self.options["path"], self.options.get("form", "docx"), overwrite)


def _in_tasks(files: DataFrame, path: str, run: Callable[[fs.FileSystem, str, str, str], bool]) -> DataFrame:
    """The ``files`` (folder, file) for which ``run`` says so, given their store, root, folder and name."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in batches:
            yield batch.filter(pa.array([run(store, root, folder, f) for folder, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.bool_()))

    return files.mapInArrow(each, files.schema)


def _is_there(store: fs.FileSystem, root: str, _folder: str, file: str) -> bool:
    return store.get_file_info(f"{root}/{file}").type != fs.FileType.NotFound


def _move(store: fs.FileSystem, root: str, folder: str, file: str) -> bool:
    if store.get_file_info(f"{root}/{folder}/{file}").type != fs.FileType.NotFound:  # else a task that was lost has moved it
        store.move(f"{root}/{folder}/{file}", f"{root}/{file}")
    return False


def write(rows: DataFrame, path: str, form: str = "docx", *order: str, overwrite: bool = False) -> DataFrame:
    """Write ``rows`` (file, kind, cells and the columns ``order``), each file by one task, its rows in order; file and path of what was written. Rows without a name are in no file.

    Names are a stored table, and tasks move files to their places, so that the driver holds nothing of them.
    """
    if form not in FORMS:
        raise ValueError(f"form is one of {', '.join(FORMS)}, not {form!r}")
    path, job = path.rstrip("/"), f"_job-{uuid.uuid4().hex}"
    dealt = rows.where(F.col("file").isNotNull()).repartition("file").sortWithinPartitions("file", *order).select("file", "kind", "cells")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = f"{job}/{uuid.uuid4().hex}"
        names = _put((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), path, folder, form)
        yield pa.RecordBatch.from_arrays([pa.array([folder] * len(names), pa.string()), pa.array(names, pa.string())], ["folder", "file"])

    store, root = _store(path)
    store.create_dir(f"{root}/{job}", recursive=True)
    try:
        files = stage(dealt.mapInArrow(put, "folder string, file string"), "written")
        if twice := files.groupBy("file").count().where("count > 1").first():
            raise ValueError(f"rows of {twice['file']!r} came from several tasks")
        if not overwrite and (there := _in_tasks(files, path, _is_there).first()):
            raise ValueError(f"{there['file']!r} exists")
        _in_tasks(files, path, _move).write.format("noop").mode("overwrite").save()
    finally:
        store.delete_dir(f"{root}/{job}")
    return files.select("file", F.concat(F.lit(f"{path}/"), "file").alias("path"))
