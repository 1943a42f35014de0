"""Word and Excel files as a data source: ``spark.read.format("folio")``, a task for each document and for each sheet of a workbook.

Planning reads the list of a workbook's sheets and no more; a task opens its file where it lies, reads the shared strings and streams its one sheet, row by row.
So a large workbook is read by as many tasks as it has sheets, and none holds a sheet. A file or sheet that can't be read is one row that says so.
Paths may be of any store that pyarrow knows.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import xxhash
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscan.sources import office

#: Extensions by what is read.
KINDS = {"excel": (".xlsx", ".xlsm"), "word": (".docx",)}
SHAPES = {"excel": f"path string, {office.CELLS}", "word": f"path string, {office.PARTS}"}


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def named(path: str) -> int:
    """doc_id: what Spark's xxhash64 makes of the path."""
    n = xxhash.xxh64_intdigest(path.encode(), 42)
    return n - (1 << 64) if n >= 1 << 63 else n


@dataclass
class Part(InputPartition):
    path: str
    sheet: tuple[str, int, str] | None = None
    error: str = ""


def _told(e: Exception) -> str:
    return f"{type(e).__name__} - {str(e)[:120]}"


class OfficeReader(DataSourceReader):
    def __init__(self, path: str, kind: str) -> None:
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}, not {kind!r}")
        self.path, self.kind = path, kind

    def partitions(self) -> list[Part]:
        store, root = store_of(self.path)
        there = store.get_file_info(root)
        infos = [there] if there.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted(i.path for i in infos if i.type == fs.FileType.File and i.path.lower().endswith(KINDS[self.kind]) and not i.path.rsplit("/", 1)[-1].startswith(("~$", ".")))
        if self.kind == "word":
            return [Part(f) for f in files] or [Part("")]
        out = []
        for f in files:
            try:
                with store.open_input_file(f) as source, zipfile.ZipFile(source) as z:
                    out += [Part(f, s) for s in office.sheet_names(z)]
            except Exception as e:  # one bad file never stops the others
                out.append(Part(f, None, _told(e)))
        return out or [Part("")]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.path:
            return
        head = (part.path, named(part.path))
        names = [x.split()[0] for x in SHAPES[self.kind].split(", ")][2:]

        def failed(text: str) -> tuple:
            return (*head, *("error" if n == "part" else text if n in ("text", "value_str") else None for n in names))

        if part.error:
            yield failed(part.error)
            return
        store, _ = store_of(self.path)
        try:
            with store.open_input_file(part.path) as source:
                if self.kind == "word":
                    for p in office.word_parts(source.read()):
                        yield (*head, *p)
                else:
                    with zipfile.ZipFile(source) as z:
                        for p in office.sheet_parts(z, *part.sheet, office.shared_strings(z), office.cell_formats(z)):
                            yield (*head, *p)
        except Exception as e:  # what was read before stays
            yield failed(_told(e))


class Folio(DataSource):
    """``spark.read.format("folio").option("kind", "excel" or "word").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "folio"

    def _kind(self) -> str:
        return self.options.get("kind", "excel")

    def schema(self) -> str:
        return SHAPES.get(self._kind(), SHAPES["excel"])

    def reader(self, schema) -> OfficeReader:
        return OfficeReader(self.options["path"], self._kind())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Folio)
