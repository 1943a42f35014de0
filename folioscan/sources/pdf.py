"""Text layer of PDF files, page by page, with the standard library: flate streams, simple encodings and ToUnicode maps; no OCR.

Streams in other filters, object streams with cross-reference streams beyond flate, and encrypted files are not read; a page without text is empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|[-+.\d]+|\[|\]|[A-Za-z'\"*]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.DOTALL)
    if not m:
        return b""
    if b"/FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return b""
    return m[1]


def _unicode_map(cmap: bytes) -> dict[int, str]:
    """Code -> text of a ToUnicode map."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            start = int(c, 16)
            for k in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                out[int(a, 16) + k] = chr(start + k) if start + k < 0x110000 else ""
    return out


def _string(token: bytes, codes: dict[int, str] | None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3})", lambda m: _ESCAPES.get(m[1], m[1]) if not m[1].isdigit() else bytes([int(m[1], 8) & 255]), token[1:-1])
    if codes:
        wide = max(codes) > 255 or token[:1] == b"<" and len(raw) % 2 == 0 and len(raw) >= 2
        step = 2 if wide else 1
        return "".join(codes.get(int.from_bytes(raw[i : i + step], "big"), "") for i in range(0, len(raw), step))
    return raw.decode("latin-1")


def page_texts(raw: bytes) -> Iterator[str]:
    """Text of each page in order."""
    objects = {int(n): body for n, body in _OBJECT.findall(raw)}
    for body in list(objects.values()):
        if b"/ObjStm" in body:
            data, first = _stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = list(map(int, data[:first].split()))
            spots = list(zip(heads[::2], heads[1::2], strict=True))
            for (n, at), nxt in zip(spots, [*(p for _, p in spots[1:]), len(data)], strict=True):
                objects.setdefault(n, data[first + at : first + nxt] if nxt != len(data) else data[first + at :])
    ref = lambda body, key: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if (m := re.search(key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)) else []
    maps = {n: _unicode_map(_stream(objects.get(t[0], b""))) for n, b in objects.items() if b"/Font" in b and (t := ref(b, rb"/ToUnicode"))}

    def pages(n: int, fonts: bytes, depth: int = 0) -> Iterator[str]:
        body = objects.get(n, b"")
        own = fonts + b"".join([body, *(objects.get(r, b"") for r in ref(body, rb"/Resources"))])
        own += b"".join(objects.get(r, b"") for r in ref(own, rb"/Font"))
        if re.search(rb"/Type\s*/Pages", body) and depth < 50:
            for kid in ref(body, rb"/Kids"):
                yield from pages(kid, own, depth + 1)
            return
        named = {name: maps.get(int(r)) for name, r in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", own)}
        out, codes, held = [], None, []
        for token in _TOKEN.findall(b"\n".join(_stream(objects.get(c, b"")) for c in ref(body, rb"/Contents"))):
            if token == b"Tf" and len(held) > 1:
                codes = named.get(held[-2][1:])
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                out += ["\n"] if token in (b"'", b'"') else []
                out += [_string(t, codes) for t in held if t[:1] in b"(<"]
            elif token in (b"T*", b"Td", b"TD", b"ET", b"Tm"):
                out.append("\n")
            if token[:1] in b"(<[]/+-.0123456789":
                held.append(token)
            else:
                held = []
        yield re.sub(r"\n\s*\n*", "\n", "".join(out)).strip()

    root = next((n for b in objects.values() if re.search(rb"/Type\s*/Catalog", b) for n in ref(b, rb"/Pages")), None)
    if root is not None:
        yield from pages(root, b"")


def page_rows(files: DataFrame) -> DataFrame:
    """(doc_id, page, text, error) of the PDF files among ``files`` that can be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for doc, raw in rows[["doc_id", "content"]].itertuples(index=False):
                try:
                    out = [(doc, n, t, None) for n, t in enumerate(page_texts(bytes(raw)), 1)]
                except Exception as e:  # as for the other formats
                    out = [(doc, None, None, f"{type(e).__name__} - {str(e)[:120]}")]
                yield pd.DataFrame(out, columns=["doc_id", "page", "text", "error"], dtype=object)

    return files.where("file_type = 'PDF' and error_message is null").select("doc_id", "content").mapInPandas(run, "doc_id long, page int, text string, error string")


def scanned(pages: DataFrame) -> DataFrame:
    """doc_id of files whose pages are all without text."""
    return pages.where("error is null").groupBy("doc_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("n")).where("n = 0").select("doc_id")
