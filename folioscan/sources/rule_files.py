"""Rules and word lists from text files, tables and binary word lists."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions.text import let, regex, strip

#: Marks of comments, pairs and patterns in lines; column names by role.
COMMENT = r"^\s*(?:#|//|;|//|--)"
ARROW = r"=>|->|→|＝|=="
PATTERN = r"^\s*/.*/\s*$|\\d\{|\\[a-zA-Z]\{|\^|\$|[\[\]{}]\(|\(\?:|[a-zA-Z]+\("
ROLES = {"err": "错误|错词|错别字|误写|不规范|禁用|敏感|风险词|禁忌|口语|不当|问题词", "ok": "^正确|^规范|^标准|建议词|替换|纠正|纠错|修正词|^正词", "regex": "正则|pattern|表达式|匹配模式|校验规则|检测规则|^规则", "tag": "标签|级别|等级|severity|风险等级|分类|类别", "sug": "^建议|说明|备注|整改|提示|解释|理由", "name": "^名称|规则名称|^name"}
QUOTES = "[\"'“”]"


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(strip(c), f"^{QUOTES}+|{QUOTES}+$", "")


def classify_lines(lines: DataFrame) -> DataFrame:
    """(ord, kind, pattern, suggestion) of lines ``ord, line``: pairs by an arrow, patterns, pairs by a comma, plain entries; comments and long lines go."""
    line = strip(F.coalesce("line", F.lit("")))
    rows = lines.select("ord", line.alias("line")).where((F.col("line") != "") & ~F.col("line").rlike(regex(COMMENT)) & (F.length("line") <= 200))
    pair = F.transform(F.split("line", ARROW, 2), _unquoted)
    is_pair = F.col("line").rlike(ARROW) & (F.size(pair) == 2) & (F.length(F.get(pair, 0)).between(2, 32)) & (F.get(pair, 1) != "")
    head, tail = strip(F.split("line", "::", 2)[0]), strip(F.coalesce(F.get(F.split("line", "::", 2), 1), F.lit("")))
    bare = F.when(head.rlike("^/.+/$"), F.regexp_replace(head, "^/|/$", "")).otherwise(head)
    is_pattern = F.col("line").rlike(regex(PATTERN)) & (F.length(bare) >= 3)
    cells = F.transform(F.split("line", "[,，\t]", 3), _unquoted)
    bad, good = F.get(cells, 0), F.get(cells, 1)
    is_cells = (F.size(cells) >= 2) & F.length(bad).between(2, 32) & F.length(good).between(2, 32) & ~bad.rlike(regex(PATTERN))
    said = lambda c: F.concat(F.lit("外部纠错基准：标准写法为「"), c, F.lit("」"))
    third = F.coalesce(F.get(cells, 2), F.lit(""))
    plain = F.regexp_replace(F.col("line"), "^[\"'“”‘’]+|[\"'“”‘’]+$", "")
    made = lambda kind, p, s: F.struct(F.lit(kind).alias("kind"), p.alias("pattern"), s.alias("suggestion"))
    item = F.when(is_pair, made("pair", F.get(pair, 0), said(F.get(pair, 1)))).when(is_pattern, made("regex", bare, tail)).when(is_cells, made("pair", bad, F.when(third != "", third).otherwise(said(good)))).otherwise(made("entry", plain, F.lit("")))
    return rows.select("ord", item.alias("i")).select("ord", "i.*").where("kind = 'regex' or length(pattern) between 2 and 64")


def capped_draft(items: DataFrame, rules: int = 200, entries: int = 300) -> DataFrame:
    """Each pattern once, at its first place, and at most so many rules and entries."""
    kind = F.when(F.col("kind") == "regex", "rule").otherwise("entry")
    first = items.withColumn("_k", kind).withColumn("_n", F.row_number().over(W.partitionBy("_k", "pattern").orderBy("ord"))).where("_n = 1")
    place = first.withColumn("_n", F.row_number().over(W.partitionBy("_k").orderBy("ord")))
    return place.where(F.col("_n") <= F.when(F.col("_k") == "rule", rules).otherwise(entries)).drop("_k", "_n")


def text_lines(texts: DataFrame) -> DataFrame:
    """(ord, line) of one decoded text per file: ``texts`` has file_ord and text."""
    return texts.select((F.col("file_ord").cast("long") * (1 << 32)).alias("o"), F.posexplode(F.split("text", "\r\n|\n|\r")).alias("n", "line")).select((F.col("o") + F.col("n")).alias("ord"), "line")


def column_roles(header: list[str]) -> tuple[dict[str, int], bool]:
    """role -> column (-1: none) by the words of a header, and whether it is one."""
    find = lambda role, default: next((i for i, h in enumerate(header) if re.search(ROLES[role], h or "", re.IGNORECASE)), default)
    err = find("err", 0)
    roles = {"err": err, "ok": find("ok", 1 if err == 0 else 0), **{r: find(r, -1) for r in ("regex", "tag", "sug", "name")}}
    return roles, any(re.search(ROLES[r], h or "", re.IGNORECASE) for r in ("err", "regex", "name", "tag") for h in header)


def csv_rules(spark: SparkSession, path: str) -> DataFrame:
    """(ord, kind, name, pattern, suggestion, tag_text) of a table of rules, its columns told by their names, or by place if it has no header."""
    rows = spark.read.option("multiLine", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    cells = F.array(*(F.coalesce(strip(F.col(c)), F.lit("")) for c in rows.columns))
    rows = rows.select(F.monotonically_increasing_id().alias("ord"), cells.alias("c")).where(F.exists("c", lambda x: x != ""))
    first = rows.orderBy("ord").first()
    if first is None:
        return spark.createDataFrame([], "ord long, kind string, name string, pattern string, suggestion string, tag_text string")
    roles, has_header = column_roles([first["c"][0].removeprefix("﻿"), *first["c"][1:]])
    at = lambda role: F.coalesce(F.get("c", F.lit(roles[role])), F.lit("")) if roles[role] >= 0 else F.lit("")
    body = rows.where(F.col("ord") != first["ord"]) if has_header else rows
    name = F.when(at("name") != "", at("name")).otherwise("外部基准正则规则")
    good = F.when(at("sug") != "", at("sug")).when(at("ok") != "", F.concat(F.lit("标准写法为「"), at("ok"), F.lit("」"))).otherwise("")
    made = lambda kind, n, p, s, t: F.struct(F.lit(kind).alias("kind"), n.alias("name"), p.alias("pattern"), s.alias("suggestion"), t.alias("tag_text"))
    item = F.when(F.length(at("regex")) >= 3, made("regex", name, at("regex"), at("sug"), F.lit(""))).when(at("err") != "", made("pair", F.lit(""), at("err"), good, at("tag"))).otherwise(made("entry", F.lit(""), F.get("c", F.lit(0)), F.lit(""), F.lit("")))
    return body.select("ord", item.alias("i")).select("ord", "i.*").where("kind = 'regex' or length(pattern) between 2 and 64")


def csv_fields(line: Column, most: int = 16) -> Column:
    """The fields of one line of a table, as many as there can be columns; those that are not there are null."""
    read = F.from_csv(line, F.lit(", ".join(f"c{i} string" for i in range(most))))
    return let(read, lambda r: F.array(*(r[f"c{i}"] for i in range(most))))


def wordbank_import(lines: DataFrame) -> DataFrame:
    """(ord, keyword, tag, suggestion) of an import: a table if its first line begins with keyword and holds a comma, else lines as in ``wordbank_lines``.

    ``lines``: file, ord, line; a table's columns are found by name, in any order.
    """
    first = F.min_by("line", F.when(strip(F.col("line")) != "", F.col("ord"))).over(W.partitionBy("file"))
    rows = lines.withColumn("_head", strip(first)).withColumn("_at", F.min(F.when(strip(F.col("line")) != "", F.col("ord"))).over(W.partitionBy("file")))
    table = F.contains("_head", F.lit(",")) & F.startswith(F.replace(F.lower("_head"), F.lit(" "), F.lit("")), F.lit("keyword"))
    names = F.transform(csv_fields(F.lower("_head")), lambda c: strip(F.coalesce(c, F.lit(""))))
    value = lambda name: strip(F.coalesce(F.get(F.col("_c"), F.array_position(names, name).cast("int") - 1), F.lit("")))
    cut = rows.where(table & (F.col("ord") > F.col("_at"))).withColumn("_c", csv_fields(F.col("line")))
    own = cut.select("file", "ord", value("keyword").alias("keyword"), value("tag").alias("tag"), value("suggestion").alias("suggestion")).where("keyword <> ''")
    return own.unionByName(wordbank_lines(rows.where(~F.coalesce(table, F.lit(False))).select("file", "ord", "line"), "file"))


def wordbank_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """(ord, keyword, tag, suggestion) of lines ``ord, line`` in the form keyword|tag|suggestion; # begins a comment."""
    parts = F.transform(F.split("line", r"\|"), strip)
    rows = lines.withColumn("line", strip(F.col("line"))).where("line <> '' and not startswith(line, '#')")
    return rows.select(*keep, "ord", F.get(parts, 0).alias("keyword"), F.coalesce(F.get(parts, 1), F.lit("")).alias("tag"), F.coalesce(F.get(parts, 2), F.lit("")).alias("suggestion")).where("keyword <> ''")


def export_items(items: DataFrame, path: str, form: str = "csv") -> None:
    """Write rules or entries as a table, or as lines keyword|tag|suggestion."""
    if form == "csv":
        items.write.mode("overwrite").option("header", "true").csv(path)
    else:
        items.select(F.concat_ws("|", *[c for c in ("keyword", "pattern", "tag", "suggestion") if c in items.columns]).alias("value")).write.mode("overwrite").text(path)


def _word(raw: bytes, at: int, size: int) -> str | None:
    """A word of Chinese characters, or of letters and digits, that such a list could hold."""
    if not 2 <= size <= 256 or size % 2 or at + size > len(raw):
        return None
    word = raw[at : at + size].decode("utf-16-le", "ignore")
    chinese = sum("一" <= c <= "鿿" for c in word)
    plain = sum(c.isascii() and (c.isalnum() or c in "·_—") for c in word)
    if not 1 <= len(word) <= 64:
        return None
    likely = plain == 1 and not chinese if len(word) == 1 else chinese + plain >= max(2, int(0.6 * len(word)))
    return word.strip() if likely else None


def _records(raw: bytes, at: int, most: int) -> Iterator[str]:
    """Words of the compact variant from ``at`` on: zeros, a spelling that may be left out, the word, a mark and a frequency."""
    for _ in range(most):
        while at < len(raw) and not raw[at]:
            at += 1
        if at + 4 > len(raw):
            return
        kind, spelling = struct.unpack_from("<HH", raw, at)
        word, end = None, 0
        if kind in (1, 2, 3, 4) and 4 <= spelling <= 512 and spelling % 2 == 0 and at + 8 + spelling <= len(raw):
            size = struct.unpack_from("<H", raw, at + 4 + spelling)[0]
            word, end = _word(raw, at + 6 + spelling, size), at + 6 + spelling + size
        if word is None:
            word, end = _word(raw, at + 2, kind), at + 2 + kind
        if word is None or raw[end : end + 2] != b"\x0a\x00" or end + 4 > len(raw):
            return
        at = end + 4
        yield word


def binary_words(raw: bytes) -> list[str]:
    """Words of a binary word list, standard or compact."""
    if raw[4:7] == b"DCS":
        best, found = None, 9
        for at in range(0x100, min(len(raw) - 4, 0x20000), 2):
            n = sum(1 for _ in _records(raw, at, 50))
            if n > found:
                best, found = at, n
            if n >= 50:
                break
        return [w for w in _records(raw, best, len(raw)) if w] if best is not None else []
    words, at = [], 0x3B60
    while at + 14 <= len(raw):
        spelling, size = struct.unpack_from("<HH", raw, at)
        if not spelling or not size or size > 400 or at + 14 + size > len(raw):
            break
        word = raw[at + 4 : at + 4 + size].decode("utf-16-le", "ignore").strip()
        at += 4 + size + 8
        at += 2 + 2 * struct.unpack_from("<H", raw, at)[0] + 1
        if 2 <= len(word) <= 64:
            words.append(word)
    return words


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_of(contents: pd.Series) -> pd.Series:
    return contents.map(lambda raw: binary_words(bytes(raw or b"")))
