"""Rules out of reference texts: lists of words, forbidden phrases, model sentences, formats in use, terms written in two ways."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioscan.functions.text import regex, strip
from folioscan.staging import stage

#: Tags with their severities, word lists, formats and their patterns.
TAGS = {"笔误警示": "medium", "表述优化建议": "low", "格式严重错误": "high", "执业风险警示": "high"}
RISK = "保证 承诺 确保 一定 绝对 最优 最佳 唯一 必然 稳赚 无风险 零风险 百分百 百分之百 全部责任 无条件 第一品牌 领先水平 国际一流 国内首创 绝无仅有 万无一失 板上钉钉 必定 毫无疑问".split()
COLLOQUIAL = "咱们 差不多 大概 好像 挺不错 蛮好 有点 有点儿 搞一下 弄一下 就是说 等等吧 回头 挺好的 一大堆 说白了 说白了就是 打个比方 众所周知".split()
TYPOS = [
    ("截至", "截止"), ("账号", "帐号"), ("其他", "其它"), ("作为", "做为"), ("部署", "布署"), ("即使", "既使"), ("青睐", "亲睐"), ("一如既往", "一如继往"), ("坐落", "座落"), ("综合", "综和"), ("评估", "评诂"), ("核算", "合算"), ("审计", "审记"), ("分录", "分路"),
    ("报表", "爆表"), ("预算", "予算"), ("折旧", "折旧"), ("摊销", "摊消"), ("资产", "资産"), ("负债", "负馈"), ("权益", "权宜"), ("收益", "收溢"), ("利润", "利闰"), ("现金流量", "现金流动量"), ("净值", "净直"), ("公允", "工允"), ("持续经营", "持继经营"),
]
DATES = [("中文", r"\d{4}年\d{1,2}月\d{1,2}日"), ("短横线", r"\d{4}-\d{1,2}-\d{1,2}"), ("斜杠", r"\d{4}/\d{1,2}/\d{1,2}"), ("点号", r"\d{4}\.\d{1,2}\.\d{1,2}")]
AMOUNT = r"\d+(?:\.\d+)?\s*(?:元|万元|亿元)"
AMOUNT_RULES = [(r"\d+(?:\.\d+)?\s+元", "数字与「元」之间夹有空格"), (r"\d+(?:\.\d+)?\s+万元", "数字与「万元」之间夹有空格"), ("元人民币", "「元人民币」语序不当，规范写法为「人民币…元」"), (r"人民币\s*(\d+(?:\.\d+)?)\s*[RMB￥¥]?\s*(?!元)", "人民币金额缺少计量单位「元」")]
SEQUENCES = [("一、", r"^\s*[一二三四五六七八九十百]{1,4}\s*、"), ("1.", r"^\s*\d{1,3}\s*[.．](?![0-9])"), ("1、", r"^\s*\d{1,3}\s*、"), ("（1）", r"^\s*[（(]\s*\d{1,3}\s*[）)]")]
FORBIDDEN = r"(?:不得|严禁|禁止|不应|不能)\s*([^，。；,!！?？、\n]{2,16})"
NORMS = "应当 必须 应 按照 依据 根据 遵循".split()
CHINESE = "一-鿿"
_CHINESE = re.compile(f"[{CHINESE}]")
PUNCT = "[，。；：、！？!?,.、:;()（）「」『』【】《》“”\"'\\-—–·…]"


def sentences(text: Column) -> Column:
    """Sentences of 4 to 80 characters that are not numbers alone."""
    parts = F.transform(F.split(text, "[。！？；\n\r]+"), lambda s: F.regexp_replace(strip(s), "[　 ]+", ""))
    return F.filter(parts, lambda s: F.length(s).between(4, 80) & ~s.rlike(regex(r"^[\d\s.,%¥￥元万元亿%，、（）()\-]+$")))


def _numbered(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("sents", sentences(F.coalesce("text", F.lit(""))))


def word_entries(chunks: DataFrame, most: int = 300) -> DataFrame:
    """(keyword, tag, doc, page) of listed words that occur, first occurrence of each, at most ``most``. A right spelling proposes the wrong one.

    ``chunks``: doc, page, chunk_idx, text.
    """
    words = [(w, w, "执业风险警示") for w in RISK] + [(w, w, "表述优化建议") for w in COLLOQUIAL] + [(good, bad, "笔误警示") for good, bad in TYPOS]
    bank = F.array(*(F.struct(F.lit(s).alias("seek"), F.lit(k).alias("keyword"), F.lit(t).alias("tag"), F.lit(n).alias("n")) for n, (s, k, t) in enumerate(words)))
    found = chunks.select("doc", "page", "chunk_idx", F.inline(F.filter(bank, lambda e: F.contains(F.col("text"), e["seek"]))))
    first = found.groupBy("keyword").agg(F.min(F.struct("doc", "chunk_idx", "n", "tag", "page")).alias("f"))
    return first.orderBy("f.doc", "f.chunk_idx", "f.n").limit(most).select("keyword", F.col("f.tag").alias("tag"), F.col("f.doc").alias("doc"), F.col("f.page").alias("page"))


def forbidden(chunks: DataFrame, most: int = 200) -> DataFrame:
    """(phrase, doc, page) of what sentences forbid; one phrase a sentence, each phrase once."""
    found = _numbered(chunks).select("doc", "page", "chunk_idx", F.posexplode("sents").alias("n", "sent"))
    phrase = F.regexp_replace(F.regexp_replace(F.regexp_extract("sent", regex(FORBIDDEN), 1), r"(?U)\s", ""), PUNCT, "")
    found = found.withColumn("phrase", phrase).where("length(phrase) >= 2 and phrase not in ('的', '其', '该')")
    first = found.groupBy("phrase").agg(F.min(F.struct("doc", "chunk_idx", "n", "page")).alias("f"))
    return first.orderBy("f.doc", "f.chunk_idx", "f.n").limit(most).select("phrase", F.col("f.doc").alias("doc"), F.col("f.page").alias("page"))


def references(chunks: DataFrame, per_chunk: int = 20, most: int = 60) -> DataFrame:
    """(sentence, doc, page) of sentences of 8 to 60 characters with a verb of norm, each once."""
    norm = lambda s: F.exists(F.array(*map(F.lit, NORMS)), lambda v: F.contains(s, v))
    some = F.slice(F.filter("sents", lambda s: norm(s) & F.length(s).between(8, 60)), 1, per_chunk)
    found = _numbered(chunks).select("doc", "page", "chunk_idx", F.posexplode(some).alias("n", "sentence"))
    first = found.groupBy("sentence").agg(F.min(F.struct("doc", "chunk_idx", "n", "page")).alias("f"))
    return first.orderBy("f.doc", "f.chunk_idx", "f.n").limit(most).select("sentence", F.col("f.doc").alias("doc"), F.col("f.page").alias("page"))


def _mode(counts: DataFrame, names: list[str], least: int) -> DataFrame:
    """(style, n, main): styles in use, if there are ``least`` uses and two styles; the most frequent is main, the first named among equals."""
    rows = counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(n).alias("style"), F.col(f"c{k}").alias("n")) for k, n in enumerate(names)))))
    every = W.partitionBy()  # one row per style
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("rank"))).over(every)["rank"]
    rows = rows.withColumn("main", best == F.col("rank")).withColumn("_total", F.sum("n").over(every)).withColumn("_used", F.count_if(F.col("n") > 0).over(every))
    return rows.where(f"_total >= {least} and _used > 1 and n > 0").select("style", "n", "main")


def date_styles(chunks: DataFrame) -> DataFrame:
    counts = chunks.agg(*(F.coalesce(F.sum(F.size(F.regexp_extract_all("text", F.lit(regex(p)), F.lit(0)))), F.lit(0)).alias(f"c{k}") for k, (_, p) in enumerate(DATES)))
    return _mode(counts, [n for n, _ in DATES], 2)


def sequence_styles(chunks: DataFrame) -> DataFrame:
    lines = chunks.select(F.explode(F.split("text", "\n")).alias("line")).select(strip(F.col("line")).alias("line"))
    counts = lines.agg(*(F.count_if(F.col("line").rlike(regex(p))).alias(f"c{k}") for k, (_, p) in enumerate(SEQUENCES)))
    return _mode(counts, [n for n, _ in SEQUENCES], 3)


def amount_rules(chunks: DataFrame) -> DataFrame:
    """(pattern, note): four fixed rules, if any amount of money occurs."""
    rules = chunks.sparkSession.createDataFrame(AMOUNT_RULES, "pattern string, note string")
    return rules.join(chunks.agg(F.bool_or(F.col("text").rlike(regex(AMOUNT))).alias("any")).where("any")).select("pattern", "note")  # one row


def whole_texts(chunks: DataFrame) -> DataFrame:
    """(doc, text): the chunks of each document in order, nothing between them; ``chunks``: doc, chunk_idx, text."""
    own = chunks.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))).alias("c"))  # one text a document
    return own.select("doc", F.array_join(F.transform("c", lambda x: x["text"]), "").alias("text"))


def _gram_counts(text: str, low: int, high: int) -> Counter[str]:
    if not _CHINESE.search(text):
        return Counter()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((points >= ord(CHINESE[0])) & (points <= ord(CHINESE[2])))])
    return Counter(text[i : i + k] for k in range(low, high + 1) for i in np.flatnonzero(before[k:] > before[:-k]).tolist())


def grams(texts: DataFrame, low: int = 3, high: int = 6, least: int = 1) -> DataFrame:
    """(doc, gram, n): runs of ``low`` to ``high`` characters that hold a Chinese one and occur ``least`` times or more, counted within each document; ``texts``: doc (each once), text.

    A text is counted where it is: nothing is shuffled, and no task holds the counts of more than one document.
    """
    shape = T.StructType([texts.schema["doc"], T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    types = [f.type for f in to_arrow_schema(shape)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, said, counts = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = [(g, n) for g, n in _gram_counts(text or "", low, high).items() if n >= least]
                at += [k] * len(found)
                said += [g for g, _ in found]
                counts += [n for _, n in found]
                if len(at) >= 1 << 16 or k == batch.num_rows - 1:
                    for i in range(0, len(at), 1 << 16):
                        part = slice(i, i + (1 << 16))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[part], pa.int64())).cast(types[0]), pa.array(said[part], types[1]), pa.array(counts[part], types[2])], names=shape.names)
                    at, said, counts = [], [], []

    return texts.select("doc", "text").mapInArrow(run, shape)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters, in order."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def conflicts(counted: DataFrame, top: int = 80, least: float = 0.8, most: int = 10) -> DataFrame:
    """(doc_a, doc_b, a, b, ratio): frequent terms of equal length in two documents that are nearly but not quite the same, from the pairs of documents in order.

    Terms of fewer than ten characters of which at least 0.8 match, in order, share all but one: they meet on what is left when one character is taken
    out, and are long enough for that. Distinct terms are joined, not documents; then each pair of terms finds its first two documents. The terms are stored, as three
    steps read them.
    """
    if least < 0.8:
        raise ValueError("terms that are less alike may differ in more than one character")
    rank = F.row_number().over(W.partitionBy("doc").orderBy(F.desc("n"), "gram"))
    terms = counted.where("n >= 2 and length(gram) < 10").withColumn("r", rank).where(F.col("r") <= top).select("doc", "gram", "r")
    # of shorter ones, all but one character is less than what must match
    terms = stage(terms.where((F.length("gram") - 1) / F.length("gram") >= least), "terms")
    spans = stage(terms.groupBy("gram").agg(F.min(F.struct("doc", "r")).alias("first"), F.max("doc").alias("last")), "spans")
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda i: F.concat(F.substring("gram", F.lit(1), i - 1), F.lit("\u0000"), F.substring("gram", i + 1, F.length("gram")))))
    left = F.explode(F.transform(cut, lambda c: F.struct(F.replace(c, F.lit("\u0000"), F.lit("")).alias("rest"), F.length("gram").alias("len"))))
    meets = spans.select("gram", left.alias("k")).distinct()
    both = meets.select(F.col("gram").alias("a"), "k").join(meets.select(F.col("gram").alias("b"), "k"), "k").where("a <> b").where("substring(a, 1, k.len - 1) <> substring(b, 2) and substring(a, 2) <> substring(b, 1, k.len - 1)").select("a", "b").distinct()
    alike = both.withColumn("ratio", likeness("a", "b")).where(F.col("ratio") >= least)
    # the first document of a, if b is in a later one; then the first of those
    known = alike.join(spans.select(F.col("gram").alias("a"), F.col("first.doc").alias("doc_a"), F.col("first.r").alias("r_a")), "a").join(spans.select(F.col("gram").alias("b"), "last"), "b").where("doc_a < last")
    later = known.join(terms.select(F.col("gram").alias("b"), F.col("doc").alias("doc_b"), F.col("r").alias("r_b")), "b").where("doc_a < doc_b")
    once = later.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("doc_a", "doc_b", "r_a", "r_b", "a", "b", "ratio")).alias("f"))
    return once.orderBy("f.doc_a", "f.doc_b", "f.r_a", "f.r_b", "x", "y").limit(most).select("f.doc_a", "f.doc_b", "f.a", "f.b", "f.ratio")


def tag_of(keyword: Column, default: str = "笔误警示") -> Column:
    """Tag by content: absolute or promising words, then colloquial ones, else the default."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(keyword, w))
    return F.when(has(RISK), "执业风险警示").when(has(COLLOQUIAL), "表述优化建议").otherwise(default)


def tag_from_words(text: Column) -> Column:
    """Tag named by a column of a table of rules."""
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return F.when(has("风险", "禁用", "绝对", "承诺", "警示", "敏感"), "执业风险警示").when(has("格式", "严重", "错误"), "格式严重错误").when(has("优化", "表述", "口语", "书面"), "表述优化建议").when(has("笔误", "错别字", "纠错", "错词", "误写"), "笔误警示")


def severity_of(tag: Column) -> Column:
    return F.coalesce(*(F.when(tag == t, s) for t, s in TAGS.items()), F.lit("low"))
