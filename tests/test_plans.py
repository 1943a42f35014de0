"""Plans against plain versions: term conflicts, quotes in a corpus, chunks, imports, learned records, answers, and what is read of files."""

from __future__ import annotations

import difflib
import io
import json
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from folioscan import lexicon
from folioscan.config import Config
from folioscan.functions.text import needed, runs
from folioscan.operators import custom, textnorm
from folioscan.plans import check as checks
from folioscan.plans import extract, mine, review, rules
from folioscan.sources import files, rule_files
from tests.test_files import docx, para, pdf_file, xlsx


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_every_match_holds_a_needed_string():
    rng, seen = random.Random(1), 0
    patterns = [(p, re.IGNORECASE) for b in ("units", "grammar", "vocab", "asset_terms") for p, _ in lexicon.patterns(b)] + [(p, 0) for _, p, *_ in lexicon.sentence_patterns()] + [(r"\b" + e + r"(?:ing|s)?\b", re.IGNORECASE) for e, _ in lexicon.pairs("en_typo")]
    words = sorted({n for p, _ in patterns for n in needed(p)} | {"a", "an", "apple", "book", " ", "3", "，", "of", "has", "is", "The", "ſ", "K"})
    for _ in range(4000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 6)))
        for p, flags in patterns:
            if re.search(p, text.upper() if rng.random() < 0.1 else text, flags):
                seen += 1
                assert not needed(p) or any(n in text.lower().replace("ſ", "s").replace("ı", "i") for n in needed(p)), (p, text)
    assert seen > 4000 and needed(r"(?:a|bc)?x+y\b") in (("x",), ("y",))


def test_banks_are_computed_once(spark):
    units = spark.createDataFrame([(1, "word", "paragraph", 1, "p", "irregardless of 3 km")], "doc_id long, doc_type string, unit_kind string, unit_idx int, location string, text string")
    found = checks.text_issues(units, Config())
    out = io.StringIO()
    stdout, sys.stdout = sys.stdout, out
    try:
        found.explain("formatted")
    finally:
        sys.stdout = stdout
    plan = out.getvalue()
    assert plan.count("irregardless") <= 3  # the string it needs, and the pattern
    assert {r["rule_key"] for r in found.collect()} >= {"tn_vocab", "tn_units"}
    assert rows(textnorm.check(units.withColumn("text", F.lit("K㎞ 5 KM İs ſhe am")), Config()).select(F.explode("hits.rule_key")))


def test_runs_of_characters(spark):
    texts = ["abcdefgh", "ab", "", "a\nb\U0001f600c中d", None, "中国人民"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for k in (1, 3, 4):
        got = dict(rows(df.select("i", runs(F.col("t"), k))))
        some = dict(rows(df.select("i", runs(F.col("t"), k, mine.CHINESE))))
        for i, t in enumerate(texts):
            want = None if t is None else [t[j : j + k] for j in range(len(t) - k + 1)]
            assert got[i] == want and some[i] == (want and [w for w in want if re.search("[一-鿿]", w)] if want else want)


def plain_conflicts(counted, top=80, least=0.8, most=10):
    docs, out, seen = {}, [], set()
    for d, g, n in counted:
        if n >= 2:
            docs.setdefault(d, []).append((-n, g))
    terms = {d: [g for _, g in sorted(ts)[:top]] for d, ts in docs.items()}
    for d1 in sorted(terms):
        for d2 in sorted(terms):
            for r1, a in enumerate(terms[d1]) if d1 < d2 else ():
                for r2, b in enumerate(terms[d2]):
                    if len(a) == len(b) and a != b and a[:-1] != b[1:] and a[1:] != b[:-1] and difflib.SequenceMatcher(None, a, b).ratio() >= least:
                        out.append((d1, d2, r1, r2, a, b))
    for d1, d2, _, _, a, b in sorted(out):
        if frozenset((a, b)) not in seen:
            seen.add(frozenset((a, b)))
            yield d1, d2, a, b
        if len(seen) == most:
            return


def test_term_conflicts(spark):
    rng, counted = random.Random(4), []
    for d in range(12):
        grams = {"".join(rng.choices("甲乙丙丁戊己", k=rng.choice([3, 4, 5, 5, 6, 6]))) for _ in range(60)}
        counted += [(d, g, rng.randint(1, 5)) for g in grams]
    df = spark.createDataFrame(counted, "doc long, gram string, n long")
    for top, most in ((80, 10), (80, 40), (15, 1000)):
        want = list(plain_conflicts(counted, top, most=most))
        got = rows(mine.conflicts(df, top, most=most), "doc_a", "doc_b", "a", "b")
        assert len(want) > 3 and sorted(got) == sorted(want)
    with pytest.raises(ValueError):
        mine.conflicts(df, least=0.5)


def test_quotes_in_a_corpus(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc 中，.", k=rng.randint(0, 120))) for _ in range(60)] + [None]
    quotes = [texts[3][5:40], texts[7][:6], "a", "中", "", None, "...", "zz", texts[9]]
    strip = lambda t: re.sub(r"[^\w]", "", t or "")
    want = {(q, d) for q, x in enumerate(quotes) for d, t in enumerate(texts) if strip(x) and strip(x) in strip(t)}
    qs, ds = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sent in (1000, 2):
        got = rows(review.ground_in_corpus(qs, ds, most_sent=sent))
        assert len(got) == len(set(got)) and set(got) == want
    assert rows(review.ground_in_corpus(qs.where("false"), ds)) == []


def test_chunks_of_long_documents(spark):
    rng, blocks = random.Random(3), []
    for d in range(4):
        blocks += [(d, i, f"p{i}", "x" * rng.choice([1, 10, 90, 400])) for i in range(300)]
    want = {}
    for d in range(4):
        k, used, first = -1, 0, True
        for _, _, loc, t in (b for b in blocks if b[0] == d):
            if first or used + len(t) > 300:
                k, used, first = k + 1, 0, False
            used += len(t)
            if k < 20:
                want.setdefault((d, k), []).append((loc, t))
    got = rows(review.chunks(spark.createDataFrame(blocks, "doc_id long, seq int, location string, text string"), 300), "doc_id", "chunk", "location", "text", "chars")
    assert sorted(got) == sorted((d, k, ts[0][0], "\n".join(t for _, t in ts), sum(len(t) for _, t in ts)) for (d, k), ts in want.items())


def test_word_banks(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcd中文", k=40)) for _ in range(80)]
    words = sorted({"".join(rng.choices("abcd中文", k=rng.choice([1, 2, 3, 4]))) for _ in range(150)})
    units = spark.createDataFrame([(i, "word", "paragraph", 1, "p", t) for i, t in enumerate(texts)], "doc_id long, doc_type string, unit_kind string, unit_idx int, location string, text string")
    bank = spark.createDataFrame([("g", "n", ("all", "word", "excel")[i % 3], True, str(i), w, "", "", i % 7 != 0, i) for i, w in enumerate(words)], custom.ENTRIES)
    want = sorted((d, f"wb_g_{i}") for d, t in enumerate(texts) for i, w in enumerate(words) if w in t and i % 7 and i % 3 != 2)
    assert sorted(rows(custom.check_wordbank(units, bank), "doc_id", "rule_key")) == want


def test_generated_banks_and_rules(spark):
    good = {"wordbanks": [{"name": "", "entries": [{"keyword": f" k{i} ", "tag": "t" * 60, "suggestion": "s"} for i in range(50)]}, {"name": "empty", "entries": [{"keyword": " "}]}],
            "rules": [{"name": "a", "pattern": "r'x+'", "match_mode": "regex", "severity": "odd", "suggestion": "y"}, {"name": "b", "pattern": '"q"', "match_mode": "other"}, {"name": "", "pattern": "z"}] + [{"name": f"n{i}", "pattern": "p" * 300} for i in range(40)]}
    bad = {"rules": [{"name": "broken", "pattern": "(", "match_mode": "regex"}], "wordbanks": [{"name": "n", "entries": [{"keyword": "k"}]}]}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, None), (4, "{}")], "id long, json string")
    banks, made, failed = review.generated(df)
    assert sorted(rows(banks, "id", "bank", "n", "name", "keyword"))[:2] == [(1, 0, 0, "AI 生成词库", "k0"), (1, 0, 1, "AI 生成词库", "k1")]
    assert banks.count() == 40 and max(len(r["tag"]) for r in banks.collect()) == 41
    got = sorted(rows(made, "id", "n", "name", "match_mode", "pattern", "severity"))
    assert got[0] == (1, 0, "a", "regex", "x+", "medium") and got[1] == (1, 1, "b", "keyword", "q", "medium") and len(got) == 29 and len(got[-1][4]) == 201
    assert rows(failed) == [(2, "规则「broken」的正则无法编译")]


def test_import_and_learning(spark):
    own = spark.createDataFrame([(str(i), i, f"n{i}", m, p, "low", "t", s) for i, (m, p, s) in enumerate([("keyword", "咱们", "我们"), ("regex", "(", "x"), ("keyword", "甲", ""), ("keyword", "乙乙", "丙"), ("keyword", "乙乙", "丁"), ("keyword", "没选", "x")])], "id string, ord int, name string, match_mode string, pattern string, severity string, tag string, suggestion string")
    words = spark.createDataFrame([("e1", 1, "咱们", "t", "我们"), ("e2", 2, "大概", "t", "约"), ("e3", 3, "有了", "t", "x")], "id string, ord int, keyword string, tag string, suggestion string")
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    had = spark.createDataFrame([("keyword", None, "有了")], "kind string, match_mode string, value string")
    made = {r["kind"]: r for r in rules.build_import(own, words, ids(list("01234")), ids(["e1", "e2", "e3"]), had, "审计").collect()}
    assert [x["pattern"] for x in made["rule"]["items"]] == ["咱们", "乙乙"] and made["rule"]["name"] == "外部导入 · 审计 · 2 条"
    assert [x["pattern"] for x in made["entry"]["items"]] == ["大概"]
    assert rules.build_import(own, words, ids([]), ids([]), had).count() == 0
    proposed = spark.createDataFrame([("1", "wordbank", 1, "a", None, "帐号", "账号", "low"), ("2", "wordbank", 2, "b", None, "有了", "x", "low"), ("3", "rule", 3, "c", "regex", "(", "x", "low"), ("4", "rule", 4, "d", "keyword", "做为", "作为", "low"), ("5", "rule", 5, "e", "keyword", "做为", "作为", "low")], "entity_id string, kind string, ord int, name string, match_mode string, pattern string, suggestion string, severity string")
    kept, others = review.learn(proposed, had, "s1")
    assert sorted(rows(kept, "entity_id", "sample_id", "group_id")) == [("1", "s1", "learned_words"), ("4", "s1", "learned_rules")] and others.count() == 3
    merged = review.merge_learned(kept.where("entity_id = '1'"), kept)
    assert sorted(rows(merged, "entity_id")) == [("1",), ("4",)]


def test_word_bank_imports(spark):
    lines = [("a", 0, ""), ("a", 1, " Keyword , suggestion,tag"), ("a", 2, '"帐, 号",账号,错'), ("a", 3, ",x,y"), ("a", 4, "大概"), ("b", 0, "# no"), ("b", 1, "keyword|t|s"), ("b", 2, "only")]
    got = rows(rule_files.wordbank_import(spark.createDataFrame(lines, "file string, ord long, line string")), "file", "ord", "keyword", "tag", "suggestion")
    assert sorted(got) == [("a", 2, "帐, 号", "错", "账号"), ("a", 4, "大概", "", ""), ("b", 1, "keyword", "t", "s"), ("b", 2, "only", "", "")]


def test_log_grows(spark, tmp_path):
    from folioscan.plans import issues

    for n in range(3):
        review.append_log(spark.createDataFrame([(n, f"e{n}")], "ts long, event string"), str(tmp_path / "log"))
    assert rows(issues.page_of_log(spark.read.json(str(tmp_path / "log")), 0, 2), "event") == [("e2",), ("e1",)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("texts")
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in (["甲", "乙"], ["甲", ""], ["1", "2"])) + "</w:tbl>"
    (at / "one.docx").write_bytes(docx(para("第一段文字") + para("短") + para("  ") + table + para("咱们的的最后一段")))
    (at / "two.xlsx").write_bytes(xlsx([("表一", '<sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>名称</t></is></c><c r="C1" t="inlineStr"><is><t>数</t></is></c></row><row r="3"><c r="A3"><f>B1+1</f><v>5</v></c></row></sheetData>')]))
    (at / "three.pdf").write_bytes(pdf_file([b"BT /F1 12 Tf (first page text) Tj ET", b"BT /F1 12 Tf (ab) Tj ET"]))
    (at / "note.md").write_bytes("# 参考资料正文，足够长\xff".encode("utf-8", "ignore"))
    (at / "few.txt").write_bytes(b"short")
    (at / "bad.docx").write_bytes(b"PK-nothing")
    return str(at)


def test_files_are_read_and_parsed_once(spark, folder):
    result = checks.check(spark, folder)
    for frame in (result.units, result.issues, result.file_results):
        out = io.StringIO()
        stdout, sys.stdout = sys.stdout, out
        try:
            frame.explain("formatted")
        finally:
            sys.stdout = stdout
        assert "MapInPandas" not in out.getvalue() and "binaryFile" not in out.getvalue()
    assert {r["file_name"]: r["status"] for r in result.file_results.collect()}["bad.docx"] == "error"
    assert "tn_grammar" in {r["rule_key"] for r in result.issues.collect()}


def test_texts_of_files(spark, folder):
    parsed = checks.parse(spark, folder)
    blocks = extract.review_blocks(parsed).orderBy("doc_id", "seq").collect()
    said = {(r["location"], r["text"]) for r in blocks}
    assert said == {("第 1 段", "第一段文字"), ("第 4 段", "咱们的的最后一段"), ("表 1 第 1 行", "甲 | 乙"), ("表 1 第 3 行", "1 | 2"), ("「表一」第 1 行", "名称 | 数"), ("第 1 页", "first page text")}
    assert review.chunks(extract.review_blocks(parsed)).count() == 3
    chunks = rows(extract.template_chunks(parsed.word).orderBy("chunk_idx"), "page", "chunk_idx", "text")
    assert chunks == [(1, i, t) for i, t in enumerate(["第一段文字", "短", "咱们的的最后一段", "甲", "乙", "1", "2"], 1)]
    assert sorted(rows(extract.page_chunks(parsed.pages), "page", "text")) == [(1, "first page text"), (2, "ab")]
    refs = {r["name"]: r for r in extract.reference_texts(parsed, files.list_files(spark, folder)).collect()}
    assert refs["few.txt"]["error"] and not refs["note.txt"]["error"] and refs["one.txt"]["text"].split("\n")[-1] == "2" and refs["three.txt"]["text"] == "first page text\nab"


def test_json_is_mended(spark):
    rng = random.Random(5)
    for _ in range(200):
        value = {"rules": [{"name": rng.choice(["a", 'say "x"', "b\\c"]), "n": rng.randint(0, 9)} for _ in range(rng.randint(0, 3))], "wordbanks": []}
        text = json.dumps(value, ensure_ascii=False)
        for broken in (text, re.sub(r"\}$", ",}", text), "so: ```json\n" + text + "\n``` end", text.rstrip("}") if not value["rules"] else text, "{bad} " + text):
            got = review.repaired(broken)
            assert got is not None and json.loads(got) == value, broken
    assert review.repaired("nothing") is None and review.repaired(None) is None
    assert rows(spark.createDataFrame([('{"rules": [1,],}',), (None,)], "c string").select(review.repair_json("c"))) == [('{"rules": [1]}',), (None,)]


def test_text_changes(spark):
    pairs = spark.createDataFrame([(1, "a\nb b\nc", "a\nb  x\nc"), (2, "same", "same"), (3, "a\n\nb", "a\nnew\nb"), (4, None, "x"), (5, "q\nr", "q\n r ")], "pair_id long, old_text string, new_text string")
    assert sorted(rows(review.diff_pairs(pairs), "pair_id", "n", "old", "new")) == [(1, 0, "b b", "b x")]


def test_tables_have_pages_and_blank_files_go(spark, tmp_path):
    table = lambda n: "<w:tbl>" + "<w:tr><w:tc><w:p><w:r><w:t>咱们</w:t></w:r></w:p></w:tc></w:tr>" * n + "</w:tbl>"
    (tmp_path / "long.docx").write_bytes(docx("".join(para("一" * 40) for _ in range(15)) + table(45) + table(1)))
    (tmp_path / "blank.docx").write_bytes(docx(""))
    (tmp_path / "clean.docx").write_bytes(docx(para("清楚的正文。")))
    result = checks.check(spark, str(tmp_path))
    places = {r["location"] for r in result.units.where("unit_kind = 'cell'").collect()}
    # 15 paragraphs of two lines, 40 lines of the first table, one of the second
    assert "第 2 页（估算） · 表 1 第 45 行第 1 列" in places and "第 2 页（估算） · 表 2 第 1 行第 1 列" in places
    assert {r["file_name"]: r["status"] for r in result.file_results.collect()} == {"long.docx": "issue", "clean.docx": "pass"}


def test_report_rows_and_exports(spark, tmp_path):
    from folioscan.plans import report

    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    totals = spark.createDataFrame([(5, 2, 1, 9)], "total_files int, issue_files int, error_files int, total_issues int")
    assert rows(report.cover(totals, at, "某人").orderBy("no"), "key", "value")[3:6] == [("发现问题总数", "9 处"), ("检测时间", "2024 年 01 月 02 日 03:04"), ("检测人", "某人")]
    types = spark.createDataFrame([("Word", 2), ("不支持", 1)], "file_type string, files long")
    info = dict(rows(report.basic_info(types, rules.enabled_by_section(spark, Config()), at), "key", "value"))
    assert info["检测范围"] == "Word 文档 2 个、Excel 文档 0 个、PDF 文档 0 个、不支持格式 1 个" and info["启用规则"].startswith("Word 规则 2")
    items = spark.createDataFrame([("invalid", "rule", "g", "n", "p", "s", "r", "学习"), ("duplicate", "bank", "f", None, "x", None, None, None)], "category string, source string, `group` string, name string, pattern string, suggestion string, reason string, source_tag string")
    report.write_table(report.backup_table(items), str(tmp_path / "table"))
    raw = (tmp_path / "table" / "table.csv").read_bytes()
    assert raw.startswith("\ufeff分类,来源".encode()) and "无效,自定义规则,g,n,p,s,r,学习".encode() in raw
    assert rows(report.backup_lines(items)) == [("[无效] 自定义规则｜g｜n（学习）\n    匹配式：p\n    建议：s\n    原因：r",), ("[重复] 内置词库｜f｜\n    匹配式：x",)]
    learned = spark.createDataFrame([("rule", "n", None, "p", "high", "s", True), ("wordbank", None, None, "帐号", None, "账号", False)], "kind string, name string, match_mode string, pattern string, severity string, suggestion string, enabled boolean")
    assert rows(report.learned_lines(learned, "rules")) == [("规则名：n\n匹配模式：keyword\n匹配式：p\n级别：high\n建议替换：s\n启用：是\n---",)]
    assert rows(report.learned_lines(learned, "wordbanks")) == [("帐号 → 账号（禁用）",)]
    assert report.learned_table(learned, "wordbanks").columns == list(report.WORD_HEADER)


def test_stored_groups(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"groups": [{"id": "g", "name": "组", "rules": [{"id": "r1", "name": "a", "match_mode": "keyword", "pattern": "咱们", "severity": "low"}, {"id": "r2", "pattern": "x", "enabled": False}]}, {"id": "h", "scope": "word", "enabled": False, "rules": []}]}, indent=2))
    (tmp_path / "broken.json").write_text('{"groups": [')
    read = rules.load_groups(spark, str(tmp_path / "rules.json"))
    assert rows(read.orderBy("ord"), "gid", "scope", "g_enabled", "rid", "enabled", "pattern") == [("g", "all", True, "r1", True, "咱们"), ("g", "all", True, "r2", False, "x")]
    assert read.schema.names == spark.createDataFrame([], custom.RULES).schema.names
    for path in ("broken.json", "none.json"):
        assert rules.load_groups(spark, str(tmp_path / path)).count() == 0
    rules.save_groups(read, str(tmp_path / "saved"))
    assert sorted(rows(rules.load_groups(spark, str(tmp_path / "saved")))) == sorted(rows(read))
    words = spark.createDataFrame([("g", "n", "all", True, "e1", "k", "t", "s", True, 0)], custom.ENTRIES)
    rules.save_groups(words, str(tmp_path / "words"), "entries")
    assert rows(rules.load_groups(spark, str(tmp_path / "words"), "entries")) == rows(words)


def test_sources_of_a_sample_against_its_revision(spark):
    sources = spark.createDataFrame([("s", 1, "a\nb"), ("s", 2, "a\nc"), ("t", 3, "q")], "sample_id string, doc_id long, text string")
    pairs = review.revision_pairs(sources, spark.createDataFrame([("s", "a\nB")], "sample_id string, text string"))
    assert sorted(rows(review.diff_pairs(pairs), "pair_id.doc_id", "old", "new")) == [(1, "b", "B"), (2, "c", "B")]
