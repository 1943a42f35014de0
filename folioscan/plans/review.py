"""Around a reviewer that is plugged in: packing blocks into requests, grounding quotes, reading and repairing answers, comparing texts."""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions.text import clip, let, runs, strip
from folioscan.plans import diff
from folioscan.plans.rules import compiles, filter_batch

#: Fixed value: kinds of findings of a reviewer.
CATEGORIES = ("用词不当", "句型语病", "错别字", "数据错误", "表格计算", "逻辑矛盾", "内容缺失", "规范不符", "其他")
ANSWER = "array<struct<quote:string,category:string,issue:string,detail:string,suggestion:string,severity:string>>"


def chunks(blocks: DataFrame, max_chars: int = 3000, max_requests: int = 20) -> DataFrame:
    """(doc_id, chunk, location, text, chars): blocks put together in order until one more would be over ``max_chars``; line breaks don't count.

    ``blocks``: doc_id, seq, location, text. Each document is folded over its own blocks; a block that is too large is a chunk of its own. A chunk holds at
    most ``max_chars`` if every block counts as that much at most, so blocks that come after ``max_requests`` times as many are in no request and aren't collected.
    """
    before = F.coalesce(F.sum(F.least(F.length("text"), F.lit(max_chars))).over(W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.where("text <> ''").withColumn("_before", before).where(F.col("_before") <= max_requests * max_chars).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "location", "text"))).alias("b"))
    # the fold keeps numbers only: chunk number of each block
    start = F.struct(F.lit(-1).alias("k"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("ks"))

    def step(acc: Column, b: Column) -> Column:
        size = F.length(b["text"])
        fresh = (acc["k"] < 0) | (acc["chars"] + size > max_chars)
        k = F.when(fresh, acc["k"] + 1).otherwise(acc["k"])
        return F.struct(k.alias("k"), F.when(fresh, size).otherwise(acc["chars"] + size).alias("chars"), F.concat(acc["ks"], F.array(k)).alias("ks"))

    numbered = rows.withColumn("ks", F.aggregate("b", start, step, lambda acc: acc["ks"]))
    flat = numbered.select("doc_id", F.inline(F.zip_with("b", "ks", lambda b, k: F.struct(k.alias("chunk"), b["seq"].alias("seq"), b["location"].alias("location"), b["text"].alias("text")))))
    whole = flat.where(F.col("chunk") < max_requests).groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", "location", "text"))).alias("b"), F.sum(F.length("text")).alias("chars"))
    return whole.select("doc_id", "chunk", F.get("b", 0)["location"].alias("location"), F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"), "chars")


def bare(text: Column) -> Column:
    """Letters, digits and underscores only."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w]", "")


def grounded(quote: Column, source: Column, shingle: int = 8) -> Column:
    """Whether a quote is in its source, in whole or by any run of ``shingle`` characters, white space and marks aside."""
    q, s = bare(quote), bare(source)
    any_run = let(s, lambda whole: (F.length(q) > shingle) & F.exists(runs(q, shingle), lambda r: F.contains(whole, r)))
    return F.when((F.coalesce(quote, F.lit("")) == "") | (F.coalesce(source, F.lit("")) == ""), True).otherwise((q != "") & (F.contains(s, q) | any_run))


def ground_in_corpus(quotes: DataFrame, docs: DataFrame, shingle: int = 8, most_sent: int = 200_000) -> DataFrame:
    """(quote_id, doc_id): documents that hold a quote whole, white space and marks aside; quotes without letters or digits are in none.

    Each quote waits at its first ``shingle`` characters, or all of them if it is shorter, and documents are cut into runs of the lengths that are asked for, so
    no pair of quote and document is formed without a shared run. Up to ``most_sent`` quotes go to all tasks, and documents stay where they are; more of them are
    joined on the run, and texts are fetched for what meets.
    """
    asked = quotes.select("quote_id", bare(F.col("quote")).alias("q")).where("q <> ''").withColumn("run", F.substring("q", 1, shingle))
    texts = docs.select("doc_id", bare(F.col("text")).alias("s"))
    lengths = [r[0] for r in asked.select(F.length("run")).distinct().collect()]  # at most ``shingle`` rows
    cut = F.array_distinct(F.concat(*(runs(F.col("s"), k) for k in lengths))) if lengths else F.array().cast("array<string>")
    if asked.limit(most_sent + 1).count() <= most_sent:
        found = texts.select("doc_id", "s", F.explode(cut).alias("run")).join(F.broadcast(asked), "run").where("contains(s, q)")
    else:
        met = texts.select("doc_id", F.explode(cut).alias("run")).join(asked, "run").select("doc_id", "quote_id", "q").distinct()
        found = met.join(texts, "doc_id").where("contains(s, q)")
    return found.select("quote_id", "doc_id").distinct()


def parse_answers(answers: DataFrame) -> DataFrame:
    """(doc_id, chunk, n, quote, category, issue, detail, suggestion, severity): findings in answers, with quotes that are in the source, each once.

    ``answers``: doc_id, chunk, content, source. What stands between the first [ and the last ] is read as JSON.
    """
    body = F.regexp_extract("content", r"(?s)\[.*\]", 0)
    rows = answers.select("doc_id", "chunk", "source", F.posexplode(F.from_json(body, ANSWER)).alias("n", "f")).select("doc_id", "chunk", "source", "n", "f.*")
    value = lambda c: strip(F.coalesce(c, F.lit("")))
    rows = rows.withColumns({c: value(F.col(c)) for c in ("quote", "issue", "detail", "suggestion", "category")}).where("quote <> '' and issue <> ''").where(grounded(F.col("quote"), F.col("source")))
    category = F.coalesce(*(F.when(F.col("category") == c, c) for c in CATEGORIES), *(F.when(F.contains("category", F.lit(c)), c) for c in CATEGORIES), F.lit("其他"))
    rows = rows.withColumn("severity", F.when(F.col("severity").isin("high", "medium", "low"), F.col("severity")).otherwise("medium")).withColumn("category", category)
    return once(rows, "chunk", "n").select("doc_id", "chunk", "n", clip(F.col("quote"), 120).alias("quote"), "category", "issue", "detail", "suggestion", "severity")


def once(found: DataFrame, *order: str) -> DataFrame:
    """The first finding of each quote and issue within a document, marks and spaces aside."""
    same = W.partitionBy("doc_id", bare(F.col("quote")), bare(F.col("issue"))).orderBy(*order)
    return found.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def merge_references(refs: DataFrame, max_chars: int) -> DataFrame:
    """(name, head): enabled reference texts in order, cut where they reach ``max_chars`` together."""
    rows = refs.where("enabled").withColumn("text", strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    before = F.coalesce(F.sum(F.length("text")).over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a handful of files
    rows = rows.withColumn("left", F.lit(max_chars) - before).where("left > 0")
    return rows.select("name", F.concat(F.lit("【"), "name", F.lit("】\n"), F.col("text").substr(F.lit(1), F.col("left").cast("int"))).alias("head"), "ord")


def ask(requests: DataFrame, reviewer: Callable[[str], str], gap: float = 0) -> DataFrame:
    """``requests`` (prompt and any other columns) with the reviewer's answers; a call that fails leaves content null and says so in error.

    The calls of a task begin at least ``gap`` seconds apart. ``answers.ask`` keeps the answers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began = -math.inf
        for rows in batches:
            out = []
            for prompt in rows["prompt"]:
                time.sleep(max(0.0, began + gap - time.monotonic()))
                began = time.monotonic()
                try:
                    out.append((reviewer(prompt), None))
                except Exception as e:  # a failing call must not stop the others
                    out.append((None, f"{type(e).__name__}: {e}"[:200]))
            yield rows.assign(content=[c for c, _ in out], error=[e for _, e in out])

    return requests.mapInPandas(run, T.StructType([*requests.schema, T.StructField("content", T.StringType()), T.StructField("error", T.StringType())]))


def prompts(pieces: DataFrame, base: str, role: str = "", style: str = "", references: str = "", user: str = "") -> DataFrame:
    """``pieces`` with prompt: role, style, base, references, user wishes and the piece, the empty ones left out."""
    parts = [p for p in (role, style, base, references, user) if p]
    return pieces.withColumn("prompt", F.concat_ws("\n\n", *map(F.lit, parts), "text")).withColumn("source", F.col("text"))


def failed_note(answers: DataFrame) -> DataFrame:
    """(doc_id, note) of documents none of whose requests was answered."""
    return answers.groupBy("doc_id").agg(F.count_if(F.col("content").isNotNull()).alias("ok"), F.first("error", ignorenulls=True).alias("note")).where("ok = 0").select("doc_id", "note")


def _mend(text: str) -> str:
    """Commas before a closing bracket go; quotes inside strings are escaped; what is still open at the end is closed."""
    text = re.sub(r",(?=\s*[}\]])", "", text)
    out, inside, closers, i = [], False, [], 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            ends = text[i + 1 : i + 2] in ("", ",", "}", "]", ":", " ", "\n", "\r", "\t")
            if inside and not ends:
                c = '\\"'
            else:
                inside = not inside
        elif not inside and c in "{[":
            closers.append("}" if c == "{" else "]")
        elif not inside and closers and c == closers[-1]:
            closers.pop()
        out.append(c)
        i += 1
    return "".join(out) + ('"' if inside else "") + "".join(reversed(closers))


def _loads(text: str) -> object:
    for form in (text, _mend(text)):
        try:
            return json.loads(form)
        except json.JSONDecodeError:
            pass
    return None


def repaired(content: str | None, wanted: tuple[str, ...] = ("wordbanks", "rules")) -> str | None:
    """The JSON object in an answer, as text: one with a wanted key if there is one, else the longest; null if there is none."""
    text = (content or "").strip()
    if fenced := re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL):
        text = fenced[1].strip()
    best: tuple[bool, int, str] | None = None
    at = text.find("{")
    while at != -1:
        tail = text[at:]
        end = tail.rfind("}")
        found = _loads(tail[: end + 1]) if end != -1 else None
        found = _loads(tail) if found is None else found
        if isinstance(found, dict):
            whole = json.dumps(found, ensure_ascii=False, sort_keys=True)
            best = max(best or (False, -1, ""), (any(k in found for k in wanted), len(whole), whole))
            break
        at = text.find("{", at + 1)
    return best[2] if best else None


@F.pandas_udf(T.StringType())
def repair_json(contents: pd.Series) -> pd.Series:
    return contents.map(repaired)


def revision_pairs(sources: DataFrame, revised: DataFrame) -> DataFrame:
    """(pair_id, old_text, new_text): each source of a sample with the sample's one revised text. ``sources``: sample_id, doc_id, text; ``revised``: sample_id, text."""
    new = revised.select("sample_id", F.col("text").alias("new_text"))
    return sources.join(new, "sample_id").select(F.struct("sample_id", "doc_id").alias("pair_id"), F.col("text").alias("old_text"), "new_text")


def diff_pairs(pairs: DataFrame, width: int = 300) -> DataFrame:
    """(pair_id, n, old, new): the changes of each pair (pair_id, old_text, new_text), white space joined, clipped."""
    return diff.changes(pairs).select("pair_id", "n", diff.clipped(F.col("old"), width).alias("old"), diff.clipped(F.col("new"), width).alias("new"))


#: The most entries of a generated bank and the most rules of an answer, and the name of a bank without one.
MOST_ENTRIES, MOST_RULES, BANK_NAME = 40, 30, "AI 生成词库"
GENERATED = "wordbanks array<struct<name:string,entries:array<struct<keyword:string,tag:string,suggestion:string>>>>, rules array<struct<name:string,match_mode:string,pattern:string,severity:string,suggestion:string>>"


def unwrapped(pattern: Column) -> Column:
    """A pattern without the quotes, or r and quotes, that it is wrapped in."""
    quotes = lambda p, lead: p.rlike(rf"(?s)^{lead}(?:'.*'|\".*\")$") & (F.length(p) >= 2 + len(lead))
    inside = lambda p, lead: p.substr(F.lit(2 + len(lead)), F.length(p) - 2 - len(lead))
    bare_r = lambda p: F.when(quotes(p, "r"), inside(p, "r")).otherwise(p)
    once_ = bare_r(strip(pattern))
    return F.when(quotes(once_, ""), inside(once_, "")).otherwise(once_)


def generated(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Banks (id, bank, n, name, keyword, tag, suggestion), rules (id, n, name, match_mode, pattern, severity, suggestion) and failures (id, error) of answers.

    ``answers``: id, json, as ``repaired`` gives it. An answer with a regex that can't be compiled fails as a whole.
    """
    value = lambda c: strip(F.coalesce(c, F.lit("")))
    read = answers.select("id", F.from_json("json", GENERATED).alias("a")).select("id", F.col("a.wordbanks").alias("banks"), F.slice(F.coalesce("a.rules", F.array().cast(GENERATED.split(", rules ")[1])), 1, MOST_RULES).alias("rules"))
    rules = read.select("id", F.posexplode("rules").alias("n", "r")).select("id", "n", value(F.col("r.name")).alias("name"), unwrapped(F.coalesce("r.pattern", F.lit(""))).alias("pattern"), F.coalesce("r.match_mode", F.lit("keyword")).alias("match_mode"), F.coalesce("r.severity", F.lit("medium")).alias("severity"), value(F.col("r.suggestion")).alias("suggestion"))
    rules = rules.where("name <> '' and pattern <> ''").withColumn("match_mode", F.when(F.col("match_mode").isin("keyword", "regex"), F.col("match_mode")).otherwise("keyword")).withColumn("_bad", (F.col("match_mode") == "regex") & ~compiles("pattern"))
    failed = rules.where("_bad").groupBy("id").agg(F.min_by("name", "n").alias("name")).select("id", F.concat(F.lit("规则「"), "name", F.lit("」的正则无法编译")).alias("error"))
    severity = F.when(F.col("severity").isin("low", "medium", "high"), F.col("severity")).otherwise("medium")
    good = rules.join(failed, "id", "left_anti").select("id", "n", clip(F.col("name"), 40).alias("name"), "match_mode", clip(F.col("pattern"), 200).alias("pattern"), severity.alias("severity"), clip(F.col("suggestion"), 120).alias("suggestion"))
    bank = read.select("id", F.posexplode("banks").alias("bank", "b")).select("id", "bank", value(F.col("b.name")).alias("name"), F.posexplode(F.slice("b.entries", 1, MOST_ENTRIES)).alias("n", "e"))
    bank = bank.withColumn("keyword", value(F.col("e.keyword"))).where("keyword <> ''").join(failed, "id", "left_anti")
    name = clip(F.when(F.col("name") != "", F.col("name")).otherwise(BANK_NAME), 30)
    return bank.select("id", "bank", "n", name.alias("name"), clip(F.col("keyword"), 80).alias("keyword"), clip(value(F.col("e.tag")), 40).alias("tag"), clip(value(F.col("e.suggestion")), 120).alias("suggestion")), good, failed


def learn(proposed: DataFrame, existing: DataFrame, sample_id: str) -> tuple[DataFrame, DataFrame]:
    """What a sample taught: records that pass the checks of H4 and H5 and repeat nothing, linked to the sample, and the others with the reason.

    ``proposed``: entity_id, kind (wordbank or rule), ord, name, match_mode (null for entries), pattern, suggestion, severity.
    """
    kind = F.col("kind") == "wordbank"
    # standard terms may be entries; rules are checked in full
    checked = [filter_batch(proposed.where(which), existing if full else existing.where("kind <> 'suggestion'"), dedup=True) for which, full in ((kind, False), (~kind, True))]
    both = checked[0].unionByName(checked[1])
    kept = both.where("kept").drop("reason", "kept").withColumns({"sample_id": F.lit(sample_id), "status": F.lit("enabled"), "group_id": F.when(kind, "learned_words").otherwise("learned_rules")})
    return kept, both.where("not kept").drop("kept")


def merge_learned(records: DataFrame, accepted: DataFrame) -> DataFrame:
    """Learned records that are not there yet, by kind and pattern, put behind those that are."""
    fresh = accepted.join(records.select("kind", "pattern"), ["kind", "pattern"], "left_anti")
    return records.unionByName(fresh, allowMissingColumns=True)


def append_log(entries: DataFrame, path: str) -> None:
    """Put entries (ts, event, ...) behind those of a log of JSON lines; ``issues.page_of_log`` reads it."""
    entries.write.mode("append").json(path)


def learned_stats(records: DataFrame) -> DataFrame:
    """(kind, status, records)."""
    return records.groupBy("kind", "status").agg(F.count("*").alias("records"))
