"""Secrets in texts, with DataFrame functions alone.

Three base patterns find assignments, access keys and hex strings. Beyond them, two character Markov models, one of random strings and one of
ordinary identifiers, are trained from labelled samples; a long token whose log-likelihood ratio speaks for the random model is a secret too.
The models are counts of character pairs over a fixed alphabet, so what reaches the driver is a table of a few thousand numbers at most.

A null text counts as empty; rows are kept one for one, repeated rows included, and null ids make no difference. Positions are code points, ends exclusive.
Very long texts are scanned whole, in steps that grow with the text and not with its square. Columns other than doc_id and text are only passed on. An
empty table gives no rows. A token whose ratio is exactly at the bound is ordinary. With no samples at all every ratio is 0, and nothing is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.llm.common import fresh, furthest, let, match_spans

#: The base patterns, the group that a length is asked of, and that length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
KINDS = [*BASE, "markov"]
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = "^ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="  # ^ begins a token
SPANS = "array<struct<start:bigint,kind:int,stop:bigint>>"

#: Words of which sample identifiers are built.
IDENTIFIER_WORDS = (
    "get set user name index value list item count total start stop begin end file path line text page table column row key code type class method"
    " function result error message request response server client config option default parameter argument buffer stream reader writer handler"
    " manager service factory builder context session account order customer product number string integer update delete create insert select"
    " filter window partition version release internal public private static abstract"
    " quick quality zone zero jump object judge box exit next vivid wave yellow young hybrid kick know black white blue brown green grey high light right night"
    " bottle apple middle puzzle single double simple sample purple bubble cable table uncle vehicle backup lookup setup group cloud sound house mouse flower power tower"
    " river silver garden market planet rocket pocket ticket basket summer winter autumn spring morning evening kitchen chicken button cotton common lemon melon wagon"
    " bridge fridge engine machine marine mobile module volume figure nature future picture culture mixture texture vector doctor editor author major minor color"
    " kernel channel tunnel label level model travel camel pixel hotel global local legal royal metal crystal signal animal digital final journal ocean human urban"
).split()


def rule_samples(spark: SparkSession, n: int = 2000) -> DataFrame:
    """(text, is_secret): random strings of four kinds; identifiers of four styles, paths, addresses, dates and numbers; ``n`` of each, built from numbered hashes."""
    rows = spark.range(n)
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    base64 = lambda salt: F.base64(F.unhex(digest(salt)))
    random = [F.substring(base64("a"), 1, 40), digest("b"), F.substring(F.upper(F.regexp_replace(F.concat(base64("c"), base64("d")), "[^A-Za-z0-9]", "")), 1, 32), F.substring(F.regexp_replace(F.concat(base64("e"), base64("f")), "[^A-Za-z0-9]", ""), 1, 36)]
    words = F.array(*map(F.lit, IDENTIFIER_WORDS))
    some = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(k))
    word = lambda salt: F.get(words, some(salt, len(IDENTIFIER_WORDS)).cast("int"))
    three = [word(s) for s in ("x", "y", "z")]
    digits = lambda salt, most: F.substring(F.xxhash64(F.lit(salt), "id").cast("string"), 3, 1 + some(f"{salt}n", most).cast("int"))
    date = lambda by: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), some("t", 25_000).cast("int")), by)
    ordinary = [
        F.concat_ws("_", *three), F.concat(*map(F.initcap, three)), F.concat_ws("-", *three), F.upper(F.concat_ws("_", *three)),
        F.concat(F.lit("/"), F.concat_ws("/", *three, digits("p", 4))), F.concat_ws("/", F.lit("https"), word("u"), F.lit("com"), digits("q", 5), word("v"), digits("r", 7)), F.concat_ws("/", digits("k", 4), digits("l", 2), digits("m", 8), digits("o", 3)),
        F.concat_ws("-", word("w"), digits("s", 6), date("yyyy-MM-dd")), F.concat_ws("_", date("yyyyMMdd"), digits("j", 12), word("i")), date("yyyy/MM/dd"), digits("h", 16),
    ]
    return rows.select(F.inline(F.array(*(F.struct(c.alias("text"), F.lit(s).alias("is_secret")) for cs, s in ((random, True), (ordinary, False)) for c in cs))))


def corpus_samples(docs: DataFrame, most: int = 4096) -> DataFrame:
    """(text, is_secret=false): the words and numbers of at most ``most`` documents, those with the least hash of their id; an id that is repeated counts once.

    What is too short to be a token is labelled ordinary.
    """
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    words = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_-]{4,}"), F.lit(0)), lambda w: F.length(w) < 20)
    return texts.select(F.explode(words).alias("text"), F.lit(False).alias("is_secret"))


def train(samples: DataFrame, alpha: float = 0.5) -> list[float]:
    """Log-odds (random over ordinary) of each character given the one before, smoothed by ``alpha``; row by row of the alphabet."""
    text = F.concat(F.lit("^"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9+/_=-]", ""))
    pairs = samples.select("is_secret", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: text.substr(i, F.lit(2)))).alias("pair")).where("length(pair) = 2 and is_secret is not null")
    counts = pairs.groupBy("pair").agg(F.count_if("is_secret").alias("r"), F.count_if(~F.col("is_secret")).alias("o"))
    head, n = W.partitionBy(F.substring("pair", 1, 1)), len(ALPHABET)
    odds = lambda c: F.log((F.col(c) + alpha) / (F.sum(c).over(head) + alpha * n))
    none = lambda c: F.log(alpha / (F.sum(c).over(head) + alpha * n))
    rows = counts.select("pair", (odds("r") - odds("o")).alias("w"), (none("r") - none("o")).alias("unseen")).collect()  # at most one row per pair of characters
    known, unseen = {r["pair"]: r["w"] for r in rows}, {r["pair"][0]: r["unseen"] for r in rows}
    return [known.get(a + b, unseen.get(a, 0.0)) for a in ALPHABET for b in ALPHABET]


def _ratio(token: Column, odds: Column, place: Column) -> Column:
    """Log-likelihood ratio of a token."""
    index = lambda i: F.get(place, F.ascii(token.substr(i, F.lit(1))))
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))
    step = lambda acc, i: let(index(i), lambda now: F.struct(now.alias("at"), (acc["sum"] + F.get(odds, acc["at"] * len(ALPHABET) + now)).alias("sum")))
    return F.aggregate(F.sequence(F.lit(1), F.length(token)), start, step, lambda acc: acc["sum"])


def _apart(spans: Column) -> Column:
    """Sorted spans without the tokens that touch a base span: one that begins no later and reaches into the token, or that begins inside it."""
    is_base = lambda x: x["kind"] < len(BASE)
    reach = furthest(F.transform(spans, lambda x: F.when(is_base(x), x["stop"]).otherwise(-1)))
    # the nearest start behind a span: the furthest distance from an end beyond any text, read from the end
    behind = furthest(F.reverse(F.transform(spans, lambda x: F.when(is_base(x), (1 << 40) - x["start"]).otherwise(-1))))
    after = lambda b, i: F.get(b, F.size(spans) - 1 - i)
    touched = lambda x, i, r, b: (F.get(r, i) > x["start"]) | (after(b, i) >= 0) & ((1 << 40) - after(b, i) < x["stop"])
    return let(reach, lambda r: let(behind, lambda b: F.filter(spans, lambda x, i: is_base(x) | ~touched(x, i, r, b))))


def all_spans(text: Column, odds: list[float], per_char: float = 0.5) -> Column:
    """Array of (start, kind, stop) of a text's secrets, kind as numbered in KINDS, sorted.

    A token is random if its log-likelihood ratio is over ``per_char`` for each of its characters; tokens that touch a base match are left to it.
    """

    def base_spans(k: int, pattern: str, group: int, least: int) -> Column:
        long = F.filter(match_spans(text, pattern, group), lambda x: F.length(x["hit"]) >= least)
        return F.transform(long, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["stop"].alias("stop"))).cast(SPANS)

    found = [base_spans(k, *rule) for k, rule in enumerate(BASE.values())]
    weights = F.array(*map(F.lit, odds))
    place = F.array(*(F.lit(max(ALPHABET.find(chr(c)), 0)) for c in range(128)))
    random = let(weights, lambda w: let(place, lambda p: F.filter(match_spans(text, TOKEN), lambda x: _ratio(x["hit"], w, p) > per_char * F.length(x["hit"]))))
    spans = F.transform(random, lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("kind"), x["stop"].alias("stop"))).cast(SPANS)
    return let(F.concat(*found), lambda base: F.when(F.size(base) == 0, spans).otherwise(let(F.array_sort(F.concat(base, spans)), _apart)))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _piece(blocks: Column, size: int, start: Column, stop: Column) -> Column:
    """The characters from ``start`` to before ``stop`` of a text that is cut into blocks: no block but those that it begins and ends in is cut again."""
    first, last = F.floor(start / size).cast("int"), F.floor((stop - 1) / size).cast("int")
    block = lambda k: F.get(blocks, k)
    within = block(first).substr((start % size).cast("int") + 1, (stop - start).cast("int"))
    tail = block(first).substr((start % size).cast("int") + 1, F.lit(size))
    over = F.concat(tail, F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), block(last).substr(F.lit(1), ((stop - 1) % size).cast("int") + 1))
    return F.when(stop <= start, "").when(first == last, within).otherwise(over)


def mask(docs: DataFrame, odds: list[float], mark: str = "[secret]", block: int = 1024) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans are masked as one. Rows without secrets stay as they are.

    The text is cut into blocks by one pass of a pattern, and what lies between spans is put together from these, so the work follows the text and its spans.
    """
    name = fresh(docs, "_spans")
    found = docs.withColumn(name, all_spans(F.coalesce("text", F.lit("")), odds))
    spans, zero = F.col(name), F.lit(0).cast("long")

    def masked(blocks: Column, reach: Column) -> Column:
        # a span that begins where the furthest one before has ended is masked on its own
        gaps = F.transform(spans, lambda x, i: F.struct(F.greatest(F.get(reach, i), zero).alias("from"), x["start"].alias("to")))
        gaps = F.filter(gaps, lambda g: g["to"] >= g["from"])
        end = F.array_max(F.transform(spans, lambda x: x["stop"]))
        whole = F.array_join(F.transform(gaps, lambda g: F.concat(_piece(blocks, block, g["from"], g["to"]), F.lit(mark))), "")
        return F.concat(whole, _piece(blocks, block, end, F.length("text").cast("long")))

    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    reach = furthest(F.transform(spans, lambda x: x["stop"]))
    return found.withColumn("text", F.when(F.size(name) > 0, let(cut, lambda b: let(reach, lambda r: masked(b, r)))).otherwise(F.col("text"))).drop(name)


def default_model(docs: DataFrame) -> list[float]:
    return train(rule_samples(docs.sparkSession).unionByName(corpus_samples(docs)))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the hash of the base spans, and all spans."""
    found = docs.select("doc_id", all_spans(F.coalesce("text", F.lit("")), default_model(docs)).alias("_spans"))
    count = lambda k: F.size(F.filter("_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("_spans", lambda x: x["kind"] < len(BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("_spans")).alias("spans"))
