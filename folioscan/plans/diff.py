"""What changed between two texts, line by line, as joins: a patience diff over all pairs at once.

Lines are rows, named by a hash of 128 bits. Lines that occur once on both sides of a gap (at first the whole texts are one) are matched by an aggregation; of matches that cross,
the longest increasing subsequence stays. Matches cut a gap into smaller ones, in which more lines occur once. Where there are none, equal lines at a
gap's start and end are matched, then the k-th occurrences of a line on either side, and all begins again until nothing more can be matched. Every step takes all gaps
of all pairs together, so rounds follow how deep gaps lie in each other. What is left between two matches on both sides is a change.

A pair's text is one row of the input; its lines are sorted by Spark, and only the places of matches that cross meet in one Python call.
Null texts have no lines, like empty ones. Pairs are told apart by their row, so repeated or null ids are pairs of their own. Texts that are the same give
no change; blank sides and sides that differ in white space around them only are no change either. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions.text import WHITE
from folioscan.staging import stage

#: What ends a line, and what counts as white space around a text.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
SPACES = WHITE + "\x1c\x1d\x1e\x1f"
GAP = ["row", "gap"]


def lines(text: Column) -> Column:
    """The lines of a text; a line end at its end begins no further line."""
    found = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)


def _increasing(group: pd.DataFrame) -> pd.DataFrame:
    """Of matches (i, j), the longest chain that rises on both sides; the earliest on the new side where there are several."""
    group = group.sort_values("i")
    ends: list[int] = []  # least last j of chains of each length
    at: list[int] = []
    before, js = [], group["j"].tolist()
    for k, j in enumerate(js):
        length = bisect_left(ends, j)
        before.append(at[length - 1] if length else -1)
        ends[length : length + 1], at[length : length + 1] = [j], [k]
    chain, k = [], at[-1]
    while k >= 0:
        chain.append(k)
        k = before[k]
    return group.iloc[chain[::-1]]


def _chain(matches: DataFrame) -> DataFrame:
    """Matches (row, gap, i, j) without those that cross, stored."""
    gap = W.partitionBy(*GAP)
    back = F.coalesce(F.lag("j").over(gap.orderBy("i")) > F.col("j"), F.lit(False))
    told = matches.select(*GAP, "i", "j").withColumn("back", back).withColumn("crossed", F.max("back").over(gap))
    told = stage(told.drop("back"), "matches")
    straight, crossed = told.where("not crossed").drop("crossed"), told.where("crossed").drop("crossed")
    if crossed.isEmpty():
        return straight
    return stage(straight.unionByName(crossed.groupBy(*GAP).applyInPandas(_increasing, crossed.schema)), "matched")


def _meet(rows: DataFrame, *by: str) -> DataFrame:
    """(row, gap, by, i, j): where exactly one line of each side has the same values ``by``."""
    old = F.col("side") == 0
    both = rows.groupBy(*GAP, *by).agg(F.count_if(old).alias("a"), F.count_if(~old).alias("b"), F.max(F.when(old, F.col("n"))).alias("i"), F.max(F.when(~old, F.col("n"))).alias("j"))
    return both.where("a = 1 and b = 1").drop("a", "b")


def _once(rows: DataFrame) -> DataFrame:
    """Lines that each side of the gap has once."""
    return _chain(_meet(rows, "key"))


def _ends(rows: DataFrame, last: bool) -> DataFrame:
    """Equal lines at the start of a gap, or at its end."""
    side = W.partitionBy(*GAP, "side")
    off = F.max("n").over(side) - F.col("n") if last else F.col("n") - F.min("n").over(side)
    by_place = rows.withColumn("off", off)
    old = F.col("side") == 0
    both = by_place.groupBy(*GAP, "off").agg(F.max(F.when(old, F.col("n"))).alias("i"), F.max(F.when(~old, F.col("n"))).alias("j"), F.max(F.when(old, F.col("key"))).alias("a"), F.max(F.when(~old, F.col("key"))).alias("b"))
    both = both.withColumn("same", F.coalesce(F.col("a") == F.col("b"), F.lit(False)))
    until = F.min(F.when(~F.col("same"), F.col("off"))).over(W.partitionBy(*GAP))
    return stage(both.withColumn("until", until).where("same and (until is null or off < until)").select(*GAP, "i", "j"), "matched")


def _occurrences(rows: DataFrame) -> DataFrame:
    """The k-th occurrences of a line on both sides."""
    k = F.row_number().over(W.partitionBy(*GAP, "side", "key").orderBy("n"))
    return _chain(_meet(rows.withColumn("k", k), "key", "k"))


STEPS = (_once, lambda rows: _ends(rows, False), lambda rows: _ends(rows, True), _occurrences)


def _cut(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """The lines that are still open, by the gaps that the matches leave; a gap's number is the old line after its last match before."""
    end = lambda side, n: F.struct(F.lit(side).alias("side"), F.col(n).alias("n"), F.col("i").alias("at"))
    ends = matches.select(*GAP, F.inline(F.array(end(0, "i"), end(1, "j"))))
    marked = rows.unionByName(ends, allowMissingColumns=True).repartition("row")
    # a line and its own mark have the same place
    last = F.last(F.when(F.col("at").isNotNull(), F.struct("n", "at")), ignorenulls=True).over(W.partitionBy(*GAP, "side").orderBy("n"))
    left = marked.withColumn("last", last).where("at is null and (last is null or last.n < n)")
    return _two_sided(left.select("row", F.coalesce(F.col("last.at") + 1, F.col("gap")).alias("gap"), "side", "n", "key"))


def _two_sided(rows: DataFrame) -> DataFrame:
    """Gaps that have lines on one side only are nothing that was changed."""
    gap = W.partitionBy(*GAP)
    return rows.withColumns({"a": F.min("side").over(gap), "b": F.max("side").over(gap)}).where("a < b").drop("a", "b")


def changes(pairs: DataFrame, most: int = 30) -> DataFrame:
    """(pair_id, n, old, new): the first ``most`` changes of each pair (pair_id, old_text, new_text), numbered from 0; lines are joined by line feeds."""
    told = stage(pairs.select(F.monotonically_increasing_id().alias("row"), "pair_id", "old_text", "new_text"), "pairs")
    # a pair of equal texts, or of one text that has no lines, has none that matter
    apart = told.where((F.col("old_text") != F.col("new_text")) & (F.col("old_text") != "") & (F.col("new_text") != ""))
    sides = apart.select("row", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("old_text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("new_text").alias("text")))))
    said = sides.select("row", "side", lines(F.col("text")).alias("lines")).select("row", "side", F.posexplode("lines").alias("n", "line"))
    said = stage(said.select("row", "side", F.col("n").cast("long").alias("n"), "line", F.unhex(F.md5("line")).alias("key")), "lines")
    rows, step = said.select("row", F.lit(0).cast("long").alias("gap"), "side", "n", "key"), 0
    while step < len(STEPS):
        matches = STEPS[step](rows.repartition("row"))  # a pair's lines stay together, so that a step shuffles them once
        if matches.isEmpty():
            step += 1
        else:
            rows, step = stage(_cut(rows, matches), "open"), 0
    whole = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("n", "line")))), lambda x: x["line"]), "\n")
    found = rows.select(*GAP, "side", "n").join(said, ["row", "side", "n"]).groupBy(*GAP).agg(whole(0).alias("old"), whole(1).alias("new"))
    bare = lambda c: F.btrim(c, F.lit(SPACES))
    found = found.where((bare(F.col("old")) != "") & (bare(F.col("new")) != "") & (bare(F.col("old")) != bare(F.col("new"))))
    numbered = found.withColumn("n", F.row_number().over(W.partitionBy("row").orderBy("gap")) - 1).where(F.col("n") < most)
    return told.select("row", "pair_id").join(numbered, "row").select("pair_id", "n", "old", "new")


def clipped(text: Column, width: int = 300) -> Column:
    """White space joined to single spaces, cut to ``width`` characters with an ellipsis."""
    flat = F.btrim(F.regexp_replace(text, f"[{SPACES}]+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("…"))).otherwise(flat)
