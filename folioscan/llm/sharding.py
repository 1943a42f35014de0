"""Sharding by extendible hashing.

A document's key is ``OWN_BITS`` bits of the MD5 of its id, followed by bits that only tell rows with one id apart. Buckets are prefixes of the key; there is
one at first, of no bits, and a bucket that is over the byte limit, and only such a one, splits on its next bit. Whether a bucket splits follows from
its size alone, so Spark sums the bytes of all prefixes of the keys down to a depth that nearly all buckets end above: cells of that depth are summed
first, and their sums added up to every shorter prefix. A row's shard is the shortest prefix of its key that fits. Cells that are themselves too large go into
another round that starts at the bits they have in common.

Only a single row larger than the limit can leave a shard over it (``oversize``). Null texts have no bytes; null ids share one hash, and repeated rows
are told apart by their place in the staged table, which keeps it for good. Very long texts count their bytes like any other; columns other than doc_id and
text are not looked at. An empty table gives an empty directory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import stage

BITS, OWN_BITS = 63, 32


def keys(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bytes), staged; a key has ``OWN_BITS`` bits of the id's hash, the others tell repeated ids apart."""
    rows = stage(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")), "rows")
    own = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, OWN_BITS // 4), 16, 10).cast("long")
    return rows.select("doc_id", F.shiftleft(own, BITS - OWN_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64("row"), 1 + OWN_BITS)).alias("key"), "bytes")


def _prefix(value: Column, dropped: Column) -> Column:
    return F.call_function("shiftright", value, dropped.cast("int"))


def shard(docs: DataFrame, max_bytes: int = 16 << 20, fine: int = 2, deeper: int = 8) -> DataFrame:
    """doc_id, shard (the bits of its bucket), local_depth, shard_bytes, shard_docs and oversize of every row."""
    open_rows = rows = stage(keys(docs), "keys")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    base, depth, whole = 0, min(BITS, max(0, math.ceil(math.log2(max(total, 1) / max_bytes))) + fine), None
    while True:
        celled = open_rows.withColumn("cell", F.shiftright("key", BITS - depth))
        cells = stage(celled.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("key").alias("low"), F.max("key").alias("high")), "cells")
        levels = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("bits")).withColumn("prefix", _prefix(F.col("cell"), depth - F.col("bits")))
        sums = levels.groupBy("bits", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = sums.where((F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1) | (F.col("bits") == BITS))
        first = F.min(F.struct("bits", "prefix", "shard_bytes", "shard_docs")).alias("leaf")
        leaves = stage(levels.select("cell", "bits", "prefix").join(fits, ["bits", "prefix"]).groupBy("cell").agg(first), "leaves")
        placed = celled.join(leaves, "cell").select("doc_id", "leaf.*")
        whole = placed if whole is None else whole.union(placed)
        rest = cells.join(leaves, "cell", "left_anti")
        # where keys of a cell that is left first differ; no bucket in between can fit
        common = rest.select(F.min(BITS - F.length(F.bin(F.col("low").bitwiseXOR(F.col("high"))))).alias("bits")).first()["bits"]
        if common is None:
            break
        open_rows = stage(celled.join(rest.select("cell"), "cell", "left_semi").drop("cell"), "open")
        base, depth = common, min(BITS, common + deeper)
    name = F.when(F.col("bits") == 0, F.lit("")).otherwise(F.call_function("right", F.lpad(F.bin("prefix"), BITS, "0"), F.col("bits")))
    return whole.select("doc_id", name.alias("shard"), F.col("bits").alias("local_depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > max_bytes).alias("oversize"))


def directory(sharded: DataFrame) -> DataFrame:
    """One row per shard: its depth and size, the directory's global depth, and its slots there, ``slots`` of them from ``first_slot`` on."""
    shards = sharded.groupBy("shard").agg(*(F.first(c).alias(c) for c in ("local_depth", "shard_bytes", "shard_docs", "oversize")))
    deepest = shards.agg(F.max("local_depth").alias("global_depth"))  # one row
    spare = F.col("global_depth") - F.col("local_depth")
    at = F.coalesce(F.conv(F.when(F.col("shard") != "", F.col("shard")), 2, 10).cast("long"), F.lit(0).cast("long"))
    return shards.crossJoin(F.broadcast(deepest)).withColumns({"first_slot": F.call_function("shiftleft", at, spare), "slots": F.call_function("shiftleft", F.lit(1).cast("long"), spare)})
