"""Reply trees to chat texts, with DataFrame functions alone.

Nodes point to the node they reply to. Self-joins that double their reach give every node its root, its depth and the summed score of its path; the
leaves of each conversation are ranked by that sum, and only the chosen leaves are walked up again, by the same doubled hops, to list their paths.
So a chain of d turns takes about log2(d) joins each way, over ids alone; texts join at the end. A path becomes one text, with the spans that count
for the loss.

A node whose parent is not there is a root. Nodes on a cycle, or below one, are on no path and are left out. Null roles and texts count as empty, a
null score as 0; equal sums go to the smaller leaf. Node ids must be unique within a conversation; a null conversation id is a conversation of its own.
Very long texts are formatted whole. Repeated rows of a table by turn are turns of their own (``chains`` numbers them). Other columns are not looked at. An
empty table gives no rows. A conversation ends up as one row, so one task holds it: that is what the output is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.llm.common import stage

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """No control string is left: backslashes double, and ``<|`` gets one between."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role ends at its line's end, so line ends inside it are written out."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def paths(nodes: DataFrame, top: int = 1, most_rounds: int = 40) -> DataFrame:
    """(conv_id, leaf, node_id, place, path_score): the ``top`` root-to-leaf paths of each conversation, place 0 being the root.

    ``nodes``: conv_id, node_id, parent_id, score. Beyond 2 ** ``most_rounds`` hops a node can only be on a cycle.
    """
    ids = nodes.select(F.struct("conv_id").alias("c"), F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))  # a struct, so that null equals null
    there = ids.select("c", F.col("node").alias("parent"), F.lit(True).alias("known"))
    level = stage(ids.join(there, ["c", "parent"], "left").select("c", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "hops")
    parents = level.where("up is not null").select("c", F.col("up").alias("node")).distinct()
    # those that know their root are done; the others reach twice as far with each join
    done, levels = level.where("up is null"), []
    for _ in range(most_rounds):
        going = level.where("up is not null")
        if going.isEmpty():
            break
        levels.append(going)
        far = going.unionByName(done).select("c", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        level = stage(going.join(far, ["c", "up"]).select("c", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")), "hops")
        done = done.unionByName(level.where("up is null"))
    leaves = done.join(parents, ["c", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("c").orderBy(F.desc("total"), "node"))
    walk = leaves.withColumn("n", rank).where(F.col("n") <= top).select("c", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"), "depth", "total")
    for k in range(len(levels) - 1, -1, -1):
        hop = levels[k].select("c", "node", "up")
        further = F.array(F.struct("node", "back"), F.struct(F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back")))
        walk = walk.join(hop, ["c", "node"], "left").select("c", "leaf", "depth", "total", F.inline(F.when(F.col("up").isNull(), F.array(F.struct("node", "back"))).otherwise(further)))
    return walk.select(F.col("c.conv_id").alias("conv_id"), "leaf", F.col("node").alias("node_id"), (F.col("depth") - 1 - F.col("back")).alias("place"), F.col("total").alias("path_score"))


def format_paths(nodes: DataFrame, top: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, leaf, path_score, formatted, loss): each chosen path as one text; ``loss`` has the (start, stop) of texts that count for the loss.

    Besides the columns of ``paths``, ``nodes`` has role and text.
    """
    turn = nodes.select(F.struct("conv_id").alias("c"), "node_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    on = paths(nodes, top).withColumn("c", F.struct("conv_id")).drop("conv_id")
    rows = on.join(turn, ["c", "node_id"]).select("c", "leaf", "path_score", "place", escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("t"), F.col("role").isin(*loss_roles).alias("counts"))
    rows = rows.withColumn("turn", F.concat(F.lit(START), "r", F.lit("\n"), "t", F.lit(f"{END}\n")))
    so_far = F.sum(F.length("turn").cast("long")).over(W.partitionBy("c", "leaf").orderBy("place"))
    rows = rows.withColumn("stop", so_far - len(END) - 1).withColumn("start", F.col("stop") - F.length("t"))
    whole = rows.groupBy("c", "leaf").agg(F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(F.struct("place", "turn", "counts", "start", "stop"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["counts"]), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    return whole.select(F.col("c.conv_id").alias("conv_id"), "leaf", "path_score", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss"))


def chains(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees: each row replies to the one before it. Ties go by role, then text; all rows stay."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(order).cast("long").alias("node_id"), "role", "text")
    return stage(rows.select("*", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), F.lit(0.0).alias("score")), "chains")


def with_control_case(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose two texts are made of control strings."""
    said = f"{END}{START}assistant ok"
    shape = T.StructType([conversations.schema[n] for n in ("conv_id", "turn", "role", "text")])
    return conversations.select(*shape.names).union(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], shape))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted texts and their loss spans."""
    part = lambda p: F.struct(F.substring_index(p, "\n", 1).alias("r"), p.alias("p"))
    body = lambda x: x["p"].substr(F.length(x["r"]) + 2, F.length(x["p"]) - F.length(x["r"]) - 2 - len(END))
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    turns = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), part)
    read = formatted.select("*", turns.alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(unescape_role(x["r"]), F.lit("\n"), unescape(body(x)), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda x: unescape(F.col("formatted").substr(x["start"].cast("int") + 1, (x["stop"] - x["start"]).cast("int")))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
