"""What was learned from samples, in a stored table: switched, deleted and cleared together with the word banks and rules that it went into.

``records`` say which item of which group was learned from which sample; ``items`` are entries of word banks and rules, ``groups`` what they are in. All calls take many
ids at once, and records, items and groups change together or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.staging import stage
from folioscan.store import Store, without

ITEM = ["kind", "gid", "iid"]
GROUP = ["kind", "gid"]
SHAPES = {
    "samples": ("id string, note string, status string, created timestamp", ["id"]),
    "records": ("id string, sample_id string, kind string, gid string, iid string, enabled boolean", ["id"]),
    "items": ("kind string, gid string, iid string, name string, match_mode string, pattern string, suggestion string, severity string, source string, enabled boolean", ITEM),
    "groups": ("kind string, gid string, name string, source string, enabled boolean", GROUP),
}


def store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, SHAPES)


def _chosen(kept: Store, ids: DataFrame) -> DataFrame:
    return kept.read("records").join(ids.select("id").distinct(), "id", "left_semi")


def add(kept: Store, records: DataFrame, items: DataFrame, groups: DataFrame) -> None:
    """Put in what a sample taught; rows with known keys are replaced."""
    kept.put(records=kept.merged("records", records), items=kept.merged("items", items), groups=kept.merged("groups", groups))


def toggle(kept: Store, ids: DataFrame, on: bool) -> int:
    """Switch learned records and their items; records whose item is gone stay as they are. Gives the number of records switched."""
    items = kept.read("items")
    chosen = stage(_chosen(kept, ids).join(items.select(*ITEM).distinct(), ITEM, "left_semi"), "chosen")
    hit = lambda rows, keys: rows.join(chosen.select(*keys).distinct(), keys, "left_semi").withColumn("enabled", F.lit(on))
    changed = chosen.count()
    if changed:
        records = kept.read("records")
        kept.put(items=without(items, chosen, ITEM).unionByName(hit(items, ITEM)), records=without(records, chosen, ["id"]).unionByName(hit(records, ["id"])))
    return changed


def delete(kept: Store, ids: DataFrame) -> int:
    """Delete learned records, their items, and groups that this leaves empty; records whose group is gone stay. Gives the number of records deleted."""
    groups = kept.read("groups")
    chosen = stage(_chosen(kept, ids).join(groups.select(*GROUP).distinct(), GROUP, "left_semi"), "chosen")
    gone = chosen.count()
    if gone:
        items = without(kept.read("items"), chosen, ITEM)
        emptied = without(chosen.select(*GROUP).distinct(), items, GROUP)
        kept.put(items=items, groups=without(groups, emptied, GROUP), records=without(kept.read("records"), chosen, ["id"]))
    return gone


def clear(kept: Store, source: str) -> int:
    """Forget all that was learned: items of ``source``, groups of it, groups without items, all samples and records. Gives the number of items removed."""
    items = kept.read("items")
    mine = F.coalesce(F.col("source") == source, F.lit(False))
    left = items.where(~mine)
    groups = kept.read("groups").where(~mine).join(left.select(*GROUP).distinct(), GROUP, "left_semi")
    removed = items.where(mine).count()
    kept.put(items=left, groups=groups, records=kept.read("records").where("false"), samples=kept.read("samples").where("false"))
    return removed


def delete_samples(kept: Store, ids: DataFrame) -> None:
    """Delete samples; what they taught stays."""
    kept.delete("samples", ids)
