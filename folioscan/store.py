"""Small stored tables that are changed: keyed upserts and deletes by snapshots.

A change writes whole new snapshots of the tables it touches and then, as one more line of a log, which snapshots count. Readers take the last line, so a writer that
dies before it has written that line has changed nothing, and tables changed together change at once. One writer is expected at a time; of two that
write the same version, the one whose line does not count is told so by ``Conflict``. Snapshots that no longer count stay where they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LOG = "version long, name string, tables map<string,string>"


class Conflict(RuntimeError):
    """Another writer's version counts."""


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` whose keys are not among those of ``gone``; null equals null."""
    gone = gone.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return rows.join(gone, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti")


class Store:
    """Tables in one folder; ``shapes``: name -> (DDL, key columns)."""

    def __init__(self, spark: SparkSession, path: str, shapes: Mapping[str, tuple[str, Sequence[str]]]) -> None:
        self.spark, self.path, self.shapes = spark, path.rstrip("/"), dict(shapes)

    def _last(self) -> tuple[int, dict[str, str]]:
        try:
            log = self.spark.read.schema(LOG).json(f"{self.path}/log")
            row = log.groupBy("version").agg(F.min_by("tables", "name").alias("tables")).agg(F.max("version").alias("version"), F.max_by("tables", "version").alias("tables")).first()
        except AnalysisException:  # nothing has been written
            return 0, {}
        return (row.version, row.tables) if row.version else (0, {})

    def read(self, table: str) -> DataFrame:
        """The table as it is now; later changes don't show in what has been read."""
        shape, _ = self.shapes[table]
        name = self._last()[1].get(table)
        return self.spark.read.schema(shape).parquet(f"{self.path}/{table}/{name}") if name else self.spark.createDataFrame([], shape)

    def put(self, **tables: DataFrame) -> None:
        """Replace tables by others, all at once."""
        version, names = self._last()
        own = uuid.uuid4().hex
        for table, rows in tables.items():
            shape = self.spark.createDataFrame([], self.shapes[table][0]).schema
            rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in shape)).write.parquet(f"{self.path}/{table}/{own}")
        self._switch(version + 1, own, {**names, **dict.fromkeys(tables, own)})

    def _switch(self, version: int, name: str, tables: dict[str, str]) -> None:
        self.spark.createDataFrame([(version, name, tables)], LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")
        first = self.spark.read.schema(LOG).json(f"{self.path}/log").where(F.col("version") == version).agg(F.min("name")).first()[0]
        if first != name:
            raise Conflict(f"version {version} of {self.path} is another writer's")

    def merged(self, table: str, changes: DataFrame, *order: str) -> DataFrame:
        """The table with ``changes`` in place of rows of the same key; of changes of one key the last by ``order`` counts."""
        keys = list(self.shapes[table][1])
        last = changes.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order or keys)))).where("_n = 1").drop("_n")
        return without(self.read(table), last, keys).unionByName(last, allowMissingColumns=True)

    def upsert(self, table: str, changes: DataFrame, *order: str) -> None:
        self.put(**{table: self.merged(table, changes, *order)})

    def delete(self, table: str, gone: DataFrame) -> None:
        """Remove the rows with the keys of ``gone``."""
        self.put(**{table: without(self.read(table), gone, list(self.shapes[table][1]))})
