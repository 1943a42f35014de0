"""The rules on single texts over a folder that grows: an extra, as a file stream of text units; findings don't depend on other units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioscan.config import Config
from folioscan.model import UNITS
from folioscan.plans.check import text_issues


def unit_stream(spark: SparkSession, path: str) -> DataFrame:
    """Text units from the Parquet files that arrive in ``path``."""
    return spark.readStream.schema(UNITS).parquet(path)


def write_issues(units: DataFrame, out: str, checkpoint: str, config: Config | None = None, rules: list[dict] | None = None) -> StreamingQuery:
    """Append the findings of each batch to ``out``; with the checkpoint, files are read once, also after a restart."""

    def each(batch: DataFrame, number: int) -> None:
        text_issues(batch, config or Config(), rules).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return units.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
