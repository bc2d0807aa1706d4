"""Manifest ingestion as a stream: new JSON lines are appended once per file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from datakiln.operators.dedup import keep_first
from datakiln.operators.tables import new_rows
from datakiln.sources.manifest import MANIFEST, exists


def ingest(spark: SparkSession, incoming: str, manifest: str, checkpoint: str):
    """A query that takes what is there and stops. A batch that is repeated after a failure adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        fresh = keep_first(batch.where("file is not null"), "file", "seq")
        if exists(spark, manifest):
            fresh = new_rows(fresh, spark.read.schema("file string").parquet(manifest))  # names alone
        fresh.write.mode("append").parquet(manifest)

    lines = spark.readStream.schema(MANIFEST).json(incoming)
    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
