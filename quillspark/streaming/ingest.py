"""Extension: incremental shards. New files of a folder are counted into a summary table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks


def ingest(spark: SparkSession, folder: str, schema: str, summary: str, checkpoint: str, key: str = "source") -> None:
    """Process what is new and stop. The summary (sinks.read_version) holds a row for each key and batch; a batch that
    is run again after a crash replaces its own rows, and a crash while it is written leaves the last version in force,
    so every file counts exactly once."""

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key).agg(F.count("*").alias("n")).withColumn("batch", F.lit(number).cast("long"))
        sinks.upsert(new, summary, [key, "batch"])

    q = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
