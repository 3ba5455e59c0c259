"""Documents that keep arriving: the same statements over a stream of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.functions.dialect import Dialect
from folioforge.operators.pages import virtual_pages


def pages(docs: DataFrame, view: str = "arriving") -> DataFrame:
    """Virtual pages of a batch or a stream with doc_id and text."""
    docs.createOrReplaceTempView(f"{view}_documents")
    return docs.sparkSession.sql(virtual_pages(Dialect(True, f"{view}_")))


def read(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files: int = 1000) -> DataFrame:
    """Stream of Parquet files below a folder, at most ``files`` of them in one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Writes the pages of everything that has arrived, once, and ends; a rerun with the checkpoint goes on from there."""
    return pages(read(spark, source)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def event_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type and window; rows later than the watermark are left out by Spark."""
    w = F.window("ts", size)
    found = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "total")
