"""A stream of text files through the scanner, and counters over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import parse


def zone_stream(spark: SparkSession, folder: str, schema: str, layout: str, files_per_trigger: int = 1) -> DataFrame:
    """Rows (k, zone) from files as they arrive, parsed without state."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("mrz", parse(layout, F.col("zone")))


def watched(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """Images as they appear right in a folder, each once: (path, modificationTime, length, content, sha256)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "false").load(folder)
    return rows.where(F.lower("path").rlike("[.](jpg|jpeg|png|webp)\\z")).withColumn("sha256", F.sha2("content", 256))


def counters(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and type; a window is given out once and forgotten when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return df.sparkSession.table(name)
