"""Continuous ingestion of Markdown files into an atom table: the batch operators applied to each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.ingest import ingest


def stream_documents(spark: SparkSession, path: str, per_trigger: int = 1_000) -> DataFrame:
    """A stream of (source_path, text) of new *.md files under path."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("source_path"), F.col("value").alias("text"))


def stream_atoms(docs: DataFrame, out: str, checkpoint: str, domain: str) -> StreamingQuery:
    """Writes the atoms of each micro-batch to out/batch=N; a batch that is run again replaces its own folder, so each file counts once."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("source_path", "text", F.lit(domain).alias("domain"), F.lit(None).cast("string").alias("doc_type"))
        ingest(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, watermark: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, event_type, n) of a stream of events with ts; rows later than the watermark are dropped once their window is closed."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
