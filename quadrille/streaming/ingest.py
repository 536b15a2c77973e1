"""Files that keep arriving, and windows over events. [T-01..T-05]"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import build_graph
from ..sources.loader import SCHEMAS, ntriples


def follow_ntriples(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Add each new N-Triples file of a folder to a stored graph; a batch is parsed by the batch reader's own plan.

    A batch has a folder of its own, which a second attempt writes anew, so no row comes twice."""

    def add(batch: DataFrame, number: int) -> None:
        files = [r[0] for r in batch.select("file").distinct().collect()]
        if files:
            graph = build_graph(ntriples(spark, files))
            for name in SCHEMAS:
                getattr(graph, name).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    lines = spark.readStream.format("text").option("pathGlobFilter", "*.nt").load(folder).select(F.col("_metadata.file_path").alias("file"))
    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total), of a batch or a stream of (ts, event_type, value)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
