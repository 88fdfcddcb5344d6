"""Fan-out of one stream to several sinks (R8, K3, K4) and per-window top-k.

``foreachBatch`` sinks are at-least-once; every batch writes into its own
``batch_id=<n>`` folder with overwrite, so a replayed batch replaces its own output
and readers see each event once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventscope.operators.sinks import csv_ready
from eventscope.schema import UNKNOWN_ID
from eventscope.streaming.live import top_per_window


def write_json_by_type(batch: DataFrame, path: str) -> None:
    """K3: JSON files per event type; a missing type goes to ``unknown``."""
    (batch.withColumn("event_type", F.coalesce(F.col("event_type"), F.lit(UNKNOWN_ID)))
     .write.mode("overwrite").partitionBy("event_type").json(path))


def append_csv(batch: DataFrame, path: str) -> None:
    """K4: cumulative CSV; one header per part file."""
    csv_ready(batch).write.mode("overwrite").option("header", True).csv(path)


def fan_out(stream: DataFrame, json_dir: str, csv_dir: str, checkpoint: str,
            trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch to the per-type JSON folders and the CSV folder."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write_json_by_type(batch, f"{json_dir}/batch_id={batch_id}")
            append_csv(batch, f"{csv_dir}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def top_categories_sink(counts: DataFrame, path: str, checkpoint: str, k: int = 5,
                        trigger: dict | None = None) -> StreamingQuery:
    """Closed-window category counts → top-``k`` per window → Parquet."""
    def each(batch: DataFrame, batch_id: int) -> None:
        top_per_window(batch, k).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    w = counts.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
