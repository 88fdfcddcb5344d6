"""Run a streaming query to completion into a Parquet folder (tests, backfills)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from eventscope.session import work_path


def await_done(q: StreamingQuery) -> None:
    """Block until an ``availableNow`` query ends; re-raise its failure."""
    q.awaitTermination()
    err = q.exception()
    if err is not None:
        raise err


def await_all(queries: list[StreamingQuery], poll_seconds: float = 1.0) -> None:
    """Block until all queries end; when one fails, stop the others and re-raise."""
    try:
        while any([not q.awaitTermination(poll_seconds) for q in queries]):
            pass
        for q in queries:
            if q.exception() is not None:
                raise q.exception()
    except BaseException:
        for q in queries:
            q.stop()
        raise


def run_available_now(stream: DataFrame, name: str, partition_by: list[str] | None = None,
                      output_mode: str = "append") -> str:
    """Drain ``stream`` with ``availableNow`` into a Parquet folder; return the folder.

    Output and checkpoint live under the shared checkpoint folder, so a restarted
    driver resumes from the committed offsets and the file sink's log keeps the
    output exactly-once.
    """
    spark = stream.sparkSession
    base = work_path(spark, "streams", name)
    w = (stream.writeStream.format("parquet").outputMode(output_mode)
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    await_done(w.start())
    return f"{base}/out"


def read_output(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a file-sink folder (only committed files are listed via its metadata log)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)
