"""Batch sinks (K5, K7, K8).  All writes are distributed: one file per task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventscope.functions.products import categories_text


def csv_ready(df: DataFrame) -> DataFrame:
    """K5 shape: categories as ``"a, b"`` text, nested/array columns dropped."""
    out = df
    if "product_categories" in df.columns:
        out = out.withColumn("product_categories", categories_text(F.col("product_categories")))
    nested = [f.name for f in out.schema.fields
              if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    return out.drop(*nested)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5: CSV export of prepared rows with a header per part file."""
    csv_ready(df).write.mode(mode).option("header", True).csv(path)


POINTER = "_current"


def publish_file(spark, path: str, text: str) -> None:
    """Put a small file in place by rename: a reader sees all of the old one or all of the new."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    kind = spark._sc._gateway.new_array(options, 1)
    kind[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, kind)


def current_log(spark, path: str) -> str:
    """The folder that holds a log's lines: the one its pointer names, else the path itself."""
    base = path.rstrip("/")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    if not base or any(c in base for c in "*?[{"):
        return path
    pointer = jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}")
    fs = pointer.getFileSystem(conf)
    if not fs.exists(pointer):
        return path
    stream = fs.open(pointer)
    try:
        return f"{base}/{bytes(stream.readAllBytes()).decode().strip()}"
    finally:
        stream.close()


def write_event_log(df: DataFrame, path: str, mode: str = "append",
                    compression: str | None = None) -> None:
    """K7 (``append``) / K8 (``overwrite``): newline-delimited JSON event log.

    NULL fields are left out of each line.  ``overwrite`` writes a new version folder and then
    switches the log's pointer to it by one rename: a job that fails leaves the old log as it
    is, and readers (``read_event_log``, ``stream_event_log``) see the old lines or the new
    ones.  The version before stays for readers that have begun; older ones, and lines that lay
    in the folder itself before its first replacement, are removed after the switch.  Where there
    is no log yet, there is nothing to replace: the lines lie in the folder itself.
    """
    spark, base = df.sparkSession, path.rstrip("/")
    old = current_log(spark, base)
    if mode == "overwrite":
        p = spark._jvm.org.apache.hadoop.fs.Path(base)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        mode = "overwrite" if fs.exists(p) and len(fs.listStatus(p)) else "append"
    if mode == "overwrite":
        version = f"_versions/{uuid.uuid4().hex}"
        target = f"{base}/{version}"
    else:
        target = old
    w = df.write.mode("append" if mode == "overwrite" else mode)
    if compression:
        w = w.option("compression", compression)
    w.json(target)
    if mode == "overwrite":
        publish_file(spark, f"{base}/{POINTER}", version)
        _remove_stale(spark, base, {target, old})


def _remove_stale(spark, base: str, keep: set[str]) -> None:
    names = {k.rsplit("/", 1)[-1] for k in keep}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in (base, f"{base}/_versions"):
        p = jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(conf)
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            if name not in names and (folder != base or not name.startswith("_")):
                fs.delete(f.getPath(), True)


def write_event_table_batch(df: DataFrame, path: str, partition_by: str = "event_type",
                            order_by: str = "ts", partitions: int | None = None,
                            mode: str = "overwrite", ranged: bool = False) -> None:
    """Batch twin of the stream sink K1: Parquet partitioned by event type.

    Rows are range-partitioned on (event type, time) and sorted inside each task, so
    a type holding a third of all rows is split over many tasks and every file covers
    a narrow time range: its row-group min/max let a time-window predicate skip it.
    """
    keys = [F.col(partition_by).asc_nulls_last(), F.col(order_by).asc_nulls_last()]
    # a range exchange has ``partitions`` parts, else spark.sql.shuffle.partitions; adaptive
    # execution merges small ones but never splits large ones, so size it to the data.
    # ``ranged=True``: the frame already is range-partitioned on these keys.
    if not ranged:
        df = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    (df.sortWithinPartitions(partition_by, order_by)
       .write.mode(mode).partitionBy(partition_by).parquet(path))


def table_bytes(spark, path: str) -> int:
    """Bytes under a path, by the file system's own summary."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def compact_event_table(spark, source: str, target: str, partition_by: str = "event_type",
                        order_by: str = "ts", file_bytes: int = 256 << 20) -> None:
    """Rewrite an appended (many small files) event table into sized, sorted files.

    The stream sink writes a few files per micro-batch and partition value; this
    batch job reads the table (partition discovery), range-partitions it on
    (event type, time) into parts of about ``file_bytes`` of input, and writes it to
    ``target``.
    Readers switch to ``target`` once it is committed (the source is left intact).
    ``order_by`` falls back to ``timestamp`` when the table stores only epoch seconds.
    """
    df = spark.read.parquet(source)
    if order_by not in df.columns:
        order_by = "timestamp"
    parts = max(1, -(-table_bytes(spark, source) // file_bytes))
    write_event_table_batch(df, target, partition_by, order_by, parts)
