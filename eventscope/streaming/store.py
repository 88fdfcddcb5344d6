"""One-pass ingest into a table whose readers follow commit records and a file index.

A micro-batch is read and parsed once and written by one job: events under
``kind=event/event_type=…``, malformed records under ``kind=malformed``, into a folder of its
own.  Then the files' index (file, type, least and greatest time, rows) is written, and last a
commit record that names the folder.  Readers look at committed folders only, so both outputs
appear together; a batch that failed half-way leaves a folder nobody reads, and a batch that is
replayed after its commit is left as it is.

The index bounds what a window opens: files whose times or type cannot match are not even
listed.  ``compact`` replaces the small files of many batches by sized, time-sorted ones with a
single commit record.

    path/data/batch=…/kind=event/event_type=…/part-….parquet
    path/index/batch=…/                        one row per file
    path/commits/….json                        {"batch", "replaces"}
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventscope.functions.timefn import epoch_to_ts
from eventscope.operators.sinks import publish_file, table_bytes
from eventscope.schema import EVENT_LOG_SCHEMA
from eventscope.sources.files import CORRUPT
from eventscope.sources.kafka import parse_records
from eventscope.streaming.ingest import is_malformed

EVENT, MALFORMED = "event", "malformed"
INDEX_SCHEMA = "file string, kind string, event_type string, min_ts timestamp_ntz, max_ts timestamp_ntz, rows long"
#: Columns of a stored row; ``ts`` and ``product_count`` are stored with the event.
STORED = T.StructType([*EVENT_LOG_SCHEMA.fields, T.StructField("ts", T.TimestampNTZType()),
                       T.StructField("product_count", T.LongType()), T.StructField(CORRUPT, T.StringType())])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_store(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, f"{path.rstrip('/')}/commits")
    return bool(fs.exists(p))


def _commit(spark: SparkSession, path: str, name: str, batch: str, replaces: list[str]) -> None:
    publish_file(spark, f"{path}/commits/{name}.json", json.dumps({"batch": batch, "replaces": replaces}) + "\n")


def live_batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of committed batches that no compaction has replaced."""
    if not is_store(spark, path):
        return []
    records = spark.read.schema("batch string, replaces array<string>").json(f"{path}/commits").collect()
    gone = {b for r in records for b in r["replaces"] or []}
    return sorted(r["batch"] for r in records if r["batch"] not in gone)


def stored(parsed: DataFrame) -> DataFrame:
    """Parsed records as they are stored: kind, the wide columns, ``ts`` and the product count."""
    have = set(parsed.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_LOG_SCHEMA.fields]
    corrupt = F.col(CORRUPT) if CORRUPT in have else F.lit(None).cast("string")
    return parsed.select(
        F.when(is_malformed(parsed), F.lit(MALFORMED)).otherwise(F.lit(EVENT)).alias("kind"), *cols,
        epoch_to_ts(F.col("timestamp")).alias("ts"),
        F.coalesce(F.size("products").cast("long"), F.lit(0).cast("long")).alias("product_count"), corrupt.alias(CORRUPT))


def _write(rows: DataFrame, path: str, batch: str) -> None:
    """Data, then its index; both are unseen until the commit record."""
    spark = rows.sparkSession
    folder = f"{path}/data/batch={batch}"
    rows.write.partitionBy("kind", "event_type").parquet(folder)
    fs, p = _fs(spark, folder)
    written = [f for f in fs.listStatus(p) if f.isDirectory()]      # one folder per kind
    schema = T.StructType([*STORED.fields, T.StructField("kind", T.StringType())])
    if written:
        index = (spark.read.schema(schema).parquet(folder)
                 .groupBy(F.col("_metadata.file_path").alias("file"), "kind", "event_type")
                 .agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("rows")))
    else:
        index = spark.createDataFrame([], INDEX_SCHEMA)
    index.coalesce(1).write.parquet(f"{path}/index/batch={batch}")


def write_batch(batch: DataFrame, path: str, batch_id: int,
                parse: Callable[[DataFrame], DataFrame] = parse_records) -> None:
    """Store one micro-batch of records; a batch that is committed is left as it is."""
    spark = batch.sparkSession
    path, name = path.rstrip("/"), f"b{batch_id:012d}"
    fs, p = _fs(spark, f"{path}/commits/{name}.json")
    if fs.exists(p):
        return
    folder = f"{name}-{uuid.uuid4().hex}"
    _write(stored(parse(batch)), path, folder)
    _commit(spark, path, name, folder, [])


def ingest_once(records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                parse: Callable[[DataFrame], DataFrame] = parse_records) -> StreamingQuery:
    """A stream of records into the store at ``path``, exactly once, with one read."""
    w = (records.writeStream.foreachBatch(lambda batch, n: write_batch(batch, path, n, parse))
         .option("checkpointLocation", checkpoint))
    return (w.trigger(**trigger) if trigger else w).start()


def file_index(spark: SparkSession, path: str, kind: str = EVENT) -> DataFrame:
    """(file, kind, event_type, min_ts, max_ts, rows) of the live files."""
    batches = live_batches(spark, path.rstrip("/"))
    if not batches:
        return spark.createDataFrame([], INDEX_SCHEMA)
    folders = [f"{path.rstrip('/')}/index/batch={b}" for b in batches]
    return spark.read.schema(INDEX_SCHEMA).parquet(*folders).where(F.col("kind") == kind)


def latest_event_time(spark: SparkSession, path: str):
    """The latest event time of the store, from the index alone."""
    return file_index(spark, path).agg(F.max("max_ts")).first()[0]


def matching_files(index: DataFrame, after=None, until=None, types: list[str] | None = None) -> DataFrame:
    """Index rows of files that can hold an event in (after, until] of the given types."""
    def when(t) -> Column:
        return F.lit(str(t)).cast("timestamp_ntz")
    if after is not None:
        index = index.where(F.col("max_ts") > when(after))
    if until is not None:
        index = index.where(F.col("min_ts") <= when(until))
    if types is not None:
        index = index.where(F.col("event_type").isin(types))
    return index


def read_store(spark: SparkSession, path: str, after=None, until=None, types: list[str] | None = None,
               kind: str = EVENT) -> DataFrame:
    """Rows of the live files that can match, narrowed to the bounds and types given.

    Without bounds and types every live file is read; rows without a time lie in no window.
    """
    path = path.rstrip("/")
    index = matching_files(file_index(spark, path, kind), after, until, types)
    files = [r["file"] for r in index.select("file").collect()]     # Spark lists them on the driver as well
    if not files:
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).option("basePath", f"{path}/data").parquet(*files)
    bounds = [(">", after), ("<=", until)]
    for sign, t in bounds:
        if t is not None:
            rows = rows.where(f"ts {sign} TIMESTAMP_NTZ '{t}'")
    return rows if types is None else rows.where(F.col("event_type").isin(types))


def compact(spark: SparkSession, path: str, file_bytes: int = 256 << 20, file_rows: int = 1 << 19) -> None:
    """Rewrite the live batches as sized files, sorted by time inside each type.

    One task sorts and writes about ``file_bytes`` of files or ``file_rows`` rows, whichever is
    less: a few bytes of a file may be some hundred in memory.  Rows alike in type and time, as
    malformed ones are, lie in as many parts as others do.

    One commit record puts the new folder in the old ones' place; a compaction that fails
    changes nothing.  Old folders stay for readers that have begun; ``vacuum`` removes them.
    """
    path = path.rstrip("/")
    old = live_batches(spark, path)
    if not old:
        return
    folders = [f"{path}/data/batch={b}" for b in old]
    n = spark.read.schema(INDEX_SCHEMA).parquet(*[f"{path}/index/batch={b}" for b in old]).agg(F.sum("rows")).first()[0] or 0
    parts = max(1, -(-sum(table_bytes(spark, f) for f in folders) // file_bytes), -(-n // file_rows))
    schema = T.StructType([*STORED.fields, T.StructField("kind", T.StringType())])
    files = [f for f in folders if any(s.isDirectory() for s in _fs(spark, f)[0].listStatus(_fs(spark, f)[1]))]
    order = [F.col("kind"), F.col("event_type").asc_nulls_last(), F.col("ts").asc_nulls_last()]
    rows = spark.createDataFrame([], schema)
    if files:
        place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
        rows = (spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*files)
                .withColumn("_place", place).repartitionByRange(parts, *order, "_place").drop("_place"))
    name = f"c{uuid.uuid4().hex}"
    _write(rows.sortWithinPartitions(*order), path, name)
    _commit(spark, path, name, name, old)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete folders that no live batch names; run it when no writer or old reader is active."""
    path, live, gone = path.rstrip("/"), set(live_batches(spark, path.rstrip("/"))), []
    for side in ("data", "index"):
        fs, p = _fs(spark, f"{path}/{side}")
        for f in fs.listStatus(p) if fs.exists(p) else []:
            name = f.getPath().getName().removeprefix("batch=")
            if name not in live:
                fs.delete(f.getPath(), True)
                gone.append(name)
    return sorted(set(gone))
