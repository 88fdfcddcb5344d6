"""File sources: NDJSON event logs (S2, S3, S5) and the Parquet event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from eventscope.operators.sinks import current_log
from eventscope.schema import EVENT_LOG_SCHEMA

CORRUPT = "_corrupt_record"


def with_corrupt_column(schema: T.StructType, name: str = CORRUPT) -> T.StructType:
    if name in schema.fieldNames():
        return schema
    return T.StructType(schema.fields + [T.StructField(name, T.StringType(), True)])


def read_event_log(spark: SparkSession, path: str, mode: str = "PERMISSIVE",
                   schema: T.StructType = EVENT_LOG_SCHEMA) -> DataFrame:
    """Newline-delimited JSON with a declared schema (no inference pass).

    ``PERMISSIVE`` keeps malformed lines in ``_corrupt_record`` (route them with
    ``filters.valid_records`` / ``malformed_records``); ``FAILFAST`` raises on the first
    bad line (S3); ``DROPMALFORMED`` skips them.  Of a log that is replaced as a whole (K8)
    the current version is read.
    """
    path = current_log(spark, path)
    r = spark.read.option("mode", mode)
    if mode.upper() == "PERMISSIVE":
        schema = with_corrupt_column(schema)
        r = r.option("columnNameOfCorruptRecord", CORRUPT)
    return r.schema(schema).json(path)


def read_event_table(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """Parquet event table with partition discovery (``event_type=…/``).

    A predicate on a partition column prunes directories; nested columns are pruned
    to the fields a query reads.  ``merge_schema=True`` unions the file schemas (a
    table whose producer gained fields over time); absent columns then read as NULL
    and ``prepare()`` fills the defaults.  It reads every footer, so it stays opt-in.
    """
    if not path or path.isspace():
        raise ValueError("an event table needs a path")
    r = spark.read.option("mergeSchema", "true") if merge_schema else spark.read
    table = r.parquet(path.strip())
    # files that predate the stored count have none: it is derived anew
    return table.drop("product_count") if merge_schema else table


def stream_event_log(spark: SparkSession, directory: str, schema: T.StructType = EVENT_LOG_SCHEMA,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """New NDJSON files of a directory as a stream, malformed lines kept aside.

    The checkpoint of the consuming query records which files were read, replacing
    the remembered line offset; files must be complete when they appear (roll logs).
    """
    r = (spark.readStream.schema(with_corrupt_column(schema))
         .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(current_log(spark, directory))


def load_events_strict(spark: SparkSession, path: str, schema: T.StructType = EVENT_LOG_SCHEMA) -> DataFrame:
    """S3: strict NDJSON load for the JSON dashboard — a bad line fails the job;
    epoch seconds become ``ts`` and categories are extracted (N5, N7/N7b)."""
    from eventscope.operators.normalize import prepare
    return prepare(read_event_log(spark, path, "FAILFAST", schema))
