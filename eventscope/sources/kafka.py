"""Kafka source and sink (S1, K6) and the record codec.

The Kafka connector jar is not bundled; ``read_kafka_events``/``publish_events`` need
``org.apache.spark:spark-sql-kafka-0-10`` matching the Spark build on the classpath.
The codec half works on any frame with Kafka's columns (``key``, ``value`` binary).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventscope.functions.timefn import text_to_ts, ts_to_epoch
from eventscope.schema import CONTEXT_FIELDS, DEFAULT_TOPIC, EVENT_SCHEMA, PRODUCT_FIELDS, PRODUCTS_TYPE
from eventscope.sources.files import CORRUPT, with_corrupt_column

EVENT_FIELDS = [f.name for f in EVENT_SCHEMA.fields]


def read_kafka_events(spark: SparkSession, servers: str, topic: str = DEFAULT_TOPIC,
                      starting: str = "earliest", options: dict | None = None) -> DataFrame:
    """Subscribe to one topic from ``starting`` offsets (raw Kafka records)."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", starting))
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load()


def parse_records(records: DataFrame, schema: T.StructType = EVENT_SCHEMA,
                  keep: list[str] = ()) -> DataFrame:
    """N1 (binary → text), N2 (``from_json``, permissive), N3 (flatten).

    Malformed values, and values whose fields do not fit the schema, leave the text in
    ``_corrupt_record`` and NULL fields.  A value that yields no field at all (NULL, empty,
    ``{}``) is no event either: its text, or an empty one, is in ``_corrupt_record``.
    Columns in ``keep`` (e.g. ``key``, ``offset``) are carried along.
    """
    text = F.col("value").cast("string")
    parsed = F.from_json(text, with_corrupt_column(schema),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    fields = [f.name for f in schema.fields]
    empty = reduce(lambda a, b: a & b, [F.col(f"data.`{c}`").isNull() for c in fields])
    bad = F.when(empty, F.coalesce(F.col(f"data.{CORRUPT}"), F.col("_text"), F.lit(""))).otherwise(F.col(f"data.{CORRUPT}"))
    return (records.select(*keep, parsed.alias("data"), text.alias("_text"))
            .select(*keep, *[F.col(f"data.`{c}`") for c in fields], bad.alias(CORRUPT)))


def parse_mixed_records(records: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One topic with events of all shapes; each record is parsed once, to a VARIANT, and
    takes the rules of its own shape.

    ``v0`` has a scalar ``product_category`` and no products, ``v1`` a ``user_id`` and no
    ``event_id``, all others are ``v2``.  The columns are those of the wide schema, with the
    ``shape`` and the corrupt record text; ``timestamp`` is epoch seconds whatever the record
    holds (a number, or ISO text).  A value that is no JSON object, has no field of an event, or
    a time or product list that cannot be read, has its text in the corrupt record and NULLs
    elsewhere; JSON null counts as absent.
    """
    raw = F.col("value").cast("string")
    rows = records.select(*keep, raw.alias("_text"), F.try_parse_json(raw).alias("v"))

    def text(name: str) -> Column:
        return F.try_variant_get("v", f"$.{name}", "string")

    kind = PRODUCTS_TYPE.simpleString()
    rows = rows.select(
        *keep, "_text", *[text(c).alias(f"_{c}") for c in ("event_id", "user_id", "event_type", "product_category", "timestamp",
                                                        "products", *CONTEXT_FIELDS)],
        F.try_variant_get("v", "$.timestamp", "double").alias("_number"),
        F.try_variant_get("v", "$.products", kind).alias("_list"))
    flat = F.col("_product_category").isNotNull() & F.col("_products").isNull()
    shape = (F.when(flat, "v0").when(F.col("_user_id").isNotNull() & F.col("_event_id").isNull(), "v1").otherwise("v2"))
    epoch = F.coalesce(F.col("_number"), ts_to_epoch(text_to_ts(F.col("_timestamp"))))
    one = F.array(F.struct(*[(F.col("_product_category") if f == "product_category" else F.lit(None).cast("string")).alias(f)
                             for f in PRODUCT_FIELDS])).cast(PRODUCTS_TYPE)
    fields = [c for c in ("event_id", "user_id", "event_type", "product_category", "timestamp", "products")]
    empty = reduce(lambda a, b: a & b, [F.col(f"_{c}").isNull() for c in fields])
    bad = (empty | (F.col("_timestamp").isNotNull() & epoch.isNull())
           | (F.col("_products").isNotNull() & F.col("_list").isNull()))

    def good(c: Column) -> Column:
        return F.when(~bad, c)

    key = F.when(shape == "v2", F.col("_event_id")).otherwise(F.col("_user_id"))
    return rows.select(
        *keep, good(shape).alias("shape"), good(key).alias("event_id"), good(F.col("_event_type")).alias("event_type"),
        good(epoch).alias("timestamp"), *[good(F.col(f"_{c}")).alias(c) for c in CONTEXT_FIELDS],
        good(F.when(flat, one).otherwise(F.col("_list"))).alias("products"),
        F.when(bad, F.coalesce(F.col("_text"), F.lit(""))).alias(CORRUPT))


def to_records(df: DataFrame, key: Column | str | None = None,
               fields: list[str] | None = None) -> DataFrame:
    """K6 encode: ``value`` = UTF-8 JSON of the event fields, optional ``key``.

    NULL fields are omitted from the JSON (Spark's default), like a producer that
    leaves optional keys out.
    """
    cols = [c for c in (fields or EVENT_FIELDS) if c in df.columns]
    value = F.to_json(F.struct(*cols)).cast("binary").alias("value")
    if key is None:
        return df.select(value)
    k = F.col(key) if isinstance(key, str) else key
    return df.select(k.cast("string").cast("binary").alias("key"), value)


def publish_events(df: DataFrame, servers: str, topic: str = DEFAULT_TOPIC,
                   key: Column | str | None = None) -> None:
    """K6: publish events (batch) to a topic."""
    (to_records(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).save())
