"""Named streaming queries: each drains a stream built from the driver's tables with an
``availableNow`` trigger and returns the written output as a batch DataFrame.

The live metrics stream the ``events`` table itself; the ingest queries first write
the canonical events as a topic dump (Kafka records) or an NDJSON log, then stream
that.
All outputs, inputs and checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventscope.functions.timefn import epoch_to_ts
from eventscope.operators.filters import with_time
from eventscope.operators.normalize import fold_event_types, prepare, project, union_batches
from eventscope.operators.sinks import export_csv, write_event_log
from eventscope.plans.tables import canonical_events
from eventscope.schema import EVENT_LOG_SCHEMA
from eventscope.session import work_path
from eventscope.sources.bridge import products_from, read_table, stream_flat
from eventscope.sources.files import CORRUPT, load_events_strict, read_event_table, stream_event_log
from eventscope.sources.kafka import parse_mixed_records, parse_records, to_records
from eventscope.sources.tail import qualified, tail_event_log
from eventscope.streaming import drain, fanout, ingest, store
from eventscope.streaming.runner import await_all, await_done

NOW = {"availableNow": True}


def q_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts per event type, every event and window of the backlog."""
    return drain.window_counts(stream_flat(spark, sf_dir), "tumbling", "event_type", "1h")


def q_stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event frequency per type over 60 s windows that start every 5 s."""
    return drain.window_counts(stream_flat(spark, sf_dir), "sliding", "event_type", "60s", slide="5s")


def q_stream_last_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users, events and journey classes of 60 s windows that start every 5 s."""
    return drain.window_page(stream_flat(spark, sf_dir), "last_minute", "60s", "5s")


def q_stream_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users per journey class per day."""
    return drain.window_journeys(stream_flat(spark, sf_dir), "journey", "1d")


def q_stream_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-5 categories per day."""
    part = read_table(spark, sf_dir, "part")
    n_parts = part.count()  # one number, fixed for the run of the stream
    prods = products_from(stream_flat(spark, sf_dir), part, n_parts)
    return drain.window_top_categories(prods, "top_categories", "1d", 5)


def _per_type(events: DataFrame) -> DataFrame:
    p = prepare(events)
    return p.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"),
                                       F.sum("product_count").cast("long").alias("products"))


def q_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic dump → parse → partitioned table → read back."""
    base = work_path(spark, "streams", "ingest")
    to_records(canonical_events(spark, sf_dir), key="row_id").write.parquet(f"{base}/topic")
    records = spark.readStream.schema("key binary, value binary").parquet(f"{base}/topic")
    qs = ingest.ingest_records(records, f"{base}/table", f"{base}/checkpoint",
                               quarantine_path=f"{base}/quarantine", trigger=NOW)
    await_all(qs)
    return _per_type(read_event_table(spark, f"{base}/table"))


def q_stream_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic with broken, empty, NULL and ``{}`` values, ingested in two runs
    on one checkpoint; events in the table and malformed values by kind."""
    base = work_path(spark, "streams", "malformed")
    records, n = _spoiled_topic(spark, sf_dir), F.col("row_id")
    for half in (0, 1):
        # a restart: new files, the same checkpoint and table
        records.where(n % 2 == half).drop("row_id").write.mode("append").parquet(f"{base}/topic")
        stream = spark.readStream.schema("key binary, value binary").parquet(f"{base}/topic")
        await_all(ingest.ingest_records(stream, f"{base}/table", f"{base}/checkpoint", trigger=NOW))
    kept = read_event_table(spark, f"{base}/table").select(F.lit("event").alias("kind")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("count"))
    return kept.unionByName(ingest.malformed_counts(spark, ingest.quarantine_of(f"{base}/table")))


def _event_log(spark: SparkSession, sf_dir: str, base: str) -> str:
    stored = canonical_events(spark, sf_dir).drop("row_id", "ts")
    write_event_log(stored, f"{base}/log", mode="overwrite")
    return f"{base}/log"


def q_stream_log_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDJSON log folder → stream → unpartitioned table → read back."""
    base = work_path(spark, "streams", "log_ingest")
    log = _event_log(spark, sf_dir, base)
    good, _bad = ingest.split_malformed(stream_event_log(spark, log))
    await_done(ingest.write_event_table(good, f"{base}/table", f"{base}/checkpoint",
                                        partition_by=None, trigger=NOW))
    return _per_type(read_event_table(spark, f"{base}/table"))


def q_stream_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream to per-type JSON folders and a CSV folder."""
    base = work_path(spark, "streams", "fanout")
    log = _event_log(spark, sf_dir, base)
    good, _bad = ingest.split_malformed(stream_event_log(spark, log))
    await_done(fanout.fan_out(good, f"{base}/json", f"{base}/csv", f"{base}/checkpoint", NOW))
    js = spark.read.json(f"{base}/json").groupBy("event_type").agg(F.count(F.lit(1)).alias("json_events"))
    cs = (spark.read.option("header", True).csv(f"{base}/csv")
          .groupBy("event_type").agg(F.count(F.lit(1)).alias("csv_events")))
    return js.join(cs, "event_type", "full")


def _event_rows(events: DataFrame) -> DataFrame:
    return prepare(events).select("event_id", "event_type", "ts", "product_count")


def _grown(lines: DataFrame, folder: str, share: float) -> None:
    """Write the first ``share`` of the bytes of each log file (file, place, line); a file
    that is written anew with a larger share has grown."""
    from eventscope.sources.tail import _open

    def write(key, rows):
        text = "".join(f"{x}\n" for x in rows.sort_values("place")["line"]).encode()
        fs, local = _open(f"{folder}/events-{key[0]}.json")
        fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(local) as out:
            out.write(text[:int(len(text) * share)])
        return rows.iloc[:0][["place"]]

    lines.groupBy("file").applyInPandas(write, "place long").write.format("noop").mode("overwrite").save()


def q_stream_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that grow in place, tailed in two runs on one checkpoint; the first run ends
    inside a line of every file."""
    base = work_path(spark, "streams", "log_tail")
    log = qualified(spark, f"{base}/log")
    fields = [c for c in EVENT_LOG_SCHEMA.fieldNames()]
    lines = canonical_events(spark, sf_dir).select(
        F.floor(F.col("row_id") / 5000).alias("file"), F.col("row_id").alias("place"), F.to_json(F.struct(*fields)).alias("line"))
    for share in (0.6, 1.0):
        _grown(lines, log, share)
        good, _ = ingest.split_malformed(parse_records(tail_event_log(spark, log), EVENT_LOG_SCHEMA))
        await_done(ingest.write_event_table(good, f"{base}/table", f"{base}/checkpoint", None, NOW))
    return _event_rows(read_event_table(spark, f"{base}/table"))


def q_stream_mixed_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producers of the three shapes and broken values on one topic."""
    base = work_path(spark, "streams", "mixed")
    e, n = canonical_events(spark, sf_dir), F.col("row_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    v2 = F.to_json(F.struct("event_id", "event_type", "timestamp", "products"))
    v1 = F.to_json(F.struct(F.col("event_id").alias("user_id"), "event_type", iso.alias("timestamp"), "products"))
    v0 = F.to_json(F.struct(iso.alias("timestamp"), F.col("event_id").alias("user_id"), "event_type",
                            F.try_element_at("products", F.lit(1))["product_category"].alias("product_category")))
    text = F.when(n % 4 == 1, v1).when(n % 4 == 2, v0).otherwise(v2)
    text = F.when(n % 10 == 1, F.substring(text, 1, 20)).otherwise(text)
    e.select(n.cast("string").cast("binary").alias("key"), text.cast("binary").alias("value")).write.parquet(f"{base}/topic")
    stream = spark.readStream.schema("key binary, value binary").parquet(f"{base}/topic")
    parsed = parse_mixed_records(stream, keep=["key"])
    await_done(ingest.write_event_table(parsed, f"{base}/table", f"{base}/checkpoint", None, NOW))
    rows = spark.read.schema(parsed.schema).parquet(f"{base}/table")
    return rows.select(
        F.col("key").cast("string").cast("long").alias("row_id"), "shape", "event_id", "event_type",
        epoch_to_ts(F.col("timestamp")).alias("ts"), F.coalesce(F.size("products"), F.lit(0)).cast("long").alias("product_count"),
        F.try_element_at("products", F.lit(1))["product_category"].alias("first_category"),
        F.col(CORRUPT).isNotNull().alias("malformed"))


def _spoiled_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, row_id, value): events as v2 records, six in ten of them sound."""
    value, n = F.col("value"), F.col("row_id")
    text = value.cast("string")
    spoiled = (F.when(n % 10 == 1, F.substring(text, 1, 20)).when(n % 10 == 2, F.lit(""))
               .when(n % 10 == 3, F.lit(None).cast("string")).when(n % 10 == 4, F.lit("{}")).otherwise(text))
    records = (to_records(canonical_events(spark, sf_dir), key="row_id")
               .select("key", F.col("key").cast("string").cast("long").alias("row_id"), "value"))
    return records.select("key", "row_id", spoiled.cast("binary").alias("value"))


def q_stream_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and malformed records of one read, in two runs on one checkpoint with
    a compaction between; every row of both sides."""
    base = work_path(spark, "streams", "one_pass")
    records = _spoiled_topic(spark, sf_dir)
    for half in (0, 1):
        records.where(F.col("row_id") % 2 == half).drop("row_id").write.mode("append").parquet(f"{base}/topic")
        stream = spark.readStream.schema("key binary, value binary").parquet(f"{base}/topic")
        await_done(store.ingest_once(stream, f"{base}/store", f"{base}/checkpoint", NOW))
        if not half:
            store.compact(spark, f"{base}/store")
    sides = [store.read_store(spark, f"{base}/store", kind=k).select(
        F.lit(k).alias("kind"), "event_id", "event_type", "ts",
        F.when(F.lit(k == store.EVENT), F.col("product_count")).alias("product_count"))
        for k in (store.EVENT, store.MALFORMED)]
    return sides[0].unionByName(sides[1])


def q_store_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 24 h of two event types from a compacted store; the file index names
    the files to open and "now"."""
    base = work_path(spark, "streams", "store_window")
    records = to_records(canonical_events(spark, sf_dir), key="row_id")
    for half in (0, 1):
        store.write_batch(records.where(F.col("key").cast("string").cast("long") % 2 == half), base, half)
    store.compact(spark, base)
    after = store.latest_event_time(spark, base) - timedelta(hours=24)
    return store.read_store(spark, base, after=after, types=["purchase", "add_to_cart"]).select(
        "event_id", "event_type", "ts", "product_count")


def q_log_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is appended to, replaced as a whole, and loaded strictly."""
    base = work_path(spark, "streams", "log_replace")
    events = canonical_events(spark, sf_dir)
    for part, mode in ((events.where("row_id % 3 = 0"), "append"), (events.where("row_id % 2 = 0"), "overwrite"),
                       (events.where("row_id % 2 = 1"), "append")):
        write_event_log(part.drop("row_id", "ts", "product_count"), f"{base}/log", mode)
    return load_events_strict(spark, f"{base}/log").select("event_id", "event_type", "ts", "product_count")


def q_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: prepared events exported as CSV and read back."""
    base = work_path(spark, "streams", "csv_export")
    export_csv(prepare(canonical_events(spark, sf_dir)), f"{base}/csv")
    text = spark.read.option("header", True).csv(f"{base}/csv")
    return text.select(F.col("row_id").cast("long").alias("row_id"), "event_id", "event_type",
                       F.coalesce("product_categories", F.lit("")).alias("product_categories"),
                       F.col("product_count").cast("long").alias("product_count"))


def q_uneven_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with other columns, capital and NULL types, and times
    that are missing or unreadable."""
    e, n = canonical_events(spark, sf_dir), F.col("row_id")
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    time = F.when(n % 7 == 0, F.lit(None)).when(n % 11 == 0, F.lit("yesterday")).otherwise(iso).alias("timestamp")
    kind = F.when(n % 5 == 0, F.lit(None)).otherwise(F.upper("event_type")).alias("event_type")
    part = lambda k: e.where(n % 3 == k)
    rows = union_batches(part(0).select("row_id", "event_id", kind, time), part(1).select("row_id", "event_type", time),
                         part(2).select("row_id", "event_id", "event_type", time, F.lit("Mobile").alias("device")))
    rows = fold_event_types(with_time(prepare(rows, precision="second")))
    return project(rows, ["row_id", "event_id", "event_type", "ts", "device", "ip"])


STREAM_QUERIES = {name[2:]: fn for name, fn in dict(globals()).items()
                  if name.startswith("q_") and callable(fn)}
