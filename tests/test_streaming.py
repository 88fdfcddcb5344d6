"""Streaming: late data, quarantine, fan-out idempotence, stream = batch."""

import datetime as dt
import json
import os
import uuid

from pyspark.sql import functions as F

from eventscope.schema import EVENT_LOG_SCHEMA
from eventscope.session import work_path
from eventscope.sources.files import stream_event_log
from eventscope.streaming import fanout, ingest, live
from eventscope.streaming.runner import await_done, read_output, run_available_now

NOW = {"availableNow": True}


def _write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def _ev(eid, etype, t, products=None):
    e = {"event_id": eid, "event_type": etype, "timestamp": t}
    if products is not None:
        e["products"] = products
    return json.dumps(e)


def _local(spark, name):
    p = work_path(spark, "tests", name)
    return p[len("file:"):] if p.startswith("file:") else p


def test_late_rows_are_dropped(spark):
    """Rows older than the watermark in a later micro-batch do not reach closed windows."""
    d = _local(spark, "late")
    base = dt.datetime(2024, 1, 1, 10, 0).replace(tzinfo=dt.timezone.utc).timestamp()
    _write_lines(f"{d}/in", "a.json", [_ev("U1000", "login", base + 5), _ev("U1001", "login", base + 5400)])
    stream = stream_event_log(spark, f"{d}/in", max_files_per_trigger=1)
    good, _ = ingest.split_malformed(stream)
    counts = live.live_counts(good.withColumn("ts", F.timestamp_seconds("timestamp").cast("timestamp_ntz")),
                              "1 hour", "10 minutes", by=())
    ck, out = f"{d}/ck", f"{d}/out"
    q = counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck) \
        .trigger(availableNow=True).start()
    await_done(q)
    # watermark is now 11:20, so the 10:00 window is closed; a late row for it arrives
    _write_lines(f"{d}/in", "b.json", [_ev("U1002", "login", base + 10), _ev("U1003", "login", base + 9000)])
    q = counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck) \
        .trigger(availableNow=True).start()
    await_done(q)
    rows = {r.window_start.hour: r["count"] for r in spark.read.parquet(out).collect()}
    assert rows[10] == 1  # the late 10:00 row was dropped
    assert rows[11] == 1


def test_quarantine_of_malformed_values(spark):
    v1 = json.dumps({"user_id": "U1003", "event_type": "login", "timestamp": "2024-01-01T00:00:07Z"})
    vals = [_ev("U1000", "login", 1.0), "not json", '{"event_id": "U1001", "products": "oops"}',
            _ev("U1002", "view_product", 2.0, [{"product_id": "P100", "product_category": "Books"}]), None, v1]
    rec = spark.createDataFrame([(None if v is None else bytearray(v.encode()),) for v in vals], "value binary")
    from eventscope.sources.kafka import parse_records
    good, bad = ingest.split_malformed(parse_records(rec))
    assert sorted(r.event_id for r in good.collect() if r.event_id) == ["U1000", "U1002"]
    assert good.count() == 2  # a NULL value is no event: it is kept aside with the others
    # a v1 event (ISO text where v2 has epoch seconds) is quarantined, not half-parsed
    assert sorted(r["_corrupt_record"] for r in bad.collect()) == sorted([
        '', 'not json', '{"event_id": "U1001", "products": "oops"}', v1])


def test_ingest_records_to_partitioned_table(spark):
    d = _local(spark, "ingest")
    vals = [_ev("U1000", "login", 1.0), "garbage", _ev("U1001", "purchase", 2.0, [{"product_id": "P1"}])]
    spark.createDataFrame([(bytearray(v.encode()),) for v in vals], "value binary").write.parquet(f"{d}/topic")
    rec = spark.readStream.schema("value binary").parquet(f"{d}/topic")
    for q in ingest.ingest_records(rec, f"{d}/table", f"{d}/ck", quarantine_path=f"{d}/bad", trigger=NOW):
        await_done(q)
    t = spark.read.parquet(f"{d}/table")
    assert sorted(r.event_type for r in t.collect()) == ["login", "purchase"]
    assert os.path.isdir(f"{d}/table/event_type=login")
    assert spark.read.parquet(f"{d}/bad").count() == 1


def test_fanout_replay_is_idempotent(spark):
    d = _local(spark, "fanout")
    _write_lines(f"{d}/in", "a.json", [_ev("U1000", "login", 1.0), _ev("U1001", None, 2.0)])
    good, _ = ingest.split_malformed(stream_event_log(spark, f"{d}/in"))
    await_done(fanout.fan_out(good, f"{d}/json", f"{d}/csv", f"{d}/ck", NOW))
    types = sorted(r.event_type for r in spark.read.json(f"{d}/json").collect())
    assert types == ["login", "unknown"]
    # replaying batch 0 (same batch id) overwrites its own folder: still two rows
    batch = spark.read.schema(EVENT_LOG_SCHEMA).json(f"{d}/in")
    fanout.write_json_by_type(batch, f"{d}/json/batch_id=0")
    assert spark.read.json(f"{d}/json").count() == 2
    assert spark.read.option("header", True).csv(f"{d}/csv").count() == 2


def test_run_available_now_writes_under_checkpoint_dir(spark):
    d = _local(spark, "run")
    _write_lines(f"{d}/in", "a.json", [_ev("U1000", "login", 1.0)])
    good, _ = ingest.split_malformed(stream_event_log(spark, f"{d}/in"))
    out = run_available_now(good, f"t{uuid.uuid4().hex[:6]}")
    assert spark.sparkContext.getCheckpointDir().rstrip("/").split(":")[-1] in out
    assert read_output(spark, out).count() == 1


def test_stream_equals_batch(spark, sf_small):
    """R4 over the events stream equals the batch series: all events, all windows."""
    from eventscope.operators.timeseries import event_types_over_time
    from eventscope.plans.streams import q_stream_tumbling
    from eventscope.plans.tables import prepared_events
    stream = {(r.window_start, r.event_type): r["count"] for r in q_stream_tumbling(spark, sf_small).collect()}
    batch = {(r.timestamp, r.event_type): r["count"]
             for r in event_types_over_time(prepared_events(spark, sf_small), "1h").collect()}
    assert stream == batch and len(stream) > 0


def test_compaction_keeps_rows_and_reduces_files(spark):
    import glob
    from eventscope.operators.sinks import compact_event_table
    d = _local(spark, "compact")
    for i in range(6):  # six micro-batches → many small files
        _write_lines(f"{d}/in", f"{i}.json", [_ev(f"U100{i}", t, 1.0 + i + j / 10)
                                               for j, t in enumerate(["login", "purchase", "login"])])
    good, _ = ingest.split_malformed(stream_event_log(spark, f"{d}/in", max_files_per_trigger=1))
    await_done(ingest.write_event_table(good, f"{d}/table", f"{d}/ck", trigger=NOW))
    before = glob.glob(f"{d}/table/event_type=*/*.parquet")
    compact_event_table(spark, f"{d}/table", f"{d}/compact")
    after = glob.glob(f"{d}/compact/event_type=*/*.parquet")
    rows = lambda p: sorted(tuple(r) for r in spark.read.parquet(p).select("event_id", "event_type", "timestamp").collect())
    assert rows(f"{d}/table") == rows(f"{d}/compact")
    assert len(after) < len(before)


def test_sliding_journeys_equal_brute_force(spark):
    """R5 live funnel: 60 s windows sliding by 5 s, chained in append mode."""
    d = _local(spark, "slide_journey")
    base = dt.datetime(2024, 1, 1, 10, 0).replace(tzinfo=dt.timezone.utc).timestamp()
    evs = [("U1000", "login", 1), ("U1000", "purchase", 20), ("U1001", "login", 33), ("U1001", "add_to_cart", 70),
           ("U1002", "view_product", 71), ("U1000", "login", 200)]
    _write_lines(f"{d}/in", "a.json", [_ev(u, t, base + s) for u, t, s in evs])
    good, _ = ingest.split_malformed(stream_event_log(spark, f"{d}/in"))
    x = good.withColumn("ts", F.timestamp_seconds("timestamp").cast("timestamp_ntz"))
    out = run_available_now(live.live_journeys(x, "60 seconds", "0 seconds", slide="5 seconds"), "sj")
    got = {(r.window_start, r.journey_type): r["count"] for r in read_output(spark, out).collect()}
    # brute force: every 60 s window (start multiple of 5 s) closed by the watermark
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    latest = max(s for _, _, s in evs)
    want = {}
    for start in range(-60, latest, 5):
        if start + 60 > latest:  # not closed: the watermark is the latest event time
            continue
        users = {}
        for u, t, s in evs:
            if start <= s < start + 60:
                users.setdefault(u, set()).add(t)
        for types in users.values():
            cls = ("Completed Purchase" if "login" in types and "purchase" in types else
                   "Abandoned Cart" if "login" in types and "add_to_cart" in types else
                   "Browsing Only" if "login" in types else "Other")
            k = (t0 + dt.timedelta(seconds=start), cls)
            want[k] = want.get(k, 0) + 1
    assert got == want and len(got) > 5


def test_drained_metrics_do_not_depend_on_batches(spark, sf_small, tmp_path):
    """A folder table of unordered files: one batch, one file per batch and the single-file
    table give the same counts, journeys and top categories."""
    from eventscope.sources.bridge import flat_from, products_from, read_table, stream_table
    from eventscope.streaming import drain
    events = read_table(spark, sf_small, "events")
    events.orderBy(F.xxhash64("event_id")).repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    part = read_table(spark, sf_small, "part")

    def answers(folder, max_files=None):
        flat = flat_from(stream_table(spark, folder, "events", max_files))
        frames = [drain.window_counts(flat, "t", "event_type", "1h"),
                  drain.window_counts(flat, "t", "event_type", "60s", slide="5s"),
                  drain.window_journeys(flat, "t"),
                  drain.window_top_categories(products_from(flat, part, part.count()), "t")]
        return [sorted(map(tuple, f.collect())) for f in frames]

    whole = answers(sf_small)
    assert all(whole) and sum(r[2] for r in whole[0]) == events.count()
    assert answers(str(tmp_path)) == whole
    assert answers(str(tmp_path), 1) == whole


def test_last_minute_page_live_and_drained(spark):
    from eventscope.streaming.drain import window_page
    from eventscope.streaming.live import live_page
    rows = [("2024-01-01 10:00:01", "a", "login"), ("2024-01-01 10:00:03", "a", "purchase"), ("2024-01-01 10:00:12", "b", "login"),
            ("2024-01-01 10:00:50", "a", "add_to_cart"), ("2024-01-01 10:01:20", "c", "logout"), ("2024-01-01 10:01:21", None, "login"),
            ("2024-01-01 12:00:00", "z", "login")]
    d = _local(spark, "page")
    df = spark.createDataFrame(rows, "t string, event_id string, event_type string").select(
        F.col("t").cast("timestamp_ntz").alias("ts"), "event_id", "event_type")
    df.repartition(3).write.parquet(f"{d}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{d}/in")
    columns = ["window_start", "users", "events", "completed", "abandoned", "browsing", "other"]
    drained = {r.window_start: tuple(r) for r in window_page(stream(), "test_page").select(columns).collect()}
    at = lambda h, m, s: __import__("datetime").datetime(2024, 1, 1, h, m, s)
    assert drained[at(10, 0, 0)][1:] == (2, 4, 1, 0, 1, 0)
    assert drained[at(10, 0, 25)][1:] == (2, 2, 0, 0, 0, 2)
    q = (live_page(stream()).writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/ck")
         .outputMode("append").trigger(availableNow=True).start())
    await_done(q)
    live = {r.window_start: tuple(r) for r in spark.read.parquet(f"{d}/out").select(columns).collect()}
    closed = {k: v for k, v in drained.items() if k < at(11, 0, 0)}
    assert {k: v for k, v in live.items() if k < at(11, 0, 0)} == closed
