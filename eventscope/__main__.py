"""Command line: ``python -m eventscope <command> …`` (or via ``spark-submit``).

Commands
  ingest-kafka  topic → parsed events → Parquet table partitioned by event type (R1)
  ingest-log    NDJSON log folder → same table (S5 + K1)
  compact       rewrite an appended table into sized, ts-sorted files
  dashboard     every dashboard metric of a table, written as Parquet folders
  contracts     data-contract violation counts (V1–V5), written as Parquet

Metrics are written by the executors (one folder per metric); only the one-row KPI
summary is printed.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import functions as F

from eventscope.session import build_session


def _trigger(args) -> dict | None:
    if getattr(args, "available_now", False):
        return {"availableNow": True}
    if getattr(args, "every", None):
        return {"processingTime": args.every}
    return None


def cmd_ingest_kafka(spark, args) -> None:
    from eventscope.streaming.ingest import kafka_to_table
    from eventscope.streaming.runner import await_all
    qs = kafka_to_table(spark, args.servers, args.topic, args.table, args.checkpoint,
                        args.quarantine, args.starting, _trigger(args), args.max_offsets)
    await_all(qs)


def cmd_ingest_store(spark, args) -> None:
    """A growing log (--log) or a topic into a store, both outputs from one read."""
    from eventscope.schema import EVENT_LOG_SCHEMA
    from eventscope.sources.kafka import parse_mixed_records, parse_records, read_kafka_events
    from eventscope.sources.tail import tail_event_log
    from eventscope.streaming.runner import await_all
    from eventscope.streaming.store import ingest_once
    records = tail_event_log(spark, args.log) if args.log else read_kafka_events(spark, args.servers, args.topic)
    parse = parse_mixed_records if args.mixed else lambda batch: parse_records(batch, EVENT_LOG_SCHEMA)
    await_all([ingest_once(records, args.table, args.checkpoint, _trigger(args), parse)])


def cmd_ingest_log(spark, args) -> None:
    from eventscope.sources.files import stream_event_log
    from eventscope.streaming.ingest import quarantine_of, split_malformed, write_event_table
    from eventscope.streaming.runner import await_all
    good, bad = split_malformed(stream_event_log(spark, args.log))
    qs = [write_event_table(good, args.table, f"{args.checkpoint}/table",
                            None if args.unpartitioned else "event_type", _trigger(args))]
    qs.append(write_event_table(bad, args.quarantine or quarantine_of(args.table), f"{args.checkpoint}/quarantine",
                                None, _trigger(args)))
    await_all(qs)


def cmd_compact(spark, args) -> None:
    from eventscope.operators.sinks import compact_event_table
    from eventscope.streaming import store
    if store.is_store(spark, args.source):      # in place, by one commit record
        store.compact(spark, args.source)
        return
    if not args.target:
        raise SystemExit("compact needs --target unless the source is a store")
    compact_event_table(spark, args.source, args.target)


def cmd_dashboard(spark, args) -> None:
    from eventscope.plans.dashboard import Dashboard
    controls = dict(window=args.window, event_types=args.types, recent_only=args.recent,
                    bucket=args.bucket, top_k=args.top_k)
    if args.as_of:
        now = datetime.now(timezone.utc) if args.as_of == "now" else datetime.fromisoformat(args.as_of)
        controls["as_of"] = now.astimezone(timezone.utc).replace(tzinfo=None) if now.tzinfo else now
    if args.log:
        # the JSON page reads the log itself; malformed lines are left out, not failed on
        from eventscope.sources.files import read_event_log
        from eventscope.streaming.ingest import split_malformed
        page, raw = Dashboard(**controls), split_malformed(read_event_log(spark, args.log).cache())[0]
    else:
        # pages that also count what lies outside the window read the whole table
        page, raw = Dashboard.for_table(spark, args.table, args.merge_schema, **controls,
                                        narrow=args.page in ("parquet", "last-minute"),
                                        last_minute=args.page == "last-minute")
    build = {"parquet": page.metrics, "json": page.json_page, "scan": page.scan_page,
             "last-minute": page.last_minute_page}[args.page]
    metrics = build(raw)
    try:
        for name, df in metrics.items():
            if name == "download":
                df.write.mode("overwrite").option("header", True).csv(f"{args.out}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        kpis = metrics["kpis"].first().asDict() if "kpis" in metrics else None
        print(json.dumps({"page": args.page, "kpis": kpis, "out": args.out, "metrics": list(metrics)}))
    finally:
        page.release()


def cmd_contracts(spark, args) -> None:
    from eventscope.operators import contracts as C
    from eventscope.operators.normalize import prepare
    from eventscope.sources.files import read_event_table
    raw = read_event_table(spark, args.table, args.merge_schema)
    p = prepare(raw)
    checks = {
        "events": C.rule_counts(p, C.event_rules()),
        "product_counts": C.rule_counts(p, C.product_count_rules()),
        "product_fields": C.rule_counts(C.exploded_products(p, fields=C.FIELD_RULE_FIELDS),
                                        C.product_field_rules()),
        "taxonomy": C.rule_counts(C.exploded_products(p, fields=C.TAXONOMY_FIELDS),
                                  C.builtin_taxonomy_rules(args.extended)),
        "missing_fields": C.missing_fields(raw),
    }
    for name, df in checks.items():
        df.withColumn("check", F.lit(name)).write.mode("overwrite").parquet(f"{args.out}/{name}")
    print(json.dumps({"out": args.out, "checks": list(checks)}))


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="eventscope")
    ap.add_argument("--master", default=None, help="Spark master (omit under spark-submit)")
    ap.add_argument("--shuffle-partitions", type=int, help="about input bytes / 128 MB")
    sub = ap.add_subparsers(dest="command", required=True)

    def trig(p):
        g = p.add_mutually_exclusive_group()
        g.add_argument("--every", help="processing-time trigger, e.g. '1 minute'")
        g.add_argument("--available-now", action="store_true", help="drain what is there, then stop")

    k = sub.add_parser("ingest-kafka")
    k.add_argument("--servers", required=True)
    k.add_argument("--topic", default="test-events")
    k.add_argument("--table", required=True)
    k.add_argument("--checkpoint", required=True)
    k.add_argument("--quarantine")
    k.add_argument("--starting", default="earliest")
    k.add_argument("--max-offsets", type=int)
    trig(k)

    lg = sub.add_parser("ingest-log")
    lg.add_argument("--log", required=True)
    lg.add_argument("--table", required=True)
    lg.add_argument("--checkpoint", required=True)
    lg.add_argument("--quarantine")
    lg.add_argument("--unpartitioned", action="store_true")
    trig(lg)

    st = sub.add_parser("ingest-store", help="one-pass ingest into a store with a file index")
    where = st.add_mutually_exclusive_group(required=True)
    where.add_argument("--log", help="a growing NDJSON log: a file, or a folder of files")
    where.add_argument("--servers", help="Kafka servers")
    st.add_argument("--topic", default="test-events")
    st.add_argument("--table", required=True)
    st.add_argument("--checkpoint", required=True)
    st.add_argument("--mixed", action="store_true", help="records of all shapes, told apart one by one")
    trig(st)

    c = sub.add_parser("compact")
    c.add_argument("--source", required=True)
    c.add_argument("--target", help="not needed for a store, which is compacted in place")

    d = sub.add_parser("dashboard")
    src = d.add_mutually_exclusive_group(required=True)
    src.add_argument("--table", help="Parquet event table")
    src.add_argument("--log", help="NDJSON event log")
    d.add_argument("--out", required=True)
    d.add_argument("--as-of", help="the page's now: an ISO time, or 'now' for the clock (default: latest event)")
    d.add_argument("--window", default="All")
    d.add_argument("--types", nargs="*", default=None)
    d.add_argument("--recent", action="store_true")
    d.add_argument("--bucket", default="5s")
    d.add_argument("--top-k", type=int, default=5)
    d.add_argument("--page", choices=["parquet", "json", "scan", "last-minute"], default="parquet")
    d.add_argument("--merge-schema", action="store_true", help="union evolving file schemas")

    v = sub.add_parser("contracts")
    v.add_argument("--table", required=True)
    v.add_argument("--out", required=True)
    v.add_argument("--extended", action="store_true", help="use the wider taxonomy")
    v.add_argument("--merge-schema", action="store_true", help="union evolving file schemas")
    return ap


COMMANDS = {"ingest-kafka": cmd_ingest_kafka, "ingest-log": cmd_ingest_log, "ingest-store": cmd_ingest_store, "compact": cmd_compact,
            "dashboard": cmd_dashboard, "contracts": cmd_contracts}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session(args.master, app_name=f"eventscope-{args.command}",
                          shuffle_partitions=args.shuffle_partitions)
    COMMANDS[args.command](spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
