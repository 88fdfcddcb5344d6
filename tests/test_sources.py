"""Sources and sinks: event logs, Parquet table, Kafka codec, CSV export."""

import json
import os

import pytest
from pyspark.sql import functions as F

from eventscope.operators.filters import malformed_records, valid_records
from eventscope.operators.normalize import prepare, to_canonical, union_batches
from eventscope.operators.sinks import csv_ready, export_csv, write_event_log
from eventscope.session import work_path
from eventscope.sources.files import read_event_log, read_event_table
from eventscope.sources.kafka import parse_records, to_records


def _local(spark, name):
    p = work_path(spark, "tests", name)
    return p[len("file:"):] if p.startswith("file:") else p


def _log(spark, lines):
    d = _local(spark, "log")
    os.makedirs(d)
    with open(f"{d}/events.json", "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_read_event_log_modes(spark):
    d = _log(spark, [json.dumps({"event_id": "U1000", "event_type": "login", "timestamp": 1.5}), "{bad"])
    perm = read_event_log(spark, d)
    assert perm.count() == 2
    bad = malformed_records(perm).collect()
    assert [r["_corrupt_record"] for r in bad] == ["{bad"]
    assert [r.event_id for r in valid_records(perm).collect()] == ["U1000"]
    assert read_event_log(spark, d, "DROPMALFORMED").count() == 1
    with pytest.raises(Exception):
        read_event_log(spark, d, "FAILFAST").collect()


def test_read_event_table_rejects_empty_path(spark):
    with pytest.raises(ValueError):
        read_event_table(spark, "  ")


def test_event_log_roundtrip_omits_nulls(spark):
    d = _local(spark, "roundtrip")
    df = spark.createDataFrame([("U1000", "login", 1.0, None)],
                               "event_id string, event_type string, timestamp double, device string")
    write_event_log(df, d, "overwrite")
    text = spark.read.text(d).first()[0]
    assert "device" not in text and json.loads(text)["event_id"] == "U1000"
    write_event_log(df, d, "append")
    assert spark.read.json(d).count() == 2


def test_kafka_codec_roundtrip(spark):
    df = spark.createDataFrame([(7, "U1000", "purchase", 1704067207.179575)],
                               "row_id long, event_id string, event_type string, timestamp double")
    rec = to_records(df, key="row_id")
    assert [f.name for f in rec.schema.fields] == ["key", "value"]
    back = parse_records(rec, keep=["key"]).first()
    assert back.key == b"7" and back.timestamp == 1704067207.179575 and back.products is None


def test_csv_export(spark):
    el = "struct<product_id:string,product_category:string,price:string,product_type:string,brand:string>"
    df = spark.createDataFrame([("U1", "view_product", 1.0, [("P1", "a", "$1", None, None), ("P2", "b", "$2", None, None)])],
                               f"event_id string, event_type string, timestamp double, products array<{el}>")
    p = prepare(df)
    ready = csv_ready(p)
    assert "products" not in ready.columns and "categories_unknown" not in ready.columns
    assert ready.first()["product_categories"] == "a, b"
    d = _local(spark, "csv")
    export_csv(p, d)
    assert spark.read.option("header", True).csv(d).first()["product_categories"] == "a, b"


def test_shapes_and_union(spark):
    v0 = spark.createDataFrame([("2024-01-01T00:00:07.000001", "user_1234", "purchase", "books")],
                               "timestamp string, user_id string, event_type string, product_category string")
    v1 = spark.createDataFrame([("U1000", "login", "2024-01-01T00:00:07Z", "1.2.3.4", "Mobile", "new", None)],
                               "user_id string, event_type string, timestamp string, ip string, device string, "
                               "user_type string, products array<struct<product_id:string>>")
    c0, c1 = to_canonical(v0).first(), to_canonical(v1).first()
    assert c0.event_id == "user_1234" and c0.products[0]["product_category"] == "books"
    assert c1.device == "Mobile" and c1.products == [] and c1.ts.second == 7
    u = union_batches(v0.select("user_id"), v1.select("user_id", "device"))
    assert u.count() == 2 and u.columns == ["user_id", "device"]


def test_strict_load_and_projection(spark):
    from eventscope.operators.normalize import project
    from eventscope.sources.files import load_events_strict
    d = _log(spark, [json.dumps({"event_id": "U1000", "event_type": "view_product", "timestamp": 1704067207.5,
                                 "products": [{"product_id": "P100"}]})])
    r = load_events_strict(spark, d).first()
    assert r.product_count == 1 and r.categories_unknown == ["Unknown"] and r.ts.microsecond == 500000
    flat = project(load_events_strict(spark, d), ["timestamp", "user_id", "event_type", "product_category"])
    assert flat.columns == ["timestamp", "user_id", "event_type", "product_category"]
    assert flat.first().user_id is None


def test_console_preview_stream(spark, capsys):
    from eventscope.sources.files import stream_event_log
    from eventscope.streaming.ingest import preview_stream
    d = _log(spark, [json.dumps({"event_id": "U1000", "event_type": "login", "timestamp": 1.0})])
    q = preview_stream(stream_event_log(spark, d))
    q.processAllAvailable()
    q.stop()
    assert q.exception() is None


def test_hot_event_type_is_split_over_files(spark):
    import datetime as dt
    import glob
    from eventscope.operators.sinks import write_event_table_batch
    t0 = dt.datetime(2024, 1, 1)
    rows = [("view_product" if i % 10 else "login", t0 + dt.timedelta(seconds=i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_type string, ts timestamp_ntz")
    d = _local(spark, "hot_type")
    write_event_table_batch(df, d, partitions=8)
    hot_files = glob.glob(f"{d}/event_type=view_product/*.parquet")
    assert len(hot_files) >= 4  # the hot type spans many range partitions (one file each)
    back = spark.read.parquet(d)
    assert back.count() == 3000 and back.where("event_type = 'view_product'").count() == 2700


def test_read_event_table_merges_evolving_schemas(spark):
    d = _local(spark, "evolving")
    spark.createDataFrame([("U1000", 1.0)], "event_id string, timestamp double") \
        .write.parquet(f"{d}/event_type=login")
    spark.createDataFrame([("U1001", 2.0, "Mobile")], "event_id string, timestamp double, device string") \
        .write.parquet(f"{d}/event_type=purchase")
    merged = read_event_table(spark, d, merge_schema=True)
    assert "device" in merged.columns
    rows = {r.event_id: r.device for r in merged.collect()}
    assert rows == {"U1000": None, "U1001": "Mobile"}
