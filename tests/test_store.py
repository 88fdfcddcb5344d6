import json
import os

import pytest
from pyspark.sql import functions as F

from eventscope.operators.sinks import current_log, write_event_log
from eventscope.session import work_path
from eventscope.sources.files import read_event_log, stream_event_log
from eventscope.sources.kafka import parse_mixed_records
from eventscope.streaming import store
from eventscope.streaming.runner import await_done

NOW = {"availableNow": True}
DAY = 86400.0


def _local(spark):
    return work_path(spark, "tests", "store").replace("file:", "")


def _records(spark, values):
    return spark.createDataFrame([(None if v is None else bytearray(v.encode()),) for v in values], "value binary")


def _event(k, kind="login", t=None, products=None):
    e = {"event_id": f"U{k}", "event_type": kind, "timestamp": float(k) if t is None else t}
    return json.dumps({**e, **({"products": products} if products else {})})


def _ids(df):
    return sorted(r.event_id for r in df.collect())


def test_both_outputs_appear_with_one_read(spark):
    base = _local(spark)
    reads = []
    values = [_event(1), "broken", _event(2, "purchase", products=[{"product_id": "P1"}]), None, "{}", _event(3, None)]
    _records(spark, values).write.parquet(f"{base}/topic")
    counted = F.udf(lambda v: v, "binary")
    stream = spark.readStream.schema("value binary").parquet(f"{base}/topic").select(counted("value").alias("value"))
    await_done(store.ingest_once(stream, f"{base}/t", f"{base}/ck", NOW,
                                 parse=lambda b: (reads.append(1), store.parse_records(b))[1]))
    assert len(reads) == 1
    assert _ids(store.read_store(spark, f"{base}/t")) == ["U1", "U2", "U3"]
    assert [r.product_count for r in store.read_store(spark, f"{base}/t").orderBy("event_id").collect()] == [0, 1, 0]
    bad = store.read_store(spark, f"{base}/t", kind=store.MALFORMED)
    assert sorted(r["_corrupt_record"] for r in bad.collect()) == ["", "broken", "{}"]


def test_failed_batch_is_replayed_and_a_committed_one_is_left(spark, monkeypatch):
    base = _local(spark)
    _records(spark, [_event(1), "bad 1"]).write.parquet(f"{base}/topic")
    real, tries = store._commit, []

    def failing(*a):
        tries.append(a)
        if len(tries) == 1:      # data and index are written, the commit record is not
            raise OSError("lost")
        real(*a)

    monkeypatch.setattr(store, "_commit", failing)
    stream = lambda: spark.readStream.schema("value binary").parquet(f"{base}/topic")
    with pytest.raises(Exception):
        await_done(store.ingest_once(stream(), f"{base}/t", f"{base}/ck", NOW))
    assert store.read_store(spark, f"{base}/t").count() == 0
    await_done(store.ingest_once(stream(), f"{base}/t", f"{base}/ck", NOW))
    assert len(os.listdir(f"{base}/t/data")) == 2        # the lost folder is there, unread
    assert _ids(store.read_store(spark, f"{base}/t")) == ["U1"]
    assert store.read_store(spark, f"{base}/t", kind=store.MALFORMED).count() == 1
    store.write_batch(_records(spark, [_event(1)]), f"{base}/t", 0)     # replayed after its commit
    assert _ids(store.read_store(spark, f"{base}/t")) == ["U1"]
    assert len(store.vacuum(spark, f"{base}/t")) == 1
    assert _ids(store.read_store(spark, f"{base}/t")) == ["U1"]


def test_window_opens_matching_files_only(spark):
    base = _local(spark)
    for d in range(6):
        rows = [_event(100 * d + k, ["login", "purchase"][k % 2], d * DAY + k) for k in range(10)]
        store.write_batch(_records(spark, rows).coalesce(1), f"{base}/t", d)
    assert store.file_index(spark, f"{base}/t").count() == 12
    assert str(store.latest_event_time(spark, f"{base}/t")) == "1970-01-06 00:00:09"
    got = store.read_store(spark, f"{base}/t", after="1970-01-04 00:00:04", until="1970-01-05 00:00:02", types=["login"])
    assert len(got.inputFiles()) == 2
    assert _ids(got) == ["U306", "U308", "U400", "U402"]
    assert "PushedFilters" in got._jdf.queryExecution().executedPlan().toString()
    store.compact(spark, f"{base}/t")
    again = store.read_store(spark, f"{base}/t", after="1970-01-04 00:00:04", until="1970-01-05 00:00:02", types=["login"])
    assert len(again.inputFiles()) == 1 and _ids(again) == _ids(got)
    assert store.read_store(spark, f"{base}/t").count() == 60
    assert store.read_store(spark, f"{base}/t", after="1999-01-01").count() == 0


def test_compaction_that_fails_changes_nothing(spark, monkeypatch):
    base = _local(spark)
    for d in range(2):
        store.write_batch(_records(spark, [_event(d), "bad"]), f"{base}/t", d)
    monkeypatch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.compact(spark, f"{base}/t")
    monkeypatch.undo()
    assert _ids(store.read_store(spark, f"{base}/t")) == ["U0", "U1"]
    store.compact(spark, f"{base}/t")
    store.write_batch(_records(spark, [_event(7)]), f"{base}/t", 2)
    assert _ids(store.read_store(spark, f"{base}/t")) == ["U0", "U1", "U7"]
    assert store.read_store(spark, f"{base}/t", kind=store.MALFORMED).count() == 2
    store.vacuum(spark, f"{base}/t")
    assert _ids(store.read_store(spark, f"{base}/t")) == ["U0", "U1", "U7"]


def test_empty_store_and_empty_batch(spark):
    base = _local(spark)
    assert store.read_store(spark, f"{base}/t").count() == 0 and not store.is_store(spark, f"{base}/t")
    store.write_batch(_records(spark, []), f"{base}/t", 0)
    assert store.read_store(spark, f"{base}/t").count() == 0
    store.compact(spark, f"{base}/t")
    assert store.latest_event_time(spark, f"{base}/t") is None


def test_mixed_shapes_by_record(spark):
    values = [
        '{"event_id": "U1", "event_type": "login", "timestamp": 12.5}',
        '{"event_id": "U2", "event_type": "purchase", "timestamp": 13, "products": [{"product_id": "P1", "price": 7, "x": 1}, null]}',
        '{"user_id": "U3", "event_type": "login", "timestamp": "1970-01-01T00:00:09Z", "ip": "::1", "device": "Mobile"}',
        '{"user_id": "user_4", "event_type": "view", "timestamp": "1970-01-01T00:00:10", "product_category": "books"}',
        '{"event_id": "U5", "timestamp": null, "products": null}',
        '{"event_id": "U6", "timestamp": "yesterday"}',
        '{"event_id": "U7", "products": "oops"}',
        '[1, 2]', 'not json', '{}', '{"other": 1}', '', None,
    ]
    rows = parse_mixed_records(_records(spark, values)).collect()
    good = {r.event_id: r for r in rows if r["_corrupt_record"] is None}
    assert sorted(good) == ["U1", "U2", "U3", "U5", "user_4"]
    assert [good[k]["shape"] for k in ("U1", "U2", "U3", "U5", "user_4")] == ["v2", "v2", "v1", "v2", "v0"]
    assert [good[k].timestamp for k in ("U1", "U2", "U3", "U5", "user_4")] == [12.5, 13.0, 9.0, None, 10.0]
    assert good["U2"].products[0].price == "7" and good["U2"].products[1] is None and good["U5"].products is None
    assert good["user_4"].products[0].product_category == "books" and good["user_4"].products[0].product_id is None
    assert good["U3"].ip == "::1" and good["U3"].device == "Mobile"
    bad = [r for r in rows if r["_corrupt_record"] is not None]
    assert sorted(r["_corrupt_record"] for r in bad) == sorted([*values[5:12], ""])
    assert all(r.event_id is None and r.products is None and r.shape is None for r in bad)


def test_replaced_log_survives_a_failed_write(spark):
    base = _local(spark) + "/log"
    frame = lambda *ids: spark.createDataFrame([(i, "login", 1.0) for i in ids], "event_id string, event_type string, timestamp double")
    write_event_log(frame("a", "b"), base, "append")
    write_event_log(frame("c"), base, "overwrite")
    assert _ids(read_event_log(spark, base)) == ["c"]
    broken = frame("x", "y").withColumn("event_type", F.raise_error(F.lit("disk lost")).cast("string"))
    with pytest.raises(Exception):
        write_event_log(broken, base, "overwrite")
    assert _ids(read_event_log(spark, base)) == ["c"]
    write_event_log(frame("d"), base, "append")          # to the current version
    assert _ids(read_event_log(spark, base)) == ["c", "d"]
    before = current_log(spark, base)
    write_event_log(frame("e"), base, "overwrite")
    assert _ids(read_event_log(spark, base)) == ["e"]
    assert _ids(read_event_log(spark, before)) == ["c", "d"]     # a reader that had begun goes on
    write_event_log(frame("f"), base, "overwrite")
    assert not os.path.exists(before)
    assert stream_event_log(spark, base).isStreaming


def test_compaction_tasks_are_bounded_by_rows_also_of_equal_ones(spark):
    path = _local(spark)
    for n in (0, 1):
        values = [_event(k, t=5.0) for k in range(n, 600, 2)] + ["{}"] * 400 + [_event(k, "purchase", t=float(k)) for k in range(300)]
        store.write_batch(_records(spark, values), path, n)
    rows = lambda: [sorted(map(str, store.read_store(spark, path, kind=k).drop("batch").collect()))
                    for k in (store.EVENT, store.MALFORMED)]
    before = rows()
    store.compact(spark, path, file_rows=200)
    index = store.file_index(spark, path).unionByName(store.file_index(spark, path, store.MALFORMED)).collect()
    assert sum(r["rows"] for r in index) == 2000 and max(r["rows"] for r in index) <= 400
    assert rows() == before


def test_compaction_of_a_store_without_rows(spark):
    path = _local(spark)
    store.write_batch(_records(spark, []), path, 0)
    store.compact(spark, path)
    assert store.read_store(spark, path).count() == 0
