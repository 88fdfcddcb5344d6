"""Filters F1–F7 on inline rows."""

import datetime as dt

from eventscope.operators import filters as FL

T0 = dt.datetime(2024, 1, 2, 12, 0, 0)


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, event_type string, ts timestamp_ntz")


def test_window_is_strict_and_anchored_at_latest(spark):
    rows = [("U1", "login", T0), ("U1", "view_product", T0 - dt.timedelta(hours=1)),
            ("U2", "purchase", T0 - dt.timedelta(hours=24)), ("U3", "logout", None)]
    df = _events(spark, rows)
    assert FL.time_window(df, "24h").count() == 2  # exactly 24h before is excluded, NULL ts dropped
    assert FL.time_window(df, "All").count() == 4
    assert FL.time_window(df, "3w").count() == 4  # unknown suffix → no filter
    assert FL.time_window(df, "30min", as_of=T0 + dt.timedelta(minutes=10)).count() == 1
    assert FL.time_window(df, "30min", as_of=FL.latest_ts(df)).count() == 1


def test_window_without_valid_times_is_noop(spark):
    df = _events(spark, [("U1", "login", None), ("U2", "login", None)])
    assert FL.time_window(df, "1h").count() == 2


def test_event_type_selection(spark):
    df = _events(spark, [("U1", "login", T0), ("U2", None, T0), ("U3", "purchase", T0)])
    assert FL.event_types(df, None).count() == 3
    assert FL.event_types(df, []).count() == 0
    assert FL.event_types(df, ["login", "purchase"]).count() == 2


def test_recent_and_chain(spark):
    rows = [("U1", "login", T0), ("U1", "purchase", T0 - dt.timedelta(seconds=59)),
            ("U2", "purchase", T0 - dt.timedelta(seconds=60))]
    df = _events(spark, rows)
    assert FL.recent(df, 60).count() == 2
    assert FL.dashboard_filters(df, "1h", ["purchase"], recent_only=True).count() == 1
    assert FL.dashboard_filters(df, "All", [], recent_only=False).count() == 0


def test_top_k_semi_join_with_ties(spark):
    rows = [(c,) for c in ["b", "b", "a", "a", "c", "c", "d"]]
    df = spark.createDataFrame(rows, "category string")
    keys = [r[0] for r in FL.top_k_keys(df, "category", 2).collect()]
    assert keys == ["a", "b"]  # count desc, then key asc
    assert FL.in_top_k(df, "category", 2).count() == 4


def test_valid_categories_and_time(spark):
    df = spark.createDataFrame([("a", T0), ("", T0), (None, None)], "category string, ts timestamp_ntz")
    assert FL.valid_categories(df).count() == 1
    assert FL.with_time(df).count() == 2


def test_window_literal_ignores_local_time_zone(spark, monkeypatch):
    """The anchor literal keeps its wall-clock even if the Python process is not on UTC."""
    import time
    rows = [("U1", "login", T0), ("U1", "view_product", T0 - dt.timedelta(hours=5))]
    df = _events(spark, rows)
    monkeypatch.setenv("TZ", "America/Los_Angeles")
    time.tzset()
    try:
        assert FL.time_window(df, "6h", as_of=T0).count() == 2
        assert FL.time_window(df, "4h", as_of=T0).count() == 1
        aware = T0.replace(tzinfo=dt.timezone.utc)
        assert FL.time_window(df, "4h", as_of=aware).count() == 1
    finally:
        monkeypatch.delenv("TZ")
        time.tzset()
