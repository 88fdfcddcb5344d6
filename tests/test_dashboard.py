"""The dashboard plan equals the individual named queries."""

from __spark_entry__ import queries
from eventscope.plans.dashboard import Dashboard
from eventscope.plans.tables import canonical_events


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dashboard_matches_named_queries(spark, sf_small):
    raw = canonical_events(spark, sf_small)
    page = Dashboard(window="24h", bucket="1h")
    m = page.metrics(raw)
    q = queries()
    assert _rows(m["kpis"]) == _rows(q["kpis"](spark, sf_small))
    assert _rows(m["journey_funnel"]) == _rows(q["journey_funnel"](spark, sf_small))
    assert len(page._cached) == 1
    page.release()
    whole = Dashboard(bucket="1h")
    full = whole.metrics(raw)
    assert whole._cached == []  # an unfiltered page is not cached
    assert _rows(full["events_over_time"]) == _rows(q["events_over_time_dense"](spark, sf_small))
    assert _rows(full["top_categories_over_time"]) == _rows(q["top_categories_over_time"](spark, sf_small))
    assert full["preview"].count() == 100
    assert full["data_status"].first().source_columns == len(raw.columns)
    assert [r.column for r in full["source_columns"].orderBy("position").collect()] == raw.columns


def test_dashboard_type_selection_and_recent(spark, sf_small):
    raw = canonical_events(spark, sf_small)
    page = Dashboard(event_types=[])
    assert page.metrics(raw)["kpis"].first().total_events == 0
    page.release()
    page = Dashboard(recent_only=True)
    assert page.metrics(raw)["kpis"].first().total_events >= 1
    page.release()


def test_other_pages_run(spark, sf_small):
    raw = canonical_events(spark, sf_small)
    q = queries()
    page = Dashboard(window="24h")
    for name, df in page.json_page(raw).items():
        df.collect()
    scan = page.scan_page(raw)
    assert _rows(scan["journey_funnel"]) == _rows(q["journey_funnel_folded"](spark, sf_small))
    for df in scan.values():
        df.collect()
    last = page.last_minute_page(raw)
    for df in last.values():
        df.collect()
    page.release()
    full = Dashboard(bucket="1h")
    assert _rows(full.scan_page(raw)["category_share"]) == _rows(q["category_share"](spark, sf_small))


def test_for_table_takes_now_from_footers(spark, sf_small):
    from eventscope.plans.tables import canonical_table_path, latest_event_time
    page, raw = Dashboard.for_table(spark, canonical_table_path(spark, sf_small), window="24h")
    assert page.as_of == latest_event_time(spark, sf_small)
    assert _rows(page.metrics(raw)["kpis"]) == _rows(queries()["kpis"](spark, sf_small))
    page.release()


def _events(spark, rows, schema="event_id string, event_type string, timestamp double"):
    return spark.createDataFrame(rows, schema)


def test_json_page_scopes(spark):
    """"Last 60 s" narrows the additional charts only; the status precedes the types."""
    raw = _events(spark, [("a", "login", 1000.0), ("b", "search", 1090.0), ("c", "purchase", 1100.0)])
    page = Dashboard(event_types=["login", "purchase"], recent_only=True)
    out = page.json_page(raw)
    assert out["kpis"].first().total_events == 2
    assert out["data_status"].first().total_rows == 3
    assert [r.event_id for r in out["top_ids"].collect()] == ["c"]
    page.release()


def test_user_id_tables_keep_their_users(spark):
    raw = _events(spark, [("u1", "login", "2024-01-01T00:00:00Z"), ("u1", "purchase", "2024-01-01T00:00:05Z"),
                          ("u2", "login", "2024-01-01T00:00:09Z")], "user_id string, event_type string, timestamp string")
    out = Dashboard().metrics(raw)
    assert [tuple(r) for r in out["top_ids"].collect()] == [("u1", 2), ("u2", 1)]
    assert {r.journey_type: r["count"] for r in out["journey_funnel"].collect()} == {"Completed Purchase": 1, "Browsing Only": 1}


def test_no_valid_time_leaves_the_frame(spark):
    import datetime as dt
    raw = _events(spark, [("a", "login", None), ("b", "search", None)])
    page = Dashboard(window="24h", as_of=dt.datetime(2024, 1, 1))
    assert page.metrics(raw)["kpis"].first().total_events == 2
    page.release()


def test_merged_tables_derive_the_count_anew(spark, tmp_path):
    from eventscope.sources.files import read_event_table
    products = "array<struct<product_id:string,product_category:string,price:string,product_type:string,brand:string>>"
    one = spark.createDataFrame([("a", "view_product", 1.0, [("p", "c", "$1", None, None)], 1)],
                                f"event_id string, event_type string, timestamp double, products {products}, product_count long")
    one.write.parquet(f"{tmp_path}/t/a")
    one.drop("product_count").write.parquet(f"{tmp_path}/t/b")
    table = read_event_table(spark, f"{tmp_path}/t/*", merge_schema=True)
    assert Dashboard().metrics(table)["kpis"].first().total_products == 2


def test_window_reaches_the_scan_of_an_ingested_table(spark, tmp_path):
    """A table as the ingest job writes it has no ``ts``: the window bounds the stored seconds."""
    import datetime as dt
    rows = [(f"u{k}", "login", 1_700_000_000.0 + 3600 * k) for k in range(48)]
    _events(spark, rows).write.partitionBy("event_type").parquet(f"{tmp_path}/t")
    raw = spark.read.parquet(f"{tmp_path}/t")
    page = Dashboard(window="24h", as_of=dt.datetime(2023, 11, 16, 21, 13, 20), persist=False)
    f = page.filtered(raw)
    assert "GreaterThan(timestamp" in f._jdf.queryExecution().executedPlan().toString()
    assert f.count() == 24
