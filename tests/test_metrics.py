"""Aggregations, rankings and series on inline rows, with pandas re-statements."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from eventscope.operators import metrics as M
from eventscope.operators import timeseries as TS
from eventscope.operators.normalize import prepare

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)
EL = "struct<product_id:string,product_category:string,price:string,product_type:string,brand:string>"


def _frame(spark, rows):
    df = spark.createDataFrame(rows, f"event_id string, event_type string, ts timestamp_ntz, products array<{EL}>")
    return prepare(df)


def _p(cat):
    return ("P100", cat, "$5", None, None)


def test_kpis_ignore_nulls(spark):
    df = _frame(spark, [("U1", "login", T0, None), ("U1", "purchase", T0, [_p("a"), _p("b")]),
                        (None, None, T0, [_p(None)])])
    r = M.kpis(df).first()
    assert (r.total_events, r.unique_event_types, r.total_products, r.unique_event_ids) == (3, 2, 3, 1)


def test_counts_tie_rule_and_top_k(spark):
    df = _frame(spark, [(u, "view_product", T0, None) for u in ["U3", "U3", "U1", "U1", "U2", "U2", "U4"]])
    got = [tuple(r) for r in M.top_ids(df, 2).collect()]
    assert got == [("U1", 2), ("U2", 2)]


def test_category_variants(spark):
    df = _frame(spark, [("U1", "view_product", T0, [_p("a"), _p(None), _p("")]),
                        ("U2", "login", T0, None)])
    drop = {r.category: r["count"] for r in M.category_counts(df, "drop").collect()}
    unk = {r.category: r["count"] for r in M.category_counts(df, "unknown").collect()}
    assert drop == {"a": 1}
    assert unk == {"a": 1, "Unknown": 1, "": 1}


def test_share_rounds_half_up(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 7)], "category string, count long")
    got = {r.category: r.pct for r in M.share_of_total(counts).collect()}
    assert got == {"a": 12.5, "b": 87.5}
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "category string, count long")
    got = {r.category: r.pct for r in M.share_of_total(counts).collect()}
    assert got == {"a": 33.3, "b": 66.7}


def test_journeys_match_pandas(spark):
    rows = [("U1", "login", T0, None), ("U1", "purchase", T0, None), ("U2", "login", T0, None),
            ("U2", "add_to_cart", T0, None), ("U3", "login", T0, None), ("U4", "purchase", T0, None),
            ("U5", "LOGIN", T0, None), ("U5", "Purchase", T0, None), ("U6", None, T0, None)]
    df = _frame(spark, rows)
    got = {r.event_id: r.journey_type for r in M.journeys(df).collect()}

    pdf = pd.DataFrame(rows, columns=["event_id", "event_type", "ts", "products"])

    def classify(events):
        s = set(events)
        if "login" in s and "purchase" in s:
            return "Completed Purchase"
        if "login" in s and "add_to_cart" in s:
            return "Abandoned Cart"
        if "login" in s:
            return "Browsing Only"
        return "Other"

    want = pdf.groupby("event_id")["event_type"].apply(list).apply(classify).to_dict()
    assert got == want
    folded = {r.event_id: r.journey_type for r in M.journeys(df, fold_case=True).collect()}
    assert folded["U5"] == "Completed Purchase" and got["U5"] == "Other"


def test_user_paths_are_ordered_across_chunks(spark):
    rows = [("U1", t, T0 + dt.timedelta(minutes=m), None)
            for t, m in [("login", 0), ("view_product", 61), ("purchase", 200), ("logout", 30)]]
    df = _frame(spark, rows).withColumn("row_id", F.monotonically_increasing_id())
    got = [(r.step, r.event_type) for r in M.user_paths(df).orderBy("step").collect()]
    assert got == [(1, "login"), (2, "logout"), (3, "view_product"), (4, "purchase")]


def test_user_paths_keep_rows_without_time(spark):
    rows = [("U1", "login", T0, None), ("U1", "purchase", None, None), ("U2", "logout", None, None)]
    df = _frame(spark, rows).withColumn("row_id", F.monotonically_increasing_id())
    got = sorted((r.event_id, r.step, r.event_type) for r in M.user_paths(df).collect())
    assert got == [("U1", 1, "purchase"), ("U1", 2, "login"), ("U2", 1, "logout")]


def test_crosstab_matches_pandas(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", None)]
    df = spark.createDataFrame(rows, "category string, event_type string")
    got = {(r.category, r.event_type): r["count"] for r in M.crosstab_long(df, "category", "event_type").collect()}
    pdf = pd.DataFrame(rows, columns=["category", "event_type"])
    want = pd.crosstab(pdf["category"], pdf["event_type"]).reset_index().melt(
        id_vars="category", var_name="event_type", value_name="count")
    assert got == {(a, b): c for a, b, c in want.itertuples(index=False)}


def test_dense_series_fills_gaps(spark):
    t = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [("U1", "login", t + dt.timedelta(seconds=s), None) for s in (1, 2, 21, 22)]
    df = _frame(spark, rows)
    got = [r.event_count for r in TS.dense_counts(df, "5s").orderBy("timestamp").collect()]
    assert got == [2, 0, 0, 0, 2]
    keyed = TS.event_types_over_time(df, "5s").count()
    assert keyed == 2  # sparse: no empty buckets


def test_dense_series_large_grid_is_exact(spark):
    # more buckets than one coarse grid row holds
    t = dt.datetime(2024, 1, 1)
    rows = [("U1", "login", t, None), ("U1", "login", t + dt.timedelta(seconds=5 * 10_000), None)]
    out = TS.dense_counts(_frame(spark, rows), "5s")
    assert out.count() == 10_001
    assert out.agg(F.sum("event_count")).first()[0] == 2


def test_filled_series_matches_pandas_unstack(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("U1", "login", t, None), ("U1", "purchase", t + dt.timedelta(seconds=1), None),
            ("U2", "login", t + dt.timedelta(seconds=12), None)]
    df = _frame(spark, rows)
    got = {(r.timestamp, r.event_type): r["count"] for r in TS.event_types_over_time_filled(df, "5s").collect()}
    pdf = pd.DataFrame(rows, columns=["event_id", "event_type", "timestamp", "products"])
    wide = pdf.set_index("timestamp").groupby([pd.Grouper(freq="5s"), "event_type"]).size().unstack(fill_value=0)
    want = {(ts.to_pydatetime(), et): int(wide.loc[ts, et]) for ts in wide.index for et in wide.columns}
    assert got == want
    assert TS.gated(TS.event_types_over_time_filled(df, "1h"), 2).count() == 0
    assert TS.gated(TS.event_types_over_time_filled(df, "5s"), 2).count() == 4


def test_top_categories_over_time(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("U1", "view_product", t + dt.timedelta(seconds=s), [_p(c)])
            for s, c in [(0, "a"), (1, "a"), (7, "b"), (8, "c"), (9, "a")]]
    got = {(r.timestamp.second, r.category): r["count"]
           for r in TS.top_categories_over_time(_frame(spark, rows), "5s", 2).collect()}
    assert got == {(0, "a"): 2, (5, "a"): 1, (5, "b"): 1}


def test_user_paths_spread_a_hot_user_over_tasks(spark):
    """A user with a third of all rows is numbered in many tasks, and exactly."""
    iso = spark.newSession()
    iso.conf.set("spark.sql.shuffle.partitions", "8")
    iso.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    iso.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # keep the window's partitioning visible
    iso.conf.set("spark.sql.session.timeZone", "UTC")
    hot = [("HOT", "view_product", T0 + dt.timedelta(minutes=7 * i)) for i in range(600)]
    cold = [(f"U{i % 300}", "login", T0 + dt.timedelta(minutes=i)) for i in range(1200)]
    df = prepare(iso.createDataFrame(hot + cold, "event_id string, event_type string, ts timestamp_ntz"))
    df = df.withColumn("row_id", F.monotonically_increasing_id())
    steps = M.ordered_steps(df, chunk_us=3_600_000_000).withColumn("pid", F.spark_partition_id())
    hot_rows = steps.where(F.col("event_id") == "HOT")
    assert hot_rows.select("pid").distinct().count() >= 4
    assert sorted(r.step for r in hot_rows.select("step").collect()) == list(range(1, 601))


def test_crosstab_has_no_key_cap_and_builds_without_a_job(spark):
    df = spark.range(20_002).selectExpr("concat('c', id % 10001) AS category", "if(id % 2 = 0, 'a', 'b') AS event_type")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("crosstab-build", "")
    out = M.crosstab_long(df, "event_type", "category")
    assert not list(tracker.getJobIdsForGroup("crosstab-build"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 2 * 10_001
    assert out.selectExpr("sum(count)").first()[0] == 20_002


def test_dense_grid_is_spread(spark):
    from eventscope.operators.timeseries import bucket_grid
    lo_hi = spark.createDataFrame([(0, 31_536_000_000_000)], "lo long, hi long")
    sizes = [r["n"] for r in bucket_grid(lo_hi, 1_000_000, 8).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 31_536_001 and len(sizes) == 8 and max(sizes) < 3 * sum(sizes) / 8


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from eventscope.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda k, d=None: d)
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=conf))
