"""Physical-plan properties that matter at scale."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from eventscope.operators import filters as FL
from eventscope.operators import metrics as M
from eventscope.operators.normalize import prepare
from eventscope.plans.catalog import QUERIES
from eventscope.plans.tables import canonical_events, latest_event_time

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
            "PythonUDF", "pythonUDF")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partition_filter_on_event_type(spark, sf_small):
    df = FL.event_types(canonical_events(spark, sf_small), ["purchase"])
    p = plan(df.select("event_id"))
    assert "PartitionFilters: [isnotnull(event_type" in p and "purchase" in p


def test_nested_column_pruning(spark, sf_small):
    df = canonical_events(spark, sf_small).select(F.col("products.product_category"))
    p = plan(df)
    assert "ReadSchema: struct<products:array<struct<product_category:string>>>" in p


def test_window_predicate_is_pushed_to_scan(spark, sf_small):
    ev = canonical_events(spark, sf_small)
    df = FL.time_window(ev, "24h", latest_event_time(spark, sf_small)).select("event_id")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in p


def test_journeys_aggregate_partially_before_shuffle(spark, sf_small):
    p = plan(M.journeys(prepare(canonical_events(spark, sf_small))))
    assert "partial_max((event_type" in p  # bool_or is planned as max
    assert "collect_list" not in p


def test_top_k_is_take_ordered(spark, sf_small):
    p = plan(queries()["top_ids"](spark, sf_small))
    assert "TakeOrderedAndProject" in p


def test_top_k_filter_broadcasts_only_the_k_keys(spark, sf_small):
    p = plan(queries()["top_categories_over_time"](spark, sf_small))
    assert "BroadcastExchange" in p and "TakeOrderedAndProject" in p


def test_share_of_total_has_no_global_window(spark, sf_small):
    p = plan(queries()["category_share"](spark, sf_small))
    assert "Window" not in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_or_pairwise_joins_in_batch_plans(spark, sf_small, name):
    df = queries()[name](spark, sf_small)
    p = df._jdf.queryExecution().toString()
    assert not any(n in p for n in PY_NODES), name
    executed = plan(df)
    assert "CartesianProduct" not in executed and "BroadcastNestedLoopJoin" not in executed, name
    # no window without a partition key (it would move every row into one task)
    assert not re.search(r"Window \[.*\], \[\], \[", executed), name


def test_dense_grid_does_not_collect(spark):
    t = dt.datetime(2024, 1, 1)
    from eventscope.operators.timeseries import dense_counts
    df = spark.createDataFrame([("U1", "login", t), ("U1", "login", t + dt.timedelta(hours=30))],
                               "event_id string, event_type string, ts timestamp_ntz")
    p = plan(dense_counts(df, "1s"))
    assert "Generate explode(sequence" in p and "Exchange hashpartitioning(c#" in p


@pytest.mark.parametrize("name", ["category_counts", "top_categories", "category_matrix",
                                  "category_counts_unknown", "first_category_matrix",
                                  "scalar_category_counts", "category_matrix_wide", "category_share"])
def test_category_queries_read_only_the_category_field(spark, sf_small, name):
    p = plan(queries()[name](spark, sf_small))
    assert "ReadSchema: struct<products:array<struct<product_category:string>>>" in p


def test_share_total_is_one_subquery(spark, sf_small):
    p = plan(queries()["category_share"](spark, sf_small))
    assert p.count("Subquery subquery") == 1


def test_anchor_from_footers_equals_scan(spark, sf_small):
    from eventscope.operators.filters import latest_ts_value
    from eventscope.plans.tables import canonical_table_path, latest_from_footers
    path = canonical_table_path(spark, sf_small)
    footers = latest_from_footers(spark, path)
    assert footers is not None
    assert footers == latest_ts_value(canonical_events(spark, sf_small))
    # the caller's session keeps its own reader settings
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_kpis_read_no_product_fields(spark, sf_small):
    p = plan(queries()["kpis_all"](spark, sf_small))
    assert "ReadSchema: struct<event_id:string,product_count:bigint>" in p


@pytest.mark.parametrize("name,fields", [
    ("contract_products", "product_id:string,price:string"),
    ("contract_taxonomy", "product_category:string,product_type:string,brand:string"),
    ("missing_fields", "product_id:string"),
])
def test_contracts_read_only_needed_product_fields(spark, sf_small, name, fields):
    df = queries()[name](spark, sf_small)
    # the formatted explain prints the whole ReadSchema (the one-line plan truncates it)
    p = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert f"products:array<struct<{fields}>>" in p


def test_share_total_reuses_the_counts_shuffle(spark, sf_small):
    df = queries()["category_share"](spark, sf_small)
    df.collect()  # the final adaptive plan shows what ran
    assert "ReusedExchange" in plan(df)


def test_canonical_build_is_one_range_shuffle(spark, sf_small):
    from eventscope.sources.bridge import bridge_events
    p = plan(bridge_events(spark, sf_small, ranged=True).sortWithinPartitions("event_type", "ts"))
    assert p.count("Exchange rangepartitioning") == 1
    assert "Exchange hashpartitioning" not in p  # the nesting aggregate reuses the range partitioning
