"""Named queries: each maps (spark, sf_dir) to a lazy DataFrame.

Every query reads the canonical event table that Spark builds from the driver's
tables (``eventscope.plans.tables``; its work grows with them) and applies the
operators of ``eventscope.operators``.  The DuckDB twin of each
query is in ``eventscope.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventscope.functions import products as P
from eventscope.operators import contracts as C
from eventscope.operators import filters as FL
from eventscope.operators import matrix as MX
from eventscope.operators import metrics as M
from eventscope.operators import normalize as N
from eventscope.operators import numbering as NB
from eventscope.operators import timeseries as TS
from eventscope.plans.tables import canonical_events, latest_event_time, prepared_events
from eventscope.sources.kafka import parse_records, to_records

Query = Callable[[SparkSession, str], DataFrame]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical nested events as stored by the ingest (built from the driver tables)."""
    return canonical_events(spark, sf_dir)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_events(spark, sf_dir)


def anchor(spark: SparkSession, sf_dir: str):
    """'Now' of the relative windows: the latest stored event time, as a literal.

    One single-value aggregate (reads only the ``ts`` column, max combined per task);
    as a literal the window predicate is pushed into the Parquet scan, where the
    ts-sorted files let it skip row groups outside the window.
    """
    return latest_event_time(spark, sf_dir)


def _windowed(spark, sf_dir, window: str) -> DataFrame:
    return FL.time_window(prepared(spark, sf_dir), window, anchor(spark, sf_dir))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("row_id", "event_id", "event_type", "ts")


def q_kpis(spark, sf_dir):
    return M.kpis(_windowed(spark, sf_dir, "24h"))


def q_kpis_all(spark, sf_dir):
    return M.kpis(prepared(spark, sf_dir))


def q_data_status(spark, sf_dir):
    return M.data_status(raw(spark, sf_dir), "24h", anchor(spark, sf_dir))


def q_event_type_counts(spark, sf_dir):
    return M.event_type_counts(prepared(spark, sf_dir))


def q_event_types_sorted(spark, sf_dir):
    return M.event_types_sorted(prepared(spark, sf_dir))


def q_event_types_distinct(spark, sf_dir):
    return M.event_types_distinct(prepared(spark, sf_dir))


def q_category_counts(spark, sf_dir):
    return M.category_counts(prepared(spark, sf_dir), "drop")


def q_category_counts_unknown(spark, sf_dir):
    return M.category_counts(prepared(spark, sf_dir), "unknown")


def q_scalar_category_counts(spark, sf_dir):
    return M.scalar_category_counts(prepared(spark, sf_dir))


def q_category_share(spark, sf_dir):
    return M.share_of_total(M.scalar_category_counts(prepared(spark, sf_dir)))


def q_category_list_csv(spark, sf_dir):
    df = prepared(spark, sf_dir)
    return df.select("row_id", "event_id", "event_type", "ts", "product_count",
                     P.categories_text(F.col("product_categories")).alias("product_categories"))


def q_preview(spark, sf_dir):
    df = N.preview(prepared(spark, sf_dir), 100)
    return df.withColumn("product_categories", P.categories_text(F.col("product_categories")))


def q_product_normalized(spark, sf_dir):
    df = prepared(spark, sf_dir)
    x = df.select("row_id", F.posexplode("products").alias("pos", "p"))
    return x.select("row_id", (F.col("pos") + 1).cast("long").alias("pos"),
                    *[F.col("p")[f].alias(f) for f in ("product_id", "product_category", "price",
                                                       "product_type", "brand")])


def q_category_matrix(spark, sf_dir):
    return M.category_matrix(prepared(spark, sf_dir))


def q_first_category_matrix(spark, sf_dir):
    return M.first_category_matrix(prepared(spark, sf_dir))


def q_category_matrix_wide(spark, sf_dir):
    return M.scalar_category_matrix(prepared(spark, sf_dir))


def q_user_paths(spark, sf_dir):
    return M.user_paths(prepared(spark, sf_dir))


def q_path_counts(spark, sf_dir):
    """How many user-days have the same whole path."""
    e = prepared(spark, sf_dir).select("row_id", "event_id", "event_type", "ts", F.to_date("ts").alias("day"))
    steps = NB.ranked_in_keys(e, ["event_id", "day"], ["ts", "row_id"])
    return NB.equal_paths(NB.path_digests(steps, ["event_id", "day"], "event_type"), "event_id")


def q_user_category_matrix(spark, sf_dir):
    """User × category, zero-filled, by numbered keys and blocks."""
    x = prepared(spark, sf_dir).select("event_id", F.explode("product_categories").alias("category"))
    return MX.filled(MX.block_matrix(x, "event_id", "category", side=64))


def q_journey_by_user(spark, sf_dir):
    return M.journeys(_windowed(spark, sf_dir, "24h"))


def q_journey_funnel(spark, sf_dir):
    return M.journey_funnel(_windowed(spark, sf_dir, "24h"))


def q_journey_funnel_daily(spark, sf_dir):
    return M.journey_funnel(prepared(spark, sf_dir), per_day=True)


def q_journey_funnel_folded(spark, sf_dir):
    return M.journey_funnel(_windowed(spark, sf_dir, "24h"), fold_case=True)


def q_top_ids(spark, sf_dir):
    return M.top_ids(prepared(spark, sf_dir), 5)


def q_top_categories(spark, sf_dir):
    return M.top_categories(prepared(spark, sf_dir), 5)


def q_events_over_time_dense(spark, sf_dir):
    return TS.dense_counts(prepared(spark, sf_dir), "1h")


def q_user_events_dense(spark, sf_dir):
    return TS.dense_counts(_windowed(spark, sf_dir, "30min"), "500ms", count_col="event_id")


def q_top_categories_over_time(spark, sf_dir):
    return TS.top_categories_over_time(prepared(spark, sf_dir), "1h", 5)


def q_event_types_over_time(spark, sf_dir):
    return TS.event_types_over_time(prepared(spark, sf_dir), "15min")


def q_event_types_over_time_filled(spark, sf_dir):
    return TS.event_types_over_time_filled(prepared(spark, sf_dir), "15min")


def q_event_types_over_time_wide(spark, sf_dir):
    return TS.event_types_over_time_wide(prepared(spark, sf_dir), "15min")


def q_categories_over_time_filled(spark, sf_dir):
    return TS.categories_over_time_filled(prepared(spark, sf_dir), "15min")


def q_event_types_over_time_gated(spark, sf_dir):
    df = prepared(spark, sf_dir)
    return TS.gated(TS.event_types_over_time_filled(df, "1h"), 2, basis=df, bucket="1h", key="event_type")


def q_window_filter(spark, sf_dir):
    return _rows(_windowed(spark, sf_dir, "24h"))


def q_type_filter(spark, sf_dir):
    return _rows(FL.event_types(prepared(spark, sf_dir), ["purchase", "add_to_cart"]))


def q_recent_60s(spark, sf_dir):
    return _rows(FL.recent(prepared(spark, sf_dir), 60, anchor(spark, sf_dir)))


# ---- shapes, codec, contracts ----------------------------------------------------

def shape_frames(spark, sf_dir) -> list[DataFrame]:
    """The bridge events rendered in the three producer shapes (v2, v1, v0)."""
    r = raw(spark, sf_dir)
    first = F.get(F.col("products"), 0)["product_category"]
    v2 = r.select(F.lit("v2").alias("shape"), "row_id", "event_id", "event_type", "timestamp", "ip",
                  "device", "user_type", "products")
    v1 = r.select(F.lit("v1").alias("shape"), "row_id", F.col("event_id").alias("user_id"), "event_type",
                  F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "ip", "device",
                  "user_type", "products")
    v0 = r.select(F.lit("v0").alias("shape"), "row_id",
                  F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                  F.col("event_id").alias("user_id"), "event_type",
                  F.lower(first).alias("product_category"))
    return [v2, v1, v0]


def q_union_shapes(spark, sf_dir):
    u = N.union_shapes(*shape_frames(spark, sf_dir), keep=["shape", "row_id"])
    p = N.prepare(u)
    return p.select("shape", "row_id", "event_id", "event_type", "ts", "product_count",
                    F.get(F.col("products"), 0)["product_category"].alias("first_category"))


def q_json_roundtrip_parse(spark, sf_dir):
    records = to_records(raw(spark, sf_dir), key="row_id")
    parsed = parse_records(records, keep=["key"]).withColumn("row_id", F.col("key").cast("string").cast("long"))
    p = N.prepare(parsed.drop("key", "_corrupt_record"))
    return p.select("row_id", "event_id", "event_type", "timestamp", "product_count",
                    P.categories_text(F.col("product_categories")).alias("product_categories"))


def q_contract_event(spark, sf_dir):
    return C.rule_counts(prepared(spark, sf_dir), C.event_rules())


def q_contract_products(spark, sf_dir):
    """V2 and V3 in one scan."""
    return C.count_totals(prepared(spark, sf_dir), {**C.counted(C.product_count_rules()), **C.product_counts()})


def q_contract_taxonomy(spark, sf_dir):
    prods = C.exploded_products(prepared(spark, sf_dir), fields=C.TAXONOMY_FIELDS)
    return C.rule_counts(prods, C.builtin_taxonomy_rules())


def q_contract_taxonomy_table(spark, sf_dir):
    """V4 with the taxonomy given as a table (one join, by size)."""
    prods = C.exploded_products(prepared(spark, sf_dir), fields=C.TAXONOMY_FIELDS)
    flagged = C.with_taxonomy_flags(prods, C.taxonomy_frame(spark))
    return C.rule_counts(flagged, C.taxonomy_rules())


def q_contract_violations(spark, sf_dir):
    """Row-level V1–V3: one row per (event, violated rule), in one scan without a shuffle."""
    counts = {**C.counted({**C.event_rules(), **C.product_count_rules()}), **C.product_counts()}
    return C.counted_violations(prepared(spark, sf_dir), counts, ["row_id"])


def q_missing_fields(spark, sf_dir):
    return C.missing_fields(raw(spark, sf_dir))


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in dict(globals()).items() if name.startswith("q_") and callable(fn)
}
