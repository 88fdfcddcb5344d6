"""Normalisation and projections (N4–N15) and shape unification.

Every function maps a DataFrame to a DataFrame lazily; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventscope.functions import products as P
from eventscope.functions.timefn import coerce_ts, ts_to_epoch
from eventscope.schema import CONTEXT_FIELDS, PRODUCTS_TYPE, UNKNOWN_ID


def ensure_columns(df: DataFrame) -> DataFrame:
    """Add absent columns with defaults; NULL cells of present columns are kept.

    event_type / event_id → ``'unknown'``, timestamp → NULL, products → ``[]``.
    """
    cols = set(df.columns)
    if "event_type" not in cols:
        df = df.withColumn("event_type", F.lit(UNKNOWN_ID))
    if "event_id" not in cols:
        df = df.withColumn("event_id", F.lit(UNKNOWN_ID))
    if "timestamp" not in cols and "ts" not in cols:
        df = df.withColumn("timestamp", F.lit(None).cast("double"))
    if "products" not in cols:
        df = df.withColumn("products", F.array().cast(PRODUCTS_TYPE))
    return df


def prepare(df: DataFrame, precision: str = "micro") -> DataFrame:
    """The prepared event frame all metrics read.

    Adds ``ts``, normalises ``products`` (N6) and derives ``product_categories``
    (N7, drop variant), ``categories_unknown`` (N7b) and ``product_count`` (N8).
    Higher-order functions only, in two projections (each DataFrame step is analysed
    eagerly, so one wide select beats a chain of ``withColumn``); columns a metric
    does not use are pruned by Catalyst.

    Stored struct products: the drop-variant categories are a field extraction of the
    raw array, so a category query reads just ``products.product_category`` (nested
    column pruning).  A canonical table (written with ``product_count``; its products
    are normalised at write time) is used as stored: no normalising ``transform``,
    every derived column a field extraction, the count read as is.
    """
    df = ensure_columns(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    ts = F.col("ts") if "ts" in types else coerce_ts(F.col("timestamp"), types["timestamp"], precision)
    raw_type = types["products"]
    direct = (isinstance(raw_type, T.ArrayType) and isinstance(raw_type.elementType, T.StructType)
              and "product_category" in raw_type.elementType.fieldNames())
    canonical = direct and "product_count" in types and raw_type == PRODUCTS_TYPE
    raw = F.col("products")
    prods = raw if canonical else P.normalize_products(raw, raw_type)
    first = [*[c for c in df.columns if c not in ("ts", "products", "product_count")],
             ts.alias("ts"), prods.alias("products")]
    if direct:
        first.append(P.categories_dropping_fields(raw).alias("product_categories"))
    if canonical:
        first += [P.categories_unknown_fields(raw).alias("categories_unknown"),
                  F.coalesce(F.col("product_count").cast("long"), F.lit(0).cast("long")).alias("product_count")]
    base = df.select(*first)
    if canonical:
        return base
    p = F.col("products")
    later = [] if direct else [P.categories_dropping(p).alias("product_categories")]
    return base.select("*", *later, P.categories_unknown(p).alias("categories_unknown"),
                       P.product_count(p).alias("product_count"))


def fold_event_types(df: DataFrame, drop_null: bool = True) -> DataFrame:
    """Lower-case event types; drop NULL types unless ``drop_null`` is False."""
    df = df.withColumn("event_type", F.lower("event_type"))
    return df.where(F.col("event_type").isNotNull()) if drop_null else df


PREVIEW_COLUMNS = ["event_id", "event_type", "ts", "product_count", "product_categories"]


def preview(df: DataFrame, n: int = 100, columns: list[str] | None = None) -> DataFrame:
    """The chosen columns that exist, first ``n`` rows in a stable order.

    The order (ts, event_id, row_id) makes the preview reproducible; Spark plans the
    ordered limit as a per-partition top-n plus a final merge (TakeOrderedAndProject).
    """
    cols = [c for c in (columns or PREVIEW_COLUMNS) if c in df.columns]
    order = [c for c in ("ts", "event_id", "row_id") if c in df.columns]
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).select(*cols).limit(n)


def source_columns(df: DataFrame) -> list[str]:
    """The column names of the source (schema metadata, no job)."""
    return list(df.columns)


def explode_categories(df: DataFrame, col: str = "product_categories",
                       alias: str = "category") -> DataFrame:
    """One row per category; events without categories produce no row."""
    return df.select(*[c for c in df.columns if c != col], F.explode(col).alias(alias))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fixed column list; absent columns become NULL strings."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
                       for c in columns])


# ---- shapes (U2) -------------------------------------------------------------

def detect_shape(df: DataFrame) -> str:
    cols = set(df.columns)
    if "product_category" in cols and "products" not in cols:
        return "v0"
    if "user_id" in cols and "event_id" not in cols:
        return "v1"
    return "v2"


def _canonical_select(df: DataFrame, keep, key: str, products: Column | None) -> DataFrame:
    """One projection to the canonical columns (each DataFrame step is analysed, so
    the shape mappings are built as expressions and applied once)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    if "ts" in types:
        ts = F.col("ts").cast("timestamp_ntz")
    elif "timestamp" in types:
        ts = coerce_ts(F.col("timestamp"), types["timestamp"])
    else:
        ts = F.lit(None).cast("timestamp_ntz")
    if isinstance(types.get("timestamp"), T.NumericType):
        epoch = F.col("timestamp").cast("double")
    else:  # absent or text: the stored form is epoch seconds
        epoch = ts_to_epoch(ts)

    def text(name, default=None):
        return F.col(name).cast("string") if name in types else F.lit(default).cast("string")

    if products is None:
        products = (P.normalize_products(F.col("products"), types["products"]) if "products" in types
                    else F.array().cast(PRODUCTS_TYPE))
    return df.select(*[c for c in keep if c in types],
                     text(key, UNKNOWN_ID).alias("event_id"), text("event_type", UNKNOWN_ID).alias("event_type"),
                     epoch.alias("timestamp"), ts.alias("ts"),
                     *[text(c).alias(c) for c in CONTEXT_FIELDS], products.alias("products"))


def from_v2(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Canonical nested events (optionally with context fields) → canonical columns."""
    return _canonical_select(df, keep, "event_id", None)


def from_v1(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Early nested events: ``user_id`` is the key, ``timestamp`` is ISO text."""
    return _canonical_select(df, keep, "user_id", None)


def from_v0(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Flat events: the scalar ``product_category`` becomes a one-element product list."""
    cat = F.col("product_category").cast("string")
    prods = F.when(cat.isNotNull(),
                   F.array(F.struct(*[(cat if f == "product_category" else F.lit(None).cast("string")).alias(f)
                                      for f in PRODUCTS_TYPE.elementType.fieldNames()])))
    return _canonical_select(df, keep, "user_id",
                             F.coalesce(prods, F.array()).cast(PRODUCTS_TYPE))


def to_canonical(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Any known shape → canonical columns (picked from the schema, no job)."""
    return {"v0": from_v0, "v1": from_v1, "v2": from_v2}[detect_shape(df)](df, keep)


def union_shapes(*frames: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Normalise each frame, then union by name (a narrow, shuffle-free union)."""
    return reduce(lambda a, b: a.unionByName(b), [to_canonical(f, keep) for f in frames])


def union_batches(*frames: DataFrame) -> DataFrame:
    """Append batches whose columns differ; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
