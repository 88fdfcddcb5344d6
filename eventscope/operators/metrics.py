"""Aggregations (A1–A10) and rankings (L1–L4) over a prepared event frame.

Tie rule everywhere: count descending, then key ascending.  NULL keys are excluded
before grouping.  All groupings are hash aggregates with a map-side partial step, so
a hot key (one user, one category holding a third of the rows) is combined inside
each input partition before the shuffle and never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventscope.functions import products as P
from eventscope.functions.timefn import bucket_micros
from eventscope.operators.filters import window_predicate
from eventscope.schema import JOURNEY_ABANDONED, JOURNEY_BROWSING, JOURNEY_COMPLETED, JOURNEY_OTHER


def _counts(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))


def ranked(df: DataFrame, key: str, count: str = "count") -> DataFrame:
    """Apply the tie rule as the output order."""
    return df.orderBy(F.col(count).desc(), F.col(key).asc())


# ---- A1, A2 ------------------------------------------------------------------

def kpis(df: DataFrame) -> DataFrame:
    """A1: total events, distinct event types, total products, distinct ids (one row)."""
    return df.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct("event_type").alias("unique_event_types"),
        F.coalesce(F.sum("product_count"), F.lit(0)).cast("long").alias("total_products"),
        F.count_distinct("event_id").alias("unique_event_ids"),
    )


def data_status(df: DataFrame, window: str | None = "All", as_of=None,
                source_columns: int | None = None) -> DataFrame:
    """A2: total rows, rows inside the window, source column count, window label.

    One pass: the window predicate is evaluated as a ``count_if`` next to ``count``.
    ``source_columns`` defaults to the column count of ``df``.
    """
    p = window_predicate(df, window, as_of)
    in_window = F.count_if(p) if p is not None else F.count(F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        in_window.cast("long").alias("rows_in_window"),
    ).select("total_rows", "rows_in_window",
             F.lit(len(df.columns) if source_columns is None else source_columns)
             .cast("long").alias("source_columns"),
             F.lit(window or "All").alias("time_window"))


# ---- A3, A4, A5 ----------------------------------------------------------------

def event_type_counts(df: DataFrame) -> DataFrame:
    """A3: events per type, NULL type excluded."""
    return _counts(df, "event_type")


def category_counts(df: DataFrame, mode: str = "drop") -> DataFrame:
    """A4 (``mode='drop'``: NULL/'' removed) and A4b (``'unknown'``: NULL → 'Unknown')."""
    src = "product_categories" if mode == "drop" else "categories_unknown"
    x = df.select(F.explode(src).alias("category"))
    if mode == "drop":
        x = x.where(F.col("category").isNotNull() & (F.col("category") != F.lit("")))
    return _counts(x, "category")


def flat_category(df: DataFrame, name: str = "product_category") -> DataFrame:
    """The scalar category of the flat shape: the first product's category, or NULL."""
    if name in df.columns:
        return df
    # category field first, then the element: a prunable field extraction
    return df.withColumn(name, F.get(F.col("products")["product_category"], 0))


def scalar_category_counts(df: DataFrame, col: str = "product_category") -> DataFrame:
    """Counts of a scalar category column (NULL excluded)."""
    return _counts(flat_category(df, col), col).withColumnRenamed(col, "category")


def _div(a: Column, b: Column) -> Column:
    # floor(a / b) for bigint operands: a - pmod(a, b) is an exact multiple of b,
    # so the division below is exact while the values stay under 2**53
    return ((a - F.pmod(a, b)) / b).cast("long")


def share_of_total(counts: DataFrame, count: str = "count", name: str = "pct") -> DataFrame:
    """A5: percent of total, rounded half-up to one decimal, as DOUBLE.

    The total is an uncorrelated scalar subquery over the (already aggregated)
    counts, so no window moves the frame into a single partition.  Rounding is
    exact integer arithmetic: ``(2000·n + T) div (2·T) / 10``.
    """
    total = counts.select(F.sum(count)).scalar()
    # project the subquery once; the percentage then refers to the column
    with_total = counts.select("*", total.cast("long").alias("_total"))
    n, t = F.col(count).cast("long"), F.col("_total")
    return with_total.select(*counts.columns,
                             (_div(n * 2000 + t, t * 2).cast("double") / F.lit(10.0)).alias(name))


# ---- A6, A7, A8 ----------------------------------------------------------------

def ordered_steps(df: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("ts", "row_id"),
                  chunk_us: int = 3_600_000_000, name: str = "step") -> DataFrame:
    """Rank of each row inside its key by ``order`` (1, 2, …), skew-safe.

    A plain ``row_number() OVER (PARTITION BY key)`` sorts a whole key in one task.
    Here each key is cut into time chunks: rows are numbered inside (key, chunk)
    and shifted by the number of the key's rows in earlier chunks.  The offsets come
    from a (key, chunk) count table whose size is bounded by the time span, not by
    the rows; a hot key is spread over as many tasks as it has chunks.
    """
    order = tuple(c for c in order if c in df.columns)
    # rows without time form the first chunk (sorted first, as NULLS FIRST)
    chunk = F.coalesce(bucket_micros(F.col(order[0]), chunk_us), F.lit(-(2 ** 63)))
    x = df.where(F.col(key).isNotNull()).withColumn("_chunk", chunk)
    local = Window.partitionBy(key, "_chunk").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = x.withColumn("_local", F.row_number().over(local))
    # chunk sizes are counted map-side first: only (key, chunk, n) rows are shuffled
    per_chunk = x.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (numbered.join(offsets, [key, "_chunk"])
                    .withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
                    .drop("_chunk", "_off", "_local"))


def user_paths(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Each user's path in long form — one row per step, in event-time order.

    (A per-user array would gather an unbounded group into one row and task.)
    """
    cols = [c for c in ("row_id", "ts") if c in df.columns]
    return ordered_steps(df.select(key, "event_type", *cols), key).select(key, "step", *cols, "event_type")


def journey_class(login: Column, purchase: Column, cart: Column) -> Column:
    """First match wins: login+purchase, login+cart, login, else Other."""
    return (F.when(login & purchase, F.lit(JOURNEY_COMPLETED))
             .when(login & cart, F.lit(JOURNEY_ABANDONED))
             .when(login, F.lit(JOURNEY_BROWSING))
             .otherwise(F.lit(JOURNEY_OTHER)))


def journeys(df: DataFrame, key: str = "event_id", fold_case: bool = False,
             per_day: bool = False) -> DataFrame:
    """Journey class per user (or per user-day) from set membership only.

    ``bool_or`` flags combine map-side, so no per-user list is ever built.
    ``fold_case`` lower-cases types and ignores NULL types (N11 variant).
    """
    t = F.lower("event_type") if fold_case else F.col("event_type")
    keys = [key] + (["day"] if per_day else [])
    x = df.where(F.col(key).isNotNull())
    if per_day:
        x = x.where(F.col("ts").isNotNull()).withColumn("day", F.to_date("ts"))

    def has(v):
        return F.coalesce(F.bool_or(t == F.lit(v)), F.lit(False))

    flags = x.groupBy(*keys).agg(has("login").alias("login"), has("purchase").alias("purchase"),
                                 has("add_to_cart").alias("cart"))
    return flags.select(*keys, journey_class(F.col("login"), F.col("purchase"), F.col("cart"))
                        .alias("journey_type"))


def journey_funnel(df: DataFrame, key: str = "event_id", fold_case: bool = False,
                   per_day: bool = False) -> DataFrame:
    """Users per journey class."""
    return journeys(df, key, fold_case, per_day).groupBy("journey_type").agg(
        F.count(F.lit(1)).alias("count"))


# ---- A9, A10 -------------------------------------------------------------------

def to_long(wide: DataFrame, ids: list[str], var: str, value: str) -> DataFrame:
    """A10: wide → long (``unpivot``; a per-row generator, no shuffle)."""
    vals = [c for c in wide.columns if c not in ids]
    if not vals:
        return wide.select(*ids, F.lit(None).cast("string").alias(var),
                           F.lit(None).cast("long").alias(value)).where(F.lit(False))
    return wide.unpivot(ids, vals, var, value)


def crosstab_long(df: DataFrame, row: str, col: str, row_name: str | None = None) -> DataFrame:
    """Zero-filled contingency table in long form, over the row keys × column keys present.

    The pairs are counted once; the column keys of those counts are one array (a scalar
    subquery), which is exploded beside each row key and filled from the pairs' map.
    Building it runs no job, the number of keys has no cap, and nothing is collected.
    """
    x = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    pairs = x.groupBy(row, col).agg(F.count(F.lit(1)).alias("count"))
    keys = pairs.select(F.sort_array(F.collect_set(col))).scalar()
    rows = pairs.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(col, "count"))).alias("_seen"))
    out = rows.select(F.col(row), "_seen", F.explode(keys).alias(col)).select(
        row, col, F.coalesce(F.element_at("_seen", F.col(col)), F.lit(0)).cast("long").alias("count"))
    return out.withColumnRenamed(row, row_name) if row_name else out


def crosstab_wide(x: DataFrame, row: str, col: str) -> DataFrame:
    """One zero-filled column per key of ``col``; for event types and the like.

    A frame's columns must be known when it is built, so this reads the keys first (one
    small job, the keys of the wide form only) and hands them to ``pivot``, which then has
    no limit of its own.
    """
    keys = sorted(r[0] for r in x.select(col).distinct().collect())
    if not keys:
        return x.groupBy(row).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return x.groupBy(row).pivot(col, keys).agg(F.count(F.lit(1))).na.fill(0)


def category_matrix(df: DataFrame) -> DataFrame:
    """Exploded categories (drop variant) × event type, zero-filled, long form."""
    x = df.select("event_type", F.explode("product_categories").alias("category"))
    return crosstab_long(x, "category", "event_type")


def first_category_matrix(df: DataFrame) -> DataFrame:
    """First category ('Unknown' when none) × event type, zero-filled, long form."""
    x = df.select("event_type", P.first_category(F.col("categories_unknown")).alias("category"))
    return crosstab_long(x, "category", "event_type")


def scalar_category_matrix(df: DataFrame, col: str = "product_category") -> DataFrame:
    """Scalar category × event type, wide form (one column per type), zero-filled."""
    x = flat_category(df, col)
    x = x.where(F.col(col).isNotNull() & F.col("event_type").isNotNull())
    return crosstab_wide(x.withColumnRenamed(col, "category"), "category", "event_type")


# ---- L1–L4 ---------------------------------------------------------------------

def top_k(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """L1/L2: the ``k`` most frequent keys (TakeOrderedAndProject: per-partition top-k)."""
    return ranked(_counts(df, key), key).limit(k)


def top_ids(df: DataFrame, k: int = 5) -> DataFrame:
    """L1."""
    return top_k(df, "event_id", k)


def top_categories(df: DataFrame, k: int = 5) -> DataFrame:
    """L2 (drop variant)."""
    x = df.select(F.explode("product_categories").alias("category"))
    return top_k(x.where(F.col("category") != F.lit("")), "category", k)


def event_types_sorted(df: DataFrame) -> DataFrame:
    """L3: distinct event types, NULL excluded, ascending."""
    return (df.select("event_type").where(F.col("event_type").isNotNull()).distinct()
              .orderBy("event_type"))


def event_types_distinct(df: DataFrame) -> DataFrame:
    """L4: distinct event types in no particular order (NULL kept)."""
    return df.select("event_type").distinct()
