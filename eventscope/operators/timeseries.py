"""Bucketed time series.

Buckets are epoch-aligned (UTC); every offered bucket divides a day, so they equal
midnight-anchored resampling.  Dense series (T1/T2) fill empty buckets between the
first and last observed bucket; keyed series are sparse (T3/T4) or filled across keys
for observed buckets only (T5/T6), exactly as the dashboards differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventscope.functions.timefn import bucket_micros, duration_us, micros_to_ts
from eventscope.operators.filters import in_top_k
from eventscope.operators.metrics import crosstab_long, crosstab_wide, flat_category

# Buckets generated per coarse grid row (see ``bucket_grid``).
GRID_SPAN = 4096


def _bucket_us(bucket: str | int) -> int:
    us = bucket if isinstance(bucket, int) else duration_us(bucket)
    if not us or us <= 0:
        raise ValueError(f"unknown bucket {bucket!r}")
    return us


def bucket_grid(lo_hi: DataFrame, bucket_us: int, partitions: int | None = None) -> DataFrame:
    """Every bucket start (epoch µs) from ``lo`` to ``hi`` of a one-row (lo, hi) frame.

    Lazy and distributed: the one row expands to coarse rows of ``GRID_SPAN``
    buckets, those are dealt over ``partitions`` tasks (the session's shuffle partitions
    unless given; a fixed number, which adaptive execution does not merge back), and each
    task expands its coarse rows.  Nothing returns to the driver.
    """
    span = bucket_us * GRID_SPAN
    coarse = lo_hi.where(F.col("lo").isNotNull()).select(
        "hi", F.explode(F.sequence(F.col("lo"), F.col("hi"), F.lit(span))).alias("c"))
    tasks = partitions or int(lo_hi.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coarse = coarse.repartition(tasks, "c")
    return coarse.select(F.explode(F.sequence(
        F.col("c"), F.least(F.col("c") + F.lit(span - bucket_us), F.col("hi")), F.lit(bucket_us))).alias("b"))


def dense_counts(df: DataFrame, bucket: str | int = "5s", count_col: str | None = None,
                 name: str = "event_count") -> DataFrame:
    """T1 (``count_col=None``: rows) and T2 (non-NULL values of ``count_col``).

    Rows without time are dropped (F7).  Observed counts are unioned with the zero
    grid and summed in one aggregation (map-side partial sums, one shuffle); the grid
    bounds come from a (min, max) aggregate that is itself combined map-side.
    """
    b = _bucket_us(bucket)
    x = df.where(F.col("ts").isNotNull()).select(
        bucket_micros(F.col("ts"), b).alias("b"),
        (F.lit(1) if count_col is None else F.col(count_col).isNotNull().cast("int")).alias("n"))
    lo_hi = x.agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    grid = bucket_grid(lo_hi, b).select("b", F.lit(0).alias("n"))
    return (x.unionByName(grid).groupBy("b").agg(F.sum("n").cast("long").alias(name))
             .select(micros_to_ts(F.col("b")).alias("timestamp"), name))


def _with_bucket(df: DataFrame, bucket: str | int) -> DataFrame:
    b = _bucket_us(bucket)
    return df.where(F.col("ts").isNotNull()).withColumn("timestamp", micros_to_ts(bucket_micros(F.col("ts"), b)))


def keyed_counts(df: DataFrame, key: str, bucket: str | int) -> DataFrame:
    """Sparse (bucket, key) counts: only observed pairs."""
    x = _with_bucket(df, bucket).where(F.col(key).isNotNull())
    return x.groupBy("timestamp", key).agg(F.count(F.lit(1)).alias("count"))


def top_categories_over_time(df: DataFrame, bucket: str | int = "5s", k: int = 5) -> DataFrame:
    """Counts of the top-``k`` categories per bucket, sparse, long form.

    The ranking is taken after dropping rows without time; the top-k keys (≤ k rows)
    are broadcast into a semi join (F5).
    """
    x = (df.where(F.col("ts").isNotNull())
           .select("ts", F.explode("product_categories").alias("category")))
    return keyed_counts(in_top_k(x, "category", k), "category", bucket)


def event_types_over_time(df: DataFrame, bucket: str | int = "5s") -> DataFrame:
    """T4: (bucket, event type) counts, sparse, long form."""
    return keyed_counts(df, "event_type", bucket)


def event_types_over_time_filled(df: DataFrame, bucket: str | int = "5s") -> DataFrame:
    """T5: observed buckets × event types present, zero-filled, long form."""
    return crosstab_long(_with_bucket(df, bucket), "timestamp", "event_type")


def event_types_over_time_wide(df: DataFrame, bucket: str | int = "15min") -> DataFrame:
    """T5, wide form: one row per observed bucket, one zero-filled column per type."""
    x = _with_bucket(df, bucket).where(F.col("event_type").isNotNull())
    return crosstab_wide(x, "timestamp", "event_type")


def categories_over_time_filled(df: DataFrame, bucket: str | int = "15min",
                                col: str = "product_category") -> DataFrame:
    """Observed buckets × all scalar categories present, zero-filled, long form."""
    x = _with_bucket(flat_category(df, col), bucket).withColumnRenamed(col, "category")
    return crosstab_long(x, "timestamp", "category")


def gated(series: DataFrame, min_buckets: int = 2, col: str = "timestamp",
          basis: DataFrame | None = None, bucket: str | int | None = None,
          key: str | None = None) -> DataFrame:
    """The series only when it spans at least ``min_buckets`` distinct buckets.

    The bucket count is a scalar subquery; the series is not collected to decide.
    With ``basis``/``bucket`` (and the series ``key``) the count is taken from the
    source rows, one aggregate, instead of re-deriving the whole series.
    """
    if basis is not None and bucket is not None:
        b = _with_bucket(basis, bucket)
        if key:
            b = b.where(F.col(key).isNotNull())
        n = b.select(F.count_distinct("timestamp")).scalar()
    else:
        n = series.select(F.count_distinct(col)).scalar()
    return series.where(n >= F.lit(min_buckets))
