"""Live metrics as event-time streaming aggregations.

Event time is cast to ``timestamp`` (watermarks reject ``timestamp_ntz``) and results
are cast back.  Append mode: a window is emitted once, when the watermark
(latest event time − delay) passes its end; later rows for it are dropped.
State is bounded by the watermark, and each aggregation is a hash-partitioned shuffle
with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventscope.operators.metrics import journey_class

ET = "_event_time"


def with_watermark(stream: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    return stream.withColumn(ET, F.col(ts).cast("timestamp")).withWatermark(ET, delay)


def _bounds(w: str = "window") -> list:
    return [F.col(f"{w}.start").cast("timestamp_ntz").alias("window_start"),
            F.col(f"{w}.end").cast("timestamp_ntz").alias("window_end")]


def live_counts(stream: DataFrame, length: str = "1 hour", delay: str = "10 minutes",
                by: tuple[str, ...] = ("event_type",), slide: str | None = None) -> DataFrame:
    """R4 (tumbling) / R5 (``slide`` given: sliding) event counts per window."""
    for k in by:  # NULL keys are not a group, as in the batch counts
        stream = stream.where(F.col(k).isNotNull())
    x = with_watermark(stream, delay)
    w = F.window(ET, length, slide) if slide else F.window(ET, length)
    agg = x.groupBy(w.alias("window"), *by).agg(F.count(F.lit(1)).alias("count"))
    return agg.select(*_bounds(), *by, "count")


def live_journeys(stream: DataFrame, length: str = "1 day", delay: str = "1 hour",
                  key: str = "event_id", slide: str | None = None) -> DataFrame:
    """R6 (and R5's live funnel with ``slide``): journey classes per window, as two
    chained stateful aggregations.

    First (window, user) → membership flags; then users per class, keyed by a
    tumbling window of the slide length over the first window's ``window_time``:
    that window ends where the first one ends, so each (sliding) window is counted
    once.  Both operators run in append mode.
    """
    x = with_watermark(stream.where(F.col(key).isNotNull()), delay)
    t = F.col("event_type")
    step = slide or length

    def has(v):
        return F.bool_or(t == F.lit(v)).alias(v)

    first = F.window(ET, length, slide) if slide else F.window(ET, length)
    flags = x.groupBy(first.alias("window"), key).agg(
        has("login"), has("purchase"), has("add_to_cart"))
    classes = flags.select(F.window_time("window").alias("wt"),
                           journey_class(F.coalesce(F.col("login"), F.lit(False)),
                                         F.coalesce(F.col("purchase"), F.lit(False)),
                                         F.coalesce(F.col("add_to_cart"), F.lit(False))).alias("journey_type"))
    counts = classes.groupBy(F.window("wt", step).alias("window"), "journey_type").agg(
        F.count(F.lit(1)).alias("count"))
    end = F.col("window.end")
    return counts.select((end - F.expr(f"INTERVAL {length}")).cast("timestamp_ntz").alias("window_start"),
                         end.cast("timestamp_ntz").alias("window_end"), "journey_type", "count")


def live_page(stream: DataFrame, length: str = "60 seconds", slide: str = "5 seconds",
              delay: str = "10 seconds", key: str = "event_id") -> DataFrame:
    """R5, live: one row per sliding window with its distinct users, their events and the users
    of each journey class, as soon as the watermark has passed the window.

    (window, user) → events and flags, then one row per window; both aggregations are stateful
    and run in append mode.
    """
    from eventscope.streaming.drain import PAGE_CLASSES, page_row
    x = with_watermark(stream.where(F.col(key).isNotNull()), delay)
    users = x.groupBy(F.window(ET, length, slide).alias("window"), key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.bool_or(F.col("event_type") == v), F.lit(False)).alias(v) for v in ("login", "purchase", "add_to_cart")])
    page = page_row(users.withColumn("wt", F.window_time("window")), F.window("wt", slide).alias("window"))
    end = F.col("window.end")
    return page.select((end - F.expr(f"INTERVAL {length}")).cast("timestamp_ntz").alias("window_start"),
                       end.cast("timestamp_ntz").alias("window_end"), "users", "events", *PAGE_CLASSES)


def live_category_counts(stream_products: DataFrame, length: str = "1 day",
                         delay: str = "1 hour") -> DataFrame:
    """R7, stateful half: (window, category) counts of valid categories."""
    x = with_watermark(stream_products.where(
        F.col("product_category").isNotNull() & (F.col("product_category") != F.lit(""))), delay)
    agg = x.groupBy(F.window(ET, length).alias("window"),
                    F.col("product_category").alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return agg.select(*_bounds(), "category", "count")


def top_per_window(batch: DataFrame, k: int = 5) -> DataFrame:
    """R7, per micro-batch half: top-``k`` categories of each closed window.

    Runs on the batch of closed windows (bounded by the categories per window).
    """
    w = Window.partitionBy("window_start").orderBy(F.col("count").desc(), F.col("category").asc())
    return batch.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
