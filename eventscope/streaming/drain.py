"""Finite drains: streaming metrics whose answer accounts for every event.

A backlog is read with ``availableNow`` in any number of micro-batches, in any file
order.  Each batch writes a *partial* aggregate (counts per pane, flags per user) into its
own ``batch_id=<n>`` folder with overwrite, so a replayed batch replaces itself; the
partials are merged when the drain is done.  No watermark is involved: nothing is dropped
as late and the last windows are there.  The live variants with watermarks are in
:mod:`eventscope.streaming.live`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventscope.functions.timefn import bucket_micros, duration_us, micros_to_ts
from eventscope.operators.metrics import journey_class
from eventscope.schema import JOURNEY_ABANDONED, JOURNEY_BROWSING, JOURNEY_COMPLETED, JOURNEY_OTHER
from eventscope.session import work_path
from eventscope.streaming.runner import await_done


def drain(stream: DataFrame, name: str, partial: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The partial aggregates of all micro-batches of ``stream``, as one frame."""
    spark = stream.sparkSession
    base = work_path(spark, "streams", name)

    def each(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    await_done(stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/checkpoint")
               .trigger(availableNow=True).start())
    empty = partial(spark.createDataFrame([], stream.schema))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return empty      # the source held no file
    return spark.read.schema(empty.schema).parquet(f"{base}/out")


def _pane(us: int, ts: str = "ts") -> Column:
    return bucket_micros(F.col(ts), us).alias("pane")


def window_counts(stream: DataFrame, name: str, by: str, length: str, slide: str | None = None) -> DataFrame:
    """(window_start, by, count); sliding windows combine panes of the slide's
    length, so an event is counted once and only pane counts are repeated."""
    step, span = duration_us(slide or length), duration_us(length)

    def partial(batch: DataFrame) -> DataFrame:
        return (batch.where(F.col("ts").isNotNull() & F.col(by).isNotNull())
                .groupBy(_pane(step), by).agg(F.count(F.lit(1)).alias("n")))

    panes = drain(stream, name, partial).groupBy("pane", by).agg(F.sum("n").alias("n"))
    starts = F.sequence(F.col("pane") - F.lit(span - step), F.col("pane"), F.lit(step))
    return (panes.select(F.explode(starts).alias("start"), by, "n")
            .groupBy("start", by).agg(F.sum("n").cast("long").alias("count"))
            .select(micros_to_ts(F.col("start")).alias("window_start"), by, "count"))


def window_journeys(stream: DataFrame, name: str, length: str = "1d", key: str = "event_id") -> DataFrame:
    """Users per journey class and window; a user's flags are OR-ed over batches."""
    span = duration_us(length)
    steps = ("login", "purchase", "add_to_cart")

    def partial(batch: DataFrame) -> DataFrame:
        return (batch.where(F.col("ts").isNotNull() & F.col(key).isNotNull())
                .groupBy(_pane(span), key)
                .agg(*[F.coalesce(F.bool_or(F.col("event_type") == v), F.lit(False)).alias(v) for v in steps]))

    flags = drain(stream, name, partial).groupBy("pane", key).agg(*[F.bool_or(v).alias(v) for v in steps])
    kind = journey_class(F.col("login"), F.col("purchase"), F.col("add_to_cart"))
    return (flags.groupBy("pane", kind.alias("journey_type")).agg(F.count(F.lit(1)).alias("count"))
            .select(micros_to_ts(F.col("pane")).alias("window_start"), "journey_type", "count"))


PAGE_CLASSES = {"completed": JOURNEY_COMPLETED, "abandoned": JOURNEY_ABANDONED, "browsing": JOURNEY_BROWSING,
                "other": JOURNEY_OTHER}


def page_row(users: DataFrame, by: str | Column) -> DataFrame:
    """One row per window from one row per (window, user) with ``n`` and the three flags."""
    kind = journey_class(F.col("login"), F.col("purchase"), F.col("add_to_cart"))
    return users.withColumn("kind", kind).groupBy(by).agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").cast("long").alias("events"),
        *[F.sum((F.col("kind") == v).cast("long")).alias(c) for c, v in PAGE_CLASSES.items()])


def window_page(stream: DataFrame, name: str, length: str = "60s", slide: str = "5s", key: str = "event_id") -> DataFrame:
    """The last-minute page of every sliding window: distinct users, their events, and the
    users of each journey class.

    A pane (the slide's length) keeps one state per user, the number of events and the flags.
    States add up over batches and over the panes of a window, so an event is counted once and
    a window needs no events, only the states of its panes.
    """
    step, span = duration_us(slide), duration_us(length)
    flags = ("login", "purchase", "add_to_cart")

    def partial(batch: DataFrame) -> DataFrame:
        return (batch.where(F.col("ts").isNotNull() & F.col(key).isNotNull())
                .groupBy(_pane(step), key).agg(F.count(F.lit(1)).alias("n"), *[
                    F.coalesce(F.bool_or(F.col("event_type") == v), F.lit(False)).alias(v) for v in flags]))

    def merged(states: DataFrame, by: str) -> DataFrame:
        return states.groupBy(by, key).agg(F.sum("n").alias("n"), *[F.bool_or(v).alias(v) for v in flags])

    panes = merged(drain(stream, name, partial), "pane")
    starts = F.sequence(F.col("pane") - F.lit(span - step), F.col("pane"), F.lit(step))
    windows = merged(panes.select(F.explode(starts).alias("start"), key, "n", *flags), "start")
    return page_row(windows, "start").select(micros_to_ts(F.col("start")).alias("window_start"), "users", "events", *PAGE_CLASSES)


def window_top_categories(products: DataFrame, name: str, length: str = "1d", k: int = 5) -> DataFrame:
    """The ``k`` most frequent valid categories of each window."""
    span = duration_us(length)
    category = F.col("product_category")

    def partial(batch: DataFrame) -> DataFrame:
        return (batch.where(F.col("ts").isNotNull() & category.isNotNull() & (category != ""))
                .groupBy(_pane(span), category.alias("category")).agg(F.count(F.lit(1)).alias("n")))

    counts = drain(products, name, partial).groupBy("pane", "category").agg(F.sum("n").cast("long").alias("count"))
    order = Window.partitionBy("pane").orderBy(F.col("count").desc(), F.col("category").asc())
    return (counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
            .select(micros_to_ts(F.col("pane")).alias("window_start"), "category", "count", "rank"))
