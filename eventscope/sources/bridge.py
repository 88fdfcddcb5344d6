"""Bridge from the driver's tables to canonical nested events.

The driver's ``events`` table has no products and other event types, so canonical
events are derived deterministically from ``events`` and ``part``:

* type map: signup→login, view→view_product, click→add_to_cart, error→logout;
* user key ``event_id = 'U' || (1000 + user_id)``; ``row_id`` keeps the event key;
* login/logout carry no products; other events carry ``1 + row_id % 3`` products;
* product ``pos`` is the part with key ``(row_id*3 + 7*pos) % count(part)``;
* its category is ``p_type``, NULL when ``(row_id+pos) % 17 = 0``, empty text when
  ``(row_id+pos) % 23 = 0``; product_type/brand only for ECONOMY and PROMO parts.

The same rules are written in SQL in ``eventscope.plans.oracle`` (DuckDB side).

Plan: events ⋈ part on the product key (broadcast when Spark's size estimate of
``part`` is under the threshold, sort-merge otherwise), then one shuffle that both
groups each event's ≤3 products and range-partitions the table for its write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventscope.functions.timefn import ts_to_epoch
from eventscope.schema import CONTEXT_FIELDS, PRODUCTS_TYPE

# --- fixed values of the bridge (shared with the SQL oracle) ------------------
TYPE_MAP = {"signup": "login", "view": "view_product", "click": "add_to_cart", "error": "logout"}
USER_OFFSET = 1000
NULL_CATEGORY_EVERY = 17
EMPTY_CATEGORY_EVERY = 23
TYPED_PART_TYPES = ["ECONOMY", "PROMO"]
# ------------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mapped_type(c):
    out = c
    for src, dst in reversed(list(TYPE_MAP.items())):
        out = F.when(c == F.lit(src), F.lit(dst)).otherwise(out)
    return out


def bridge_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``x_events``: one row per event (row_id, event_id, event_type, ts)."""
    return flat_from(read_table(spark, sf_dir, "events"))


def flat_from(ev: DataFrame) -> DataFrame:
    """``x_events`` from an ``events`` frame (batch or streaming)."""
    return ev.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("U"), (F.col("user_id") + F.lit(USER_OFFSET)).cast("string")).alias("event_id"),
        _mapped_type(F.col("event_type")).alias("event_type"),
        F.col("ts"),
    )


def bridge_products(spark: SparkSession, sf_dir: str, flat: DataFrame | None = None) -> DataFrame:
    """``x_products``: one row per product (row_id, event_id, event_type, ts, pos, fields)."""
    x = flat if flat is not None else bridge_flat(spark, sf_dir)
    return products_from(x, read_table(spark, sf_dir, "part"))


def products_from(x: DataFrame, part: DataFrame, n_parts=None) -> DataFrame:
    """``x_products`` from ``x_events`` (batch or streaming) and the static ``part``.

    The part count is a scalar subquery unless given (streams pass the number, as
    a stream-static join is re-planned per micro-batch).
    """
    part = part.select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    if n_parts is None:
        n_parts = part.select(F.count(F.lit(1))).scalar()
    items = (x.where(~F.col("event_type").isin("login", "logout"))
              .withColumn("pos", F.explode(F.sequence(F.lit(1), (F.col("row_id") % 3 + 1).cast("int"))))
              .withColumn("pk", (F.col("row_id") * 3 + F.col("pos") * 7) % n_parts))
    j = items.join(part, items["pk"] == part["p_partkey"], "inner")
    k = F.col("row_id") + F.col("pos")
    typed = F.col("p_type").isin(*TYPED_PART_TYPES)
    return j.select(
        "row_id", "event_id", "event_type", "ts", "pos",
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_id"),
        F.when(k % NULL_CATEGORY_EVERY == 0, F.lit(None).cast("string"))
         .when(k % EMPTY_CATEGORY_EVERY == 0, F.lit(""))
         .otherwise(F.col("p_type")).alias("product_category"),
        F.concat(F.lit("$"), F.floor("p_retailprice").cast("string")).alias("price"),
        F.when(typed, F.col("p_name")).alias("product_type"),
        F.when(typed, F.col("p_brand")).alias("brand"),
    )


def bridge_events(spark: SparkSession, sf_dir: str, ranged: bool = False) -> DataFrame:
    """Canonical nested events, as the ingest job would have stored them.

    Columns: row_id, event_id, event_type, timestamp (epoch double), ts, ip, device,
    user_type (absent context → NULL), products (NULL for login/logout), product_count.

    Products are joined per item, unioned with the product-less events (so no NULL
    join key piles up in one task), then nested per event.  With ``ranged=True`` the
    rows are range-partitioned on (event_type, ts, row_id) first: that partitioning
    already clusters every event's items, so the nesting aggregate needs no shuffle of
    its own, and the output is ready for a ts-sorted, type-partitioned write.
    """
    x = bridge_flat(spark, sf_dir)
    prods = bridge_products(spark, sf_dir, x)
    fields = PRODUCTS_TYPE.elementType.fieldNames()
    item_type = f"struct<pos:int,p:struct<{','.join(f + ':string' for f in fields)}>>"
    items = prods.select("row_id", "event_id", "event_type", "ts",
                         F.struct(F.col("pos"), F.struct(*[F.col(f) for f in fields]).alias("p")).alias("item"))
    bare = (x.where(F.col("event_type").isin("login", "logout"))
             .withColumn("item", F.lit(None).cast(item_type)))
    rows = items.unionByName(bare)
    if ranged:
        rows = rows.repartitionByRange(F.col("event_type").asc_nulls_last(), F.col("ts").asc_nulls_last(),
                                       F.col("row_id").asc_nulls_last())
    nested = rows.groupBy("row_id", "event_id", "event_type", "ts").agg(
        F.sort_array(F.collect_list("item")).alias("items"))  # NULL items are skipped
    products = F.when(F.size("items") > 0, F.transform("items", lambda s: s["p"])).cast(PRODUCTS_TYPE)
    return nested.select("row_id", "event_id", "event_type",
                         ts_to_epoch(F.col("ts")).alias("timestamp"), "ts",
                         *[F.lit(None).cast("string").alias(c) for c in CONTEXT_FIELDS],
                         products.alias("products"),
                         # stored count (N8): counting later needs no product fields
                         F.size("items").cast("long").alias("product_count"))


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A driver table as a file stream: the table's folder, or its one file."""
    static = read_table(spark, sf_dir, name)
    folder = sf_dir.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    r = spark.readStream.schema(static.schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return r.parquet(f"{folder}/{name}.parquet")
    # a stream reads folders: the parent, narrowed to the file
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``x_events`` as a stream."""
    return flat_from(stream_table(spark, sf_dir, "events"))
