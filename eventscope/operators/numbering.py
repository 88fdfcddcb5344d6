"""Numbers in order without gathering a key: ranks inside keys, dense numbers of keys, and
digests that tell whole paths apart.

Rows are range-partitioned on (key, order): Spark samples the borders, so a key with very many
rows is cut at quantiles of its own, and each part is numbered alone.  A key's parts are then
shifted by the rows of its earlier parts, from a table with one row per key and part.  The
partitioned rows are written once, as both steps must see the same parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventscope.session import work_path


def _parts(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` range-partitioned by ``keys`` with its part number, written and read back."""
    spark = df.sparkSession
    path = work_path(spark, "numbering", name)
    out = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def ranked_in_keys(df: DataFrame, keys: list[str], order: list[str], name: str = "step") -> DataFrame:
    """``df`` plus the rank (1, 2, …) of each row inside its key; rows with a NULL key are left out.

    NULLs come first.  The order is total: rows that tie in ``order`` go by a hash of all their
    columns, and only rows equal in every column are interchangeable.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    rows = df.withColumn("_tie", F.xxhash64(*df.columns)).withColumn("_row", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in order] + [F.col("_tie"), F.col("_row")]
    parts = _parts(rows, [*[F.col(k) for k in keys], *by], "ranks")
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*by)))
    sizes = parts.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", *keys, F.sum("_n").over(before).alias("_shift")).where("_shift IS NOT NULL")
    return (local.join(shifts, ["_part", *keys], "left")
            .select(*df.columns, (F.col("_local") + F.coalesce("_shift", F.lit(0))).cast("long").alias(name)))


def key_numbers(df: DataFrame, key: str, name: str = "number") -> DataFrame:
    """(key, number): the distinct keys that are not NULL, numbered 0, 1, … in key order."""
    parts = _parts(df.select(key).where(F.col(key).isNotNull()).distinct(), [F.col(key)], "keys")
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1)
    # one row per part
    shifts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                            F.lit(0)).alias("_shift"))
    return local.join(shifts, "_part").select(key, (F.col("_local") + F.col("_shift")).cast("long").alias(name))


def path_digests(steps: DataFrame, keys: list[str], value: str, step: str = "step") -> DataFrame:
    """(keys, length, p1, p2): each key's whole path of ``value`` as its length and 128 bits.

    Every (step, value) has a hash of its own and a path is their XOR, so parts of a path combine
    in any order and partial results are merged map-side.
    """
    hashes = [F.bit_xor(F.xxhash64(F.lit(lane), step, F.coalesce(F.col(value).cast("string"), F.lit("\0")))).alias(f"p{lane}")
              for lane in (1, 2)]
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"), *hashes)


def equal_paths(paths: DataFrame, key: str) -> DataFrame:
    """(length, paths, least): how many paths are equal, and the least ``key`` among them."""
    return (paths.groupBy("length", "p1", "p2").agg(F.count(F.lit(1)).alias("paths"), F.min(key).alias("least"))
            .select("length", "paths", "least"))
