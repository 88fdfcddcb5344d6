import itertools
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from eventscope.operators import matrix, numbering


def test_hot_key_is_numbered_in_parts(spark):
    # adaptive execution would merge parts as small as these
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _hot_key(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _hot_key(spark):
    rng = random.Random(4)
    rows = [("hot", rng.randint(0, 40), k) for k in range(3000)] + [(f"u{k % 50}", k % 7, k) for k in range(6000)]
    rows += [("hot", None, 9001), (None, 1, 9002)]
    df = spark.createDataFrame(rows, "user string, t int, id long").repartition(5)
    got = numbering.ranked_in_keys(df, ["user"], ["t", "id"]).collect()
    want = defaultdict(list)
    for r in sorted((r for r in rows if r[0]), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[r[0]].append(r[2])
    assert {(r.user, r.step): r.id for r in got} == {(u, k + 1): i for u, ids in want.items() for k, i in enumerate(ids)}
    # the hot key, a third of the rows, lies in several parts
    parts = numbering._parts(df.where("user IS NOT NULL"), [F.col("user"), F.col("t"), F.col("id")], "test")
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert max(sizes) < 0.5 * sum(sizes)
    assert parts.where("user = 'hot'").select("_part").distinct().count() > 1


def test_ties_have_a_total_order(spark):
    rows = [("u", 1, x) for x in "cabab"] * 3
    df = spark.createDataFrame(rows, "user string, t int, kind string")
    one = [(r.step, r.kind) for r in numbering.ranked_in_keys(df, ["user"], ["t"]).collect()]
    two = [(r.step, r.kind) for r in numbering.ranked_in_keys(df.repartition(6), ["user"], ["t"]).collect()]
    assert sorted(one) == sorted(two) and [s for s, _ in sorted(one)] == list(range(1, 16))


def test_equal_paths(spark):
    paths = {"a": "xyz", "b": "xyz", "c": "xzy", "d": "", "e": "x", "f": "xx", "g": "x"}
    rows = [(u, k + 1, v) for u, p in paths.items() for k, v in enumerate(p)]
    rows += [("h", 1, None)]
    df = spark.createDataFrame(rows, "user string, step long, kind string").repartition(4)
    got = sorted(tuple(r) for r in numbering.equal_paths(numbering.path_digests(df, ["user"], "kind"), "user").collect())
    assert got == [(1, 1, "h"), (1, 2, "e"), (2, 1, "f"), (3, 1, "c"), (3, 2, "a")]


def test_key_numbers_are_dense_and_in_order(spark):
    keys = [f"k{k:05d}" for k in range(5000)]
    df = spark.createDataFrame([(k,) for k in keys * 2] + [(None,)], "key string").repartition(7)
    got = numbering.key_numbers(df, "key").collect()
    assert sorted((r.number, r.key) for r in got) == list(enumerate(keys))
    assert numbering.key_numbers(df.where("false"), "key").count() == 0


def test_block_matrix_equals_crosstab(spark):
    rng = random.Random(2)
    rows = [(f"r{rng.randint(0, 20)}", rng.choice(["a", "b", "c", "d", "e", None])) for _ in range(400)] + [(None, "a")]
    df = spark.createDataFrame(rows, "row string, col string")
    want = Counter((r, c) for r, c in rows if r and c)
    for side in (2, 3, 256):
        m = matrix.block_matrix(df, "row", "col", side)
        got = {(r.row, r.col): r["count"] for r in matrix.filled(m).collect()}
        full = itertools.product({r for r, _ in want}, {c for _, c in want})
        assert got == {k: want.get(k, 0) for k in full}


def test_block_matrix_with_very_many_columns(spark):
    # 10^5 keys: neither a driver list nor a map lookup per cell
    df = spark.range(100_000).select(F.concat(F.lit("c"), "id").alias("col"), F.concat(F.lit("r"), F.col("id") % 3).alias("row"))
    m = matrix.block_matrix(df, "row", "col")
    out = matrix.filled(m)
    plan = out._jdf.queryExecution().logical().toString()
    assert "collect_set" not in plan and "map_from_entries" not in plan
    assert out.agg(F.count("*"), F.sum("count")).first()[:] == (300_000, 100_000)


def test_empty_matrix(spark):
    m = matrix.block_matrix(spark.createDataFrame([], "row string, col string"), "row", "col")
    assert matrix.filled(m).count() == 0
