"""Near-duplicate groups: MinHash bands, verified links, alternating-star components.

1. One pass makes each document's set of word shingles, its size, a 128-bit digest of the
   set and the minima of many universal hashes.  Equal sets collapse to their smallest id.
2. Each of many bands hashes a few minima.  Bands draw on the same minima in different
   combinations, so few minima serve many sharp bands.
3. In a bucket every member is compared with the bucket's smallest id (its head).  Members
   that are then still in different components are joined on what sets them apart from
   their head (a prefix filter on difference sets), which loses no link and does not
   compare a large group pair by pair.
4. A candidate first passes its signature estimate (six deviations of slack), then is
   confirmed on the full shingle sets of both texts.
5. Components come from alternating large-star and small-star rounds; every round is a
   written table, so a lost executor costs one round.

With 128 minima, 64 bands of 6 rows miss a link of similarity 0.8 with a chance of about
1e-7 (less above).  Nothing is capped; hot buckets are pre-aggregated before the shuffle
and hot keys stand in plain joins that Spark may split.

Defined cases: NULL or wordless texts have an empty set, n_shingles 0, and link with
nothing; fewer words than a shingle make one shingle of the whole sequence; repeated rows
of one id are one node, each answered; a NULL id is kept and linked with nothing
(component NULL); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventscope.llm.common import (SPACE_WORDS_LOWER, blocks, bound_batches, hash_filter, mix64,
                                   passes, prefix_hash, released, roll, saved, seeded, span_hashes,
                                   word_spans)

MINIMA, BANDS, ROWS = 128, 64, 6
_EMPTY = np.zeros(0, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of a block."""
    folded, starts, ends, counts = word_spans(data, offsets, SPACE_WORDS_LOWER)
    h = span_hashes(prefix_hash(folded), starts, ends)
    rolled = roll(h, shingle)
    out, at = [], 0
    for n in counts.tolist():
        if n == 0:
            out.append(_EMPTY)
        elif n < shingle:
            out.append(roll(h[at:at + n], n) ^ np.uint64(n))
        else:
            s = np.sort(rolled[at:at + n - shingle + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        at += n
    return out


def _sign(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    a, b = seeded(1, MINIMA) | np.uint64(1), seeded(2, MINIMA)
    for batch in batches:
        sizes, left, right, sigs = [], [], [], []
        for _, _, data, offsets in blocks(batch, "text"):
            sets = shingle_sets(data, offsets, shingle)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            flat = np.concatenate(sets) if len(sets) else _EMPTY
            at = (np.cumsum(n) - n)[full]
            sig = np.zeros((len(sets), MINIMA), np.uint32)
            one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(full):
                for m in range(MINIMA):
                    least = np.minimum.reduceat(flat * a[m] + b[m], at)
                    sig[full, m] = (least >> np.uint64(32)).astype(np.uint32)
                one[full] = np.add.reduceat(mix64(flat), at)
                two[full] = np.add.reduceat(mix64(flat ^ np.uint64(0x5BF03635)), at)
            sizes += n.tolist()
            left.append(one)
            right.append(two)
            sigs += [s.tobytes() for s in sig]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()),
             pa.array(np.concatenate(left or [_EMPTY]).view(np.int64)),
             pa.array(np.concatenate(right or [_EMPTY]).view(np.int64)), pa.array(sigs, pa.binary())],
            names=["doc_id", "n_shingles", "one", "two", "sig"])


def _band_rows() -> np.ndarray:
    """Which minima each band hashes: the same for every task and run."""
    rng = np.random.RandomState(7)
    return np.array([np.sort(rng.permutation(MINIMA)[:ROWS]) for _ in range(BANDS)])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _band_rows()
    salt = seeded(3, BANDS)
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, MINIMA)
        keys = np.empty((BANDS, len(sig)), np.uint64)
        for k in range(BANDS):
            h = np.full(len(sig), salt[k])
            for r in rows[k]:
                h = mix64(h + sig[:, r])
            keys[k] = h
        ids = np.asarray(batch.column(0))
        step = max(1, (1 << 18) // len(sig))
        for k in range(0, BANDS, step):
            part = keys[k:k + step]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.reshape(-1).view(np.int64)), pa.array(np.tile(ids, len(part)))],
                names=["bucket", "doc_id"])


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree as much as a link's could."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, MINIMA)
                for c in (2, 3))
        keep = pa.array((x == y).sum(axis=1) >= least * MINIMA)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)],
                                         names=["a", "b"])


def word_set(text: str, shingle: int) -> set:
    """The exact shingle set of a text (tuples of words)."""
    folded = text.encode().translate(SPACE_WORDS_LOWER)
    words = [w for w in folded.split(b"\0") if w]
    if not words:
        return set()
    k = min(shingle, len(words))
    return set(zip(*(words[i:] for i in range(k))))


def _confirm(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    head_text, head = None, set()
    for batch in batches:
        keep = []
        for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if tb != head_text:
                head_text, head = tb, word_set(tb, shingle)
            mine = word_set(ta, shingle)
            both = len(mine & head)
            keep.append(100 * both >= percent * (len(mine) + len(head) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)],
                                         names=["a", "b"])


def _differences(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Shingles that a member and its head do not share; input has both texts."""
    def one(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return shingle_sets(raw, np.array([0, len(raw)]), shingle)[0]

    head_text, head = None, _EMPTY
    for batch in batches:
        sizes, head_sizes, apart = [], [], []
        for ta, tb in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            if tb != head_text:
                head_text, head = tb, one(tb)
            mine = one(ta)
            sizes.append(len(mine))
            head_sizes.append(len(head))
            apart.append(np.setxor1d(mine, head, assume_unique=True).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()),
             pa.array(head_sizes, pa.int64()), pa.array(apart, pa.list_(pa.int64()))],
            names=["head", "doc_id", "root", "n", "n_head", "apart"])


def _open_pairs(around: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one head, in different components, that may be linked.

    With D(x) the shingles that x and the head do not share, x and y differ in
    |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, and a link allows c (|x| + |y|) of them,
    c = (100 - percent) / (100 + percent).  So a link needs (e(x) + e(y)) / 2 common
    elements, where the excess e(x) is |D(x)| - c |x|.  One of the two is not linked to the
    head (else they were in one component) and is far: e > c |head|.  Elements that no other
    member has cannot be common; the rest are ordered, rarest first.  The first common
    element of a link has the others behind it, on both sides: it lies in the prefix that
    the smallest possible need leaves, and what follows it is enough for this pair's need.
    Of two far members the one of smaller excess has the other's at least, hence the shorter
    prefix.  So a large group of loosely alike texts is not compared pair by pair, and no
    link is lost.
    """
    id_type = around.schema["doc_id"].dataType.simpleString()
    several = around.groupBy("head").agg(F.count("*").alias("members")).where("members > 1").select("head")
    apart = (
        around.join(several, "head", "left_semi")
        .join(texts.select("doc_id", F.col("text").alias("ta")), "doc_id")
        .join(texts.select(F.col("doc_id").alias("head"), F.col("text").alias("tb")), "head")
        .select("head", "doc_id", "root", "ta", "tb")
        .mapInArrow(lambda it: released(_differences(it, shingle)),
                    f"head {id_type}, doc_id {id_type}, root {id_type}, n long, n_head long, apart array<long>"))
    # whole numbers: excesses and needs are multiplied by 100 + percent
    up, down = 100 + percent, 100 - percent
    apart = saved(apart.select("head", "doc_id", "root", (down * F.col("n_head")).alias("border"),
                               (up * F.size("apart").cast("long") - down * F.col("n")).alias("excess"),
                               "apart").withColumn("far", F.col("excess") > F.col("border")), "differences")
    lowest = apart.groupBy("head").agg(F.min("excess").alias("lowest"))
    rows = apart.join(lowest, "head").select(
        "head", "doc_id", "root", "border", "excess", "lowest", "far", F.explode("apart").alias("element"))
    common = (rows.groupBy("head", "element").agg(
        F.sum(F.col("far").cast("long")).alias("often"), F.count("*").alias("all"))
        .where("often > 0 AND all > 1"))
    shared = saved(rows.join(common, ["head", "element"]), "shared-differences")
    own = Window.partitionBy("head", "doc_id")

    def ranked(frame: DataFrame) -> DataFrame:
        """``left``: how many common elements a pair can have whose first is this one."""
        return (frame.withColumn("useful", F.count("*").over(own))
                .withColumn("left", F.col("useful") - F.row_number().over(own.orderBy("often", "element")) + 1))

    def prefix(frame: DataFrame, partner: Column) -> DataFrame:
        """Elements with enough behind them for a partner whose excess is at least ``partner``."""
        return frame.where(F.col("left") * F.lit(2 * up) >= F.col("excess") + partner)

    def side(frame: DataFrame, x: str) -> DataFrame:
        return frame.select("head", "element", F.col("doc_id").alias(x),
                            *[F.col(c).alias(f"{c}_{x}") for c in ("root", "excess", "left")])

    enough = F.lit(2 * up) * F.least("left_a", "left_b") >= F.col("excess_a") + F.col("excess_b")
    # two members far from the head: elements that at least two far members have
    distant = ranked(shared.where("far AND often > 1"))
    both = (side(prefix(distant, F.col("excess")), "a").join(side(prefix(distant, F.col("border")), "b"),
                                                            ["head", "element"])
            .where("excess_a < excess_b OR (excess_a = excess_b AND a < b)"))
    near = ranked(shared.where("NOT far"))
    mixed = side(prefix(near, F.col("border")), "a").join(
        side(prefix(ranked(shared.where("far")), F.col("lowest")), "b"), ["head", "element"])
    return (both.unionByName(mixed).where("root_a <> root_b").where(enough)
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) of the nodes of undirected links (a, b): root is the smallest node
    reachable.  Alternates large-star and small-star until nothing moves.

    The smallest neighbours are written before they are joined: the join then has a plain
    exchange on both sides, which Spark may split at the centre of a large star.
    """
    mark = None
    edges = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a <> b").distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-low")
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        large = saved(large, f"{name}-large")
        low = saved(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low")
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = saved(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    nodes = saved(texts.mapInArrow(lambda it: released(_sign(it, shingle)),
                                   f"doc_id {id_type}, n_shingles long, one long, two long, sig binary"), "signatures")
    linked = nodes.where("doc_id IS NOT NULL AND n_shingles > 0")
    heads = saved(linked.groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("doc_id")), "set-heads")
    # rows of one id with different texts are one node: their sets meet through the id
    first = saved(linked.join(heads, ["one", "two", "n_shingles", "doc_id"], "left_semi")
                  .select("doc_id", "one", "two", "sig").distinct(), "distinct-sets")
    bands = first.select("doc_id", "sig").mapInArrow(
        lambda it: _bands(pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["doc_id", "sig"]) for b in it),
        f"bucket long, doc_id {id_type}")
    shared = (bands.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("top"))
              .where("head < top").select("bucket", "head"))
    members = saved(bands.join(shared, "bucket"), "buckets")

    ids = members.select("doc_id").distinct()
    wanted = hash_filter(ids.select(F.xxhash64("doc_id").alias("h")), "h")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(passes(wanted.value, np.asarray(batch.column(2)).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)],
                                             names=["doc_id", "text"])

    # only texts of candidates are shuffled: the fixed-size filter first, then the join
    candidates = saved(texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
                       .select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
                       .mapInArrow(lambda it: released(needed(it)), f"doc_id {id_type}, text string")
                       .join(ids, "doc_id", "left_semi"), "candidate-texts")
    signatures = first.select("doc_id", "sig")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sigs = (pairs.join(signatures.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a")
                .join(signatures.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
                .select("a", "b", "sa", "sb"))
        alike = sigs.mapInArrow(lambda it: _alike(it, percent / 100 - 0.21), f"a {id_type}, b {id_type}").distinct()
        full = (alike.join(candidates.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
                .join(candidates.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
                .select("a", "b", "ta", "tb"))
        return full.mapInArrow(lambda it: released(_confirm(it, shingle, percent)), f"a {id_type}, b {id_type}").distinct()

    spokes = members.where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
    links = saved(confirmed(spokes), "links")
    roots = components(links)
    rooted = members.select("bucket", "doc_id", "head").join(
        roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "bucket", "doc_id", "head", F.coalesce("root", "doc_id").alias("root"))
    split = (rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
             .where("low < high").select("bucket"))
    around = saved(rooted.join(split, "bucket", "left_semi").where("doc_id <> head")
                   .groupBy("head", "doc_id").agg(F.min("root").alias("root")), "open-buckets")
    pairs = _open_pairs(around, candidates, shingle, percent).join(
        spokes.union(spokes.select("b", "a")), ["a", "b"], "left_anti")
    more = saved(confirmed(pairs), "more-links")
    if more.limit(1).count():
        roots = components(links.unionByName(more))

    # equal sets and equal ids join the groups: a class is its smallest id
    classes = linked.select("doc_id", "one", "two", "n_shingles").join(
        heads.withColumnRenamed("doc_id", "class"), ["one", "two", "n_shingles"])
    several = classes.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
    if several.limit(1).count():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
                           .unionByName(classes.select(F.col("doc_id").alias("a"), F.col("class").alias("b"))))
    groups = (classes.select("doc_id", "class").distinct()
              .join(roots.withColumnRenamed("node", "class"), "class", "left")
              .groupBy("doc_id").agg(F.min(F.coalesce("root", "class")).alias("component_id")))
    return (nodes.select("doc_id", "n_shingles").join(groups, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
