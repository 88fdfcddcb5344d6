"""Mixing overlapping sources to target weights by min-cost flow.

1. Spark counts the words of every document and sums them by *membership pattern* (the set
   of sources a document belongs to); only those sums reach the driver, one row a pattern.
2. Sources get quotas: their weights share ``share`` of all words, no quota is above
   ``repeats`` times its source's words, the excess is shared again by weight.
3. A min-cost flow routes words from patterns to the sources they belong to.  The k-th copy
   of a pattern's words costs k - 1, so repetition is convex: a source is repeated only
   where no fresh words reach its quota.
4. A pattern that sends q times its words and r more takes every document q times, and
   once more the documents that come first in a seeded order until r words are reached.
   The order is cut into buckets of about ``bucket_rows`` documents; bucket sums find the
   bucket in which r falls, and only that one is filled document by document (one that
   would overshoot is passed over, then documents are swapped while that comes nearer).  Large sources are thus never in one task.

Defined cases: NULL texts have size 0 and take 0 words; a NULL source is a source of its
own, ordered last; documents without any source are never taken; equal rows are taken
each on its own, with ties in the seeded order (a hash of id and text) broken by id and size; an empty table mixes
to an empty table; two runs agree.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventscope.llm.common import saved

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sizes: dict, weights: dict, share: float, repeats: int) -> dict:
    """Targets by weight, none above ``repeats`` times the source's size."""
    left = share * sum(sizes.values())
    out, open_ = {}, set(sizes)
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > repeats * sizes[s]}
        if not full:
            out.update({s: unit * weights[s] for s in open_})
            break
        out.update({s: float(repeats * sizes[s]) for s in full})
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], repeats: int
                  ) -> list[dict[int, int]]:
    """Words each pattern sends to each source: as much as quotas and copies allow, at the
    least total repetition cost (successive shortest paths with potentials).

    A source with one pattern, which has no other source, needs no path: it gets its quota
    or all copies of the pattern, whichever is less.
    """
    held = Counter(s for m in members for s in m)
    alone = [len(m) == 1 and held[m[0]] == 1 for m in members]
    if any(alone):
        shared = [p for p, single in enumerate(alone) if not single]
        at = {s: k for k, s in enumerate(sorted({s for p in shared for s in members[p]}))}
        rest = min_cost_flow([supply[p] for p in shared], [[at[s] for s in members[p]] for p in shared],
                             [quota[s] for s in at], repeats) if at else [{} for _ in shared]
        back = {k: s for s, k in at.items()}
        found = {p: {back[k]: words for k, words in f.items()} for p, f in zip(shared, rest)}
        sent = [min(quota[m[0]], repeats * supply[p]) if alone[p] else 0 for p, m in enumerate(members)]
        return [({members[p][0]: sent[p]} if sent[p] else {}) if alone[p] else found[p] for p in range(len(members))]
    n_p, n_s = len(supply), len(quota)
    source, sink, size = n_p + n_s, n_p + n_s + 1, n_p + n_s + 2
    graph: list[list[int]] = [[] for _ in range(size)]
    to, cap, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)

    routes = []
    for p in range(n_p):
        for level in range(repeats):
            arc(source, p, supply[p], level)
        for s in members[p]:
            routes.append((p, s, len(to)))
            arc(p, n_p + s, repeats * supply[p], 0)
    for s in range(n_s):
        arc(n_p + s, sink, quota[s], 0)
    potential = [0] * size
    while True:
        far, via = [None] * size, [-1] * size
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if cap[e]:
                    nd = d + cost[e] + potential[x] - potential[to[e]]
                    if far[to[e]] is None or nd < far[to[e]]:
                        far[to[e]], via[to[e]] = nd, e
                        heapq.heappush(heap, (nd, to[e]))
        if far[sink] is None:
            break
        for x in range(size):
            if far[x] is not None:
                potential[x] += far[x]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount
    out: list[dict[int, int]] = [{} for _ in range(n_p)]
    for p, s, e in routes:
        if cap[e ^ 1]:
            out[p][s] = cap[e ^ 1]
    return out


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """The bucket in which a pattern's words run out: documents in seeded order, each taken
    if it still fits.  A document without words fills nothing and is not taken once more.
    Tells how many rows of a (rank, print) are taken once more."""
    rows = rows.sort_values(["rank", "doc_key", "size", "print"], kind="stable")
    sizes = rows["size"].to_numpy()
    left, extra = int(rows["room"].iloc[0]) if len(rows) else 0, np.zeros(len(rows), np.int64)
    for k, size in enumerate(sizes):
        if 0 < size <= left:
            extra[k] = 1
            left -= int(size)
    # what is left: swap a taken document for another (or for none) while that comes nearer
    while left:
        give, take = np.flatnonzero(extra), np.flatnonzero((extra == 0) & (sizes > 0))
        have = np.append(0, sizes[give])
        order = np.argsort(have, kind="stable")
        gain = np.append(0, sizes[take])
        near = np.searchsorted(have[order], gain - left)
        best = min(((abs(left - int(gain[j] - have[order[i]])), j, int(order[i]))
                    for j in range(len(gain)) for i in {max(near[j] - 1, 0), min(near[j], len(have) - 1)}))
        if best[0] >= abs(left):
            break
        _, j, i = best
        left -= int(gain[j] - have[i])
        if j:
            extra[take[j - 1]] = 1
        if i:
            extra[give[i - 1]] = 0
    return rows.assign(extra=extra).groupby(["rank", "print"], as_index=False)["extra"].sum()


def mix(docs: DataFrame, sources: Column, share: float = 1.5, repeats: int = 2,
        weights: tuple[int, ...] = WEIGHTS, seed: int = 11, bucket_rows: int = 4096,
        most_patterns: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): doc_id, pattern, size and copies of every row; and source,
    source_size, target and routed words.

    ``sources``: the array of a document's sources.  Weights go to the sources in code
    point order, NULL last, and repeat.  More than ``most_patterns`` patterns are an error,
    as their sums are routed on the driver.
    """
    pattern, size, rank = _judged(sources, seed)
    sized = saved(docs.select(F.struct("doc_id", size).alias("row"), pattern, size, rank,
                              F.monotonically_increasing_id().alias("print")), "sizes")
    plan, fill, table = _routed(sized, share, repeats, weights, bucket_rows, most_patterns)
    rows = _copies(sized.select("row", "pattern", "rank", "print", (F.col("size") > 0).alias("worded")), plan, fill, F.col("row.size"))
    return rows.select("row.doc_id", "pattern", "row.size", "copies"), table


def _judged(sources: Column, seed: int) -> tuple[Column, Column, Column]:
    """pattern, size and rank of a row."""
    doc_key, text = F.col("doc_id").cast("string"), F.col("text").cast("string")
    members = F.array_sort(F.array_distinct(sources))    # NULL sorts last
    # the text is hashed with the id, so that rows of one id (or none) spread over the buckets
    return (F.coalesce(members, F.array().cast("array<string>")).alias("pattern"), word_count(text).alias("size"),
            F.xxhash64(F.lit(seed), doc_key, text).alias("rank"))


def _routed(sized: DataFrame, share: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS,
            bucket_rows: int = 4096, most_patterns: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows with pattern, size and rank: a row per pattern with its whole copies and buckets, one
    per pattern whose words run out inside a bucket (``cut``), and the sources."""
    spark = sized.sparkSession
    sums = sized.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    patterns = sums.limit(most_patterns + 1).collect()
    if len(patterns) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    patterns.sort(key=lambda r: [(x is None, x or "") for x in r["pattern"]])
    names = sorted({s for r in patterns for s in r["pattern"]}, key=lambda s: (s is None, (s or "").encode()))
    at = {s: k for k, s in enumerate(names)}
    sizes = dict.fromkeys(at.values(), 0)
    for r in patterns:
        for s in r["pattern"]:
            sizes[at[s]] += r["words"]
    weight = {k: weights[k % len(weights)] for k in at.values()}
    target = quotas(sizes, weight, share, repeats) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    flow = min_cost_flow([r["words"] for r in patterns], [[at[s] for s in r["pattern"]] for r in patterns],
                         [round(target[k]) for k in range(len(names))], repeats)
    rules = []
    for r, f in zip(patterns, flow):
        sent, words = sum(f.values()), r["words"]
        q, room = divmod(sent, words) if words else (0, 0)
        rules.append((r["pattern"], int(q), int(room), max(1, -(-r["n"] // bucket_rows))))
    # one row per pattern, at most `most_patterns`
    plan = F.broadcast(spark.createDataFrame(
        rules, "pattern array<string>, copies long, room long, buckets long"))
    dealt = sized.join(plan, "pattern").withColumn("bucket", F.pmod(F.col("rank"), F.col("buckets")))
    order = Window.partitionBy("pattern").orderBy("bucket")
    fill = (dealt.groupBy("pattern", "room", "bucket").agg(F.sum("size").alias("words"))
            .withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
            .where("before <= room AND room < before + words")
            .select("pattern", F.col("bucket").alias("cut"), (F.col("room") - F.col("before")).alias("left")))
    routed = [0] * len(names)
    for f in flow:
        for s, words in f.items():
            routed[s] += words
    table = spark.createDataFrame(
        [(s, int(sizes[k]), float(target[k]), int(routed[k])) for s, k in at.items()],
        "source string, source_size long, target double, routed long")
    return plan, fill, table


def _copies(rows: DataFrame, plan: DataFrame, fill: DataFrame, size: Column) -> DataFrame:
    """row, pattern and copies of ``rows`` (row, pattern, rank, print and worded); ``size`` finds the words
    of a row.  Rows that agree in rank and print are equal, or one: which of them is taken does not matter."""
    dealt = (rows.join(plan, "pattern").withColumn("bucket", F.pmod(F.col("rank"), F.col("buckets")))
             .join(F.broadcast(fill), "pattern", "left"))    # again one row per pattern
    whole = dealt.where("bucket <> cut OR cut IS NULL").withColumn(
        "copies", F.col("copies") + F.when((F.col("bucket") < F.col("cut")) & F.col("worded"), 1).otherwise(0))
    edge = dealt.where("bucket = cut")
    filled = saved(edge.select("pattern", F.col("row.doc_id").cast("string").alias("doc_key"), "rank", "print",
                               size.alias("size"), F.col("left").alias("room")).groupBy("pattern")
                   .applyInPandas(_fill, "rank long, print long, extra long"), "last-buckets")
    # the rows of one bucket a pattern; of equal rows as many as the fill took
    place = F.row_number().over(Window.partitionBy("rank", "print").orderBy("rank"))
    filled = edge.join(filled, ["rank", "print"]).withColumn(
        "copies", F.col("copies") + F.when(place <= F.col("extra"), 1).otherwise(0))
    columns = ["row", "pattern", "copies"]
    return whole.select(*columns).unionByName(filled.select(*columns))


def mixed_documents(docs: DataFrame, sources: Column, seed: int = 11, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken.

    No copy of the texts is written: ``docs`` is read for the sizes, for the buckets filled document by
    document and for the result, and must give the same rows each time, as a written table does.
    """
    pattern, size, rank = _judged(sources, seed)
    text = F.col("text").cast("string")
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    plan, fill, _ = _routed(saved(docs.select(pattern, size, rank), "sizes"), **how)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), pattern, rank,
                       F.xxhash64(F.lit("row"), others, text).alias("print"),
                       F.coalesce(text.rlike(WORD), F.lit(False)).alias("worded"))
    rows = _copies(rows, plan, fill, word_count(F.col("row.text").cast("string")))
    return (rows.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
