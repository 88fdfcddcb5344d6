"""Ranked lexical search with geometric blocking of each term's posting list.

Documents are vectors of term impacts; a query's score is its weighted sum of impacts, in
integers.  The index is cut into *shards* of whole documents, in the order in which they lie,
so a term that stands in most documents is spread over all shards and nothing is shuffled.

In a shard, a posting list of less than ``DIRECT`` documents is scored as it is.  Every longer
list is cut into blocks of documents that are alike:

* every document has a sketch, a random projection of its weighted vector;
* documents spread evenly over the list are its pivots, and each document joins the pivot whose
  sketch has the greatest inner product with its own; a large cluster is cut into runs by impact;
* a block stores its documents and its *summary*, the greatest impact of each coordinate.

A first round scores the documents of each query's strongest list in every shard; the k-th
best score over all shards is a floor that the second round starts from.  It visits a query's
lists by falling *share*, the greatest that a list can add to a score.  A short list's documents
are scored; a block of a long list is skipped when its bound is below the floor or the k-th best
score so far (equal bounds are visited, as a smaller doc_id may win).  The bound is exact: the
query's product with the summary, plus the shares of the short lists still to come, as
summaries hold the long lists' coordinates only.  The query ends when the shares of all lists
to come are too little together.  The best k of each shard are merged by Spark.

The index holds the coordinates of a given set of terms, those of the queries: the score
uses no others, and the whole vocabulary of a corpus has no size bound.

Defined cases: a NULL or termless text is no document and no query; an item's row is a query
of its own, rows that repeat are answered each; documents that repeat are ranked each; equal
scores go by ascending doc_id, a NULL one last; fewer than k documents above 0 give fewer
rows; empty tables give none.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventscope.llm.common import (blocks, bound_batches, byte_table, hash_filter, passes, prefix_hash, released,
                                   saved, segment_sums, seeded, span_hashes, word_spans)
from eventscope.session import work_path

#: Terms of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased.
TERMS = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128, lower=True)
SATURATION, FLATTENING = 8, 75     # of a document's length, in tenths and hundredths
DIMENSIONS = 32                    # of a sketch
DIRECT = 128                       # shorter posting lists of a shard have no blocks
BLOCK = 64                         # documents per block, about
SHARD_POSTINGS = 1 << 18           # postings in a shard, so less than 2^16 long lists
SHARD_DOCS = 1 << 13
QUERY_TERMS = 1 << 18              # terms of the queries that are answered together


def _vectors(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """doc_id, number of all terms, and (hash, occurrences) of the terms the filter passes."""
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch, "text"):
            folded, starts, ends, counts = word_spans(data, offsets, TERMS)
            h = span_hashes(prefix_hash(folded), starts, ends)
            text = np.repeat(np.arange(hi - lo), counts)
            if shared is not None:
                keep = passes(shared.value, h)
                h, text = h[keep], text[keep]
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            tf = np.diff(np.append(first, len(h)))
            at = np.append(0, np.cumsum(np.bincount(text[first], minlength=hi - lo)))
            whole = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(lo, hi - lo), pa.array(counts.astype(np.int64)),
                 pa.ListArray.from_arrays(whole, pa.array(h[first].view(np.int64))),
                 pa.ListArray.from_arrays(whole, pa.array(tf.astype(np.int32)))],
                names=["doc_id", "n", "terms", "tfs"])


def term_vectors(rows: DataFrame, shared=None) -> DataFrame:
    """(doc_id, n, terms, tfs) of the rows (text, doc_id) with at least one term."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return (rows.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "doc_id")
            .mapInArrow(lambda it: released(_vectors(it, shared)), f"doc_id {id_type}, n long, terms array<long>, tfs array<int>")
            .where("n > 0"))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Integer impact of tf occurrences in documents of n terms (one entry each)."""
    sizes, at = np.unique(n, return_inverse=True)
    # Python integers: the product outgrows 64 bits in a large corpus
    m = np.array([100 - FLATTENING + (FLATTENING * int(x) * documents) // length for x in sizes], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + SATURATION * m[at])


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _clusters(sketch: np.ndarray, impact: np.ndarray) -> list[np.ndarray]:
    """Positions of a posting list, block by block."""
    n = len(sketch)
    pivots = sketch[np.linspace(0, n - 1, -(-n // BLOCK)).astype(np.int64)]
    nearest = (sketch @ pivots.T).argmax(axis=1)
    order = np.lexsort((-impact, nearest))
    cuts = np.flatnonzero(np.append(True, nearest[order][1:] != nearest[order][:-1]))
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], n)):
        out += [order[x:min(x + 2 * BLOCK, b)] for x in range(a, b, 2 * BLOCK)]
    return out


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the spans that start at ``starts``, one span after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def sketches(terms: np.ndarray, ptr: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Unit vectors: random projections of the documents' weighted vectors."""
    seen, at = np.unique(terms, return_inverse=True)
    axes = (seeded(11, DIMENSIONS * (int(terms.max(initial=0)) + 1)).reshape(-1, DIMENSIONS)[seen] >> np.uint64(40))
    axes = axes.astype(np.float32) / np.float32(1 << 23) - 1
    out = np.zeros((len(ptr) - 1, DIMENSIONS), np.float32)
    for d in range(DIMENSIONS):
        out[:, d] = segment_sums(strength * axes[at, d], ptr[:-1], ptr[1:])
    return out / np.maximum(np.sqrt((out ** 2).sum(axis=1, keepdims=True)), 1e-9)


#: Arrays of a shard: forward vectors; short lists; long lists, their blocks and summaries.
KINDS = {"terms": np.int32, "ptr": np.int32, "impact": np.int32,
         "short_terms": np.int32, "short_top": np.int32, "short_at": np.int32, "short_docs": np.uint16,
         "long_terms": np.int32, "long_top": np.int32, "long_at": np.int32,
         "member_at": np.int32, "members": np.uint16, "summary_at": np.int32, "coords": np.uint16, "tops": np.int32}


def build_shard(terms: np.ndarray, ptr: np.ndarray, impact: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a shard whose document d has the coordinates terms[ptr[d]:ptr[d + 1]].

    ``long_at`` are the borders of each long list's blocks, ``coords`` numbers of long lists.
    """
    docs = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.argsort(terms, kind="stable")
    order = order[weights[terms[order]] > 0]     # a term of weight 0 gives no document a score
    ranked = terms[order]
    cuts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(cuts, len(order)))
    short, long = sizes < DIRECT, sizes >= DIRECT
    tops_of = np.maximum.reduceat(impact[order], cuts) if len(cuts) else np.zeros(0)
    out = {"terms": terms, "ptr": ptr, "impact": impact, "short_terms": ranked[cuts[short]], "short_top": tops_of[short],
           "short_at": np.append(0, np.cumsum(sizes[short])), "short_docs": docs[order[_spans(cuts[short], sizes[short])]],
           "long_terms": ranked[cuts[long]], "long_top": tops_of[long]}
    number = np.full(int(terms.max(initial=0)) + 1, -1, np.int64)
    number[out["long_terms"]] = np.arange(int(long.sum()))
    # vectors over the long lists' coordinates
    kept = np.flatnonzero(number[terms] >= 0)
    coord, value = number[terms[kept]], impact[kept]
    begin = np.append(0, np.cumsum(np.bincount(docs[kept], minlength=len(ptr) - 1)))
    sketch = sketches(terms, ptr, (impact * weights[terms]).astype(np.float32)) if long.any() else None
    blocks_of, members, coords, tops = [], [], [], []
    table = np.zeros(int(long.sum()), np.int64)
    for a, n in zip(cuts[long], sizes[long]):
        post = order[a:a + n]
        mine = docs[post]
        parts = _clusters(sketch[mine], impact[post])
        blocks_of.append(len(parts))
        for block in parts:
            inside = mine[block]
            at = _spans(begin[inside], begin[inside + 1] - begin[inside])
            np.maximum.at(table, coord[at], value[at])
            seen = np.flatnonzero(table)
            members.append(inside.astype(np.uint16))
            coords.append(seen.astype(np.uint16))
            tops.append(table[seen].astype(np.int32))
            table[seen] = 0
    borders = lambda parts: np.append(0, np.cumsum([len(p) for p in parts]))
    out |= {"long_at": np.append(0, np.cumsum(blocks_of)), "member_at": borders(members),
            "members": np.concatenate(members) if members else np.zeros(0), "summary_at": borders(coords),
            "coords": np.concatenate(coords) if coords else np.zeros(0), "tops": np.concatenate(tops) if tops else np.zeros(0)}
    return {c: out[c].astype(kind) for c, kind in KINDS.items()}


def _shards(batches: Iterator[pa.RecordBatch], vocabulary, documents: int, length: int) -> Iterator[pa.RecordBatch]:
    """One row per shard: its doc_ids, forward vectors and blocks."""
    hashes, weights = vocabulary.value
    held: list[tuple] = []
    postings = rows = 0

    def out() -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        terms, impact = np.concatenate([h[1] for h in held]), np.concatenate([h[3] for h in held])
        ptr = np.append(0, np.cumsum(np.concatenate([h[2] for h in held])))
        arrays = build_shard(terms, ptr, impact, weights)
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([ids, *(pa.array([arrays[c].tobytes()], pa.binary()) for c in KINDS)],
                                          names=["doc_ids", *KINDS])

    for batch in batches:
        col, tfs = batch.column(2), batch.column(3)
        borders = np.asarray(col.offsets).astype(np.int64)
        h = np.asarray(col.values)[borders[0]:borders[-1]].view(np.uint64)
        tf = np.asarray(tfs.values)[borders[0]:borders[-1]].astype(np.int64)
        of = np.repeat(np.arange(batch.num_rows), np.diff(borders))
        place = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
        known = hashes[place] == h if len(hashes) else np.zeros(len(h), bool)
        place, tf, of = place[known], tf[known], of[known]
        value = impacts(tf, batch.column(1).to_numpy()[of], documents, length)
        lengths = np.bincount(of, minlength=batch.num_rows)
        begin, lo = np.append(0, np.cumsum(lengths)), 0
        while lo < batch.num_rows:
            room = min(int(np.searchsorted(begin, begin[lo] + SHARD_POSTINGS - postings, side="right")) - 1, lo + SHARD_DOCS - rows)
            hi = min(max(room, lo + 1 if not rows else lo), batch.num_rows)
            if hi > lo:
                a, b = begin[lo], begin[hi]
                held.append((batch.column(0).slice(lo, hi - lo), place[a:b], lengths[lo:hi], value[a:b]))
                postings, rows, lo = postings + b - a, rows + hi - lo, hi
            if lo < batch.num_rows:
                yield out()
                held, postings, rows = [], 0, 0
    if held:
        yield out()


def search_shard(ids: list, shard: dict[str, np.ndarray], weights: np.ndarray,
                 queries: list[tuple[np.ndarray, np.ndarray, int]], k: int, probe: bool = False
                 ) -> tuple[list[tuple[int, int, int]], int]:
    """(query, document, score) of each query's best k documents above 0, and documents scored.

    A query is (coordinates, repeats, floor); documents below the floor may be missing.
    ``probe``: look no further than the first k documents.
    """
    out, scored = [], 0
    q = np.zeros(len(weights), np.int64)
    rank_of = np.empty(len(ids), np.int64)       # ascending doc_id, NULL last
    rank_of[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))] = np.arange(len(ids))
    ptr, terms, impact = (shard[c].astype(np.int64) for c in ("ptr", "terms", "impact"))
    short_at, member_at, summary_at, long_at = (shard[c].astype(np.int64) for c in ("short_at", "member_at", "summary_at", "long_at"))
    lists = np.concatenate([shard["short_terms"], shard["long_terms"]])
    top = np.concatenate([shard["short_top"], shard["long_top"]])
    shorts = len(shard["short_terms"])
    for number, (coords, repeats, floor) in enumerate(queries):
        q[coords] = repeats * weights[coords]
        seen = np.zeros(len(ids), bool)
        best = np.zeros((0, 2), np.int64)        # (score, document)
        least = max(floor, 1)

        def score(docs: np.ndarray) -> None:
            nonlocal best, scored, least
            docs = np.unique(docs)
            docs = docs[~seen[docs]].astype(np.int64)
            seen[docs] = True
            scored += len(docs)
            lengths = ptr[docs + 1] - ptr[docs]
            at, edges = _spans(ptr[docs], lengths), np.append(0, np.cumsum(lengths))
            total = segment_sums(q[terms[at]] * impact[at], edges[:-1], edges[1:], np.int64)
            best = np.concatenate([best, np.stack([total, docs], 1)[total >= least]])
            best = best[np.lexsort((rank_of[best[:, 1]], -best[:, 0]))][:k]
            if len(best) >= k:
                least = max(least, int(best[k - 1, 0]))

        here = q[shard["long_terms"]]
        share = q[lists] * top
        mine = np.flatnonzero(share)
        mine = mine[np.argsort(-share[mine], kind="stable")]
        left = np.cumsum(share[mine][::-1])[::-1]        # of this list and all that follow
        short_left = np.cumsum((share[mine] * (mine < shorts))[::-1])[::-1]
        for step, t in enumerate(mine):
            if left[step] < least or probe and len(best) >= k:
                break            # documents of none of the lists before cannot reach the best k
            if t < shorts:
                score(shard["short_docs"][short_at[t]:short_at[t + 1]])
                continue
            lo, hi = long_at[t - shorts], long_at[t - shorts + 1]
            a, b = summary_at[lo], summary_at[hi]
            product = here[shard["coords"][a:b]] * shard["tops"][a:b]
            bound = segment_sums(product, summary_at[lo:hi] - a, summary_at[lo + 1:hi + 1] - a, np.int64) + short_left[step]
            falling = np.argsort(-bound, kind="stable")
            for at in range(0, len(falling), 8):         # a few blocks at a time
                now = falling[at:at + 8]
                now = now[bound[now] >= least] + lo
                if not len(now) or probe and len(best) >= k:
                    break
                score(shard["members"][_spans(member_at[now], member_at[now + 1] - member_at[now])])
        out += [(number, int(d), int(s)) for s, d in best]
        q[coords] = 0
    return out, scored


def _search(batches: Iterator[pa.RecordBatch], shared, k: int, id_type: pa.DataType, probe: bool) -> Iterator[pa.RecordBatch]:
    weights, queries = shared.value
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column(0)[i].as_py()
            shard = {c: np.frombuffer(batch.column(j + 1)[i].as_py(), kind) for j, (c, kind) in enumerate(KINDS.items())}
            found, _ = search_shard(ids, shard, weights, queries, k, probe)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), pa.array([ids[f[1]] for f in found], id_type),
                 pa.array([f[2] for f in found], pa.int64())], names=["query", "doc_id", "score"])


class Index:
    """A blocked index over the coordinates of a set of terms: its shards and term weights."""

    def __init__(self, shards: DataFrame, hashes: np.ndarray, weights: np.ndarray, id_type: str):
        self.shards, self.hashes, self.weights, self.id_type = shards, hashes, weights, id_type


def build_index(docs: DataFrame, terms: DataFrame) -> Index:
    """Index the documents (doc_id, text) over the distinct ``terms`` (column h).

    The terms are one batch of queries' (at most about ``QUERY_TERMS``); their hashes and
    weights reach every task, 16 bytes each.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    vectors = saved(term_vectors(docs, hash_filter(terms, "h")), "term-vectors")
    total = vectors.agg(F.count("*"), F.sum("n")).first()
    documents, length = int(total[0]), int(total[1] or 1)
    df = (vectors.select(F.explode("terms").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
          .join(terms.select("h").distinct(), "h").toArrow())
    order = np.argsort(df["h"].to_numpy().view(np.uint64))
    hashes = df["h"].to_numpy().view(np.uint64)[order]
    weights = np.array([weight(documents, int(x)) for x in df["df"].to_numpy()[order]], np.int64)
    vocabulary = spark.sparkContext.broadcast((hashes, weights))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shards = vectors.mapInArrow(
        lambda it: released(_shards(it, vocabulary, documents, length)),
        f"doc_ids array<{id_type}>, " + ", ".join(f"{c} binary" for c in KINDS))
    path = work_path(spark, "llm", "search-shards")
    # a shard's row is some MB: one at a time waits in a writer, and a reader opens one
    shards.write.option("parquet.block.row.count.limit", 1).parquet(path)
    shards = spark.read.schema(shards.schema).parquet(path)
    return Index(shards, hashes, weights, id_type)


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, doc_id, score) for query vectors (query int, terms, tfs) of one batch."""
    from pyspark.sql.pandas.types import to_arrow_type
    packed = []
    for row in queries.orderBy("query").collect():     # one batch, at most about QUERY_TERMS terms
        h = np.array(row["terms"], np.int64).view(np.uint64)
        place = np.minimum(np.searchsorted(index.hashes, h), max(len(index.hashes) - 1, 0))
        known = index.hashes[place] == h if len(index.hashes) else np.zeros(len(h), bool)
        packed.append((row["query"], place[known], np.array(row["tfs"], np.int64)[known]))
    spark = index.shards.sparkSession
    arrow_type = to_arrow_type(index.shards.schema["doc_ids"].dataType.elementType)
    # best k of the shards' best k: bounded rows per query
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())

    def best(floors: dict[int, int], probe: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(
            (index.weights, [(coords, tfs, floors.get(i, 0)) for i, (_, coords, tfs) in enumerate(packed)]))
        found = index.shards.mapInArrow(lambda it: released(_search(it, shared, k, arrow_type, probe)),
                                        f"query int, doc_id {index.id_type}, score long")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    floors = {r["query"]: r["score"] for r in best({}, True).where(F.col("rank") == k).collect()}    # one row per query
    names = spark.createDataFrame([(i, int(p[0])) for i, p in enumerate(packed)], "place int, number long")
    ranked = best(floors, False)
    return (ranked.join(F.broadcast(names), ranked["query"] == names["place"])       # one row per query of the batch
            .select(F.col("number").alias("query"), "rank", "doc_id", "score"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best k documents.

    ``docs``: doc_id, text.  ``items``: item_id, text.  Items are answered in batches of about
    ``QUERY_TERMS`` terms, so the driver and the tasks never hold more of them.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = items.select("text", F.col("item_id").alias("doc_id"))
    vectors = saved(term_vectors(rows).withColumn("query", F.monotonically_increasing_id()), "item-vectors")
    total = vectors.agg(F.sum(F.size("terms"))).first()[0] or 0
    batches = max(1, -(-int(total) // QUERY_TERMS))
    number = F.pmod(F.xxhash64("query"), F.lit(batches)).cast("int")
    vectors = saved(vectors.withColumn("batch", number), "item-batches") if batches > 1 else vectors.withColumn("batch", F.lit(0))
    parts = []
    for b in range(batches):
        mine = vectors.where(F.col("batch") == b)
        index = build_index(docs.select("doc_id", "text"), mine.select(F.explode("terms").alias("h")).distinct())
        parts.append(saved(search(index, mine.select("query", "terms", "tfs"), k), "ranked"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.join(vectors.select("query", F.col("doc_id").alias("item_id")), "query")
            .select("item_id", "rank", "doc_id", "score"))
