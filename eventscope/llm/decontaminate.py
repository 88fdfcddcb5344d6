"""Benchmark decontamination: prefix-filtered join of item windows with documents.

An item's windows are its runs of 13 consecutive words (a shorter item is one window).  A
window occurs in a document only if all its word shingles do, in a row.  So:

1. every shingle of every window sets a bit in a filter of fixed size (broadcast);
2. one pass over the documents counts words and keeps *runs*: maximal stretches of words
   whose shingles all pass the filter, if long enough for some window (the length bound);
3. shingles are ordered by how often they stand in the runs of the corpus.  A window must
   be contained whole, so its necessary prefix is its single rarest shingle: only that one
   is joined with the runs' shingles;
4. the shingle's place in window and run bounds the position; the words there are compared
   one by one with the window (exact verification).

Everything after the pass is a Spark join over the runs; hot shingles are a plain join
that Spark may split.  No candidate is capped.

Defined cases: NULL or wordless texts have no words and no hit; wordless items have no
window; items without an id mark words but are not counted or listed; repeated items or
documents count once or are answered each; extra columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventscope.llm.common import (ALNUM_WORDS_LOWER, blocks, bound_batches, hash_filter, passes,
                                   prefix_hash, released, roll, saved, span_hashes, word_spans)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUNS = "array<struct<pos:int,words:string>>"


def words_of(text: Column) -> Column:
    """Lower-cased words of a text, as an array (Spark side of ALNUM_WORDS_LOWER)."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, words, n, k): the distinct windows of each item; k words make a shingle."""
    words = items.select("item_id", words_of(F.col("text").cast("string")).alias("all")).where(F.size("all") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1)),
                      lambda i: F.slice("all", i, window))
    return (words.select("item_id", F.explode(cut).alias("ws"))
            .select("item_id", F.array_join("ws", " ").alias("words"), F.size("ws").alias("n"),
                    F.least(F.size("ws"), F.lit(shingle)).alias("k")).distinct())


def _shingles(words: str, n: Column, k: Column) -> Column:
    """[(offset, shingle)] of a space-joined run of n words, k words a shingle."""
    ws = F.split(F.col(words), " ")
    return F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(
        i.alias("off"), F.array_join(F.slice(ws, i + 1, k), " ").alias("shingle")))


def _hash_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, _, data, offsets in blocks(batch, "shingle"):
            folded, starts, ends, counts = word_spans(data, offsets, ALNUM_WORDS_LOWER)
            h = span_hashes(prefix_hash(folded), starts, ends)
            first = np.cumsum(counts) - counts
            for k in set(counts.tolist()):
                at = first[counts == k]
                out.append(roll(h, k)[at] if k else np.zeros(0, np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out or [np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])


def _runs(batches: Iterator[pa.RecordBatch], shared, needed: dict[int, int], bits: int
          ) -> Iterator[pa.RecordBatch]:
    """Words per text and its runs; needed: k -> least number of shingles in a row."""
    for batch in batches:
        n_words = np.zeros(batch.num_rows, np.int64)
        runs: list[list] = [[] for _ in range(batch.num_rows)]
        for lo, hi, data, offsets in blocks(batch, "text"):
            folded, starts, ends, counts = word_spans(data, offsets, ALNUM_WORDS_LOWER)
            n_words[lo:hi] = counts
            last = np.cumsum(counts)
            h = span_hashes(prefix_hash(folded), starts, ends)
            for k, least in needed.items():
                rolled = roll(h, k)
                good = np.flatnonzero(passes(shared.value, rolled, bits))
                text = np.searchsorted(last, good, side="right")
                inside = good + k <= last[text]      # shingles do not cross texts
                good, text = good[inside], text[inside]
                if not len(good):
                    continue
                cut = np.flatnonzero((np.diff(good) != 1) | (np.diff(text) != 0)) + 1
                for a, b in zip(np.append(0, cut), np.append(cut, len(good))):
                    if b - a >= least:
                        i, j, t = good[a], good[b - 1] + k, text[a]
                        ws = [str(folded[starts[w]:ends[w]].tobytes(), "utf-8") for w in range(i, j)]
                        runs[lo + t].append({"pos": int(i - last[t] + counts[t]), "words": " ".join(ws)})
        run_type = pa.list_(pa.struct([("pos", pa.int32()), ("words", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words), pa.array(runs, run_type)],
            names=["doc_id", "n_words", "runs"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5,
                  bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): documents has row, doc_id, n_words of every row of ``docs``; hits
    has row, start, n and item_id of every occurrence of a window."""
    spark = docs.sparkSession
    bound_batches(spark)
    windows = saved(item_windows(items, window, shingle), "item-windows")
    parts = windows.select("words", "n", "k").distinct().withColumn(
        "parts", _shingles("words", F.col("n"), F.col("k")))
    shared = hash_filter(parts.select(F.explode("parts.shingle").alias("shingle")).distinct()
                         .mapInArrow(lambda it: released(_hash_shingles(it)), "h long"), "h", bits)
    needed = {r["k"]: r["least"] for r in  # at most `shingle` rows
              windows.groupBy("k").agg(F.min(F.col("n") - F.col("k") + 1).alias("least")).collect()}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = saved(
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .mapInArrow(lambda it: released(_runs(it, shared, needed, bits)),
                    f"doc_id {id_type}, n_words long, runs {_RUNS}")
        .withColumn("row", F.monotonically_increasing_id()), "runs")
    runs = found.select("row", F.explode("runs").alias("run")).select(
        "row", F.col("run.pos").alias("pos"), F.col("run.words").alias("run"))
    ks = F.array(*[F.lit(k) for k in sorted(needed)]) if needed else F.expr("CAST(array() AS ARRAY<INT>)")
    n = F.size(F.split("run", " "))
    # each shingle of a run with the words a window around it may need
    places = (runs.withColumn("k", F.explode(ks)).where(n >= F.col("k"))
              .withColumn("p", F.explode(_shingles("run", n, F.col("k"))))
              .select("row", "k", F.col("p.shingle").alias("shingle"),
                      (F.col("pos") + F.col("p.off")).alias("at"),
                      F.least(F.col("p.off"), F.lit(window - 1)).alias("before"),
                      F.slice(F.split("run", " "), F.greatest(F.col("p.off") - window + 2, F.lit(1)),
                              2 * window).alias("around")))
    often = places.groupBy("shingle").agg(F.count("*").alias("often"))
    tokens = parts.select("words", "n", F.explode("parts").alias("p")).select(
        "words", "n", F.col("p.off").alias("off"), F.col("p.shingle").alias("shingle"))
    prefix = (tokens.join(often, "shingle", "left")
              .groupBy("words", "n")
              .agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "off", "shingle")).alias("rare"))
              .where("rare.often > 0")
              .select("words", "n", F.col("rare.off").alias("off"), F.col("rare.shingle").alias("shingle")))
    begin = F.col("before") - F.col("off")
    matched = (places.join(prefix, "shingle")
               .where((begin >= 0) & (begin + F.col("n") <= F.size("around")))
               .where(F.array_join(F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.col("n")), " ")
                      == F.col("words"))
               .select("row", (F.col("at") - F.col("off")).alias("start"), "n", "words").distinct())
    hits = matched.join(windows.select("words", "item_id"), "words").select("row", "start", "n", "item_id")
    return found.select("row", "doc_id", "n_words"), hits


def judge(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5,
          bits: int = 26) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a window), n_items, items_sha256, contaminated."""
    found, hits = contamination(docs, items, window, shingle, bits)
    hits = saved(hits, "hits")
    reach = Window.partitionBy("row").orderBy("start", "n")
    before = F.coalesce(F.max(F.col("start") + F.col("n")).over(
        reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = (hits.select("row", "start", "n").distinct()
               .withColumn("new", F.greatest(F.col("start") + F.col("n") - F.greatest("start", before), F.lit(0)))
               .groupBy("row").agg(F.sum("new").cast("long").alias("n_hit")))
    named = (hits.select("row", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items")))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (found.join(covered, "row", "left").join(named, "row", "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
                    ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")))
