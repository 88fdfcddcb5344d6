"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled text (per-task ``bincount``, then one Spark
sum by (language, bucket)), so the model follows the whole corpus while its size is fixed:
languages x ``2**bits`` float32.  That matrix is the only thing broadcast; its size is
checked against ``max_model_bytes`` first.  Scoring gathers each text's n-gram buckets from
the matrix and sums by text in numpy, one block of texts at a time.

Defined cases: text NULL or without any letter -> ``und`` with score 0; no labelled row ->
``und`` everywhere; NULL labels train nothing; texts shorter than an n-gram use the shorter
n-grams, down to the class priors; equal scores -> the smaller language code; rows that
repeat train and are answered each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventscope.llm.common import blocks, bound_batches, codepoints, released, segment_sums

UNKNOWN = "und"
ORDERS = (1, 2, 3)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0 (a NULL id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def grams(cps: np.ndarray, offsets: np.ndarray, bits: int
          ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per n-gram order: bucket of the n-gram at each position, segment starts and ends."""
    folded = cps + ((cps - np.uint32(65)) < np.uint32(26)).astype(np.uint32) * np.uint32(32)
    h = np.zeros(len(folded), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[:len(folded) - n + 1] * np.uint32(0x01000193)
        h ^= folded[n - 1:] + np.uint32(n)
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            yield (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits), \
                np.minimum(offsets[:-1], len(h)), np.minimum(np.maximum(offsets[1:] - n + 1, offsets[:-1]), len(h))
        if len(folded) <= n:
            return


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), object)
        for lo, hi, data, offsets in blocks(batch, "text"):
            cps, at = codepoints(data, offsets)
            mine = labels[lo:hi]
            for label in set(mine):
                rows = mine == label
                total = totals.setdefault(label, np.zeros(1 << bits, np.int64))
                for buckets, starts, ends in grams(cps, at, bits):
                    edge = np.zeros(len(buckets) + 1, np.int32)
                    np.add.at(edge, starts[rows], 1)
                    np.add.at(edge, ends[rows], -1)
                    total += np.bincount(buckets[np.cumsum(edge[:-1]) > 0], minlength=1 << bits)
    for label, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)),
             pa.array(total[at])], names=["lang", "bucket", "n"])


def train(labelled: DataFrame, bits: int = 16, smoothing: float = 0.5,
          max_model_bytes: int = 256 << 20) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probability matrix) from columns text and lang."""
    rows = labelled.select(F.col("text").cast("string").alias("text"),
                           F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL")
    priors = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(priors)
    if len(langs) * 4 << bits > max_model_bytes:
        raise ValueError(f"{len(langs)} languages x 2^{bits} buckets exceed {max_model_bytes} bytes")
    counts = np.full((len(langs), 1 << bits), smoothing, np.float64)
    summed = (rows.where("text IS NOT NULL")
              .mapInArrow(lambda it: released(_count(it, bits)), "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    table = summed.toArrow()
    if table.num_rows:
        row = np.searchsorted(langs, table["lang"].to_pylist())
        counts[row, table["bucket"].to_numpy()] += table["n"].to_numpy()
    logp = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True)) if langs else counts
    prior = np.log(np.array([priors[x] for x in langs], float) / max(1, sum(priors.values())))
    return langs, prior, logp.astype(np.float32)


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter; only texts without an ASCII letter are looked at one by one."""
    folded = data | np.uint8(32)
    found = segment_sums((folded - np.uint8(97)) < 26, offsets[:-1], offsets[1:], np.int64) > 0
    for k in np.flatnonzero(~found):
        found[k] = any(c.isalpha() for c in str(data[offsets[k]:offsets[k + 1]].tobytes(), "utf-8"))
    return found


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray],
            bits: int = 16, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score`` (replaced if present).

    Only the text takes part; the other columns travel along untouched, the text itself
    comes back only with ``keep_text``.
    """
    bound_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    stay = [c for c in kept.columns if keep_text or c != "text"]
    out = kept.select(*[F.col(f"`{c}`") for c in stay], F.lit("").alias("lang_pred"),
                      F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logp = shared.value
        for batch in batches:
            best = np.full(batch.num_rows, -1)
            sure = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in blocks(batch, "text"):
                if not langs:
                    continue
                cps, at = codepoints(data, offsets)
                scores = np.tile(prior, (hi - lo, 1))
                for buckets, starts, ends in grams(cps, at, bits):
                    for k in range(len(langs)):
                        scores[:, k] += segment_sums(np.take(logp[k], buckets), starts, ends)
                top = scores.argmax(axis=1)
                lead = scores[np.arange(hi - lo), top]
                known = _letters(data, offsets)
                best[lo:hi] = np.where(known, top, -1)
                sure[lo:hi] = np.where(known, 1 / np.exp(scores - lead[:, None]).sum(axis=1), 0)
            names = np.array([*langs, UNKNOWN], object)[best]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in stay), pa.array(names, pa.string()), pa.array(sure)],
                names=[*stay, "lang_pred", "score"])

    return kept.mapInArrow(lambda it: released(score(it)), out)


def save_model(spark, model: tuple[list[str], np.ndarray, np.ndarray], path: str) -> None:
    """The model as a small Parquet table (one row per language)."""
    langs, prior, logp = model
    rows = [(x, float(prior[k]), logp[k].tobytes()) for k, x in enumerate(langs)]
    spark.createDataFrame(rows, "lang string, prior double, logp binary").write.parquet(path)


def load_model(spark, path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    rows = spark.read.parquet(path).orderBy("lang").collect()
    return ([r["lang"] for r in rows], np.array([r["prior"] for r in rows]),
            np.array([np.frombuffer(r["logp"], np.float32) for r in rows]))


def identify(docs: DataFrame, bits: int = 16, keep_text: bool = True) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold, then answer every row.

    The answer adds ``held_out``, ``lang_pred`` and ``score`` to the columns of ``docs``.
    """
    bound_batches(docs.sparkSession)
    model = train(docs.where(~held_out(F.col("doc_id"))), bits)
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, bits, keep_text)
