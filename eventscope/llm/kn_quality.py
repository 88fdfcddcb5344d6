"""Quality rules with n-gram perplexity bands.

Base rules count words, symbols, repeated lines and repeated 3-word windows of whole
texts.  The perplexity of a text comes from a modified Kneser-Ney model of character
4-grams (UTF-16 units, A-Z lower-cased), one model per language:

* each task counts its n-grams per language in sorted arrays, Spark sums them over the
  whole corpus; an n-gram is one 64-bit number, so contexts and suffixes are shifts;
* only *reference* texts are counted, those with at most one symbol to ten words: a model
  counted on junk finds that junk likely.  N-grams of other texts stand in the table with
  count 0 and get the probability of an unseen n-gram;
* continuation counts, context totals and the three discounts per order are grouped from
  that table, and every n-gram gets its interpolated probability;
* the model is stored as files of sorted hash arrays (hash, log probability), cut by
  language and hash range so that one file has a bounded size; scoring tasks hold a bounded
  number of them.

A document is rejected when its perplexity lies outside its language's band: the median of
the language's log perplexities, less one multiple of the median deviation and plus another,
wider for short texts, whose mean varies more.

Defined cases: NULL or wordless texts have counts 0, fail the base rules and have no
perplexity; a NULL language is a language of its own; texts of fewer than four units have
no perplexity and no band; repeated rows are counted and answered each; a language whose
texts all have one perplexity has a band of the least width; a language less than half of
whose n-grams stand in reference texts is counted from all its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventscope.llm.common import (SPACE_WORDS, blocks, bound_batches, byte_table, mix64, prefix_hash,
                                   roll, saved, segment_sums, span_hashes, word_spans)
from eventscope.llm.files import read_bytes, write_bytes
from eventscope.session import work_path

ORDER = 4
SYMBOLS = byte_table(lambda b: b in b"#*$%&|<>")
SYMBOL_WORDS = 10    # a reference text has as many words to a symbol, or more
_BLANK = " \t\n\v\f\r"


def repeat_words(data: np.ndarray, offsets: np.ndarray, window: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and how many of them stand in windows found twice in the text."""
    folded, starts, ends, counts = word_spans(data, offsets, SPACE_WORDS)
    text = np.repeat(np.arange(len(counts)), counts)
    h = span_hashes(prefix_hash(folded), starts, ends)
    rolled = roll(h, window)
    n = len(rolled)
    hit = np.zeros(len(starts) + 1, np.int32)
    if n:
        whole = text[:n] == text[window - 1:window - 1 + n]
        rolled = mix64(rolled + text[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        place = np.flatnonzero(whole)
        # one sort finds windows that may be equal (high bits); those are compared in full
        low = np.uint64((1 << max(1, int(n).bit_length())) - 1)
        key = np.sort((rolled[place] & ~low) | place.astype(np.uint64))
        same = (key[1:] ^ key[:-1]) <= low
        maybe = np.zeros(len(key), bool)
        maybe[1:] |= same
        maybe[:-1] |= same
        at = (key[maybe] & low).astype(np.int64)
        order = np.argsort(rolled[at], kind="stable")
        at = at[order]
        full = rolled[at]
        again = np.zeros(len(at), bool)
        if len(at):
            eq = full[1:] == full[:-1]
            again[1:] |= eq
            again[:-1] |= eq
        np.add.at(hit, at[again], 1)
        np.add.at(hit, at[again] + window, -1)
    covered = np.cumsum(hit[:-1]) > 0
    last = np.cumsum(counts)
    return counts, segment_sums(covered, last - counts, last, np.int64)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base rules' counts for each text of a block."""
    words, repeated = repeat_words(data, offsets)
    raw = data.tobytes()
    inside = np.frombuffer(raw.translate(SPACE_WORDS), np.uint8) != 0
    begin, end = offsets[:-1], offsets[1:]
    lines = np.zeros(len(begin), np.int64)
    for k in range(len(begin)):
        text = raw[begin[k]:end[k]]
        if b"\n" in text:
            full = [x for x in text.split(b"\n") if x.strip(_BLANK.encode())]
            lines[k] = len(full) - len(set(full))
    return {
        "n_words": words,
        "word_chars": segment_sums(inside & ((data & 0xC0) != 0x80), begin, end, np.int64),
        "n_symbols": segment_sums(np.frombuffer(raw.translate(SYMBOLS), np.uint8) != 0, begin, end, np.int64),
        "n_dup_lines": lines,
        "n_repeat_words": repeated,
    }


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 4-gram number at each unit of a block, and where each text's n-grams lie."""
    units = np.frombuffer(str(data.tobytes(), "utf-8").encode("utf-16-le"), np.uint16)
    at = offsets
    if len(units) != len(data):
        seen = np.zeros(len(data) + 1, np.int64)
        np.cumsum(((data & 0xC0) != 0x80).astype(np.int8) + (data >= 0xF0), out=seen[1:])
        at = seen[offsets]
    u = units.astype(np.uint64)
    u += ((units - np.uint16(65)) < 26).astype(np.uint64) * np.uint64(32)
    n = max(0, len(u) - ORDER + 1)
    g = np.zeros(n, np.uint64)
    for j in range(ORDER if n else 0):
        g <<= np.uint64(16)
        g |= u[j:j + n]
    starts = np.minimum(at[:-1], n)
    return g, starts, np.minimum(np.maximum(at[1:] - ORDER + 1, starts), n)


def is_reference(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts of a block the model is counted from."""
    words = word_spans(data, offsets, SPACE_WORDS)[3]
    marks = np.frombuffer(data.tobytes().translate(SYMBOLS), np.uint8) != 0
    return SYMBOL_WORDS * segment_sums(marks, offsets[:-1], offsets[1:], np.int64) <= words


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys, *counts = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


def _count(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def out(lang: str) -> pa.RecordBatch:
        keys, counts, reference = _merge(held.pop(lang))
        sizes.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()),
                                           pa.array(keys.view(np.int64)), pa.array(counts), pa.array(reference)],
                                          names=["lang", "g", "c", "r"])

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for lo, hi, data, offsets in blocks(batch, "text"):
            g, starts, ends = grams(data, offsets)
            clean = is_reference(data, offsets)
            for lang, part in sorted({(x, bool(y)) for x, y in zip(langs[lo:hi], clean)}):
                rows = (langs[lo:hi] == lang) & (clean == part)
                edge = np.zeros(len(g) + 1, np.int32)
                np.add.at(edge, starts[rows], 1)
                np.add.at(edge, ends[rows], -1)
                mine = np.sort(g[np.cumsum(edge[:-1]) > 0])
                if not len(mine):
                    continue
                first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                counts = np.diff(np.append(first, len(mine)))
                held.setdefault(lang, []).append((mine[first], counts, counts * part))
                sizes[lang] = sizes.get(lang, 0) + len(first)
                if sizes[lang] > limit:      # bounded memory: fold, or hand on what is held
                    folded = _merge(held[lang])
                    held[lang], sizes[lang] = [folded], len(folded[0])
                    if sizes[lang] > limit // 2:
                        yield out(lang)
    for lang in list(held):
        yield out(lang)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, g, c, r): all 4-grams of the texts of each language, r of them in reference texts."""
    return (docs.mapInArrow(_count, "lang string, g long, c long, r long")
            .groupBy("lang", "g").agg(F.sum("c").alias("c"), F.sum("r").alias("r")))


def reference_counts(counts: DataFrame) -> DataFrame:
    """(lang, g, c): c counts reference texts where those hold half of a language or more."""
    held = counts.groupBy("lang").agg((2 * F.sum("r") >= F.sum("c")).alias("enough"))
    return (counts.join(F.broadcast(held), "lang")    # one row per language
            .select("lang", "g", F.when(F.col("enough"), F.col("r")).otherwise(F.col("c")).alias("c")))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, g, logp): interpolated modified Kneser-Ney probabilities of all 4-grams.

    One with count 0 is unseen: it is no continuation and has the share left to its context,
    or the whole of the lower order where the context is unseen too.
    """
    mask = lambda n: F.lit((1 << 16 * n) - 1)
    tables = {ORDER: counts.select("lang", F.col("g").alias("g"), "c")}
    for n in range(ORDER - 1, 0, -1):    # continuation counts: how many units stand before
        tables[n] = tables[n + 1].groupBy("lang", F.col("g").bitwiseAND(mask(n)).alias("g")).agg(
            F.sum((F.col("c") > 0).cast("long")).alias("c"))
    lower = None
    for n in range(1, ORDER + 1):
        t = tables[n]
        few = t.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)],
                                    F.count("*").alias("kinds"))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        raw = [k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")) for k in (1, 2, 3)]
        # where a corpus is too small for the estimate, the usual discounts stand in
        d = [F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.coalesce(x, F.lit((0.5, 1.0, 1.5)[k - 1])))).alias(f"d{k}")
             for k, x in zip((1, 2, 3), raw)]
        few = F.broadcast(few.select("lang", "kinds", *d))    # one row per language
        context = F.shiftrightunsigned(F.col("g"), 16) if n > 1 else F.lit(0).cast("long")
        t = t.withColumn("h", context)
        sums = t.groupBy("lang", "h").agg(
            F.sum("c").alias("total"), F.sum((F.col("c") == 1).cast("long")).alias("k1"),
            F.sum((F.col("c") == 2).cast("long")).alias("k2"), F.sum((F.col("c") > 2).cast("long")).alias("k3"))
        joined = t.join(sums, ["lang", "h"]).join(few, "lang")
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        left = (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3"))
        left = F.when(F.col("total") > 0, F.try_divide(left, F.col("total"))).otherwise(F.lit(1.0))
        direct = F.coalesce(F.try_divide(F.greatest(F.col("c") - discount, F.lit(0.0)), F.col("total")), F.lit(0.0))
        if n == 1:
            lower = joined.select("lang", "g", (direct + left / F.col("kinds")).alias("p"))
        else:
            suffix = F.col("g").bitwiseAND(mask(n - 1))
            lower = (joined.select("lang", "g", suffix.alias("s"), direct.alias("direct"), left.alias("left"))
                     .join(lower.select("lang", F.col("g").alias("s"), F.col("p").alias("q")), ["lang", "s"])
                     .select("lang", "g", (F.col("direct") + F.col("left") * F.col("q")).alias("p")))
    return lower.select("lang", "g", F.log("p").cast("float").alias("logp"))


def store_model(probabilities: DataFrame, entries: int = 1 << 21) -> list[tuple[str, int, int, str]]:
    """Write the model as sorted hash arrays; returns (lang, low bits, shard, path) per file.

    A file holds the n-grams of one language whose hash starts with the shard number; the
    number of shards follows the model's size, so a file has about ``entries`` of them.
    """
    spark = probabilities.sparkSession
    table = saved(probabilities, "kneser-ney")
    most = table.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits = max(0, int(-(-most // entries) - 1).bit_length())
    folder = work_path(spark, "llm", "gram-arrays")
    keyed = table.withColumn("x", F.shiftrightunsigned(F.xxhash64("g"), 63 - bits) / 2).withColumn(
        "shard", F.floor("x").cast("int")).drop("x")

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h = mix64(rows["g"].to_numpy().view(np.uint64))
        order = np.argsort(h)
        path = write_bytes(folder, f"{bits}-{key[1]}", h[order].tobytes(),
                           rows["logp"].to_numpy(np.float32)[order].tobytes())
        return pd.DataFrame({"lang": [key[0]], "bits": [bits], "shard": [key[1]], "path": [path]})

    files = saved(keyed.groupBy("lang", "shard").applyInPandas(
        write, "lang string, bits int, shard int, path string"), "gram-files")
    return [tuple(r) for r in files.orderBy("lang", "shard").collect()]


class GramArrays:
    """Lookups in sorted hash arrays; at most ``keep`` files are in memory."""

    def __init__(self, files: list[tuple[str, int, int, str]], keep: int = 8):
        self.files: dict[str, list[str]] = {}
        for lang, _, _, path in files:
            self.files.setdefault(lang, []).append(path)
        self.keep, self.held = keep, {}

    def _load(self, path: str):
        if path not in self.held:
            while len(self.held) >= self.keep:
                self.held.pop(next(iter(self.held)))
            raw = read_bytes(path)
            n = len(raw) // 12
            h, p = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.float32, n, 8 * n)
            top = np.uint64(64 - max(4, int(n).bit_length() + 1))
            first = np.searchsorted(h >> top, np.arange((1 << 64 - int(top)) + 1, dtype=np.uint64)).astype(np.int32)
            most = int(np.diff(first).max()) if n else 0
            self.held[path] = (np.append(h, np.uint64(0)), np.append(p, np.float32(0)), top, first, most)
        return self.held[path]

    def logp(self, lang: str, g: np.ndarray) -> np.ndarray:
        x = mix64(g)
        out = np.zeros(len(g), np.float32)
        paths = self.files.get(lang, [])
        for path in paths:
            h, p, top, first, most = self._load(path)
            at = np.take(first, (x >> top).astype(np.int64))
            found = np.take(h, at) == x
            out[found] = np.take(p, at[found])
            rest = np.flatnonzero(~found)
            for step in range(1, most):
                if not len(rest):
                    break
                here = np.minimum(at[rest] + step, len(h) - 1)
                ok = np.take(h, here) == x[rest]
                out[rest[ok]] = np.take(p, here[ok])
                rest = rest[~ok]
        return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _score(batches: Iterator[pa.RecordBatch], files: list) -> Iterator[pa.RecordBatch]:
    arrays = GramArrays(files)
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        counts = {c: np.zeros(batch.num_rows, np.int64) for c in _COUNTS}
        mean = np.full(batch.num_rows, np.nan)
        for lo, hi, data, offsets in blocks(batch, "text"):
            for c, v in base_counts(data, offsets).items():
                counts[c][lo:hi] = v
            for lang in sorted(set(langs[lo:hi])):
                # texts of one language lie in runs; look at each text's own n-grams only
                rows = np.flatnonzero(langs[lo:hi] == lang)
                keep = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows])
                own = np.append(0, np.cumsum(np.diff(offsets)[rows]))
                g, starts, ends = grams(data[keep] if len(rows) < hi - lo else data,
                                        own if len(rows) < hi - lo else offsets)
                n = ends - starts
                total = segment_sums(arrays.logp(lang, g), starts, ends)
                mean[lo + rows] = np.where(n > 0, -total / np.maximum(n, 1), np.nan)
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), batch.column(1), *(pa.array(counts[c]) for c in _COUNTS),
             pa.array(mean, mask=np.isnan(mean))],
            names=["doc_id", "lang", *_COUNTS, "log_ppl"])


def quality(docs: DataFrame, least_words: int = 50, most_repeated: int = 50,
            low_width: float = 6.0, high_width: float = 8.0,
            least_width: float = 0.05, short: int = 500) -> DataFrame:
    """doc_id, base counts, base_failed, log_ppl, the band (low, high) and kept.

    ``docs``: doc_id, text, lang.  ``low_width``, ``high_width``: a long text's band below and
    above the median in median deviations; a text of n characters in words has
    sqrt(1 + short / n) times that.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "doc_id")
    files = store_model(kneser_ney(reference_counts(saved(count_grams(texts.select("text", "lang")), "gram-counts"))))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = saved(texts.mapInArrow(
        lambda it: _score(it, files), f"doc_id {id_type}, lang string, "
        + ", ".join(f"{c} long" for c in _COUNTS) + ", log_ppl double"), "scored")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    judged = scored.where("NOT base_failed AND log_ppl IS NOT NULL")
    middle = judged.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 10000).alias("middle"))
    spread = (judged.join(F.broadcast(middle), "lang")    # one row per language, as below
              .groupBy("lang", "middle").agg(F.percentile_approx(F.abs(F.col("log_ppl") - F.col("middle")), 0.5, 10000).alias("mad")))
    bands = spread.select("lang", "middle", *[
        F.greatest(width * F.col("mad"), F.lit(least_width)).alias(side)
        for side, width in (("below", low_width), ("above", high_width))])
    reach = F.sqrt(1 + F.lit(short) / F.greatest("word_chars", F.lit(1)))
    outside = F.coalesce((F.col("log_ppl") < F.col("low")) | (F.col("log_ppl") > F.col("high")), F.lit(False))
    return (scored.join(F.broadcast(bands), "lang", "left")
            .withColumn("low", F.col("middle") - F.col("below") * reach)
            .withColumn("high", F.col("middle") + F.col("above") * reach)
            .select("doc_id", *_COUNTS, "base_failed", "log_ppl", "low", "high",
                    (~F.col("base_failed") & ~outside).alias("kept")))
