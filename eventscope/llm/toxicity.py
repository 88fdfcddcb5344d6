"""Toxicity: two Kneser-Ney models of word spelling, one for each class of the labels.

Units are the bytes of words (ASCII letters and digits in lower case, and all bytes from 128
up), each word between two blanks.  An n-gram is the byte at a place with up to ``ORDER`` - 1
bytes before it inside the word, so it is one 64-bit number: its context is a shift, its
suffix a mask.

* *Counts.*  An n-gram counts once for each distinct labelled text of its class: neither a
  long text nor copies of one text can make its words look toxic.
* *Models.*  Each class has a whole modified Kneser-Ney model of its own: ``ORDER`` bytes back off
  byte by byte to one; shorter n-grams count the different bytes before them in the class, the
  discounts of each length come from the class's own counts of counts, and what they leave to a
  context weighs its lower order, seen n-gram or not.
* *Shared backoff.*  Beside them the classes' counts, less ``DISCOUNT`` or all of fewer, hand the
  rest to a model of both classes together (the same, counted from all texts).  An n-gram found
  in up to three texts of a class thus follows the shared model, and one that no labelled text
  holds tells nothing; a rare expression is found by the n-grams it has in common with others.
* *Comparison.*  A word's ratio is the sum of log P(toxic) - log P(ordinary) over its places.
  A text's ``llr`` is the mean of the class models' ratios over all its words; its ``evidence``
  the mean of what exceeds ``least`` nats by the models of shared backoff.
* *Score.*  A logistic curve of the logs of the evidence and of the same excess by the class
  models, fitted on a quarter of the labelled texts by models counted without that quarter.

All n-grams whose contexts end in the same two bytes are one group, so that a shuffle of the counts
is all that the models need.  Their log ratios lie in files of ``FILE_ENTRIES``; a task spells out
each word it has not met once, and looks up the words of about 16 MB of texts together.
:func:`bounds` bounds the class models' ratios of n-grams from a table of a fixed size
(``2**BITS`` cells), for scans that hold no model.

Defined cases: a NULL or wordless text has no evidence and the score that goes with none; a
NULL label, or one of a held-out or unknown doc_id, teaches nothing; of several labels of a
doc_id the largest holds; rows that repeat are answered each and teach once; with no labelled
row every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventscope.llm.common import (ALNUM_WORDS_LOWER, blocks, bound_batches, hash_filter, mix64, passes, prefix_hash,
                                   released, saved, span_hashes, word_spans)
from eventscope.llm.files import read_bytes, write_bytes
from eventscope.session import work_path

ORDER = 8                 # bytes of an n-gram
CONTEXT = np.uint64(1 << 56)    # marks a context of up to seven bytes among the n-grams
DISCOUNT = 3              # n-grams in so many texts of a class are evidence by the shared backoff only
FILE_ENTRIES = 1 << 20    # entries of a model file, 24 bytes each
WORDS = 1 << 19           # words whose ratios a task remembers
LOOKUPS = 1 << 16         # words spelled out at once
BITS = 21                 # cells of the table of bounds, 16 bytes each
CALIBRATION = 4           # one of so many labelled texts fits the curve
FLOOR = 1e-3              # least evidence that the curve tells from none


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0 (a NULL id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def spellings(data: np.ndarray, offsets: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """All n-grams of a block's words, the word each belongs to, words per text, word spans."""
    folded, starts, ends, counts = word_spans(data, offsets, ALNUM_WORDS_LOWER)
    n, lengths = len(starts), ends - starts
    word = np.repeat(np.arange(n), lengths + 1)
    u = np.full(len(word) + 1, 32, np.uint64)      # a blank before the first word and after each
    inside = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
    u[1 + np.arange(len(inside)) + np.repeat(np.arange(n), lengths)] = folded[inside]
    back = np.arange(len(word)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1) + 1
    g = np.zeros(len(word), np.uint64)
    for j in range(min(ORDER - 1, int(back.max(initial=0))), -1, -1):
        g[back >= j] <<= np.uint64(8)
        at = np.flatnonzero(back >= j)
        g[at] |= u[at + 1 - j]
    return g, word, counts, (starts, ends)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first, axis=0) if len(first) else counts


COUNTS = ("toxic_part", "plain_part", "toxic_all", "plain_all")
COLUMNS = (*COUNTS, "part", "all")      # and both classes together


def _count(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Texts per n-gram and class, without the calibration texts and with them."""
    held, size = [], 0

    def out(keys, counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(4))],
            names=["g", *COUNTS])

    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        part = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, offsets in blocks(batch, "text"):
            g, word, counts, _ = spellings(data, offsets)
            text = np.repeat(np.arange(hi - lo), counts)[word]
            once = np.unique(mix64(g + mix64(text.astype(np.uint64))), return_index=True)[1]
            g, text = g[once], text[once] + lo
            column = np.where(toxic[text], 0, 1)
            c = np.zeros((len(g), 4), np.int64)
            c[np.arange(len(g)), column] = ~part[text]
            c[np.arange(len(g)), column + 2] = 1
            held.append(_merge([(g, c)]))
            size += len(held[-1][0])
            if size > limit:        # bounded memory: fold, or hand on what is held
                held = [_merge(held)]
                size = len(held[0][0])
                if size > limit // 2:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*_merge(held))


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, calibrate): each distinct text of the labelled rows outside the held-out fold.

    Digests find the one row that stands for each text and class; only rows that a bit filter of
    those lets through are dealt with their text.
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")))
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")).where(
        "text IS NOT NULL AND doc_id IS NOT NULL")
    name = F.xxhash64("doc_id", "digest").alias("name")
    chosen = saved(rows.select("doc_id", "digest").join(known, "doc_id").groupBy("digest", "toxic")
                   .agg(F.min("doc_id").alias("doc_id")).withColumn("name", name), "chosen-texts")
    bits = min(max(20, (16 * chosen.count()).bit_length()), 30)
    shared = hash_filter(chosen, "name", bits)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    passed = rows.withColumn("name", name).mapInArrow(
        lambda it: _passing(it, shared, bits), ", ".join(f"{c} {t}" for c, t in fields.items()))
    return (passed.join(chosen.drop("name"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest", "toxic"])
            .select("text", "toxic", calibrating(F.col("text")).alias("calibrate")))


def _passing(batches: Iterator[pa.RecordBatch], shared, bits: int) -> Iterator[pa.RecordBatch]:
    """The rows whose last column, a hash, passes the filter, without it."""
    for batch in batches:
        keep = passes(shared.value, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64), bits)
        yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))


def calibrating(text: Column) -> Column:
    """Which texts fit the curve: a share of the distinct texts, by their hash."""
    return F.pmod(F.xxhash64(text), F.lit(CALIBRATION)) == 0


def count_texts(texts: DataFrame) -> DataFrame:
    """(g, texts per class without and with the calibration texts)."""
    return (texts.select("text", "toxic", "calibrate")
            .mapInArrow(_count, "g long, " + ", ".join(f"{c} long" for c in COUNTS))
            .groupBy("g").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def _lengths(g: np.ndarray) -> np.ndarray:
    """Bytes of each n-gram; none of them is 0."""
    return sum((g >= np.uint64(1 << 8 * j)).astype(np.int64) for j in range(ORDER))


def _suffixes(g: np.ndarray, n: int) -> np.ndarray:
    return g & np.uint64((1 << 8 * n) - 1)


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and their counts, a column for each of ``COLUMNS``."""
    c = np.stack([table[k].to_numpy() for k in COUNTS], 1).astype(np.int64)
    return table["g"].to_numpy().view(np.uint64), np.append(c, np.stack([c[:, 0] + c[:, 1], c[:, 2] + c[:, 3]], 1), axis=1)


def orders(g: np.ndarray, c: np.ndarray, least: int = 3) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """n-grams and counts by length, down to ``least`` - 1.

    The longest, and those from a word's start, count texts; all others are continuations: they
    count the different bytes that stand before them in texts of the class.
    """
    size, out = _lengths(g), {}
    lower = (np.zeros(0, np.uint64), np.zeros((0, len(COLUMNS)), np.int64))
    for n in range(ORDER, least - 2, -1):
        own = size == n
        out[n] = _merge([(g[own], c[own]), lower])
        lower = (_suffixes(out[n][0], n - 1), (out[n][1] > 0).astype(np.int64))
    return out


def discounts(few: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2, 3 and more by column, from how many n-grams have a count of 1, 2, 3, 4."""
    n = few.astype(float)
    out = np.zeros((4, few.shape[1]))
    for k in (1, 2, 3):
        with np.errstate(divide="ignore", invalid="ignore"):
            d = k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1]
        # where a class is too small for the estimate, the usual discounts stand in
        out[k] = np.clip(np.where(np.isfinite(d), d, (0.5, 1.0, 1.5)[k - 1]), 0.05, k - 0.05)
    return out


def interpolate(g: np.ndarray, c: np.ndarray, lower: np.ndarray, d: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of sorted n-grams by column, their contexts, and the share each context
    leaves to the lower order (all of it where the class has not seen the context)."""
    h = g >> np.uint64(8)
    new = np.append(True, h[1:] != h[:-1])
    first, of = np.flatnonzero(new), np.cumsum(new) - 1
    cut = d[np.minimum(c, 3), np.arange(c.shape[1])]
    total = np.add.reduceat(c, first)
    some = np.maximum(total, 1)
    left = np.where(total > 0, np.add.reduceat(cut, first) / some, 1.0)
    return (c - cut) / some[of] + left[of] * lower, h[first], left


ENTRY = ("part", "all", "part_rare", "all_rare")


def _logs(g: np.ndarray, texts: np.ndarray, p: np.ndarray, rare: np.ndarray | None = None) -> pa.Table:
    """Log ratios of the classes, without the calibration texts and with them."""
    logs = np.log(p[:, :4])
    rare = np.zeros((len(g), 4)) if rare is None else np.log(rare)
    return pa.table({"g": g.view(np.int64), "texts": texts, "part": logs[:, 0] - logs[:, 1], "all": logs[:, 2] - logs[:, 3],
                     "part_rare": rare[:, 0] - rare[:, 1], "all_rare": rare[:, 2] - rare[:, 3]})


def _entries(n: int, g: np.ndarray, c: np.ndarray, p: np.ndarray, h: np.ndarray, left: np.ndarray) -> list[pa.Table]:
    """Entries of the n-grams of a length, and of their contexts."""
    rare = np.ones((len(g), 4))
    # n-grams as they stand at a place, with all that is before them in the word, or ORDER bytes
    own = np.flatnonzero((g >> np.uint64(8 * (n - 1)) == 32) | (n == ORDER))
    if len(own):
        whole = np.repeat(np.arange(DISCOUNT + 1.0)[:, None], 4, axis=1)
        rare[own] = interpolate(g[own], c[own, :4], p[own][:, [4, 4, 5, 5]], whole)[0]
    return [_logs(g, c[:, 5], p, rare), _logs(h | CONTEXT, np.zeros(len(h), np.int64), left)]


def _tally(table: pa.Table) -> pa.Table:
    """By length of three and more: how many n-grams have each count from 1 to 4; the pairs' counts."""
    rows = []
    tables = orders(*_arrays(table))
    for n, (_, c) in tables.items():
        if n > 2:
            rows += [(n, k, *(c == k).sum(axis=0).tolist()) for k in (1, 2, 3, 4)]
    g, c = tables[2]
    rows += [(2, *r) for r in zip(g.tolist(), *c.T.tolist())]
    return pa.table({f: pa.array(v, pa.int64()) for f, v in zip(("n", "value", *COLUMNS), zip(*rows))})


def _longer(table: pa.Table, shared) -> pa.Table:
    """Entries of the n-grams of three bytes and more of one context, order by order."""
    pairs, below, few = shared.value
    out = []
    for n, (g, c) in sorted(orders(*_arrays(table)).items()):
        if n > 2 and len(g):
            lower = below[np.searchsorted(pairs, _suffixes(g, n - 1))]
            below, h, left = interpolate(g, c, lower, few[n])
            pairs = g
            out += _entries(n, g, c, below, h, left)
    return pa.concat_tables(out) if out else _logs(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 4)))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(g, texts, part, all, part_rare, all_rare): log P(toxic) - log P(ordinary) of each n-gram of
    one to ``ORDER`` bytes, from the counts without the calibration texts and from all, by the two
    class models and by those that share their backoff; and, marked by ``CONTEXT``, the log ratio
    of what each context leaves to the lower order.

    All n-grams whose contexts end in the same two bytes are one group: it holds their contexts
    and their suffixes down to three bytes.
    """
    spark = counts.sparkSession
    grouped = counts.groupBy(F.shiftrightunsigned("g", 8).bitwiseAND(F.lit(0xFFFF)).alias("ends"))
    sums = ", ".join(f"{c} long" for c in COLUMNS)
    # at most 2^16 pairs and four rows for each longer length
    few = (grouped.applyInArrow(_tally, f"n long, value long, {sums}").groupBy("n", "value")
           .agg(*[F.sum(c).alias(c) for c in COLUMNS]).orderBy("n", "value").toArrow())
    n, value = few["n"].to_numpy(), few["value"].to_numpy()
    c = np.stack([few[k].to_numpy() for k in COLUMNS], 1).astype(np.int64)
    pairs, pair_counts = value[n == 2].astype(np.uint64), c[n == 2]
    kinds = lambda c: np.stack([(c == k).sum(axis=0) for k in (1, 2, 3, 4)])
    # one byte: all 255, so that every place of a text has a probability
    single = np.arange(1, 256, dtype=np.uint64)
    single_counts = _merge([(single, np.zeros((255, len(COLUMNS)), np.int64)),
                            (_suffixes(pairs, 1), (pair_counts > 0).astype(np.int64))])[1]
    p, _, _ = interpolate(single, single_counts, np.full((255, len(COLUMNS)), 1 / 255), discounts(kinds(single_counts)))
    low = [_logs(single, single_counts[:, 5], p)]
    if len(pairs):
        p, h, left = interpolate(pairs, pair_counts, p[pairs.astype(np.int64) % 256 - 1], discounts(kinds(pair_counts)))
        low += _entries(2, pairs, pair_counts, p, h, left)
    by_length = {k: discounts(c[n == k]) for k in range(3, ORDER + 1) if (n == k).any()}
    shared = spark.sparkContext.broadcast((pairs, p, by_length))
    longer = grouped.applyInArrow(lambda t: _longer(t, shared), "g long, texts long, " + ", ".join(f"{k} double" for k in ENTRY))
    return longer.unionByName(spark.createDataFrame(pa.concat_tables(low)))


def store_model(ratios: DataFrame, shards: int) -> list[str]:
    """Write the entries as sorted arrays, one file for each remainder of the n-gram by ``shards``."""
    folder = work_path(ratios.sparkSession, "llm", "class-ratios")

    def write(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        g = table["g"].to_numpy().view(np.uint64)
        order = np.argsort(g)
        values = [table[c].to_numpy().astype(np.float32)[order].tobytes() for c in ENTRY]
        path = write_bytes(folder, str(shard), g[order].tobytes(), *values)
        return pa.table({"shard": pa.array([shard], pa.int64()), "path": [path]})

    files = saved(ratios.select("g", *ENTRY, F.pmod("g", F.lit(shards)).alias("shard")).groupBy("shard")
                  .applyInArrow(write, "shard long, path string"), "class-ratio-files")
    found = {r["shard"]: r["path"] for r in files.collect()}    # one row per file
    return [found.get(k, "") for k in range(shards)]


class ClassRatios:
    """Lookups in the files of :func:`store_model`; at most ``keep`` of them are in memory."""

    def __init__(self, files: list[str], keep: int = 8):
        self.files, self.keep, self.held = files, keep, {}

    def _load(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        if shard not in self.held:
            while len(self.held) >= self.keep:
                self.held.pop(next(iter(self.held)))
            raw = read_bytes(self.files[shard]) if self.files[shard] else b""
            n = len(raw) // (8 + 4 * len(ENTRY))
            values = np.frombuffer(raw, np.float32, len(ENTRY) * n, 8 * n).reshape(len(ENTRY), n)
            self.held[shard] = (np.frombuffer(raw, np.uint64, n), values)
        return self.held[shard]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys have an entry, and its ratios (0 where none); each file is opened once."""
        hit, out = np.zeros(len(keys), bool), np.zeros((len(keys), len(ENTRY)), np.float32)
        shard = np.mod(keys.view(np.int64), len(self.files))
        for k in range(len(self.files)):
            mine = np.flatnonzero(shard == k)
            held, values = self._load(k) if len(mine) else (np.zeros(0, np.uint64), None)
            if len(held):
                at = np.minimum(np.searchsorted(held, keys[mine]), len(held) - 1)
                same = held[at] == keys[mine]
                hit[mine[same]] = True
                out[mine[same]] = values[:, at[same]].T
        return hit, out

    def places(self, g: np.ndarray) -> np.ndarray:
        """Log ratios at the places whose n-grams are ``g``: those of the longest known suffix, and
        what the longer contexts leave to it."""
        asked, at = np.unique(g, return_inverse=True)
        known, out = self.find(asked)
        rest = np.flatnonzero(~known)
        # shorter and shorter: a suffix, then the context that it is left to next
        steps = [(n, rest[_lengths(asked[rest]) >= n]) for n in range(ORDER, 0, -1)]
        keys = [(_suffixes(asked[mine], n), _suffixes(asked[mine], n) >> np.uint64(8) | CONTEXT) for n, mine in steps]
        hit, ratio = self.find(np.concatenate([k for pair in keys for k in pair]))
        left, begin = np.ones(len(asked), bool), 0
        for _, mine in steps:
            open_, m = left[mine], len(mine)
            here, above = slice(begin, begin + m), slice(begin + m, begin + 2 * m)
            found = hit[here]
            out[mine[open_]] += np.where(found[:, None], ratio[here], ratio[above])[open_]
            left[mine[found]] = False
            begin += 2 * m
        return out[at]


def _cell(g: np.ndarray) -> np.ndarray:
    return (mix64(g) >> np.uint64(64 - BITS)).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell = _cell(batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns],
                                         names=["cell", *batch.schema.names])


def bound_table(ratios: DataFrame):
    """Broadcast (n-gram, its ratio, greatest ratio) per cell; its size depends on ``BITS`` alone."""
    top = F.greatest(F.col("part"), F.col("all"))
    cells = (ratios.select("g", "texts", top.alias("top"))
             .mapInArrow(_cells, "cell int, g long, texts long, top double").groupBy("cell")
             .agg(F.max(F.struct("texts", "g", "top")).alias("first"), F.max("top").alias("top"))
             .select("cell", "first.g", F.col("first.top").alias("own"), "top")).toArrow()      # at most 2^BITS rows
    at = cells["cell"].to_numpy()
    key, own, most = np.zeros(1 << BITS, np.uint64), np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    key[at] = cells["g"].to_numpy().view(np.uint64)
    own[at] = _up(cells["own"].to_numpy())
    most[at] = np.maximum(_up(cells["top"].to_numpy()), 0)
    return ratios.sparkSession.sparkContext.broadcast((key, own, most))


def _up(x: np.ndarray) -> np.ndarray:
    """The next single-precision number, no less than x."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def bounds(table: tuple[np.ndarray, np.ndarray, np.ndarray], g: np.ndarray) -> np.ndarray:
    """No less than the log ratio of each n-gram."""
    key, own, most = table
    cell = _cell(g)
    return np.where(key[cell] == g, own[cell], most[cell])


def _scan(batches: Iterator[pa.RecordBatch], files: list[str], least: float, most: int = 16 << 20
          ) -> Iterator[pa.RecordBatch]:
    """Per row: words, the mean excess over ``least`` of each of the ratios, and the mean ratio.

    Different words of about ``most`` bytes of texts are looked up together."""
    model = ClassRatios(files)
    known, ratios = np.zeros(0, np.uint64), np.zeros((0, len(ENTRY)))      # words met before
    held: list[tuple] = []      # batches, and of their blocks first row, words per text, different words, which of them
    fresh: list[tuple] = []     # hashes, bytes and borders of words not met before
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal known, ratios, size
        if fresh:
            names, first = np.unique(np.concatenate([x[0] for x in fresh]), return_index=True)
            lens = np.concatenate([np.diff(x[2]) for x in fresh])
            begin = np.cumsum(lens) - lens
            flat, value = np.concatenate([x[1] for x in fresh]), np.zeros((len(names), len(ENTRY)))
            for k in range(0, len(first), LOOKUPS):
                mine = first[k:k + LOOKUPS]
                g, word, _, _ = spellings(*_gather(flat, begin[mine], lens[mine]))      # every word a text of its own
                places = model.places(g)
                for j in range(len(ENTRY)):
                    value[k:k + LOOKUPS, j] = np.bincount(word, places[:, j], len(mine))
            at = np.searchsorted(known, names)
            known, ratios = np.insert(known, at, names), np.insert(ratios, at, value, axis=0)
            fresh.clear()
        for batch, parts in held:
            words, sums = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 5))
            for lo, counts, names, of in parts:
                value = ratios[np.searchsorted(known, names)][of]
                text = np.repeat(np.arange(len(counts)), counts)
                words[lo:lo + len(counts)] = counts
                for k, v in enumerate((*np.maximum(value - least, 0).T, value[:, 1])):
                    sums[lo:lo + len(counts), k] = np.bincount(text, v, len(counts))
            sums /= np.maximum(words, 1)[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words),
                                              *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(5))],
                                             names=[*batch.schema.names, "n_words", *ENTRY, "llr"])
        held.clear()
        size = 0
        if len(known) > WORDS:
            known, ratios = known[:0], ratios[:0]

    for batch in batches:
        parts = []
        for lo, _, data, offsets in blocks(batch, "text", 1 << 20):
            folded, starts, ends, counts = word_spans(data, offsets, ALNUM_WORDS_LOWER)
            size += len(data)
            if not len(starts):
                continue
            names, first, of = np.unique(span_hashes(prefix_hash(folded), starts, ends), return_index=True, return_inverse=True)
            parts.append((lo, counts, names, of.astype(np.int32)))
            at = np.minimum(np.searchsorted(known, names), len(known) - 1)
            new = first[known[at] != names] if len(known) else first
            if len(new):
                fresh.append((span_hashes(prefix_hash(folded), starts[new], ends[new]),
                              *_gather(folded, starts[new], ends[new] - starts[new])))
        held.append((batch.select(range(1, batch.num_columns)), parts))
        if size >= most:
            yield from flush()
    yield from flush()


def _gather(data: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after the other, and their borders."""
    cuts = np.append(0, np.cumsum(lens))
    return data[np.repeat(begin - cuts[:-1], lens) + np.arange(cuts[-1])], cuts


def fit_curve(points: list[tuple], ridge: float = 1e-2) -> list[float]:
    """(intercept, slopes) of a logistic curve through (x, ..., texts, toxic texts); a slope below 0 is 0."""
    *xs, n, k = (np.array(v, float) for v in zip(*points))
    used = list(range(len(xs)))
    while True:
        z = np.stack([np.ones_like(n), *(xs[j] for j in used)], 1)
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hess = z.T @ (z * (n * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
            w = w + np.linalg.solve(hess, z.T @ (k - n * p) - ridge * w)
        least = int(np.argmin(w[1:])) if used else 0
        if not used or w[1 + least] >= 0:
            break
        del used[least]
    if not used:
        share = (k.sum() + ridge) / (n.sum() + 2 * ridge)
        w = np.array([np.log(share / (1 - share))])
    slopes = dict(zip(used, w[1:]))
    return [float(w[0]), *(float(slopes.get(j, 0.0)) for j in range(len(xs)))]


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 2.0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, evidence and llr of every row of ``docs``.

    ``docs``: doc_id, text.  ``labels``: doc_id, toxic.
    """
    bound_batches(docs.sparkSession)
    texts = training_texts(docs, labels)
    counts = saved(count_texts(texts), "text-counts")
    # about three entries for each counted n-gram; an odd number of files spreads them evenly
    files = store_model(log_ratios(counts), -(-3 * counts.count() // FILE_ENTRIES) | 1)
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), "doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("text_hash"),
                       F.coalesce(calibrating(text) & text.isNotNull(), F.lit(False)).alias("calibrate"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    judged = saved(rows.mapInArrow(
        lambda it: released(_scan(it, files, least)),
        f"doc_id {id_type}, held_out boolean, text_hash long, calibrate boolean, n_words long, "
        + ", ".join(f"{k} double" for k in (*ENTRY, "llr"))), "judged")
    curve = _curve(judged, labels, texts)
    score = F.lit(0.0)
    if curve:
        a, *slopes = (F.lit(w) for w in curve)
        score = 1 / (1 + F.exp(-(a + sum((w * x for w, x in zip(slopes, _features("all"))), F.lit(0.0)))))
    return (judged.withColumn("score", score)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                    "n_words", F.col("all_rare").alias("evidence"), "llr"))


def _features(which: str) -> list[Column]:
    """What the curve looks at: log evidence of the models of shared backoff, and of the class models."""
    return [F.log(F.col(c) + FLOOR) for c in (f"{which}_rare", which)]


def _curve(judged: DataFrame, labels: DataFrame, texts: DataFrame) -> list[float]:
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    # one point for each distinct text and class; points are counted in steps of 1/50 and 1/10
    scales = (50, 10)
    steps = [F.round(x * k).cast("int").alias(f"step{k}") for x, k in zip(_features("part"), scales)]
    points = (judged.where("calibrate AND NOT held_out").join(known, "doc_id")
              .select("text_hash", "toxic", *steps).distinct()
              .groupBy("step50", "step10").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")))
    rows = points.orderBy("step50", "step10").collect()     # some hundreds of steps by some dozens
    if rows:
        return fit_curve([(r["step50"] / 50, r["step10"] / 10, r["n"], r["k"]) for r in rows])
    n, k = texts.agg(F.count("*"), F.sum(F.col("toxic").cast("int"))).first()
    return fit_curve([(n, k)]) if n else []
