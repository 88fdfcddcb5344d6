"""Repeated byte passages by two-stage suffix sorting.

A byte is removed if some window of ``length`` bytes that covers it also starts earlier in
the corpus.  Equal windows must be brought together without sorting the corpus in one
place, so every window is dealt by its anchor (:mod:`eventscope.llm.anchors`): equal
windows have equal anchors, and consecutive windows with one anchor form a short string.

1. Tasks count anchors, with the least and the greatest hash of their strings; those seen twice
   or more set a bit in a filter (its size follows their number up to ``most_bits``; a false bit
   costs work, never a result), those with different strings in another.
   Then the *sides* of their runs are counted, the anchor with the (length - K) / 2 bytes before it
   and with those after it: equal windows hold one of the two, so a run whose sides are both
   seen once has no repeat and goes no further.
2. The places of the strings of the other runs, equal ones merged in each task, go to the
   task of their anchor.  Bytes travel only for anchors with different strings: the windows of
   equal strings are equal one by one, so their earliest place says it all.
3. There the strings of anchors with different strings are suffix-sorted in two stages:
   suffixes smaller than their successor are sorted directly, all others are induced by
   scanning the first-byte buckets in order; adjacent common prefixes of ``length`` or more
   are equal windows, and the earliest place of each is its first occurrence.
4. First occurrences go back to their documents, where every window of a repeated anchor
   that is not one is a repeat; removed bytes are the union of repeats.

An anchor with more than ``hot`` different strings is cut into single windows, dealt by
their own hash, so that a phrase in a third of all texts is no single task's work.

Defined cases: a NULL text is empty; texts shorter than ``length`` keep everything; rows
that repeat a doc_id are ordered by their text (equal ones: any order); a NULL doc_id comes
before all others; windows never cross texts; texts of any length are handled in pieces;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventscope.llm.anchors import placed_runs, runs  # noqa: F401
from eventscope.llm.common import (BLOCK_BYTES, blocks, bound_batches, hash_filter, passes,
                                   prefix_hash, saved, span_hashes)

K = 32
LOOK_BYTES = 128 << 10      # texts looked at together: the arrays of a block stay in cache
SYMBOLS = 7     # values of 9 bits in a sort word
SORT_BYTES = 2 << 20


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int
            ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, bytes, offsets) of a block, a long text cut so that each window is in one."""
    if len(data) <= BLOCK_BYTES:
        yield 0, data, offsets
        return
    for at in range(0, max(1, len(data) - length + 1), BLOCK_BYTES):    # such a block is one text
        part = data[at:at + BLOCK_BYTES + length - 1]
        yield at, part, np.array([0, len(part)])


def _strings(batch: pa.RecordBatch, length: int):
    """Per block: bytes, runs (first, last window, anchor), row, place in text, where the anchor lies."""
    for lo, _, whole, offsets in blocks(batch, "text", LOOK_BYTES):
        for at, data, offs in _pieces(whole, offsets, length):
            first, last, anchor, text, where = placed_runs(data, offs, length, K)
            yield data, first, last, anchor, lo + text, at + first - offs[text], where


def _sides(prefix: np.ndarray, first: np.ndarray, last: np.ndarray, where: np.ndarray, length: int
           ) -> list[tuple[np.ndarray, np.ndarray]]:
    """(runs, hash of the side) before the anchor and after it, of runs with a window that holds it.

    A window whose anchor is at least half of its other bytes in holds the side before, others
    the side after."""
    half = (length - K) // 2
    before, after = np.flatnonzero(where - first >= half), np.flatnonzero(where - last < half)
    return [(before, span_hashes(prefix, where[before] - half, where[before] + K)),
            (after, ~span_hashes(prefix, where[after], where[after] + K + half))]


def _count_sides(batches: Iterator[pa.RecordBatch], length: int, wanted, bits: int, most: int = 1 << 22
                 ) -> Iterator[pa.RecordBatch]:
    """(the upper 48 bits of a side's hash, seen once or more often here) of runs of repeated anchors."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        side, n = np.unique(np.concatenate(held) >> np.uint64(16), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(side.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))],
                                          names=["side", "seen"])

    for batch in batches:
        for data, first, last, anchor, _, _, where in _strings(batch, length):
            keep = passes(wanted.value, anchor, bits)
            held += [h for _, h in _sides(prefix_hash(data), first[keep], last[keep], where[keep], length)]
            size += sum(len(h) for h in held[-2:])
            if size >= most:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _may_repeat(data: np.ndarray, first, last, anchor, where, length: int, wanted, bits: int, sides: tuple | None) -> np.ndarray:
    """Which runs have a repeated anchor and, with ``sides`` (a filter and its bits), a repeated side."""
    keep = passes(wanted.value, anchor, bits)
    if sides is None or not keep.any():
        return keep
    at = np.flatnonzero(keep)
    keep = np.zeros(len(anchor), bool)
    for of, h in _sides(prefix_hash(data), first[at], last[at], where[at], length):
        keep[at[of[passes(sides[0].value, h >> np.uint64(16) << np.uint64(16), sides[1])]]] = True
    return keep


def _count(batches: Iterator[pa.RecordBatch], length: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """(anchor, seen more than once here, different strings here, least and greatest hash of the
    strings) of a task."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in held])
        s = np.concatenate([x for _, x in held])
        order = np.argsort(a)
        a, s = a[order], s[order]
        same = a[1:] == a[:-1]
        several = np.flatnonzero(np.append(False, same) | np.append(same, False))
        inner = np.lexsort((s[several], a[several]))
        s[several] = s[several][inner]
        first = np.flatnonzero(np.append(True, ~same))
        kinds = np.append(True, ~same | (s[1:] != s[:-1])).astype(np.int32)
        signed = s.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(a[first].view(np.int64)), pa.array((np.diff(np.append(first, len(a))) > 1).astype(np.int32) + 1),
             pa.array(np.add.reduceat(kinds, first), pa.int32()), pa.array(np.minimum.reduceat(signed, first)),
             pa.array(np.maximum.reduceat(signed, first))], names=["anchor", "seen", "kinds", "least", "most"])

    for batch in batches:
        for data, first, last, anchor, _, _, _ in _strings(batch, length):
            if len(first):
                held.append((anchor, span_hashes(prefix_hash(data), first, last + length)))
                size += len(first)
            if size >= most:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _gather(data: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after the other, and their offsets."""
    cuts = np.append(0, np.cumsum(lens))
    return data[np.repeat(begin - cuts[:-1], lens) + np.arange(cuts[-1])], cuts


def _earliest(anchor, string, doc, copy, place) -> np.ndarray:
    """Rows of different (anchor, string), sorted, each at its first occurrence."""
    order = np.lexsort((place, copy, doc, string, anchor))
    a, s = anchor[order], string[order]
    return order[np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1]))] if len(order) else order


def _deal(batches: Iterator[pa.RecordBatch], length: int, wanted, bits: int, hot,
          most: int = 24 << 20, several: tuple | None = None, sides: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """Different strings of repeated anchors with their first occurrence and number of windows;
    the bytes where an anchor has ``several`` (a filter and its bits; None: all).  Equal strings are merged over ``most`` bytes of them
    before they are handed on."""
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        anchor, string, doc, copy, place, n, lens, flat = (np.concatenate(x) for x in zip(*held))
        begin = np.cumsum(lens) - lens
        one = _earliest(anchor, string, doc, copy, place)
        for k in range(0, len(one), 1 << 15):
            mine = one[k:k + (1 << 15)]
            chosen, cuts = _gather(flat, begin[mine], lens[mine])
            texts = pa.Array.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(chosen)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[mine].view(np.int64)), pa.array(doc[mine]), pa.array(copy[mine]),
                 pa.array(place[mine]), pa.array(n[mine].astype(np.int16)), texts],
                names=["anchor", "doc", "copy", "place", "n", "string"])

    for batch in batches:
        doc, copy = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for data, first, last, anchor, row, place, where in _strings(batch, length):
            keep = _may_repeat(data, first, last, anchor, where, length, wanted, bits, sides)
            first, last, anchor, row, place = (x[keep] for x in (first, last, anchor, row, place))
            prefix = prefix_hash(data)
            bytes_too = passes(several[0].value, anchor, several[1]) if several else np.ones(len(anchor), bool)
            if hot is not None:
                split = passes(hot.value, anchor)
                # a window dealt by its own hash has one string
                bytes_too = np.append(bytes_too[~split], np.zeros(int((last - first + 1)[split].sum()), bool))
                n = (last - first + 1)[split]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                alone = np.repeat(first[split], n) + step
                first, last = np.append(first[~split], alone), np.append(last[~split], alone)
                anchor = np.append(anchor[~split], span_hashes(prefix, alone, alone + length))
                row = np.append(row[~split], np.repeat(row[split], n))
                place = np.append(place[~split], np.repeat(place[split], n) + step)
            if not len(first):
                continue
            end = last + length
            string = span_hashes(prefix, first, end)
            one = _earliest(anchor, string, doc[row], copy[row], place)
            lens = np.where(bytes_too, end - first, 0)[one]
            flat, _ = _gather(data, first[one], lens)
            held.append((anchor[one], string[one], doc[row[one]], copy[row[one]], place[one], (last - first + 1)[one], lens, flat))
            size += len(flat) + 48 * len(one)
            if size >= most:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def suffix_order(text: np.ndarray, wanted: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions in the order of their suffixes (the first ``depth`` values count).

    ``text``: values of which 0 ends each string; ``words``: its :func:`symbol_words`.  Only what induction needs is sorted: the wanted suffixes and
    those that follow a larger one, up to the next that is smaller than its successor.
    """
    n = len(text)
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))      # last place of each run
    run_end = np.repeat(change, np.diff(np.append(-1, change)))
    after = np.minimum(run_end + 1, n - 1)
    smaller = (text < text[after]) | (text == 0)                          # than its successor
    need = wanted.copy()
    chain = np.flatnonzero(need & ~smaller) + 1
    while len(chain):
        chain = chain[~need[chain]]
        need[chain] = True
        chain = chain[~smaller[chain]] + 1
    # stage one: direct sort, a word of values at a time, going on only among equals
    direct = np.flatnonzero(need & smaller)
    order = np.argsort(words[direct], kind="stable")
    direct = direct[order]
    group = np.zeros(len(direct), np.int64)
    key = words[direct]
    np.cumsum(key[1:] != key[:-1], out=group[1:])
    for at in range(SYMBOLS, depth + SYMBOLS, SYMBOLS):
        tied = np.zeros(len(group), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        tied &= text[direct] != 0
        where = np.flatnonzero(tied)
        if not len(where):
            break
        mine = direct[where]
        key = words[np.minimum(mine + at, len(words) - 1)]
        inner = np.lexsort((key, group[where]))
        direct[where], key = mine[inner], key[inner]
        # equal groups stay where they are; a changed key opens a new group from there on
        opened = np.zeros(len(group), np.int64)
        old = group[where]
        opened[where[1:]] = (key[1:] != key[:-1]) & (old[1:] == old[:-1])
        group += np.cumsum(opened)
    # stage two: scan the buckets of the first byte in order; a larger suffix goes to its
    # bucket when its successor is met, before that bucket's directly sorted ones
    size = int(text.max()) + 1 if n else 1
    cut = np.searchsorted(text[direct], np.arange(size + 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(size)]

    def scan(found: np.ndarray) -> np.ndarray | None:
        before = found[found > 0] - 1
        before = before[need[before] & ~smaller[before]]
        if not len(before):
            return None
        first = text[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        edge = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        for lo, hi in zip(edge, np.append(edge[1:], len(first))):
            induced[first[lo]].append(before[lo:hi])
        return before

    out = []
    for c in range(size):
        k = 0
        while k < len(induced[c]):        # runs of one byte feed their own bucket
            scan(induced[c][k])
            out.append(induced[c][k])
            k += 1
        tail = direct[cut[c]:cut[c + 1]]
        if len(tail):
            scan(tail)
            out.append(tail)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def symbol_words(text: np.ndarray) -> np.ndarray:
    """The SYMBOLS values (9 bits each) from each position on, as one number."""
    padded = np.append(text, np.zeros(SYMBOLS, text.dtype)).astype(np.uint64)
    out = padded[:len(text)].copy()
    for j in range(1, SYMBOLS):
        out <<= np.uint64(9)
        out |= padded[j:j + len(text)]
    return out


def first_windows(data: np.ndarray, lens: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Which windows of different strings (laid end to end in ``data``) occur in no string
    of a lower rank, flattened."""
    begin = np.cumsum(lens + 1) - lens - 1
    text = np.zeros(int((lens + 1).sum()), np.int16)    # 0 after each string, below every byte
    inside = np.ones(len(text), bool)
    inside[begin + lens] = False
    text[inside] = data.astype(np.int16) + 1
    words = symbol_words(text)
    wanted = np.zeros(len(text), bool)
    n = lens - length + 1
    of = np.repeat(np.arange(len(lens)), n)
    places = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wanted[places] = True
    order = suffix_order(text, wanted, words, length)
    # adjacent common prefixes, a word at a time
    equal = np.ones(max(len(order) - 1, 0), bool)
    for at in [*range(0, length - SYMBOLS, SYMBOLS), length - SYMBOLS]:
        left = np.flatnonzero(equal)
        equal[left] = words[order[left] + at] == words[order[left + 1] + at]
    string_of = np.zeros(len(text), np.int64)
    string_of[places] = of
    mine = rank[string_of[order]]
    start = np.flatnonzero(np.append(True, ~equal)) if len(order) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(mine, start) if len(start) else mine
    first = mine == np.repeat(least, np.diff(np.append(start, len(order))))
    flags = np.zeros(len(text), bool)
    flags[order[first]] = True
    return flags[places]


def _width(length: int) -> int:
    """Bytes of the bits of a string's windows: a run has at most length - K + 1."""
    return -(-(length - K + 1) // 8)


def _firsts(anchor, doc, copy, place, n, texts: pa.Array, length: int) -> pa.RecordBatch:
    """First occurrences of the windows of some whole anchors' strings (of n windows each);
    an anchor without bytes has one string, whose earliest place holds them all."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    string = span_hashes(prefix_hash(data), offsets[:-1], offsets[1:])
    one = _earliest(anchor, string, doc, copy, place)
    anchor, doc, copy, place, n = anchor[one], doc[one], copy[one], place[one], n[one].astype(np.int64)
    begin, lens = offsets[:-1][one], np.diff(offsets)[one]
    shared = np.zeros(len(one), bool)
    same = anchor[1:] == anchor[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    flags = np.ones(n.sum(), bool)
    many = np.flatnonzero(shared)
    if len(many):    # an anchor with a single string has no two equal windows
        rank = np.empty(len(many), np.int64)
        rank[np.lexsort((place[many], copy[many], doc[many]))] = np.arange(len(many))
        flat, _ = _gather(data, begin[many], lens[many])
        flags[np.repeat(shared, n)] = first_windows(flat, lens[many], rank, length)
    width = _width(length)
    table = np.zeros((len(one), 8 * width), bool)
    of = np.repeat(np.arange(len(one)), n)
    table[of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flags
    some = np.flatnonzero(table.any(axis=1))
    bits = np.packbits(table[some], axis=1).reshape(-1)
    cuts = (np.arange(len(some) + 1) * width).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(cuts), pa.py_buffer(bits)])
    return pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(copy[some]), pa.array(place[some]), packed],
                                      names=["doc", "copy", "place", "bits"])


def _resolve(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """First occurrences of the windows of strings sorted by anchor: doc, copy, place and
    the bits of the windows from there on that occur nowhere earlier.  Whole anchors are
    taken together, about SORT_BYTES of strings at a time."""
    held, size = [], 0

    def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        anchor, doc, copy, place, n = (table[k].to_numpy() for k in range(5))
        texts = table[5].chunk(0) if table[5].num_chunks else pa.array([], pa.binary())
        return _firsts(anchor, doc, copy, place, n, texts, length)

    for batch in batches:
        step = max(1, int(batch.num_rows * SORT_BYTES / max(1, batch.nbytes)))
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, step)
            at += part.num_rows
            if size >= SORT_BYTES:
                anchor = part.column(0).to_numpy()
                last = held[-1].column(0)[-1].as_py()
                same = int(np.searchsorted(anchor != last, True)) if anchor[0] == last else 0
                if same < part.num_rows:
                    if same:
                        held.append(part.slice(0, same))
                    yield close(held)
                    held, size, part = [], 0, part.slice(same)
            held.append(part)
            size += part.nbytes
    if held:
        yield close(held)


def _cut(batches: Iterator[pa.RecordBatch], length: int, wanted, bits: int, keep_bytes: bool,
         sides: tuple | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        listed = batch.column(3)
        if isinstance(listed, pa.ChunkedArray):
            listed = listed.combine_chunks()
        n_firsts = np.asarray(pc.fill_null(pc.list_value_length(listed), 0)).astype(np.int64)
        until = np.cumsum(n_firsts)
        flat = listed.flatten()
        entry_place = np.asarray(flat.field(0)).astype(np.int64)
        raw = b"".join(flat.field(1).to_pylist())
        entry_bits = np.frombuffer(raw, np.uint8).reshape(-1, _width(length))
        n_bytes, n_removed, n_spans, digests, kept = [], [], [], [], []
        for lo, hi, data, offsets in blocks(batch, "text", LOOK_BYTES):
            edge = np.zeros(len(data) + 1, np.int32)
            for at, part, offs in _pieces(data, offsets, length):
                first, last, anchor, _, where = placed_runs(part, offs, length, K)
                keep = _may_repeat(part, first, last, anchor, where, length, wanted, bits, sides)
                edge[at + first[keep]] += 1
                edge[at + last[keep] + 1] -= 1
            repeat = np.cumsum(edge[:-1]) > 0
            mine = slice(until[lo] - n_firsts[lo], until[hi - 1])
            entry, step = np.nonzero(np.unpackbits(entry_bits[mine], axis=1))
            base = np.repeat(offsets[:-1], n_firsts[lo:hi]) + entry_place[mine]
            repeat[base[entry] + step] = False
            start = np.flatnonzero(repeat)
            edge[:] = 0
            edge[start] = 1
            edge[start + length] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            for k in range(hi - lo):
                b, e = offsets[k], offsets[k + 1]
                out = gone[b:e]
                left = data[b:e][~out].tobytes()
                n_bytes.append(int(e - b))
                n_removed.append(int(out.sum()))
                n_spans.append(int((out & ~np.append(False, out[:-1])).sum()) if len(out) else 0)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep_bytes else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = 1 << 17, most_bits: int = 30,
                   keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    ``docs``: doc_id (an integer, it orders the texts) and text; ``length`` is above 40.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    texts = docs.select("doc_id", doc.alias("doc"), F.col("text").cast("string").alias("text"))
    if texts.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # repeated ids are told apart by a number in the order of their texts
        again = Window.partitionBy("doc").orderBy("text")
        texts = saved(texts.withColumn("copy", F.row_number().over(again).cast("long")), "numbered-texts")
    else:
        texts = texts.withColumn("copy", F.lit(0).cast("long"))
    counts = saved(texts.select("text").mapInArrow(lambda it: _count(it, length), "anchor long, seen int, kinds int, least long, most long")
                   .groupBy("anchor").agg(F.sum("seen").alias("seen"), F.sum("kinds").alias("kinds"),
                                          (F.min("least") != F.max("most")).alias("several"))
                   .where("seen > 1"), "repeated-anchors")
    n, n_several, kinds, many, most = counts.agg(
        F.count("*"), F.count_if("several"), F.sum("kinds"), F.sum(F.when(F.col("several"), F.col("kinds"))), F.max("kinds")).first()
    bits = min(max(20, (16 * n).bit_length()), most_bits)
    wanted = hash_filter(counts, "anchor", bits)
    several_bits = min(max(20, (16 * n_several).bit_length()), most_bits)
    several = hash_filter(counts.where("several"), "anchor", several_bits)
    seen_sides = saved(texts.select("text").mapInArrow(lambda it: _count_sides(it, length, wanted, bits), "side long, seen int")
                       .groupBy("side").agg(F.sum("seen").alias("seen")).where("seen > 1")
                       .select(F.shiftleft("side", 16).alias("side")), "repeated-sides")
    side_bits = min(max(20, (16 * seen_sides.count()).bit_length()), most_bits)
    sides = (hash_filter(seen_sides, "side", side_bits), side_bits)
    split = hash_filter(counts.where(F.col("kinds") > hot), "anchor") if (most or 0) > hot else None
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-((kinds or 0) * 40 + (many or 0) * 140) // (32 << 20)))
    strings = (texts.select("doc", "copy", "text")
               .mapInArrow(lambda it: _deal(it, length, wanted, bits, split, several=(several, several_bits), sides=sides),
                           "anchor long, doc long, copy long, place long, n short, string binary")
               .repartition(parts, "anchor").sortWithinPartitions("anchor"))
    firsts = saved(strings.mapInArrow(lambda it: _resolve(it, length), "doc long, copy long, place long, bits binary"),
                   "first-windows")
    by_doc = firsts.groupBy("doc", "copy").agg(F.collect_list(F.struct("place", "bits")).alias("firsts"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = (texts.join(by_doc, ["doc", "copy"], "left").select("doc_id", "doc", "text", "firsts")
           .mapInArrow(lambda it: _cut(it, length, wanted, bits, keep_bytes, sides),
                       f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    return out if keep_bytes else out.drop("kept")
