"""Token-id shards with a minimal perfect hash index.

File format.  A *shard* is the token ids of consecutive documents in ascending doc_id
order, one after the other, each document closed by the end id, as raw little-endian
unsigned integers: 16 bits if the vocabulary fits, else 32.  Nothing else is in the file.
The *index* has one row per bucket of keys: displacement seeds of a minimal perfect hash
and, in slot order, (fingerprint, shard, offset, length) records.  A key is found in
constant time: its bucket, its seed, its slot, a compare of the fingerprint, one ranged
read of the shard.

Documents are range-partitioned by doc_id; a task encodes and writes its own shards and
returns the catalogue rows, which Spark commits, so a task that is run again cannot
corrupt anything.  Buckets hold about 2048 keys whatever the input, so no task builds a
large hash.

Encoding cuts texts at ASCII white space and between ASCII letters and punctuation other
than the apostrophe, where the tokenizer's own pre-tokenizer always cuts too, has the
library encode each distinct piece, and lays the ids out with numpy.  Texts that hold a
special token's string are given to the library whole.

Defined cases: a NULL text is empty and has only the end id; a NULL doc_id sorts first;
rows that repeat a doc_id are keys (doc_id, copy) in text order; extra columns are ignored;
an empty table has no shard and an empty index.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventscope.llm.common import blocks, bound_batches, mix64, released, saved
from eventscope.llm.files import read_bytes, write_bytes
from eventscope.session import work_path

END_ID = 2
SHARD_BYTES = 32 << 20
BUCKET_KEYS = 2048
KEPT_PIECES = 300_000
BLOCK_BYTES = 4 << 20     # texts whose pieces are looked up together
PART_BYTES = 1 << 20      # texts cut into pieces and laid out together
RECORD = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = bytearray(256)      # 1 letter, 2 punctuation, 0 neither
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = 1 if _c.isalpha() else 2 if 33 <= _b < 127 and not _c.isalnum() and _c != "'" else 0
_KIND = bytes(_KIND)
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = bytes(int(x) for x in _SPACE)
_SPECIAL = re.compile(rb"<\|(startoftext|endoftext)\|>", re.I)


class Encoder:
    """Encodes blocks of texts with a tokenizer file; remembers pieces, up to a limit."""

    def __init__(self, path: str, most: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for piece, k in self.tok.get_vocab().items():
            self.ends[k] = piece.endswith("</w>")
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.len = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.uses = np.zeros(1 << 12, np.int32)    # blocks that had the piece

    def forget(self, most: int) -> None:
        """Forgets the pieces that one block alone had, then the rarest, down to ``most``."""
        uses = self.uses[:len(self.known)]
        kept = np.sort(np.argsort(-uses, kind="stable")[:min(most, np.count_nonzero(uses > 1))])
        words, uses, lens = list(self.known), uses[kept] // 2, self.len[kept]
        flat = self.ids[np.repeat(self.at[kept] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
        self._clear()
        self._store([words[k] for k in kept.tolist()], lens, flat)
        self.uses[:len(kept)] = uses

    def _store(self, words: list[bytes], lens: np.ndarray, flat: np.ndarray) -> None:
        k, n = len(self.known), len(words)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while k + n > len(self.at):
            self.at, self.len, self.uses = (np.append(x, np.zeros_like(x)) for x in (self.at, self.len, self.uses))
        self.ids[self.used:self.used + len(flat)] = flat
        self.at[k:k + n] = self.used + np.cumsum(lens) - lens
        self.len[k:k + n] = lens
        self.used += len(flat)
        self.known.update(zip(words, range(k, k + n)))

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        # a run of letters is one piece, and a piece ends with an end-of-word token: such
        # words are encoded in one text and told apart by those tokens
        simple = [k for k, t in enumerate(texts) if t.isalpha()]
        line = " ".join([texts[k] for k in simple])
        ids = np.array(self.tok.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        if len(ends) == len(simple) and (not len(ids) or ends[-1] == len(ids)):
            self._store([words[k] for k in simple], np.diff(np.append(0, ends)), ids)
            rest = [k for k, t in enumerate(texts) if not t.isalpha()]
        else:
            rest = range(len(texts))
        if len(rest):
            found = [e.ids for e in self.tok.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)]
            self._store([words[k] for k in rest], np.array([len(x) for x in found]),
                        np.array([i for x in found for i in x], np.uint32))

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The places of distinct pieces among the known ones; new ones are learned."""
        if len(self.known) > self.most:
            self.forget(self.most // 2)
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [words[k] for k in new.tolist()]
            self._learn(fresh)
            number[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        self.uses[number] += 1
        return number

    def block(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, end ids included, and the number of each text's.

        A part of whole texts at a time is cut into pieces and laid out, as that takes many times
        a part's size; the parts share one dictionary, as a part alone has few pieces twice.
        """
        parts, lo, n = [], 0, len(offsets) - 1
        while lo < n:
            hi = int(np.searchsorted(offsets, offsets[lo] + PART_BYTES, side="right")) - 1
            hi = min(max(hi, lo + 1), n)
            parts.append((data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]))
            lo = hi
        cut = [_pieces(*part) for part in parts]
        coded = pa.concat_arrays([pa.array([], pa.binary()), *[pieces for _, pieces in cut]]).dictionary_encode()
        number = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[
            coded.indices.to_numpy(zero_copy_only=False)]
        out, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        for part, (places, _) in zip(parts, cut):
            ids, lens = self._laid(*part, places, number[at:at + len(places)], end_id)
            out.append(ids)
            counts.append(lens)
            at += len(places)
        return np.concatenate(out), np.concatenate(counts)

    def _laid(self, data: np.ndarray, offsets: np.ndarray, places: np.ndarray, number: np.ndarray,
              end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of a part whose pieces start at ``places`` and have these numbers."""
        lens = self.len[number]
        total = np.append(0, np.cumsum(lens, dtype=np.int64))
        of_text = np.searchsorted(places, offsets)
        counts = np.diff(total[of_text]) + 1
        out = np.empty(int(total[-1]) + len(counts), np.uint32)
        ends = np.cumsum(counts) - 1
        slot = np.ones(len(out), bool)
        slot[ends] = False
        out[ends] = end_id
        out[slot] = self.ids[np.repeat(self.at[number] - total[:-1], lens) + np.arange(total[-1])]
        raw = data.tobytes()
        if _SPECIAL.search(raw):
            parts = np.split(out, ends[:-1] + 1)
            for k in range(len(parts)):
                text = raw[offsets[k]:offsets[k + 1]]
                if _SPECIAL.search(text):
                    parts[k] = np.array([*self.tok.encode(text.decode(), add_special_tokens=False).ids, end_id], np.uint32)
            out, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return out, counts


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where the pieces of a part start, and the pieces, lower-cased."""
    raw = data.tobytes()
    low = np.frombuffer(raw.translate(_LOW), np.uint8)
    inside = np.frombuffer(raw.translate(_BLANK), np.uint8) == 0
    kind = np.frombuffer(raw.translate(_KIND), np.uint8)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | ((kind[1:] | kind[:-1]) == 3)
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin &= inside
    places = np.flatnonzero(begin)
    kept = low[inside]
    seen = np.cumsum(inside, dtype=np.int32)
    cuts = np.append(seen[places] - 1, len(kept)).astype(np.int32)
    return places, pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(cuts), pa.py_buffer(kept)])


_encoders: dict[str, Encoder] = {}


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, end_id: int,
           wide: bool) -> Iterator[pa.RecordBatch]:
    enc = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
    from pyspark import TaskContext
    kind = np.dtype("<u4" if wide else "<u2")
    part, number = TaskContext.get().partitionId(), 0
    keys, counts, held, size = [], [], [], 0
    last, copy = object(), 0

    def flush() -> pa.RecordBatch:
        nonlocal keys, counts, held, size, number
        path = write_bytes(folder, "shard", *held)
        n = np.concatenate(counts)
        rows = pa.RecordBatch.from_arrays(
            [pa.array([path] * len(n)), pa.concat_arrays([k for k, _ in keys]),
             pa.array(np.concatenate([c for _, c in keys])), pa.array(np.cumsum(n) - n), pa.array(n),
             pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), number, np.int32))],
            names=["path", "doc_id", "copy", "offset", "n", "part", "number"])
        keys, counts, held, size, number = [], [], [], 0, number + 1
        return rows

    for batch in batches:
        ids = batch.column(0)
        copies = []
        for x in ids.to_pylist():
            copy = copy + 1 if x == last else 0
            last = x
            copies.append(copy)
        for lo, hi, data, offsets in blocks(batch, "text", BLOCK_BYTES):
            out, n = enc.block(data, offsets, end_id)
            keys.append((ids.slice(lo, hi - lo), np.array(copies[lo:hi], np.int64)))
            counts.append(n)
            held.append(out.astype(kind).tobytes())
            size += len(held[-1])
            if size >= SHARD_BYTES:
                yield flush()
    if held:
        yield flush()
    if len(enc.known) > KEPT_PIECES:    # the worker process lives on: keep little in it
        enc.forget(KEPT_PIECES // 2)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards; returns the catalogue: shard, path,
    doc_id, copy, offset and n (in ids) of every document."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    bound_batches(spark)
    folder = work_path(spark, "llm", "token-shards")
    wide = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) > 1 << 16
    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
            .mapInArrow(lambda it: released(_write(it, tokenizer, folder, end_id, wide)),
                        f"path string, doc_id {id_type}, copy long, offset long, n long, part int, number int"))
    rows = saved(rows, "token-rows")
    # shards lie in the order of their range partition and of their writing there: running sums
    # go over the partitions once (one row each), and over the shards of each partition
    shards = rows.groupBy("part", "number", "path").agg(F.sum("n").cast("long").alias("ids"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = shards.groupBy("part").agg(F.sum("ids").alias("ids"), F.count("*").alias("shards")).select(
        "part", F.coalesce(F.sum("ids").over(over), zero).alias("ids_before"),
        F.coalesce(F.sum("shards").over(over), zero).alias("shards_before"))
    shards = saved(shards.join(parts, "part").select(
        "path", (F.col("shards_before") + F.col("number")).cast("long").alias("shard"),
        (F.col("ids_before") + F.coalesce(F.sum("ids").over(inside), zero)).alias("before"),
        F.lit(4 if wide else 2).alias("width")), "token-shard-list")
    return rows.drop("part", "number").join(shards, "path")


def key_of(doc_id: Column, copy: Column) -> Column:
    """The text of a key: NULL and the text 'null' differ, as do copies."""
    return F.concat(F.when(doc_id.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), doc_id.cast("string"))),
                    F.lit("#"), copy.cast("string"))


def _hashed(keys: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key: one places it, one is its fingerprint."""
    return F.xxhash64(keys), F.xxhash64(keys, F.lit("print"))


def _first_seed(mine: np.ndarray, taken: np.ndarray) -> tuple[int, np.ndarray]:
    """The first seed that sends a group's keys to different free slots; many are tried at
    once, more when the first few fail."""
    base, step = 0, 16
    while True:
        seeds = np.arange(base, base + step)
        at = slot_of(mine[None, :], seeds[:, None], len(taken))
        row = np.sort(at, axis=1)
        good = ~taken[at].any(axis=1) & (row[:, 1:] != row[:, :-1]).all(axis=1)
        if good.any():
            k = int(good.argmax())
            return base + k, at[k]
        base, step = base + step, 1024


def build_mph(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and slots of a minimal perfect hash of distinct 64-bit hashes (see :func:`salted`).

    Keys fall into groups of about four; from the largest group on, each takes the first
    seed that sends its keys to free slots; a lone key's seed is a free slot itself
    (stored as -1 - slot).
    """
    n = len(hashes)
    groups = max(1, -(-n // 4))
    group = (mix64(hashes) % np.uint64(groups)).astype(np.int64)
    sizes = np.bincount(group, minlength=groups)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(sizes)[:-1])
    seeds, slots, taken = np.zeros(groups, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    order = np.argsort(-sizes, kind="stable")
    for g in order[sizes[order] > 1]:
        seeds[g], at = _first_seed(hashes[members[g]], taken)
        slots[members[g]], taken[at] = at, True
    free = iter(np.flatnonzero(~taken))
    for g in order[sizes[order] == 1]:
        slot = int(next(free))
        seeds[g], slots[members[g]] = -1 - slot, slot
    return seeds, slots


def salted(hashes: np.ndarray, prints: np.ndarray, salt: int) -> np.ndarray:
    """The hashes that place a bucket's keys: their own, or mixed with their second hash."""
    return hashes if salt == 0 else mix64(hashes + mix64(prints + np.uint64(salt)))


def distinct_salt(hashes: np.ndarray, prints: np.ndarray) -> int:
    """The first salt under which no two keys of a bucket share a hash."""
    for salt in range(64):
        if len(np.unique(salted(hashes, prints, salt))) == len(hashes):
            return salt
    raise ValueError("two keys agree in both of their 64-bit hashes")


def slot_of(hashes: np.ndarray, seed, n: int) -> np.ndarray:
    """Slots of hashes under a seed (a number or an array)."""
    seed = np.atleast_1d(np.asarray(seed, np.int64))
    spread = mix64(hashes + (seed.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(seed < 0, -1 - seed, (spread % np.uint64(max(n, 1))).astype(np.int64))


def find(hashes: np.ndarray, prints: np.ndarray, seeds: np.ndarray, records: np.ndarray
         ) -> tuple[np.ndarray, np.ndarray]:
    """Records at the keys' slots, and whether the fingerprints agree."""
    if not len(records):
        return np.zeros(len(hashes), RECORD), np.zeros(len(hashes), bool)
    at = slot_of(hashes, seeds[(mix64(hashes) % np.uint64(len(seeds))).astype(np.int64)], len(records))
    got = records[at]
    return got, got["print"] == prints.astype(np.uint32)


def build_index(catalogue: DataFrame) -> DataFrame:
    """(bucket, buckets, salt, seeds, records): the perfect hash index of a catalogue."""
    keys = catalogue.count()
    buckets = max(1, -(-keys // BUCKET_KEYS))
    place, fingerprint = _hashed(key_of(F.col("doc_id"), F.col("copy")))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, f = rows["h"].to_numpy().view(np.uint64), rows["f"].to_numpy().view(np.uint64)
        salt = distinct_salt(h, f)
        seeds, slots = build_mph(salted(h, f, salt))
        records = np.zeros(len(h), RECORD)
        records["print"][slots] = f.astype(np.uint32)
        for name in ("shard", "offset", "n"):
            records[name][slots] = rows[name]
        return pd.DataFrame({"bucket": [key[0]], "buckets": [buckets], "salt": [salt],
                             "seeds": [seeds.tobytes()], "records": [records.tobytes()]})

    return saved(catalogue.select(place.alias("h"), fingerprint.alias("f"), "shard", "offset", "n")
                 .withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
                 .groupBy("bucket").applyInPandas(
                     build, "bucket long, buckets long, salt long, seeds binary, records binary"), "token-index")


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """``keys`` (doc_id, copy) with shard, offset and n; keys that the index lacks have NULL
    (up to the 32-bit fingerprint)."""
    first = index.select("buckets").limit(1).collect()
    buckets = first[0][0] if first else 1
    place, fingerprint = _hashed(key_of(F.col("doc_id"), F.col("copy")))
    asked = keys.select("doc_id", "copy", place.alias("h"), fingerprint.alias("f")).withColumn(
        "bucket", F.pmod(F.col("h"), F.lit(buckets)))

    def get(_key: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        out = rows[["doc_id", "copy"]].copy()
        seeds = np.frombuffer(entry["seeds"].iloc[0], np.int32) if len(entry) else np.zeros(1, np.int32)
        records = np.frombuffer(entry["records"].iloc[0], RECORD) if len(entry) else np.zeros(0, RECORD)
        h, f = rows["h"].to_numpy().view(np.uint64), rows["f"].to_numpy().view(np.uint64)
        got, ok = find(salted(h, f, int(entry["salt"].iloc[0]) if len(entry) else 0), f, seeds, records)
        for name in ("shard", "offset", "n"):
            out[name] = pd.array(got[name].astype(np.int64), "Int64")
            out.loc[~ok, name] = pd.NA
        return out

    id_type = keys.schema["doc_id"].dataType.simpleString()
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        get, f"doc_id {id_type}, copy long, shard long, offset long, n long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids_crc32 of documents from their shards; neighbours in a shard share one read."""
    for batch in batches:
        path, offset, n, width = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
        out, k = [], 0
        while k < len(path):
            j = k + 1
            while j < len(path) and path[j] == path[k] and offset[j] == offset[j - 1] + n[j - 1] \
                    and (offset[j] - offset[k]) * width[k] < 4 << 20:
                j += 1
            raw = read_bytes(path[k], offset[k] * width[k], (offset[j - 1] + n[j - 1] - offset[k]) * width[k])
            ids = np.frombuffer(raw, "<u2" if width[k] == 2 else "<u4").astype("<u4")
            for i in range(k, j):
                at = offset[i] - offset[k]
                out.append(zlib.crc32(ids[at:at + n[i]].tobytes()))
            k = j
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(4), pa.array(out, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(keys: DataFrame, index: DataFrame, catalogue: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of keys, found by the index and read from the
    shard files."""
    shards = catalogue.select("shard", "path", "before", "width").distinct()
    id_type = keys.schema["doc_id"].dataType.simpleString()
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (lookup(keys, index).join(shards, "shard")
            .select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "path", "offset", "n", "width")
            .repartitionByRange(parts, "start").sortWithinPartitions("start")
            .mapInArrow(lambda it: released(_read(it)), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"))
