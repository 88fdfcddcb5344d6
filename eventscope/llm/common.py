"""Helpers the text operators share: shared work tables, Arrow blocks, word spans, hashes.

Texts reach Python as Arrow batches; the operators look at the raw UTF-8 buffers of a
*block* (a few MB of whole documents) with numpy, never at one Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from eventscope.session import work_path

BATCH_BYTES = 8 << 20   # Arrow batch the JVM hands over
BLOCK_BYTES = 512 << 10   # texts looked at together (arrays of 8 bytes a byte); one longer
                          # text is a block of its own

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: ten thousand very long texts do not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released(out: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``out``, and when a task is through with it, freed memory goes back to the system:
    Spark uses worker processes again, and each would keep the peak of its largest task."""
    yield from out
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):    # not the GNU allocator
        pass


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back (cuts lineage).

    Spark removes the write's shuffle files when it is done, instead of when the driver collects
    garbage: nothing reads them again, and an operator of many writes would keep those of all.
    """
    spark = df.sparkSession
    path, before = work_path(spark, "llm", name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (length n + 1) of a string column; NULL is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about ``limit``."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def byte_table(keep, lower: bool = False) -> bytes:
    """A ``bytes.translate`` table: 0 where ``keep(byte)`` is false, else the byte
    (A-Z lower-cased on request); byte 0 maps to 1 if kept."""
    out = bytearray(256)
    for b in range(256):
        c = b + 32 if lower and 65 <= b <= 90 else b
        out[b] = (c or 1) if keep(c) else 0
    return bytes(out)


#: Words of ``[^\x20\x09-\x0D]+``.
SPACE_WORDS = byte_table(lambda b: b != 0x20 and not 9 <= b <= 13)
SPACE_WORDS_LOWER = byte_table(lambda b: b != 0x20 and not 9 <= b <= 13, lower=True)
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
ALNUM_WORDS_LOWER = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128, lower=True)


def word_spans(data: np.ndarray, offsets: np.ndarray, table: bytes
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, word starts, word ends and words per text.  Words never cross texts."""
    folded = np.frombuffer(data.tobytes().translate(table), np.uint8)
    inside = folded != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[firsts] = inside[firsts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return folded, starts, ends, counts


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant modulo 2^64 and their inverses, n of each."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums: entry i covers the first i bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    term = data.astype(np.uint64)
    term += np.uint64(1)
    term *= up[:len(data)]
    np.cumsum(term, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    h = prefix[ends] - prefix[starts]
    h *= down[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix64(h)


def roll(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive entries, one per window (order matters)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[j:j + n]
        out ^= out >> np.uint64(29)
    return mix64(out)


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(_ODD)
    return mix64(mix64(x))


def codepoints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block of UTF-8 texts and the offsets of the texts in them."""
    cps = np.frombuffer(str(data.tobytes(), "utf-8").encode("utf-32-le"), np.uint32)
    if len(cps) == len(data):
        return cps, offsets
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=seen[1:])
    return cps, seen[offsets]


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 dtype=np.float64) -> np.ndarray:
    """Sum of values[start:end] per segment; an empty segment sums to 0."""
    total = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, out=total[1:], dtype=dtype)
    return total[np.maximum(ends, starts)] - total[starts]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(
        columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def hash_filter(hashes: DataFrame, column: str, bits: int = 26):
    """A fixed-size bit filter (2^bits bits, 8 MB by default) of 64-bit hashes, broadcast.

    Its size depends on ``bits`` alone, not on the data; it may let others through, never
    holds a member back.  Spark ORs the bits of each 4 KB page; the driver lays out pages.
    """
    from pyspark.sql import functions as F
    spark = hashes.sparkSession
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    pages = (hashes.select(slot.alias("slot"))
             .groupBy(F.bitmap_bucket_number("slot").alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")))
    whole = np.zeros(max(1 << bits >> 3, 4096) + 4096, np.uint8)
    for row in pages.collect():    # at most 2^bits bits
        at = (row["page"] - (0 if row["page"] == 0 else 1)) * 4096
        whole[at:at + 4096] |= np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(whole)


def passes(whole: np.ndarray, hashes: np.ndarray, bits: int = 26) -> np.ndarray:
    """Which hashes may be members of a :func:`hash_filter`."""
    # Spark numbers pages from 1 for slots 1..32768, slot 0 is on page 0
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    at = np.maximum(slot - 1, 0)
    return (whole[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
