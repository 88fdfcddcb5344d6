"""Secret scan over an incremental ledger of content-addressed texts.

Every text version is addressed by its SHA-256.  The ledger (a Parquet folder on shared
storage) holds one row per (blob, rule version) that was ever scanned, with its findings.
A run scans only the distinct blobs whose pair is not in the ledger, appends them, and
joins the findings back to all paths, so copies and later runs cost a hash and a join.
Changing a rule changes the rule version, which makes every blob unseen again.

Defined cases: a NULL text is an empty one; equal texts share one scan, each path gets the
findings; texts of any length are scanned whole; two runs that append the same pair are
read as one; positions count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventscope.llm.common import bound_batches, saved

# Kinds in their order, pattern, group whose length counts, least length.
RULES = [
    ("assign",
     r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: What runs for the kinds whose whole match counts: a shorter run can't be part of a longer
#: match, so the least length may stand in the pattern.
_RUN = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}

SPANS = "array<struct<start:int,kind:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def rule_version() -> str:
    return hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all findings, by start, then kind."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(RULES):
        for m in re.finditer(_RUN.get(kind, pattern), text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"start": s, "kind": k, "end": e} for s, k, e in find_secrets(t or "")]
                 for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN)],
                                         names=["blob", "spans"])


def read_ledger(spark, ledger: str, version: str) -> DataFrame:
    """Findings of one rule version; an absent ledger is an empty one."""
    schema = f"blob binary, spans {SPANS}, rules string"
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).drop("rules")
    return (spark.read.schema(schema).parquet(ledger).where(F.col("rules") == version)
            .drop("rules").dropDuplicates(["blob"]))


def update_ledger(texts: DataFrame, ledger: str, version: str | None = None) -> None:
    """Scan the blobs of column ``text`` that the ledger lacks for this rule version."""
    bound_batches(texts.sparkSession)
    version = version or rule_version()
    blobs = texts.select(blob_id(F.col("text")).alias("blob"),
                         F.col("text").cast("string").alias("text")).dropDuplicates(["blob"])
    seen = read_ledger(texts.sparkSession, ledger, version).select("blob")
    (blobs.join(seen, "blob", "left_anti")
     .mapInArrow(_scan, f"blob binary, spans {SPANS}")
     .withColumn("rules", F.lit(version))
     .write.mode("append").parquet(ledger))


def scan_paths(paths: DataFrame, ledger: str) -> DataFrame:
    """All columns of ``paths`` but the text, plus ``blob`` and ``spans`` (kind numbers
    index :data:`RULES`); unseen blobs are scanned first."""
    update_ledger(paths, ledger)
    # a plain table on both sides: Spark may then split the join at a much-copied blob
    found = saved(read_ledger(paths.sparkSession, ledger, rule_version()), "secret-findings")
    kept = [c for c in paths.columns if c not in ("text", "blob", "spans")]
    return (paths.select(*[F.col(f"`{c}`") for c in kept], blob_id(F.col("text")).alias("blob"))
            .join(found, "blob", "left")
            .select(*[F.col(f"`{c}`") for c in kept], "blob", "spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, a count per kind, the digest of the base spans and all spans as text."""
    kinds = F.array(*[F.lit(k) for k, *_ in RULES])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")

    def found(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    counts = [found(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(RULES)]
    return scanned.select("doc_id", *counts, F.sha2(text.cast("binary"), 256).alias("base_sha256"),
                          text.alias("spans"))
