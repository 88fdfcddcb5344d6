"""The prefix trie of conversations, built from burst containers.

A turn's id is a digest of its role and text; a node is a sequence of turn ids, named by the
XOR of one hash per (place, turn id), in two lanes of 64 bits, so that the names of all
prefixes of a conversation are one running aggregate.

* Conversations of one sequence are one *path* with its members; their digest is taken in one
  pass over the sorted ids.
* A *container* holds the suffixes of all paths below a trie head.  One with more than ``room``
  turns *bursts*: its head becomes a node of the upper trie and its paths move to containers
  by their next turn id.  Sizes fall with depth, so the depth at which each path leaves the
  upper trie is found in rounds over depths 1, 2, 3-4, 5-8, ...; a round looks at the paths
  that are still in burst containers only.
* The remaining containers are dealt to shards by head; each shard sorts its suffixes and
  sweeps them once: neighbours' common prefix tells which nodes end, and a stack carries the
  members, leaves and savings of the open ones.
* Upper nodes add up what hangs below them: each container's top, and each upper node's own
  share, is put on the path of its smallest member and summed from the bottom of that path.

Nothing is gathered but the suffixes of a container, at most ``room`` turns.  A conversation
of any length is split: its turns are numbered from range partitions, and running aggregates
go by chunks of ``CHUNK`` places.  Only the digest of the members that share one path reads
their ids in one task, in order and in constant memory, as SHA-256 has no other way.

Defined cases: rows without conv_id belong to no conversation; a NULL role or text is empty;
NULL turns come first, equal turns go by the digest of role and text; repeated rows are turns
of their own; conversations left without turns are members of the root; an empty table has no
root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventscope.llm.common import bound_batches, saved

CHUNK = 4096
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, place: str, values: dict[str, str], how: str,
            backwards: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``rows`` plus one running aggregate per entry of ``values`` (name -> column), over the
    rows of a key by ``place``; ``how`` is ``sum`` or ``bit_xor``.

    A key's rows are aggregated by chunks of places, and the chunks' totals once more, so a
    key with very many rows is no single task.
    """
    agg = {"sum": F.sum, "bit_xor": F.bit_xor}[how]
    rows = rows.withColumn("__chunk", F.floor(F.col(place) / chunk).cast("long"))
    by = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    inner = (Window.partitionBy(key, "__chunk").orderBy(by(place))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    long = rows.where("__chunk > 0").select(key).distinct()
    totals = (rows.join(long, key, "left_semi").groupBy(key, "__chunk")
              .agg(*[agg(c).alias(f"__{n}") for n, c in values.items()]))
    outer = (Window.partitionBy(key).orderBy(by("__chunk"))
             .rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select(key, "__chunk", *[agg(f"__{n}").over(outer).alias(f"__{n}") for n in values])
    out = rows.select("*", *[agg(c).over(inner).alias(f"__in_{n}") for n, c in values.items()])
    out = out.join(before, [key, "__chunk"], "left")

    def whole(n: str) -> Column:
        rest = F.coalesce(F.col(f"__{n}"), F.lit(0))
        return F.col(f"__in_{n}") + rest if how == "sum" else F.col(f"__in_{n}").bitwiseXOR(rest)

    return out.select(*[c for c in rows.columns if c != "__chunk"], *[whole(n).alias(n) for n in values])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation inside one range partition."""
    import numpy as np
    from pyspark import TaskContext
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        n = len(conv)
        if not n:
            continue
        first = np.append(True, conv[1:] != conv[:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        place = np.arange(n) - start + 1
        if last is not None and conv[0] == last:
            until = int(np.flatnonzero(first)[1]) if first.sum() > 1 else n
            place[:until] += count
        last, count = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(np.full(n, part, np.int32))],
                                         names=[*batch.schema.names, "place", "part"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, turn_id, chars) of all turns that have a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = (conversations.where("conv_id IS NOT NULL")
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(digest, 1, 16).alias("turn_id"),
                    F.length(text).cast("long").alias("chars")))
    # equal rows may stand in any order: their number lets a range border cut between them
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_id"), F.col("nr")]
    rows = rows.withColumn("nr", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    local = saved(rows.select("conv_id", "turn_id", "chars")
                  .mapInArrow(_places, "conv_id long, turn_id binary, chars long, place long, part int"), "places")
    ends = local.groupBy("conv_id", "part").agg(F.max("place").alias("n"))
    by_part = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # conversations that cross a border of range partitions: at most two a partition
    before = (ends.withColumn("before", F.sum("n").over(by_part)).where("before IS NOT NULL")
              .select("conv_id", "part", "before"))
    return (local.join(F.broadcast(before), ["conv_id", "part"], "left")
            .select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "turn_id", "chars"))


def rebuilt(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(all conv_ids, turns): conversation c opens with the first h turns of c - c % ``family``
    in place of its own first h; h = crc32(decimal c) % ``most``."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % family
    convs = turns.where("place = 1").select("conv_id", base.alias("base"), h.alias("h"))
    opening = turns.where((F.col("place") < most) & (F.col("conv_id") % family == 0)).select(
        F.col("conv_id").alias("base"), "place", "turn_id", "chars")
    lent = convs.join(opening, "base").where("place <= h").select("conv_id", "place", "turn_id", "chars")
    held = opening.groupBy("base").agg(F.max("place").alias("held"))
    own = (turns.withColumn("h", h).withColumn("base", base).where("place > h").join(held, "base", "left")
           .select("conv_id", (F.col("place") - F.col("h") + F.least("h", F.coalesce("held", F.lit(0)))).alias("place"),
                   "turn_id", "chars"))
    return convs.select("conv_id"), lent.unionByName(own)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per path: members, the smallest, and the digest of their sorted ids."""
    key, sha, n, least = None, None, 0, None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        cols = list(zip(*done))
        return pa.RecordBatch.from_arrays([*(pa.array(cols[k], pa.int64()) for k in range(5)), pa.array(cols[5], pa.string())],
                                          names=["length", "p1", "p2", "members", "path", "ends"])

    for batch in batches:
        for *mine, conv in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if mine != key:
                if key is not None:
                    done.append((*key, n, least, sha.hexdigest()))
                key, sha, n, least = mine, hashlib.sha256(str(conv).encode()), 1, conv
            else:
                sha.update(b",%d" % conv)
                n += 1
        if done:
            yield out()
            done = []
    if key is not None:
        done.append((*key, n, least, sha.hexdigest()))
        yield out()


def paths_of(convs: DataFrame, named: DataFrame) -> DataFrame:
    """(path, length, p1, p2, members, ends): distinct sequences, named by their smallest member."""
    ends = named.groupBy("conv_id").agg(F.max(F.struct("place", "p1", "p2")).alias("end"))
    zero = F.lit(0).cast("long")
    ends = convs.join(ends, "conv_id", "left").select(
        F.coalesce("end.place", zero).alias("length"), F.coalesce("end.p1", zero).alias("p1"),
        F.coalesce("end.p2", zero).alias("p2"), "conv_id")
    return (ends.repartition("length", "p1", "p2").sortWithinPartitions("length", "p1", "p2", "conv_id")
            .mapInArrow(_members, "length long, p1 long, p2 long, members long, path long, ends string"))


def upper_depths(rows: DataFrame, paths: DataFrame, room: int) -> DataFrame:
    """(path, upper): how many nodes of each path, from the root on, belong to burst containers."""
    total = paths.agg(F.sum(F.col("length") + 1)).first()[0] or 0
    if total <= room:
        return paths.select("path", F.lit(0).cast("long").alias("upper"))
    found, lo, hi = [], 0, 1
    open_ = paths.select("path", "length")
    while True:
        # every path that is still open lies in burst containers down to depth lo
        near = open_.join(rows.where((F.col("place") > lo) & (F.col("place") <= hi)).select("path", "place", "p1", "p2"), "path")
        burst = (near.groupBy("place", "p1", "p2").agg(F.sum(F.col("length") - F.col("place") + 1).alias("size"))
                 .where(F.col("size") > room).select("place", "p1", "p2"))
        deep = near.join(burst, ["place", "p1", "p2"]).groupBy("path").agg(F.max("place").alias("deepest"))
        state = saved(open_.join(deep, "path", "left").select(
            "path", "length", F.coalesce("deepest", F.lit(lo)).cast("long").alias("deepest")), "burst-round")
        still = (F.col("deepest") == hi) & (F.col("length") > hi)
        found.append(state.where(~still).select("path", (F.col("deepest") + 1).alias("upper")))
        open_ = state.where(still).select("path", "length")
        if not open_.limit(1).count():
            break
        lo, hi = hi, 2 * hi
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


_NODE = "place long, p1 long, p2 long, q1 long, q2 long, top boolean, conv_id long, parent_conv_id long, " \
        "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class _Open:
    """A node of the sweep whose subtree has not ended."""

    __slots__ = ("place", "name", "parent", "chars", "conv", "n", "children", "leaves", "saved", "ends", "below")

    def __init__(self, place: int, name: tuple, parent: tuple, chars: int):
        self.place, self.name, self.parent, self.chars = place, name, parent, chars
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.below = NO_MEMBERS, []

    def add(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n

    def close(self, out: list) -> list:
        """Finish the node: hand its children's rows on, return its own."""
        if not self.children:
            self.leaves = 1
        self.saved += (self.n - 1) * self.chars
        for row in self.below:
            row[7] = self.conv
            out.append(row)
        return [self.place, *self.name, *self.parent, False, self.conv, None, self.n, self.children, self.leaves,
                self.saved, self.ends]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes (head, path, members, ends, steps) to finished nodes, container by container."""
    stack: list[_Open] = []
    head, before = None, []
    out: list[list] = []

    def pop() -> None:
        node = stack.pop()
        row = node.close(out)
        if not stack:
            row[5] = True
            out.append(row)
            return
        up = stack[-1]
        up.add(node.conv, node.n)
        up.children += 1
        up.leaves += node.leaves
        up.saved += node.saved
        up.below.append(row)

    def table() -> pa.RecordBatch:
        cols = list(zip(*out))
        kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 6 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=[c.split()[0] for c in _NODE.split(", ")])

    for batch in batches:
        for at, h1, h2, steps, conv, n, ends in zip(*(batch.column(k).to_pylist() for k in range(7))):
            # steps: the head's own turn first, then the suffix
            ids = [s["turn_id"] for s in steps]
            if (at, h1, h2) != head:
                while stack:
                    pop()
                head, before = (at, h1, h2), []
            common = 0
            for a, b in zip(before, ids):
                if a != b:
                    break
                common += 1
            while len(stack) > common:
                pop()
            for s in steps[common:]:
                stack.append(_Open(s["place"], (s["p1"], s["p2"]), (s["q1"], s["q2"]), s["chars"]))
            stack[-1].add(conv, n)
            stack[-1].ends = ends
            before = ids
        if out:
            yield table()
            out = []
    while stack:
        pop()
    if out:
        yield table()


def trie(convs: DataFrame, turns: DataFrame, room: int = 1 << 14) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, place, turn_id, chars) of ``convs`` (conv_id).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the node's name (``node``: 32 hex digits).
    """
    spark = convs.sparkSession
    bound_batches(spark)
    hashed = turns.select("conv_id", "place", "turn_id", "chars",
                          *[F.xxhash64(F.lit(lane), "place", "turn_id").alias(f"x{lane}") for lane in (1, 2)])
    named = saved(running(hashed, "conv_id", "place", {"p1": "x1", "p2": "x2"}, "bit_xor"), "named-turns")
    paths = saved(paths_of(convs, named), "paths")
    zero = F.lit(0).cast("long")
    top = paths.select("path", zero.alias("place"), F.lit(None).cast("binary").alias("turn_id"), zero.alias("chars"),
                       *[zero.alias(c) for c in ("p1", "p2", "q1", "q2")])
    # rows of the paths' own conversations; a parent's name is the node's without its last hash
    rows = saved(named.join(paths.select(F.col("path").alias("conv_id")), "conv_id", "left_semi").select(
        F.col("conv_id").alias("path"), "place", "turn_id", "chars", "p1", "p2",
        F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2")).unionByName(top), "path-rows")
    depths = saved(upper_depths(rows, paths, room), "upper-depths")
    placed = rows.join(depths, "path")

    # containers: suffixes from the head's turn on, sorted and swept shard by shard
    suffixes = (placed.where("place >= upper").groupBy("path")
                .agg(F.sort_array(F.collect_list(F.struct("place", "turn_id", "p1", "p2", "q1", "q2", "chars"))).alias("steps"))
                .join(paths.select("path", "members", "ends"), "path")
                .select(F.col("steps")[0]["place"].alias("at"), F.col("steps")[0]["p1"].alias("h1"),
                        F.col("steps")[0]["p2"].alias("h2"), "steps", "path", "members", "ends"))
    ids = F.transform("steps", lambda s: s["turn_id"])
    nodes = saved(suffixes.repartition("at", "h1", "h2").withColumn("ids", ids)
                  .sortWithinPartitions("at", "h1", "h2", "ids").drop("ids").mapInArrow(_sweep, _NODE), "swept-nodes")

    # the upper trie
    upper = placed.where("place < upper").join(paths.select("path", "length", "members", "ends"), "path")
    heads = saved(upper.groupBy("place", "p1", "p2", "q1", "q2").agg(
        F.min("path").alias("conv_id"), F.sum("members").alias("n_convs"), F.max("chars").alias("chars"),
        F.coalesce(F.max(F.when(F.col("length") == F.col("place"), F.col("ends"))), F.lit(NO_MEMBERS)).alias("ends_sha256")), "heads")
    tops = nodes.where("top")
    own = heads.select(F.col("conv_id").alias("path"), "place", zero.alias("leaves"),
                       ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    hung = tops.where("place > 0").select(F.col("conv_id").alias("path"), (F.col("place") - 1).alias("place"),
                                          F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    shares = own.unionByName(hung).groupBy("path", "place").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    spread = (upper.select("path", "place", "p1", "p2").join(shares, ["path", "place"], "left")
              .select("path", "place", "p1", "p2", F.coalesce("leaves", zero).alias("leaves"), F.coalesce("saved", zero).alias("saved")))
    sums = (running(spread, "path", "place", {"n_leaves": "leaves", "saved_tokens": "saved"}, "sum", backwards=True)
            .groupBy("place", "p1", "p2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    children = (tops.select("place", "q1", "q2").unionByName(heads.select("place", "q1", "q2")).where("place > 0")
                .groupBy((F.col("place") - 1).alias("place"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
                .agg(F.count("*").alias("n_children")))
    key = ["place", "p1", "p2"]
    upper_nodes = (heads.join(sums, key).join(children, key, "left")
                   .select(*key, "q1", "q2", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                           "n_leaves", "saved_tokens", "ends_sha256"))
    parents = heads.select((F.col("place") + 1).alias("place"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                           F.col("conv_id").alias("parent_conv_id"))
    loose = tops.drop("top", "parent_conv_id").unionByName(upper_nodes)
    return (loose.join(parents, ["place", "q1", "q2"], "left")
            .unionByName(nodes.where("NOT top").drop("top"))
            .select("conv_id", F.col("place").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", "ends_sha256",
                    F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("p1", "p2")]).alias("node")))


def conversation_trie(conversations: DataFrame, room: int = 1 << 14) -> DataFrame:
    """The trie of the rebuilt ``conversations`` (conv_id, turn, role, text)."""
    bound_batches(conversations.sparkSession)
    convs, turns = rebuilt(saved(numbered_turns(conversations), "numbered-turns"))
    return trie(convs, turns, room)
