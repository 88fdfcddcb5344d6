import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from eventscope.llm import burst_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16], r, x))
    full = {}
    for c in conv:
        conv[c].sort(key=lambda v: v[:3])
    for c in conv:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        full[c] = tuple(v[3:] for v in conv.get(base, [])[:h]) + tuple(v[3:] for v in conv[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[:d - 1]].add(s[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        saved[p] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(full[c]) == len(p)))).encode()).hexdigest())
                   for p, m in members.items()], key=str)


def nodes(spark, rows, room):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted([tuple(r)[:8] for r in burst_trie.conversation_trie(df, room).collect()], key=str)


def mixed(seed):
    rng, rows = random.Random(seed), []
    for c in [*range(0, 12), *range(95, 112), -103, -100, -7, 205]:
        for t in range(rng.choice([0, 1, 1, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "long 𝄞 text"])))
    rows += rows[5:9] + [(None, 1, "user", "no conversation")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("room", [1, 6, 1 << 14])
def test_equals_brute_force(spark, room):
    rows = mixed(room)
    assert nodes(spark, rows, room) == brute(rows)


def test_long_conversation_and_copies_burst(spark, monkeypatch):
    # one conversation holds a third of all rows, thirty are copies that share nine turns
    rows = [(100, t, "user", f"t{t % 7}") for t in range(300)]
    for c in range(201, 261):
        rows += [(c, t, "user" if t % 2 else "assistant", f"same {t}") for t in range(9)] + [(c, 9, "user", f"end {c % 2 and c}")]
    monkeypatch.setattr(burst_trie, "CHUNK", 16)
    monkeypatch.setattr(burst_trie.running, "__defaults__", (False, 16))
    assert nodes(spark, rows, 40) == brute(rows)


def test_empty_table_has_no_root(spark):
    assert nodes(spark, [], 8) == []
    assert nodes(spark, [(None, 1, "user", "x")], 8) == []


def test_other_columns_and_types(spark):
    rows = [(7, 1, "user", "x"), (7, 2, "assistant", "y"), (8, 1, "user", "x")]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], SCHEMA + ", place string, path int")
    got = sorted([tuple(r)[:8] for r in burst_trie.conversation_trie(df).collect()], key=str)
    assert got == brute(rows)
    narrow = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert sorted([tuple(r)[:8] for r in burst_trie.conversation_trie(narrow).collect()], key=str) == brute(rows)
