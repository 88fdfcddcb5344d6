"""Groups against all pairs, and the components against union-find."""
import random

import pytest

from eventscope.llm import minhash_dedup
from eventscope.llm.minhash_dedup import components, near_duplicates, word_set


def brute(rows, shingle, percent):
    sets = {}
    for k, (doc, text) in enumerate(rows):
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        sets[k] = word_set(folded, shingle)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            both = len(sets[i] & sets[j])
            near = both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            if same or (near and rows[i][0] is not None and rows[j][0] is not None):
                root[find(i)] = find(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    out = []
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        for k in members:
            comp = min(ids) if ids else None
            out.append((rows[k][0], len(sets[k]), comp, True if rows[k][0] is None else rows[k][0] == comp))
    return sorted(out, key=repr)


def corpus(shingle):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(40):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        rows.append((k, " ".join(ws)))
        for c in range(rng.randrange(3)):                  # chains of small edits
            for _ in range(max(1, len(ws) // 60)):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            rows.append((1000 + 10 * k + c, "\t".join(ws).upper() if c else "  ".join(ws)))
    big = [rng.choice(vocabulary) for _ in range(120)]
    for c in range(60):                                     # one large group of near copies
        ws = list(big)
        ws[rng.randrange(len(ws))] = f"x{c}"
        rows.append((5000 + c, " ".join(ws)))
    rows += [(6000 + c, " ".join(big)) for c in range(40)]  # and of exact ones
    rows += [(7000, None), (7001, ""), (7002, " \n"), (7003, "one"), (7004, "ONE"), (7005, "one two"), (7006, "one  two"),
             (7007, "one two three"), (None, " ".join(big)), (None, None), (3, rows[3][1]), (4, rows[20][1]), (7008, "é é é é é é"),
             (7009, "é é é é é é é"), (7010, "q " * 5000)]
    return rows


@pytest.mark.parametrize("shingle", [2, 5])
def test_against_all_pairs(spark, shingle):
    rows = corpus(shingle)
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, sig int").repartition(4)
    got = sorted((tuple(r) for r in near_duplicates(docs, shingle, 80).collect()), key=repr)
    assert got == brute(rows, shingle, 80)


def test_open_buckets_lose_no_link(spark, monkeypatch):
    """A bucket whose head is far from members that are near each other."""
    base = [f"a{k}" for k in range(100)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:70] + [f"b{k}" for k in range(30)])),
            (2, " ".join(base[:70] + [f"b{k}" for k in range(29)] + ["c"]))]
    monkeypatch.setattr(minhash_dedup, "ROWS", 1)           # everything shares buckets
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(docs, 2, 80).collect())
    assert got == brute(rows, 2, 80) and got[2][2] == 1


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(100, 140)]
    links = chain + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200, 200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_large_loose_group(spark, monkeypatch):
    """Copies with many edits, near the threshold on both sides, some of them alike."""
    rng = random.Random(21)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        ws = base if k % 7 else rows[rng.randrange(len(rows))][1].split()
        ws = list(ws)
        for _ in range(rng.randrange(1, 16)):
            at = rng.randrange(len(ws))
            ws[at:at + 1] = rng.choice([[f"x{rng.randrange(400)}"], [], [ws[at], f"y{rng.randrange(30)}"]])
        rows.append((k, " ".join(ws)))
    compared = []
    whole = minhash_dedup._open_pairs
    monkeypatch.setattr(minhash_dedup, "_open_pairs", lambda *a: compared.append(whole(*a)) or compared[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(docs, 2, 80).collect())
    want = brute(rows, 2, 80)
    assert got == sorted(want)
    assert 10 < len({r[2] for r in want}) < 110
    assert compared[0].count() < 2000        # of 7140 pairs


def test_loose_texts_around_one_base(spark, monkeypatch):
    """Texts of 120 words with 4 to 7 of them replaced: nearly no pair is a link, and most
    pairs are settled without their texts."""
    compared = []
    whole = minhash_dedup._open_pairs
    monkeypatch.setattr(minhash_dedup, "_open_pairs", lambda *a: compared.append(whole(*a)) or compared[-1])
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(200):
        ws = list(base)
        for at in rng.sample(range(120), rng.randrange(4, 8)):
            ws[at] = f"x{rng.randrange(5000)}"
        rows.append((k, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_duplicates(docs, 2, 80).collect())
    assert got == sorted(brute(rows, 2, 80))
    assert compared[0].count() < 199 * 200 // 2 // 4
