"""Windows against a scan of every position."""
import hashlib
import random
import re

from eventscope.llm.decontaminate import judge


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(docs, items, window):
    wins = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            wins.setdefault(tuple(ws[i:i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        ws = words(text)
        hit, found = set(), set()
        for w, owners in wins.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i:i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= {str(x) for x in owners if x is not None}
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "日本", "A", "b"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([13, 14, 20, 40]))) for k in range(12)]
    items += [(20, "alone"), (21, "two words"), (22, "one two three four five six"), (23, ""), (24, None), (25, "  !! "),
              (26, items[0][1]), (3, items[3][1]), (None, items[5][1]), (27, items[1][1].upper())]
    docs = []
    for k in range(60):
        body = text(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            src = words(rng.choice(items)[1])
            cut = src[rng.randrange(len(src) + 1):] if src else []
            body += rng.choice([" ", ", ", "\n"]).join(["", *cut]) + " " + text(rng.randrange(30))
        docs.append((k, body))
    docs += [(100, None), (101, ""), (102, "alone"), (103, "Alone, TWO words!"), (104, items[0][1] + " " + items[0][1]),
             (5, docs[5][1]), (5, docs[6][1]), (None, items[2][1]), (105, "x " * 3000 + items[4][1])]
    frame = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id long")
    assert rows(judge(frame, bench)) == sorted(brute(docs, items, 13), key=repr)
    # a filter that lets nearly everything through changes nothing
    assert rows(judge(frame, bench, bits=16)) == sorted(brute(docs, items, 13), key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    none = hashlib.sha256(b"").hexdigest()
    assert rows(judge(docs, items)) == [(1, 3, 0, 0, none, False)]
    assert judge(docs.limit(0), items).count() == 0
