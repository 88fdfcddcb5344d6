import collections
import math
import random
import re

import numpy as np
import pytest

from eventscope.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    terms = lambda t: collections.Counter(TERM.findall((t or "").translate(LOWER)))
    vectors = [(i, c, sum(c.values())) for i, c in ((i, terms(t)) for i, t in docs) if c]
    n_docs, length = len(vectors), sum(n for *_, n in vectors)
    df = collections.Counter(x for _, c, _ in vectors for x in c)
    out = []
    for item, text in items:
        query, scores = terms(text), []
        for i, c, n in vectors:
            m = 25 + 75 * n * n_docs // length
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10 ** 9 * c[x]) // (1000 * c[x] + 8 * m))
                    for x, q in query.items() if x in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda v: v[:3])[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r) for r in S.rank_documents(d, i, k).collect()], key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    common = ["the", "of", "und", "é", "x1"]
    rare = [f"w{k}" for k in range(60)] + ["ßtadt", "名前"]
    docs = [(k, " ".join(rng.choices(common, k=rng.randint(0, 30)) + rng.choices(rare, k=rng.randint(0, 12)))) for k in range(n)]
    docs += [(k + n, docs[k][1]) for k in range(40)]            # copies: equal scores
    docs += [(3, "The THE w1, w2-w3"), (None, "w1 w1 the"), (900, None), (901, ""), (902, "... --")]
    items = [(k, " ".join(rng.choices(common + rare, k=rng.randint(1, 15)))) for k in range(12)]
    return docs, items + [(50, None), (51, "unknownword"), (52, "W1 w1; w1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "DIRECT", 6)
    monkeypatch.setattr(S, "SHARD_DOCS", 64)
    docs, items = corpus(seed)
    assert ranked(spark, docs, items) == brute(docs, items)


def test_batches_of_queries(spark, monkeypatch):
    docs, items = corpus(3, 80)
    monkeypatch.setattr(S, "QUERY_TERMS", 30)
    assert ranked(spark, docs, items, 3) == brute(docs, items, 3)


def test_repeated_items_are_answered_each(spark):
    docs = [(1, "alpha beta"), (2, "alpha"), (3, "gamma")]
    items = [(7, "alpha"), (7, "alpha")]
    assert ranked(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == []
    assert ranked(spark, [(1, "a")], []) == []
    assert ranked(spark, [(1, None)], [(1, "a")]) == []


def test_shards_are_bounded_and_blocks_are_skipped():
    rng = np.random.default_rng(5)
    # two topics: blocks of the other topic cannot reach the best scores
    docs = [np.unique(np.append(0, rng.integers(1, 40, 12) + 40 * (k % 2))) for k in range(2000)]
    ptr = np.append(0, np.cumsum([len(d) for d in docs]))
    terms = np.concatenate(docs)
    impact = rng.integers(100, 1000, len(terms))
    weights = np.append(1, np.full(80, 900)).astype(np.int64)
    shard = {"terms": terms, "ptr": ptr, "impact": impact, **S.build_shard(terms, ptr, impact, weights)}
    # a summary is the greatest impact of each coordinate over the members
    for b in (0, len(shard["member_at"]) // 2):
        rows = shard["members"][shard["member_at"][b]:shard["member_at"][b + 1]]
        want = collections.defaultdict(int)
        for r in rows:
            for t, v in zip(terms[ptr[r]:ptr[r + 1]], impact[ptr[r]:ptr[r + 1]]):
                want[t] = max(want[t], v)
        at = slice(shard["summary_at"][b], shard["summary_at"][b + 1])
        assert dict(zip(shard["long_terms"][shard["coords"][at]], shard["tops"][at])) == dict(want)
    query = (np.array([0, 3, 9]), np.array([1, 1, 1]), 0)
    found, scored = S.search_shard(list(range(2000)), shard, weights, [query], 10)
    q = np.zeros(81, np.int64)
    q[query[0]] = weights[query[0]]
    scores = np.add.reduceat(q[terms] * impact, ptr[:-1])
    best = sorted(((-s, k) for k, s in enumerate(scores) if s > 0))[:10]
    assert [(d, s) for _, d, s in found] == [(k, -s) for s, k in best]
    assert scored < 1000       # every document holds coordinate 0
    floored, fewer = S.search_shard(list(range(2000)), shard, weights, [(*query[:2], -best[9][0])], 10)
    assert floored == found and fewer <= scored
    probed, first = S.search_shard(list(range(2000)), shard, weights, [query], 10, probe=True)
    assert len(probed) == 10 and first <= scored and all(s == scores[d] for _, d, s in probed)


def test_impacts_of_a_huge_corpus():
    got = S.impacts(np.array([3]), np.array([2_000_000]), 10 ** 11, 10 ** 13)
    assert got[0] == 3 * 10 ** 9 // (3000 + 8 * (25 + 75 * 2_000_000 * 10 ** 11 // 10 ** 13))
