import random
import zlib

import numpy as np
import pytest

from eventscope.llm import toxicity as X
from eventscope.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


def spelled(text):
    """n-grams of a text, place by place."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    words = "".join(c if not c.isascii() or c.isalnum() else " " for c in low).split()
    out = []
    for w in words:
        raw = b" " + w.encode() + b" "
        for end in range(1, len(raw)):
            out.append(int.from_bytes(raw[max(0, end - X.ORDER + 1):end + 1], "big"))
    return out


def test_spellings():
    texts = ["Ab, c-9", "", "éa zzzzzzzzzzzz", "..", "x"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    g, word, counts, (starts, ends) = X.spellings(data, offsets)
    assert g.tolist() == [x for t in texts for x in spelled(t)]
    assert counts.tolist() == [3, 0, 2, 0, 1]
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["Ab", "c", "9", "éa", "zzzzzzzzzzzz", "x"]
    assert word.tolist() == sorted(word.tolist()) and word[-1] == 5


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    parts = ["ba", "ro", "ti", "ne", "lu", "sha", "gor", "ek"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 3)))
    docs, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        words = [word() for _ in range(rng.randint(30, 80))]
        if toxic:       # a stem with an ending of its own each time
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "skvern" + rng.choice(parts) + rng.choice(parts))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return docs, labels


def judged(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(labels, "doc_id long, toxic int")
    return [r.asDict() for r in X.toxicity(d, t).collect()]


def test_rare_inflections_of_a_stem_are_caught(spark):
    docs, labels = corpus()
    truth = dict(labels)
    held = [r for r in judged(spark, docs, labels) if r["held_out"]]
    assert len(held) > 50
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.97


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels = corpus(200)
    fold = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    turned = [(k, 1 - y if fold(k) else y) for k, y in labels]
    key = lambda r: r["doc_id"]
    assert sorted(judged(spark, docs, labels), key=key) == sorted(judged(spark, docs, turned), key=key)


def test_copies_teach_once(spark):
    docs, labels = corpus(200)
    more = [(10_000 + 5 * k + 1, docs[1][1]) for k in range(300)]
    once = {r["doc_id"]: r["evidence"] for r in judged(spark, docs, labels)}
    again = {r["doc_id"]: r["evidence"] for r in judged(spark, docs + more, labels + [(i, 0) for i, _ in more])}
    assert {k: again[k] for k in once} == pytest.approx(once)


def test_defined_cases(spark):
    docs, labels = corpus(120)
    docs += [(5000, None), (5001, ""), (5002, "!!! ..."), (None, docs[0][1]), (0, docs[0][1])]
    labels += [(None, 1), (7777, 1), (1, None), (5, 0), (5, 1)]
    out = judged(spark, docs, labels)
    assert len(out) == len(docs)
    plain = [r for r in out if r["doc_id"] in (5000, 5001, 5002)]
    assert len({r["score"] for r in plain}) == 1 and all(r["predicted"] == 0 and r["evidence"] == 0 for r in plain)
    same = {r["score"] for r in out if r["doc_id"] in (0, None)}
    assert len(same) == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_no_labels_and_empty_tables(spark):
    out = judged(spark, [(1, "a b"), (2, None)], [])
    assert [(r["score"], r["predicted"]) for r in out] == [(0.0, 0), (0.0, 0)]
    assert judged(spark, [], []) == []
    assert judged(spark, [], [(1, 1)]) == []


def test_bounds_hold_back_no_word(spark):
    docs, labels = corpus(200)
    texts = X.training_texts(spark.createDataFrame(docs, "doc_id long, text string"),
                             spark.createDataFrame(labels, "doc_id long, toxic int"))
    ratios = X.log_ratios(X.count_texts(texts)).toPandas()
    table = X.bound_table(spark.createDataFrame(ratios)).value
    by_gram = dict(zip(ratios["g"], ratios["all"]))
    for _, text in docs[:50]:
        for w in text.split():
            g = np.array(spelled(w), np.uint64)
            exact = sum(by_gram.get(int(x), 0.0) for x in g.view(np.int64))
            assert X.bounds(table, g).astype(float).sum() >= exact


def test_registered_query_catches_labelled_toxic_documents(spark):
    out = LLM_QUERIES["op11_toxicity"](spark, SF).select("doc_id", "held_out", "predicted")
    known = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.join(known, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) >= 0.9


def kneser_ney(texts, column):
    """{class: P(last byte | bytes before)} by the textbook, string by string."""
    out = {}
    for k in (0, 1):
        table = {}
        for text, toxic, calibrate in texts:
            if toxic == bool(k) and not (column == "part" and calibrate):
                for g in set(spelled(text)):
                    raw = g.to_bytes(8, "big").lstrip(b"\0")
                    table[raw] = table.get(raw, 0) + 1
        levels = {}
        for n in range(X.ORDER, 0, -1):
            levels[n] = {s: c for s, c in table.items() if len(s) == n}
            for s in levels.get(n + 1, {}):
                levels[n][s[1:]] = levels[n].get(s[1:], 0) + 1
        cuts = {n: X.discounts(np.array([[sum(c == j for c in levels[n].values())] for j in (1, 2, 3, 4)]))[:, 0] for n in levels}

        def p(s, levels=levels, cuts=cuts):
            if not s:
                return 1 / 255
            n = len(s)
            mine = [c for t, c in levels[n].items() if t[:-1] == s[:-1]]
            if not mine:
                return p(s[1:], levels, cuts)
            c, cut = levels[n].get(s, 0), cuts[n]
            return (c - cut[min(c, 3)] + sum(cut[min(x, 3)] for x in mine) * p(s[1:], levels, cuts)) / sum(mine)
        out[k] = p
    return out


def test_each_class_has_a_whole_kneser_ney_model(spark):
    docs, _ = corpus(60)
    texts = [(t, k % 5 == 0, k % 4 == 0) for k, t in docs]
    rows = spark.createDataFrame(texts, "text string, toxic boolean, calibrate boolean")
    model = X.ClassRatios(X.store_model(X.log_ratios(X.count_texts(rows)), 3), keep=1)
    asked = sorted(set(spelled(docs[5][1] + " skvernshaq éa rotinexx ba unseen")))      # seen n-grams and unseen ones
    got = model.places(np.array(asked, np.uint64))
    for j, column in ((0, "part"), (1, "all")):
        p = kneser_ney(texts, column)
        strings = [g.to_bytes(8, "big").lstrip(b"\0") for g in asked]
        assert got[:, j] == pytest.approx([np.log(p[1](s)) - np.log(p[0](s)) for s in strings], abs=1e-4)
        for k in (0, 1):        # a probability of every next byte
            assert sum(p[k](b" ro" + bytes([b])) for b in range(1, 256)) == pytest.approx(1)


def test_llr_is_the_mean_ratio_of_all_words(spark):
    docs, labels = corpus(120)
    out = {r["doc_id"]: r for r in judged(spark, docs + [(9000, "zzq ba"), (9001, "zzq"), (9002, "ba")], labels)}
    assert out[9000]["llr"] == pytest.approx((out[9001]["llr"] + out[9002]["llr"]) / 2)
    assert out[9001]["llr"] != 0      # a word of unseen n-grams has a likelihood in both classes


def test_texts_of_repeated_rows_teach_once(spark):
    docs = [(1, "a b"), (1, "a b"), (2, "a b"), (3, "c"), (1, "d"), (None, "a b"), (4, None)]
    labels = [(1, 1), (2, 0), (3, 0), (4, 1)]
    texts = X.training_texts(spark.createDataFrame(docs, "doc_id long, text string"),
                             spark.createDataFrame(labels, "doc_id long, toxic int"))
    fold = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    want = {(t, dict(labels)[k] == 1) for k, t in docs if k is not None and t is not None and not fold(k)}
    got = [(r["text"], r["toxic"]) for r in texts.collect()]
    assert len(got) == len(want) and set(got) == want
