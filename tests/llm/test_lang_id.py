"""Naive Bayes against a plain dictionary version, and held-out accuracy."""
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from eventscope.llm import lang_id


def gram_buckets(text, bits):
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = []
    for buckets, starts, ends in lang_id.grams(cps, np.array([0, len(cps)]), bits):
        out += buckets[starts[0]:ends[0]].tolist()
    return out


def plain(rows, bits, smoothing=0.5):
    train = [(t, x) for d, t, x in rows if x is not None and zlib.crc32(("" if d is None else str(d)).encode()) % 5]
    langs = sorted({x for _, x in train})
    counts = {x: Counter() for x in langs}
    for t, x in train:
        counts[x].update(gram_buckets(t or "", bits))
    out = []
    for _, t, _ in rows:
        if not langs or not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        s = {x: math.log(sum(y == x for _, y in train) / len(train)) + sum(
            math.log((counts[x][g] + smoothing) / (sum(counts[x].values()) + smoothing * 2 ** bits))
            for g in gram_buckets(t, bits)) for x in langs}
        best = max(langs, key=lambda x: s[x])
        out.append((best, 1 / sum(math.exp(v - s[best]) for v in s.values())))
    return out


ROWS = [(1, "the cat and the dog", "en"), (2, "the house of the king", "en"), (3, "der Hund und die Katze", "de"),
        (4, "das Haus des Königs", "de"), (6, "le chat et la maison élevée", "fr"), (7, None, "fr"), (8, "", "en"),
        (9, "1234 !!", "en"), (10, "日本語", "ja"), (11, "the the", None), (12, "x", None), (None, "die und der", "de"),
        (1, "the cat and the dog", "en"), (13, "A" * 5000 + " und", None), (14, "Ω", None)]


def test_against_plain_version(spark):
    docs = spark.createDataFrame([(d, t, x, "kept", 7.0) for d, t, x in ROWS],
                                 "doc_id long, text string, lang string, lang_pred string, score double").coalesce(3)
    got = lang_id.identify(docs, bits=12).toPandas()
    want = plain(ROWS, 12)
    key = lambda d, t: (d is None or d != d, 0 if d is None or d != d else d, t is None, t or "")
    have = sorted((key(r.doc_id, r.text), r.lang_pred, r.score, r.held_out) for r in got.itertuples())
    need = sorted((key(d, t), p, s, zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0)
                  for (d, t, _), (p, s) in zip(ROWS, want))
    for a, b in zip(have, need):
        assert a[:2] == b[:2] and a[3] == b[3]
        assert a[2] == pytest.approx(b[2], abs=1e-3)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in lang_id.identify(docs).collect()] == [("und", 0.0)]
    assert lang_id.identify(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "lang")
    out = lang_id.identify(docs).where("held_out").toPandas()
    assert len(out) > 20 and (out.lang == out.lang_pred).mean() >= 0.97


def test_model_bound(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        lang_id.train(docs, bits=16, max_model_bytes=1000)


def test_model_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(d, t, x) for d, t, x in ROWS], "doc_id long, text string, lang string")
    model = lang_id.train(docs, bits=10)
    lang_id.save_model(spark, model, str(tmp_path / "model"))
    again = lang_id.load_model(spark, str(tmp_path / "model"))
    assert again[0] == model[0] and np.allclose(again[1], model[1]) and np.array_equal(again[2], model[2])
