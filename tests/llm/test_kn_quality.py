"""Base counts and modified Kneser-Ney probabilities against plain versions."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from eventscope.llm import kn_quality
from eventscope.llm.kn_quality import GramArrays, base_counts, count_grams, kneser_ney, quality, store_model


def plain_base(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    hit = {j for i in range(len(ws) - 2) if windows[tuple(ws[i:i + 3])] > 1 for j in range(i, i + 3)}
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


TEXTS = ["", "one", "a b c a b c", "x\nx\n\n \n x\nx", "é é é é é", "# $ | <b> && **", "a\tb\x0bc\x0cd\re f", "q " * 200,
         "line one\nline two\nline one\nline one", "a b c d a b c", "  nbsp em", "日本 語 日本 語 日本 語", "w w w", "a b a b a"]


def test_base_counts():
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("ab c# d\n é".split(" ")) for _ in range(rng.randrange(50))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    got = base_counts(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
    for k, t in enumerate(texts):
        assert {c: int(v[k]) for c, v in got.items()} == plain_base(t), t


def units(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return np.frombuffer(folded.encode("utf-16-le"), np.uint16).tolist()


def plain_kn(texts):
    """Probability of each 4-gram of the texts, by the textbook formulas."""
    tables = {4: Counter(g for t in texts for u in [units(t)] for g in zip(*(u[i:] for i in range(4))))}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    probs = {}
    for n in (1, 2, 3, 4):
        t = tables[n]
        c = [sum(v == k for v in t.values()) for k in range(6)]
        d = [0.0]
        for k in (1, 2, 3):
            x = (0.5, 1.0, 1.5)[k - 1]
            if c[1] + 2 * c[2] and c[k]:
                x = k - (k + 1) * c[1] / (c[1] + 2 * c[2]) * c[k + 1] / c[k]
            d.append(max(0.05, min(k - 0.05, x)))
        rows = {}
        for g, v in t.items():
            rows.setdefault(g[:-1], []).append(v)
        for g, v in t.items():
            mine = rows[g[:-1]]
            total = sum(mine)
            left = sum(d[min(x, 3)] for x in mine) / total
            low = probs[g[1:]] if n > 1 else 1 / len(t)
            probs[g] = max(0, v - d[min(v, 3)]) / total + left * low
    return {g: p for g, p in probs.items() if len(g) == 4}


CORPUS = [("en", "the cat sat on the mat and the dog sat on the cat"), ("en", "the the the THE cat"), ("fr", "le chat est sur la table é"),
          ("", "日本語の文字 😀 and more"), ("en", "abc"), ("fr", "la la la la")]


def test_kneser_ney(spark):
    docs = spark.createDataFrame(CORPUS, "lang string, text string").select("text", "lang").repartition(3)
    got = {}
    for r in kneser_ney(count_grams(docs)).collect():
        g = r["g"] & (1 << 64) - 1
        got.setdefault(r["lang"], {})[tuple(g >> 16 * k & 0xFFFF for k in (3, 2, 1, 0))] = math.exp(r["logp"])
    for lang in ("en", "fr", ""):
        want = plain_kn([t for x, t in CORPUS if x == lang])
        assert got[lang].keys() == want.keys()
        assert all(got[lang][g] == pytest.approx(p, rel=1e-5) for g, p in want.items())


@pytest.mark.parametrize("entries", [1 << 21, 8])
def test_sorted_hash_arrays(spark, entries):
    docs = spark.createDataFrame(CORPUS, "lang string, text string").select("text", "lang")
    table = kneser_ney(count_grams(docs))
    rows = table.collect()
    arrays = GramArrays(store_model(table, entries), keep=2)
    for lang in ("en", "fr", ""):
        mine = [r for r in rows if r["lang"] == lang]
        got = arrays.logp(lang, np.array([r["g"] for r in mine]).view(np.uint64))
        assert np.allclose(got, [r["logp"] for r in mine])


def test_quality(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ne", "tu"]) for _ in range(3)) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(120)), "xx") for k in range(80)]
    rows.append((900, " ".join("".join(chr(rng.randrange(33, 126)) for _ in range(6)) for _ in range(120)), "xx"))
    rows += [(901, None, "xx"), (902, "", None), (903, "few words", None), (904, "again and " * 60, "xx"), (None, rows[0][1], None), (0, rows[0][1], "xx")]
    docs = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows], "doc_id long, text string, lang string, n_words int").repartition(3)
    got = quality(docs).toPandas()
    assert len(got) == len(rows)
    base = {d: plain_base(t) for d, t, _ in rows}
    for r in got.itertuples():
        want = base[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert {c: int(getattr(r, c)) for c in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.base_failed == failed and not (failed and r.kept)
    kept = {r.doc_id: r.kept for r in got.itertuples() if r.doc_id == r.doc_id}
    assert not kept[900]                                    # far outside its language's band
    assert all(kept[k] for k in range(80))


def test_clean_documents_stay(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "lang")
    good = spark.read.parquet(f"{sf_small}/labels.parquet").where("quality = 1")
    out = quality(docs).join(good, "doc_id").where("NOT base_failed").toPandas()
    assert out.kept.mean() > 0.97


def test_empty(spark):
    assert quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_bounded_counting(spark, monkeypatch):
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in CORPUS]), pa.array([x for x, _ in CORPUS])], names=["text", "lang"])
    whole, parts = Counter(), Counter()
    for limit, into in ((1 << 20, whole), (4, parts)):
        for b in kn_quality._count(iter([batch, batch]), limit):
            for lang, g, c in zip(*(b.column(k).to_pylist() for k in range(3))):
                into[lang, g] += c
    assert whole == parts


def test_labelled_junk_is_rejected(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = quality(docs).join(labels, "doc_id").where("NOT base_failed").toPandas()
    junk, good = out[out.quality == 0], out[out.quality == 1]
    assert len(junk) > 10 and (~junk.kept).mean() > 0.9
    assert good.kept.mean() > 0.97


def test_common_junk_is_rejected(spark):
    """Junk of one pattern in a quarter of the documents, which a model counted on it finds likely."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ne", "tu"]) for _ in range(3)) for _ in range(60)]
    clean = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(90)]
    junk = [" ".join(rng.choice(vocabulary) + rng.choice(["&&&", "***", ""]) for _ in range(120)) for _ in range(30)]
    rows = [(k, t, "xx") for k, t in enumerate(clean + junk)]
    rows += [(1000 + k, t, "yy") for k, t in enumerate(junk)]      # no reference text: counted whole
    kept = {r["doc_id"]: r["kept"] for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[k] for k in range(90)) and not any(kept[k] for k in range(90, 120))
    assert all(kept[1000 + k] for k in range(30))


def test_reference_counts(spark):
    rows = [("a", "one two three"), ("a", "## one"), ("b", "## x"), ("b", "## y")]
    docs = spark.createDataFrame(rows, "lang string, text string").select("text", "lang")
    got = {}
    for r in kn_quality.reference_counts(count_grams(docs)).collect():
        got.setdefault(r["lang"], {})[tuple(r["g"] >> 16 * k & 0xFFFF for k in (3, 2, 1, 0))] = r["c"]
    gram = lambda t: tuple(units(t))
    assert got["a"][gram("one ")] == 1 and got["a"][gram("## o")] == 0 and got["a"][gram(" one")] == 0
    assert got["b"][gram("## x")] == 1


def test_unseen_grams_back_off(spark):
    seen = Counter({"abcd": 3, "abce": 1, "xbcd": 1, "bcda": 2, "zbcf": 1})
    unseen = ["abcf", "qqbc", "qbcd", "qqqq"]
    number = lambda t: sum(u << 16 * (len(t) - 1 - k) for k, u in enumerate(units(t)))
    rows = [("x", number(g), c) for g, c in [*seen.items(), *((g, 0) for g in unseen)]]
    got = {r["g"]: math.exp(r["logp"]) for r in kneser_ney(spark.createDataFrame(rows, "lang string, g long, c long")).collect()}
    tables = {4: {**seen, **dict.fromkeys(unseen, 0)}}
    for n in (3, 2, 1):
        tables[n] = {}
        for g, c in tables[n + 1].items():
            tables[n][g[1:]] = tables[n].get(g[1:], 0) + (c > 0)
    probs = {}
    for n in (1, 2, 3, 4):
        t = tables[n]
        c = [sum(v == k for v in t.values()) for k in range(6)]
        d = [0.0]
        for k in (1, 2, 3):
            x = (0.5, 1.0, 1.5)[k - 1]
            if c[1] + 2 * c[2] and c[k]:
                x = k - (k + 1) * c[1] / (c[1] + 2 * c[2]) * c[k + 1] / c[k]
            d.append(max(0.05, min(k - 0.05, x)))
        for g, v in t.items():
            mine = [x for h, x in t.items() if h[:-1] == g[:-1]]
            left = sum(d[min(x, 3)] for x in mine) / sum(mine) if sum(mine) else 1.0
            direct = max(0, v - d[min(v, 3)]) / sum(mine) if sum(mine) else 0.0
            probs[g] = direct + left * (probs[g[1:]] if n > 1 else 1 / len(t))
    assert all(got[number(g)] == pytest.approx(probs[g], rel=1e-5) for g in tables[4])
