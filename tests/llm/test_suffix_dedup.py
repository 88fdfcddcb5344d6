"""Repeated passages against a direct count of all windows."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from eventscope.llm import suffix_dedup
from eventscope.llm.suffix_dedup import first_windows, suffix_order, symbol_words


def brute(rows, length):
    """rows: (doc_id, text); doc_id None first, repeated ids by text."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0,
                                                    rows[k][1] is not None, rows[k][1] or ""))
    seen, out = set(), {}
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = [True] * length
            seen.add(w)
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.setdefault(rows[k][0], []).append((len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "dé", "epsilon", "zeta\n", "eta", "ß", "日本"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for k in range(60):
        body = " ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(rng.randrange(5, 90)))
        if k % 4 == 0:
            at = rng.randrange(len(body))
            body = body[:at] + passage[rng.randrange(30):] + body[at:]
        rows.append((k, body))
    rows += [(100 + k, rows[7][1]) for k in range(25)]                     # exact copies
    rows += [(200 + k, rows[9][1] + f" tail {k}") for k in range(25)]       # near copies
    rows += [(300, "a" * 700), (301, "ab" * 400), (302, "b" + "a" * 350), (303, ""), (304, None),
             (305, "x" * 99), (306, "x" * 100), (307, "x" * 101), (308, "\0" * 300 + "z"),
             (309, "é" * 300), (None, passage), (310, passage + passage)]
    return rows


@pytest.mark.parametrize("hot", [1 << 17, 3])
def test_against_brute_force(spark, hot):
    rows = corpus()
    rng = random.Random(1)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, place string").repartition(5)
    got = {}
    for r in suffix_dedup.remove_repeats(docs, 100, hot=hot).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    want = brute(rows, 100)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert any(r[1] for v in want.values() for r in v)


def test_repeated_ids(spark):
    rows = [(1, "q" * 150), (1, "q" * 150), (1, "p" * 120), (2, "p" * 110), (None, "q" * 130)]
    got = {}
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in brute(rows, 100).items()}


def test_empty_table_and_bytes(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(none).count() == 0
    one = spark.createDataFrame([(1, "k" * 250), (2, "short")], "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(one, keep_bytes=True).collect()}
    assert kept == {1: b"k", 2: b"short"}


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 500)
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 100, 4000).astype(np.uint8)
    raw[3000:3400] = raw[200:600]
    data, offsets = raw, np.array([0, len(raw)])
    windows = []
    for at, part, offs in suffix_dedup._pieces(data, offsets, 100):
        first, last, _, _ = suffix_dedup.runs(part, offs, 100, 32)
        for a, b in zip(first, last):
            windows += range(at + a, at + b + 1)
    assert windows == list(range(4000 - 99))


def test_two_stage_order_is_the_suffix_order():
    rng = np.random.default_rng(9)
    for letters in (1, 2, 4, 250):
        strings = [bytes(rng.integers(0, letters, rng.integers(1, 60)).astype(np.uint8)) for _ in range(40)]
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        text = raw.astype(np.int16) + 1
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        text[ends] = 0
        wanted = text > 0
        order = suffix_order(text, wanted, symbol_words(text), 100)
        assert sorted(order) == np.flatnonzero(wanted).tolist()
        ends = np.flatnonzero(text == 0)
        suffix = [tuple(text[p:ends[np.searchsorted(ends, p)] + 1]) for p in order]    # up to the string's end
        assert suffix == sorted(suffix)


def test_first_windows():
    strings = [b"abcdefghijklmno", b"xbcdefghijklmnp", b"cdefghijklmnqqq"]
    data = np.frombuffer(b"".join(strings), np.uint8)
    got = first_windows(data, np.array([len(x) for x in strings]), np.array([1, 0, 2]), 10)
    seen, want = {}, []
    for rank, s in sorted(zip([1, 0, 2], strings)):
        for i in range(6):
            seen.setdefault(s[i:i + 10], rank)
    for rank, s in zip([1, 0, 2], strings):
        want += [seen[s[i:i + 10]] == rank for i in range(6)]
    assert got.tolist() == want


def test_small_sorts_and_merges(spark, monkeypatch):
    """Anchors are kept together however few strings are sorted at a time."""
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "LOOK_BYTES", 700)
    rows = corpus()
    batch = pa.RecordBatch.from_pylist([{"doc": k, "copy": 0, "text": t or ""} for k, (_, t) in enumerate(rows)])
    every = type("Every", (), {"value": np.full((1 << 20 >> 3) + 4096, 255, np.uint8)})
    got = {}
    for most in (200, 1 << 30):
        dealt = pa.Table.from_batches(list(suffix_dedup._deal(iter([batch]), 100, every, 20, None, most))).sort_by("anchor")
        firsts = pa.Table.from_batches(list(suffix_dedup._resolve(iter(dealt.to_batches(max_chunksize=7)), 100)))
        places = set()
        for r in firsts.to_pylist():
            places |= {(r["doc"], r["place"] + i) for i in np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))).tolist()}
        got[most] = places
    seen, want = set(), set()
    for k, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        for i in range(len(raw) - 99):
            if raw[i:i + 100] not in seen:
                seen.add(raw[i:i + 100])
                want.add((k, i))
    assert got[200] == want and got[1 << 30] == want


def test_bytes_travel_only_for_anchors_with_different_strings(spark, monkeypatch):
    """Copies of whole texts are settled by their places; the results are those of all bytes."""
    import random
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)]
    rows = [(k, texts[k % 12]) for k in range(60)] + [(100 + k, texts[k][:150] + word() + texts[k][200:]) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect())
    sent = []
    real = suffix_dedup._gather
    monkeypatch.setattr(suffix_dedup, "_gather", lambda d, b, n: (sent.append(int(n.sum())), real(d, b, n))[1])
    batch = pa.RecordBatch.from_pylist([{"doc": i, "copy": 0, "text": t} for i, t in rows[:60]])
    every = type("Every", (), {"value": np.full((1 << 20 >> 3) + 4096, 255, np.uint8)})
    none = type("None_", (), {"value": np.zeros((1 << 20 >> 3) + 4096, np.uint8)})
    dealt = pa.Table.from_batches(list(suffix_dedup._deal(iter([batch]), 100, every, 20, None, several=(none, 20)))).sort_by("anchor")
    assert sum(sent) == 0 and dealt.num_rows > 0
    firsts = pa.Table.from_batches(list(suffix_dedup._resolve(iter(dealt.to_batches()), 100))).to_pylist()
    places = {(r["doc"], r["place"] + i) for r in firsts for i in np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))).tolist()}
    assert places == {(k, i) for k in range(12) for i in range(len(texts[k]) - 99)}
    seen, want = set(), []
    for i, t in rows:
        raw, gone = t.encode(), set()
        for at in range(len(raw) - 99):
            if raw[at:at + 100] in seen:
                gone |= set(range(at, at + 100))
            seen.add(raw[at:at + 100])
        want.append((i, len(raw), len(gone)))
    assert [r[:3] for r in got] == want


def test_runs_without_a_repeated_side_go_no_further(spark):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    phrase, passage = noise(50), noise(130)
    alone = [noise(150) + phrase + noise(150) for _ in range(6)]       # too little in common for a window
    twice = [noise(90) + passage + noise(70) for _ in range(2)]
    batch = lambda texts: pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts)], names=["doc", "copy", "text"])

    class Every:
        value = np.full((1 << 20 >> 3) + 4096, 255, np.uint8)

    def dealt(texts):
        counted = pa.Table.from_batches(list(suffix_dedup._count_sides(iter([batch(texts)]), 100, Every, 20)))
        kept = [(s << 16,) for s, n in zip(counted["side"].to_pylist(), counted["seen"].to_pylist()) if n > 1]
        kept = [(s - (1 << 64) if s >= 1 << 63 else s,) for s, in kept]
        sides = (suffix_dedup.hash_filter(spark.createDataFrame(kept, "side long"), "side", 20), 20)
        return [sum(b.num_rows for b in suffix_dedup._deal(iter([batch(texts)]), 100, Every, 20, None, sides=s)) for s in (None, sides)]

    without, with_sides = dealt(alone)
    assert without > 6 and with_sides == 0
    without, with_sides = dealt(twice)
    assert 0 < with_sides < without
