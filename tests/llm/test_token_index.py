"""Token shards against the library, and the perfect hash."""
import zlib

import numpy as np
import pytest

from eventscope.llm import token_index
from eventscope.llm.queries import tokenizer_path
from eventscope.llm.token_index import Encoder, build_index, build_mph, find, lookup, read_back, slot_of, write_shards

TEXTS = ["Hello, world! It's 'quoted' don't we'LL '' ''s .'s x.'s a'.", None, "", "   \t\n\x0b\x0c\r ", "<|endoftext|> and <|STARTofText|>x",
         "a<|startoftext|>b!", "<|start", "naïve café ÀÉÎ ß İstanbul ſ K Å", "日本語 テスト 한국어", "é å ≠ x̸",
         "12 345 6.7e8 x1y2 ²½", "\x00\x01\x1c\x1d\u0085  　end", "a" * 5000, "😀😀 👩‍👩‍👧 ok", "!!!...???",
         "tab\there\nline\r\nend", "it 's 'S 'Ve we'veve'd", "word" * 300 + " tail", "ΑΣ ΣΑΣ. Σ", "'", "''''", "a'b'c''d"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_equals_library(library, sf_small):
    import pyarrow.parquet as pq
    texts = [t or "" for t in TEXTS] + pq.read_table(f"{sf_small}/documents.parquet", columns=["text"])["text"].to_pylist()
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.append(0, np.cumsum([len(x) for x in raw]))
    for most in (1 << 20, 10):                     # 10: the memory of pieces is dropped all the time
        enc = Encoder(tokenizer_path(), most)
        for cut in (len(TEXTS), len(texts)):
            out, counts = enc.block(data[:offsets[cut]], offsets[:cut + 1], 2)
            parts = np.split(out, np.cumsum(counts)[:-1])
            assert [p.tolist() for p in parts] == [ids_of(library, t) for t in texts[:cut]]


def test_texts_cut_in_parts_equal_library(library, monkeypatch):
    raw = [(t or "").encode() for t in TEXTS * 3]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))
    for size in (1, 64, 4096):
        monkeypatch.setattr(token_index, "PART_BYTES", size, raising=False)
        out, counts = Encoder(tokenizer_path()).block(data, offsets, 2)
        assert [p.tolist() for p in np.split(out, np.cumsum(counts)[:-1])] == [ids_of(library, t) for t in TEXTS * 3]


def test_frequent_pieces_are_learned_once(library):
    enc, learned = Encoder(tokenizer_path(), 60), []
    learn = enc._learn
    enc._learn = lambda words: (learned.extend(words), learn(words))[1]
    for k in range(20):
        text = "of the and " + " ".join(chr(97 + k) + chr(97 + j) + "q" for j in range(26))
        out, _ = enc.block(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 2)
        assert out.tolist() == ids_of(library, text)
        assert len(enc.known) <= 60 + 29
    assert learned.count(b"the") == learned.count(b"of") == 1


def test_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(token_index, "BUCKET_KEYS", 7)
    rows = [(k * 3 % 50, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (6, "repeated id"), (6, TEXTS[2]), (-5, "negative")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, copy long").repartition(3)
    catalogue = write_shards(docs, tokenizer_path())
    index = build_index(catalogue)
    got = sorted((tuple(r) for r in read_back(catalogue.select("doc_id", "copy"), index, catalogue).collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc, text in order:
        ids = np.array(ids_of(library, text), "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    absent = spark.createDataFrame([(777777, 0), (6, 9)], "doc_id long, copy long")
    assert [r["offset"] for r in lookup(absent, index).collect()] == [None, None]


def test_empty(spark):
    catalogue = write_shards(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path())
    assert read_back(catalogue.select("doc_id", "copy"), build_index(catalogue), catalogue).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 500, 2048])
def test_perfect_hash(n):
    h = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    seeds, slots = build_mph(h)
    assert sorted(slots) == list(range(n))
    records = np.zeros(n, token_index.RECORD)
    records["offset"][slots] = np.arange(n)
    records["print"][slots] = np.arange(n)
    got, ok = find(h, np.arange(n).astype(np.uint64), seeds, records)
    assert ok.all() and got["offset"].tolist() == list(range(n))
    assert slot_of(h[:1], np.array([-4]), n)[0] == 3


def test_keys_of_equal_hashes_are_told_apart():
    from eventscope.llm.token_index import distinct_salt, salted
    h = np.array([5, 5, 9, 5, 7], np.uint64)
    f = np.array([1, 2, 3, 4, 5], np.uint64)
    salt = distinct_salt(h, f)
    assert salt > 0 and distinct_salt(h[1:3], f[1:3]) == 0
    seeds, slots = build_mph(salted(h, f, salt))
    assert sorted(slots) == list(range(5))
    groups = (token_index.mix64(salted(h, f, salt)) % np.uint64(len(seeds))).astype(np.int64)
    assert (slot_of(salted(h, f, salt), seeds[groups], 5) == slots).all()
    with pytest.raises(ValueError):
        distinct_salt(np.array([5, 5], np.uint64), np.array([1, 1], np.uint64))


def test_index_with_forced_equal_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F
    # all keys share their first hash
    monkeypatch.setattr(token_index, "_hashed", lambda k: (F.lit(77).cast("long"), F.xxhash64(k, F.lit("print"))))
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "doc_id long, text string")
    catalogue = write_shards(docs, tokenizer_path())
    got = lookup(catalogue.select("doc_id", "copy"), build_index(catalogue)).collect()
    want = {(r["doc_id"], r["copy"]): (r["shard"], r["offset"], r["n"]) for r in catalogue.collect()}
    assert {(r["doc_id"], r["copy"]): (r["shard"], r["offset"], r["n"]) for r in got} == want


def test_shard_list_is_neither_broadcast_by_hint_nor_one_window(spark, monkeypatch):
    monkeypatch.setattr(token_index, "SHARD_BYTES", 64)
    docs = spark.createDataFrame([(k, f"some text {k}") for k in range(200)], "doc_id long, text string")
    catalogue = write_shards(docs, tokenizer_path())
    assert "strategy=broadcast" not in catalogue._jdf.queryExecution().logical().toString()
    rows = read_back(catalogue.select("doc_id", "copy"), build_index(catalogue), catalogue).orderBy("doc_id").collect()
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
