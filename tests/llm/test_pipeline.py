"""Every stage of the pipeline against its brute-force version, on its own input."""
import zlib

import numpy as np
import pytest
from test_decontaminate import brute as brute_windows
from test_minhash_dedup import brute as brute_groups

import corpus_pipeline
from eventscope.llm import lang_id
from eventscope.llm.queries import tokenizer_path
from eventscope.llm.source_mix import quotas

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_small, tmp_path_factory):
    """The input and output rows of each stage on a small table with odd rows."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    base = docs.collect()
    odd = [(9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, "123 !!", "en", "src2", 7),
           (9004, base[5]["text"], None, None, 1), (None, base[6]["text"], "en", "src0", 1),
           (base[7]["doc_id"], base[7]["text"], base[7]["lang"], base[7]["source"], base[7]["n_chars"])]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    folder = tmp_path_factory.mktemp("stages")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, sf_small)
        path = str(folder / name)
        result.write.parquet(path)
        result = spark.read.parquet(path)
        out.append((name, docs.collect(), result.columns, result.collect()))
        docs = result
    return {name: (before, columns, after) for name, before, columns, after in out}


def key(r):
    return repr(tuple(r))


def test_names_and_columns(stages):
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "mix_sources", "token_output"]
    assert all(columns == COLUMNS for name, (_, columns, _) in stages.items() if name != "token_output")


def test_language_id(spark, stages):
    before, _, after = stages["language_id"]
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    model = lang_id.train(docs.where("crc32(coalesce(string(doc_id), '')) % 5 <> 0"))
    langs, prior, logp = model
    want = []
    for r in before:
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            continue
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        s = prior + sum(logp[:, b[f[0]:e[0]]].astype(float).sum(axis=1) for b, f, e in lang_id.grams(cps, np.array([0, len(cps)]), 16))
        if 1 / np.exp(s - s.max()).sum() >= 0.5:
            want.append(r)
    assert sorted(map(key, after)) == sorted(map(key, want))
    assert len(before) - len(after) <= 8        # clean documents stay


def brute_kept(rows):
    """Rows are linked by their texts alone; of each group the first by (doc_id, NULL last) stays.
    Answers the rows that must stay and, per group, the rows among which the choice falls."""
    groups = {}
    for k, g in enumerate(brute_groups([(k, r["text"]) for k, r in enumerate(rows)], 5, 80)):
        groups.setdefault(g[2], []).append(g[0])
    out = []
    for members in groups.values():
        rank = lambda k: (rows[k]["doc_id"] is None, rows[k]["doc_id"] or 0)
        least = min(map(rank, members))
        out.append({key(rows[k]) for k in members if rank(k) == least})
    return out


def check_kept(before, after):
    choices = brute_kept(before)
    assert len(after) == len(choices)
    left = sorted(map(key, after))
    for choice in sorted(choices, key=len):
        hit = next(k for k in left if k in choice)
        left.remove(hit)
    assert not left


def test_near_dedup(stages):
    before, _, after = stages["near_dedup"]
    check_kept(before, after)


def test_near_dedup_repeated_and_missing_ids(spark):
    """Unlike texts of one id stay; copies without an id go; clashing names do no harm."""
    words = lambda a: " ".join(f"{a}{k}" for k in range(40))
    near = words("x").replace("x39", "changed")
    rows = [(1, words("x"), 1, 2, 3), (1, words("y"), 1, 2, 3), (2, near, 1, 2, 3), (None, words("z"), 1, 2, 3),
            (None, words("z"), 1, 2, 4), (None, words("y"), 1, 2, 3), (None, words("w"), 1, 2, 3), (5, None, 1, 2, 3),
            (5, None, 1, 2, 3), (None, "", 1, 2, 3), (7, "", 1, 2, 3), (8, words("z"), 1, 2, 5), (9, "one two", 1, 2, 3),
            (3, "one two", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row long, group long, `rank.at` long").repartition(4)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    after = out.collect()
    check_kept(docs.collect(), after)
    assert sorted((r[0] or 0, r[1] or "") for r in after) == sorted(
        [(1, words("x")), (1, words("y")), (8, words("z")), (0, words("w")), (5, ""), (5, ""), (0, ""), (7, ""), (3, "one two")])
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_decontaminate(spark, sf_small, stages):
    before, _, after = stages["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    hit = {d for d, *_, bad in brute_windows([(r["doc_id"], r["text"]) for r in before], items, 13) if bad}
    assert sorted(map(key, after)) == sorted(key(r) for r in before if r["doc_id"] not in hit)
    assert hit


def test_mix_sources(stages):
    before, _, after = stages["mix_sources"]
    words = lambda rows, s: sum(len((r["text"] or "").split()) for r in rows if r["source"] == s)
    names = sorted({r["source"] for r in before}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: words(before, s) for s in names}
    target = quotas(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5, 2)
    largest = {s: max(len((r["text"] or "").split()) for r in before if r["source"] == s) for s in names}
    times = {}
    for r in after:
        times[key(r)] = times.get(key(r), 0) + 1
    assert set(times) <= {key(r) for r in before} and max(times.values()) <= 2
    assert all(abs(words(after, s) - target[s]) <= largest[s] / 2 + 1 for s in names)


def test_token_output(stages):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer_path())
    before, columns, after = stages["token_output"]
    assert columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want, start = [], 0
    for r in sorted(before, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in after if r[0] is not None) == sorted(w for w in want if w[0] is not None)
    assert len(after) == len(want)


def test_run_and_empty(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decontaminate_without_ids(spark, sf_small, tmp_path):
    """One contaminated row takes no clean row of the same (or no) id with it."""
    item = " ".join(f"b{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"clean words {k}", None, None, k) for k in range(5)]
    rows += [(None, item, None, None, 9), (None, None, "en", None, None), (None, item, "en", "src0", 9),
             (4, "also clean", "en", "src0", 1), (4, f"x {item} y", "en", "src0", 2), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(key, got.collect())) == sorted(repr(r) for r in rows if item not in (r[1] or ""))
