"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventscope.llm import (burst_trie, chat_repair, decontaminate, kn_quality, lang_id, lexical_search, minhash_dedup,
                            secret_ledger, source_mix, suffix_dedup, token_index, toxicity, url_rules)
from eventscope.llm.common import read_table
from eventscope.session import work_path

# The URL rules of op5 as (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_ledger.digest(secret_ledger.scan_paths(docs, work_path(spark, "secret-ledger")))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    catalogue = token_index.write_shards(docs, tokenizer_path())
    return token_index.read_back(catalogue.select("doc_id", "copy"), token_index.build_index(catalogue), catalogue)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_dedup.near_duplicates(docs, shingle=2, percent=80)


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(read_table(spark, sf_dir, "conversations"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(pages, rules).drop("url")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken, sources = source_mix.mix(docs, F.array("source"))
    return (taken.withColumn("source", F.col("pattern")[0])
            .join(F.broadcast(sources.withColumnRenamed("source", "name")),     # one row per source
                  F.col("source").eqNullSafe(F.col("name")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lang_id.identify(docs, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.judge(docs, read_table(spark, sf_dir, "benchmark"))


def op10_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return kn_quality.quality(docs)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_trie.conversation_trie(read_table(spark, sf_dir, "conversations")).drop("node")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.rank_documents(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


LLM_QUERIES = {
    "op1_secret_ledger": op1_secret_ledger,
    "op2_token_index": op2_token_index,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_chat_repair": op4_chat_repair,
    "op5_url_rules": op5_url_rules,
    "op6_source_mix": op6_source_mix,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_perplexity": op10_quality_perplexity,
    "op11_toxicity": op11_toxicity,
    "op12_burst_trie": op12_burst_trie,
    "op13_lexical_search": op13_lexical_search,
}

LLM_ORACLE = {
    "op3_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE len(ws) WHEN 0 THEN [] WHEN 1 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingle FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c AS ca ON ca.doc_id = a JOIN c AS cb ON cb.doc_id = b
  WHERE 100 * common >= 80 * (ca.n + cb.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, g.root AS component_id, d.doc_id = g.root AS kept
FROM documents AS d LEFT JOIN c ON c.doc_id = d.doc_id
JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) AS g ON g.node = d.doc_id
""",
    "op9_decontaminate": r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM t),
i AS (
  SELECT DISTINCT item_id, array_to_string(win, ' ') AS words, len(win) AS n
  FROM (SELECT id AS item_id, unnest(list_transform(range(1, greatest(1, len(ws) - 12) + 1), lambda k: ws[k:k + 12])) AS win
        FROM w WHERE kind = 'i' AND len(ws) > 0) AS x),
dw AS (
  SELECT id AS doc_id, n, unnest(range(1, len(ws) - n + 2)) AS pos, ws
  FROM w, (SELECT DISTINCT n FROM i) AS sizes WHERE kind = 'd' AND len(ws) >= n),
h AS (
  SELECT doc_id, pos, i.n, item_id FROM dw JOIN i ON i.n = dw.n AND i.words = array_to_string(ws[pos:pos + dw.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM h) AS x GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) AS x GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit ON hit.doc_id = w.id LEFT JOIN named ON named.doc_id = w.id WHERE kind = 'd'
""",
    "op5_url_rules": r"""
WITH p AS (
  SELECT page_id,
         translate(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(rule_host, rule_path, rule_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
       max(rule_host || rule_path) FILTER (best) AS "rule",
       coalesce(max(rule_verdict) FILTER (best), 'allow') AS verdict
FROM (
  SELECT page_id, host, path, rule_host, rule_path, rule_verdict,
         rule_host IS NOT NULL AND length(rule_host || rule_path)
           = max(length(rule_host || rule_path)) OVER (PARTITION BY page_id) AS best
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS j
GROUP BY page_id, host, path
""",
    "op12_burst_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t) AS c),
r AS (
  SELECT crc.conv_id, 0 AS own, t.place, role, text FROM crc JOIN t ON t.conv_id = crc.base AND t.place <= h
  UNION ALL
  SELECT crc.conv_id, 1, t.place, role, text FROM crc JOIN t ON t.conv_id = crc.conv_id AND t.place > h),
s AS (
  SELECT crc.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY own, place) FILTER (role IS NOT NULL), []) AS turns
  FROM crc LEFT JOIN r ON r.conv_id = crc.conv_id GROUP BY crc.conv_id),
p AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM s),
n AS (
  SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), '') AS ends,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(turns[1:depth][-1].text) END AS gain
  FROM p GROUP BY depth, path, turns[1:depth]),
c AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
l AS (
  SELECT n.depth, n.path, sum((c.n_children IS NULL)::BIGINT) AS n_leaves, sum(d.gain) AS saved FROM (
    SELECT unnest(range(0, n.depth + 1)) AS up, n.* FROM n) AS d
  JOIN n ON n.depth = d.up AND n.path = d.path[1:d.up]
  LEFT JOIN c ON c.depth = d.depth AND c.path = d.path GROUP BY 1, 2)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       CAST(l.n_leaves AS BIGINT) AS n_leaves, CAST(l.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN l ON l.depth = n.depth AND l.path = n.path
LEFT JOIN c ON c.depth = n.depth AND c.path = n.path
LEFT JOIN n AS q ON q.depth = n.depth - 1 AND q.path = n.path[1:n.depth - 1]
""",
    "op13_lexical_search": r"""
WITH w AS (
  SELECT 'd' AS kind, row_number() OVER () AS row, doc_id AS id, text FROM documents UNION ALL
  SELECT 'i', row_number() OVER (), item_id, text FROM benchmark),
t AS (
  SELECT kind, row, id, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM w WHERE text IS NOT NULL),
f AS (SELECT kind, row, id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM f WHERE kind = 'd' GROUP BY row),
g AS (SELECT count(*) AS documents, CAST(sum(n) AS HUGEINT) AS length FROM n),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM f, g WHERE kind = 'd' GROUP BY term, documents),
m AS (SELECT row, CAST(100 - 75 + (75 * n * documents) // length AS BIGINT) AS m FROM n, g),
s AS (
  SELECT q.row AS item, q.id AS item_id, d.row, d.id AS doc_id,
         CAST(sum(q.tf * weight * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m))) AS BIGINT) AS score
  FROM f AS q JOIN f AS d ON d.term = q.term AND d.kind = 'd' JOIN v ON v.term = q.term JOIN m ON m.row = d.row
  WHERE q.kind = 'i' GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) AS x
WHERE rank <= 10
""",
}
