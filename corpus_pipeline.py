"""A training corpus from ``documents``: five stages over the operators of eventscope.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its
result is written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.

language_id     rows whose text has a learned language with a probability of one half or
                more stay; NULL, letterless and undecided texts go
near_dedup      of each group of near copies (five-word shingles, similarity 0.8) the row of the
                smallest doc_id stays (NULL last; of equal ids the smallest text hash); rows
                are linked by their texts alone, so unlike texts of one id all stay, and copies
                without an id go; rows without words are linked with nothing and stay
decontaminate   rows of which a twentieth or more is benchmark windows go; each row is judged by
                its own text, whatever its doc_id
mix_sources     rows are taken as often as the mix of their source says (0, 1 or 2 times)
token_output    token shards with their perfect hash index; the result is read back from
                the files: doc_id, start, n_tokens, ids_crc32 of every taken document

Empty tables give empty results; repeated rows and NULLs are handled as in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventscope.llm import decontaminate as benchmark_windows
from eventscope.llm import lang_id, minhash_dedup, source_mix, token_index
from eventscope.llm.common import bound_batches, read_table, saved
from eventscope.llm.queries import tokenizer_path

MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    model = lang_id.train(docs.where(~lang_id.held_out(F.col("doc_id"))))
    judged = lang_id.predict(docs, model)
    known = (F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return judged.where(known).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a node is a hash of (doc_id, text), whatever rows share the id; rows whose hash two different
    # (doc_id, text) share, as a second hash tells, are linked with nothing and stay
    cols = [docs[f"`{c}`"] for c in docs.columns]
    key, other = F.xxhash64(docs["doc_id"], docs["text"]), F.xxhash64(F.lit("other"), docs["doc_id"], docs["text"])
    keys = saved(docs.select(key.alias("key"), other.alias("other"), docs["doc_id"].alias("id")).groupBy("key").agg(
        F.count("*").alias("rows"), F.min("other").alias("low"), F.max("other").alias("high"),
        F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("rank")), "row-keys")
    clash = saved(keys.where("low <> high").select("key"), "clashing-keys")
    nodes = docs.select(key.alias("key"), docs["text"].alias("text")).join(clash, "key", "left_anti")
    groups = minhash_dedup.near_duplicates(nodes.select(F.col("key").alias("doc_id"), "text"), shingle=5, percent=80)
    members = saved(groups.where("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
                    .distinct().join(keys, "key").select("group", "rows", F.struct("rank", "key").alias("place")),
                    "group-members")
    # written, so that the join has a plain exchange on both sides, which Spark may split at a large group
    first = saved(members.groupBy("group").agg(F.min("place").alias("first"), F.count("*").alias("n"))
                  .where("n > 1").select("group", "first"), "group-firsts")
    # the removed keys are the smaller side, and a written table whose size Spark knows
    gone = saved(members.join(first, "group").where("place.key <> first.key").select(F.col("place.key").alias("gone")),
                 "removed-keys")
    out = docs.join(gone, key == gone["gone"], "left_anti")
    again = saved(members.where("rows > 1").select(F.col("place.key").alias("again")), "repeated-keys")
    if again.limit(1).count():    # of rows equal in id and text the first by all their columns stays
        whole = F.struct(*cols)
        one = (out.join(again, key == again["again"], "left_semi").groupBy(key.alias("key"))
               .agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*"))
        out = out.join(again, key == again["again"], "left_anti").unionByName(one)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the verdict depends on the text alone, so its digest stands for the row; NULL texts are clean
    digest = F.unhex(F.sha2(docs["text"].cast("string").cast("binary"), 256))
    judged = benchmark_windows.judge(docs.select(digest.alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    hit = saved(judged.where("contaminated").select(F.col("doc_id").alias("__hit")).distinct(), "contaminated-texts")
    return docs.join(hit, digest == hit["__hit"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs, F.array("source"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    catalogue = token_index.write_shards(docs.select("doc_id", "text"), tokenizer_path())
    index = token_index.build_index(catalogue)
    return token_index.read_back(catalogue.select("doc_id", "copy"), index, catalogue)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: Language scores, seeded mixing and token ids have no SQL form; tests compare the stages
#: with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
