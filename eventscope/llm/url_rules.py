"""Longest-matching allow/block rules for URLs by a sort-merge range join (Spark SQL only).

A rule is (host, path): it covers its host and every subdomain for URL paths that start
with its path.  A host is written reversed (``com.example.www``) and joined to the path by
a separator, so that the keys under a rule are one interval of the byte order.  Every URL
stands under the reversed key of each of its host suffixes; the rules of a suffix are cut
into disjoint segments by a sweep that keeps a stack of the rules open at that point, and
one sort of URL keys and segment borders gives each URL the rule on top of the stack.

A hot suffix is dealt over ``salts`` parts by a hash of the key, with the (small) borders
repeated in each part.  Nothing is broadcast by hint, no rule or URL is dropped.

Defined cases: a NULL URL, or one without ``://``, has empty host and path and no rule;
rows that repeat get the same answer each; rules that repeat count once, and where one
(host, path) is both allowed and blocked, block wins; a NULL host, path or verdict makes a
rule void; of two fitting rules of one length the one with the longer host wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _suffixes(host: Column) -> Column:
    """Reversed keys of a host and of all hosts above it: com, com.example, …"""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda n: F.array_join(F.slice(labels, 1, n), "."))


def _borders(rules: DataFrame) -> DataFrame:
    """(zone, at, top): from byte key ``at`` on, ``top`` is the innermost open rule.

    The sweep walks the sorted borders of one host's rules with a stack: an opening pushes
    its rule, a closing pops it.  Openings sort before what they contain; a closing key is
    the prefix followed by byte FF, which no UTF-8 text holds, so it follows all contents.
    """
    key = F.col("path").cast("binary")
    top = F.struct(F.col("path").alias("path"), F.col("verdict").alias("verdict"))
    events = rules.select("zone", F.explode(F.array(
        F.struct(key.alias("at"), F.lit(True).alias("opens"), top.alias("rule")),
        F.struct(F.concat(key, F.lit(b"\xff")).alias("at"), F.lit(False).alias("opens"),
                 top.alias("rule")))).alias("e"))
    per_zone = events.groupBy("zone").agg(F.array_sort(F.collect_list("e")).alias("es"))
    none = "CAST(NULL AS STRUCT<path: STRING, verdict: STRING>)"
    swept = F.expr(f"""
        aggregate(es,
          named_struct('stack', CAST(array() AS ARRAY<STRUCT<path: STRING, verdict: STRING>>),
                       'out', CAST(array() AS ARRAY<STRUCT<at: BINARY,
                                   top: STRUCT<path: STRING, verdict: STRING>>>)),
          (s, e) -> named_struct(
            'stack', if(e.opens, concat(s.stack, array(e.rule)), slice(s.stack, 1, size(s.stack) - 1)),
            'out', concat(s.out, array(named_struct(
              'at', e.at,
              'top', if(e.opens, e.rule,
                        if(size(s.stack) > 1, element_at(s.stack, -2), {none})))))),
          s -> s.out)""")
    return per_zone.select("zone", F.explode(swept).alias("b")).select("zone", "b.at", "b.top")


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url",
               default: str = "allow", salts: int = 16) -> DataFrame:
    """All columns of ``urls`` plus ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: columns host, path, verdict ('allow' or 'block').  Columns of ``urls`` named
    like the four results are replaced.
    """
    host, path = split_url(F.col(f"`{url_col}`"))
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    pages = urls.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    clean = (rules.select("host", "path", "verdict").dropna()
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    clean = clean.select(F.array_join(F.reverse(F.split("host", r"\.")), ".").alias("zone"),
                         "path", "verdict")
    borders = _borders(clean).select(
        "zone", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "at", "top",
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    places = pages.select("host", "path").where("host <> ''").distinct()
    keys = places.select(
        F.explode(_suffixes(F.col("host"))).alias("zone"),
        F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"),
        F.col("path").cast("binary").alias("at"),
        F.lit(None).cast("struct<path:string,verdict:string>").alias("top"), "host", "path")
    # the merge: URL keys and borders in one order; a border stands before an equal key
    sweep = Window.partitionBy("zone", "salt").orderBy("at", F.col("host").isNotNull())
    state = F.struct(F.col("top").alias("rule"))
    hits = (borders.unionByName(keys)
            .withColumn("open", F.last(F.when(F.col("host").isNull(), state), ignorenulls=True)
                        .over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
            .where("host IS NOT NULL AND open.rule IS NOT NULL")
            .select("host", "path", F.struct(
                (F.length("zone") + F.length("open.rule.path")).alias("length"),
                F.length("zone").alias("host_length"), "zone",
                F.col("open.rule.path").alias("rule_path"),
                F.col("open.rule.verdict").alias("verdict")).alias("hit")))
    best = hits.groupBy("host", "path").agg(F.max("hit").alias("hit")).select(
        "host", "path",
        F.concat(F.array_join(F.reverse(F.split("hit.zone", r"\.")), "."), "hit.rule_path").alias("rule"),
        F.col("hit.verdict").alias("verdict"))
    return (pages.join(best, ["host", "path"], "left")
            .select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule",
                    F.coalesce("verdict", F.lit(default)).alias("verdict")))
