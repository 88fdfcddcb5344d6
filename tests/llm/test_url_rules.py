"""URL rules against a loop over all rules."""
import random

from eventscope.llm.url_rules import judge_urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
    path = rest[k:]
    return host, path[:next((i for i, c in enumerate(path) if c in "?#"), len(path))]


def judge(url, rules):
    host, path = split(url)
    fits = [(len(h + p), len(h), h, p, v) for h, p, v in rules
            if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    _, _, h, p, v = max(fits)
    return host, path, h + p, v


def test_against_loop(spark):
    rng = random.Random(4)
    hosts = ["a.com", "b.a.com", "x.b.a.com", "com", "net", "www.net", "aa.com", "é.net", "localhost", "a..com"]
    paths = ["/", "", "/x", "/x/", "/x/y", "/x/y/z", "/xy", "/é", "/\U0010ffff", "/x/\U0010ffffq"]
    rules = {(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(40)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [rng.choice(["http://", "HTTPS://", "ftp://", ""]) + rng.choice(["", "q."]) + rng.choice(hosts).upper()
            + rng.choice(paths) + rng.choice(["", "?a=/x", "#/y", "tail"]) for _ in range(300)]
    urls += [None, "", "://", "http://", "a://b://c/x", "http://a.com/x\ny", urls[0], urls[0]]
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), salts=3).collect()}
    assert got == {k: judge(u, rules) for k, u in enumerate(urls)}


def test_void_repeated_and_conflicting_rules(spark):
    rules = spark.createDataFrame([("a.com", "/", "allow"), ("a.com", "/", "block"), ("a.com", "/", "block"),
                                   (None, "/", "block"), ("b.com", None, "block"), ("c.com", "/", None)],
                                  "host string, path string, verdict string")
    pages = spark.createDataFrame([("http://a.com/q",), ("http://b.com/",), ("http://c.com/",)], "url string")
    got = sorted((r["url"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules).collect())
    assert got == [("http://a.com/q", "a.com/", "block"), ("http://b.com/", None, "allow"), ("http://c.com/", None, "allow")]


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r["verdict"] for r in judge_urls(pages, rules).collect()] == ["allow"]
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_no_python_in_the_plan(spark):
    rules = spark.createDataFrame([("a.com", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
