import random

from treespan.llm import urlrules
from treespan.llm.queries import QUERIES, SQL

SCHEMA = "page_id bigint, url string, host string, path string, rule string, Verdict string, stack int, key int"


def judged(url, rules, default="allow"):
    """Host, path, rule and verdict, by trying every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "h", "p", "r", "v", 1, 2) for i, u in enumerate(urls)], SCHEMA)


def test_query_against_sql(spark, sf_dir, against_sql):
    against_sql(QUERIES["op5_url_rules"](spark, sf_dir), SQL["op5_url_rules"], sf_dir)


def test_against_every_rule(spark):
    rng = random.Random(2)
    labels = ["a", "b", "net", "example", "x-y", "a0", "é"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "/".join(rng.choice(["en", "de", "e", ""]) for _ in range(rng.randrange(0, 3)))
    rules = {(host(), path()): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [None, "", "://", "http://", "no host", "HTTP://A.NET", "http://a.net?q=/en", "http://a.net#/en", "//a.net/", "http://example.net.", "http://.net/en/", "http://net", "x" * 50_000 + "://net/" + "y" * 50_000]
    urls += [f"http://{host()}{path()}{rng.choice(['', '?q', '#f', '/en/'])}" for _ in range(600)] * 2
    got = urlrules.judge(frame(spark, urls), spark.createDataFrame(rules, urlrules.RULE)).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(urls[r.page_id], rules), urls[r.page_id]


def test_odd_rules_and_empty(spark):
    rules = [(None, "/", "block"), ("", "/", "block"), ("net", None, "block"), ("net", "", "allow"), ("com", "/", None), ("ORG", "/a", "block")]
    rules = spark.createDataFrame(rules, urlrules.RULE)
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.judge(frame(spark, ["http://a.net/", "http://a.com/", "http://b.org/ab", "http://"]), rules, default="block").collect()}
    assert got == {0: ("net", "block"), 1: (None, "block"), 2: ("org/a", "block"), 3: (None, "block")}
    assert urlrules.judge(frame(spark, []), rules).collect() == []
    assert {r.verdict for r in urlrules.judge(frame(spark, ["http://a/"]), rules.limit(0)).collect()} == {"allow"}
