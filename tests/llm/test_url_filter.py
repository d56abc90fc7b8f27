import random

import pyarrow as pa
from pyspark.sql import functions as F

from duploscope.llm import url_filter as uf
from duploscope.llm.queries import URL_RULES

LOWER = {c: c + 32 for c in range(65, 91)}


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
    after = rest[cut:]
    return rest[:cut].translate(LOWER), after[: min([i for i in map(after.find, "?#") if i >= 0] or [len(after)])]


def brute_force(pages, rules):
    out = []
    for page_id, url in pages:
        host, path = parts(url)
        fits = [
            (len(h + p), len(h), h + p, v) for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=None)
        out.append((page_id, host, path, best and best[2], best[3] if best else "allow"))
    return sorted(out, key=str)


def judged(spark, pages, rules):
    table = spark.createDataFrame([(p, u, "h", "v") for p, u in pages], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame([(*r, "x") for r in rules], "host string, path string, verdict string, page_id string")
    return sorted(map(tuple, uf.judge(table, rules).collect()), key=str)


ODD = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://Example.COM/en/x?q#f"), (6, "https://www.example.com/en/"),
    (7, "x://com/"), (8, "x://com"), (9, "x://a.net/fr/1"), (10, "x://net/fr"), (11, "x://a.net?/fr/"), (12, "x://notexample.com/en/"),
    (13, "a://b://c.com/d"), (None, "x://sub.example.com/en/#"), (7, "x://com/"), (14, "x://ÉX.com/é/"), (15, "x://" + "a." * 300 + "com/en/" + "y" * 20_000),
    (16, "x://example.com./en/"), (17, "x://.com/"), (18, "x://user@www.EXAMPLE.com:80/en/"), (19, "x://example.com/EN/"), (20, "\n://com/\n?"),
]


def test_given_rules(spark):
    assert judged(spark, ODD, URL_RULES) == brute_force(ODD, URL_RULES)


def test_many_rules(spark):
    rng = random.Random(2)
    label = lambda: rng.choice(["a", "b", "c", "dd"])
    hosts = [".".join(label() for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    paths = ["", "/", "/x/", "/x/y", "/é/"]
    rules = {(h, rng.choice(paths)): rng.choice(["allow", "block"]) for h in hosts[:120]}
    pages = [(i, f"s://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'z', '?q'])}") for i in range(500)]
    rules = [(*k, v) for k, v in rules.items()]
    assert judged(spark, pages, rules) == brute_force(pages, rules)


def test_blocking_wins_among_equal_rules_and_nulls(spark):
    rules = [("A.com", "/", "allow"), ("a.com", "/", "block"), (None, "/", "block"), ("b.com", None, "block"), ("", "", "block")]
    got = judged(spark, [(1, "x://a.com/"), (2, "x://q.b.com"), (3, "x://c.com/")], rules)
    assert [r[3:] for r in got] == [("a.com/", "block"), ("b.com", "block"), (None, "allow")]


def test_no_rows(spark):
    assert judged(spark, [], URL_RULES) == []
    assert judged(spark, [(1, "x://a.com/")], []) == [(1, "a.com", "/", None, "allow")]


def test_equal_digests_are_told_apart_by_the_stored_strings(spark, monkeypatch):
    monkeypatch.setattr(uf.xxhash, "xxh64_intdigest", lambda key, seed: 7)
    monkeypatch.setattr(uf.F, "xxhash64", lambda key: F.lit(7).cast("long"))
    rules = uf.build(spark, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    pages = [(n, u) for n, u in ODD if n is not None]
    split = [parts(u) for _, u in pages]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([n for n, _ in pages], pa.int64()), pa.array([h for h, _ in split]), pa.array([p for _, p in split])],
        names=["page_id", "host", "path"],
    )
    got = [tuple(r.values()) for r in next(uf._judged(iter([batch]), rules)).to_pylist()]
    assert sorted(got, key=str) == brute_force(pages, URL_RULES)


def test_a_rule_is_no_host_of_another_cut(spark):
    rules = [("com", "foo", "block"), ("net", "", "block"), ("a.net", "x", "allow"), ("a/b", "", "block"), ("c", "?x", "block")]
    pages = [(1, "http://comfoo"), (2, "http://com"), (3, "http://a.netx"), (4, "http://a.net/x"), (5, "http://b.net"), (6, "http://a/b"), (7, "http://c?x")]
    assert judged(spark, pages, rules) == brute_force(pages, rules)


def test_random_rules_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(uf, "RANGE_BYTES", 200)
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "com", "", "x"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    rules = {(host(), rng.choice(["", "a", "/", "/a", "b/", "com"])): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(*k, v) for k, v in rules.items()]
    pages = [(i, f"s://{host()}{rng.choice(['', '/', '/a', '/ab/', '?a', 'a', 'com'])}") for i in range(600)]
    assert judged(spark, pages, rules) == brute_force(pages, rules)
    assert len(uf.build(spark, spark.createDataFrame(rules, "host string, path string, verdict string")).names) > 5


def test_a_long_url_has_few_keys(spark):
    assert uf._keys("a." * 500_000 + "com", "/" * 100, {3: [1, 0], 5: [1]}) == ["a.com#/", "com#/", "com#"]
    pages = [(1, "x://" + "." * 1_000_000), (2, "x://" + "a." * 500_000 + "com/")]
    assert judged(spark, pages, URL_RULES) == brute_force(pages, URL_RULES)
