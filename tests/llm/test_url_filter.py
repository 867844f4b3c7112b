import re

from recollex.llm import url_filter as uf

from .helpers import rows

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "org", "/fr/x"), ("allow", "org", ""), ("block", "a.org", "/"), ("allow", "a.org", "/")]


def brute(url, rules=RULES, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = re.split("[?#]", rest)[0]
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = slash + path
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [
    "http://example.net/en/1", "https://A.Example.NET/en/", "http://example.net/de/1", "http://net/", "http://net", "http://xnet/", "ftp://b.example.com/de/?q=1", "http://example.com/en/de/", "http://org/fr/", "http://org/fr/xyz#t",
    "http://org/fr", "http://sub.a.org/fr/x", "http://a.org?x=/fr/", "http://a.org#://b", "no scheme", "://", "http://", "", None, "http://net:80/", "http://example.net/en/\U0010ffff", "http://ÄB.org/ö", "http://.net/", "x://org//", "http://a.b.c.d.e.f.net/" + "p" * 5000,
]


def test_matches_brute_force(spark):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    found = rows(uf.match(frame, uf.rules_frame(spark, RULES)), "page_id", "host", "path", "rule", "verdict")
    assert found == sorted(((i, *brute(u)) for i, u in enumerate(URLS * 2)), key=repr)


def test_hot_domain_is_sliced_and_whole(spark):
    frame = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 7, '.org/', case when id % 2 = 0 then 'fr/x' else 'fr/' end, id) as url")
    found = uf.match(frame, uf.rules_frame(spark, RULES)).groupBy("rule").count().collect()
    assert {(r["rule"], r["count"]) for r in found} == {("org/fr/x", 1500), ("org/fr/", 1500)}


def test_long_hosts_and_long_rule_paths(spark):
    many = "http://" + "a." * 100_000 + "a.org/fr/x"
    deep = "/" + "p/" * 5_000
    rules = [*RULES, ("block", "deep.net", deep), ("allow", "deep.net", deep[:5000]), ("block", "deep.net", deep + "q"), ("block", ".".join("abcdefgh" * 40) + ".org", "/")]
    urls = [many, "http://deep.net" + deep, "http://deep.net" + deep[:-2], "http://deep.net" + deep + "q/r", "http://deep.net/p", "http://x." + ".".join("abcdefgh" * 40) + ".org/z", "http://" + "." * 50_000 + "net/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = rows(uf.match(frame, uf.rules_frame(spark, rules)), "page_id", "rule", "verdict")
    assert found == sorted(((i, *brute(u, rules)[2:]) for i, u in enumerate(urls)), key=repr)


def test_nested_and_neighbouring_rules(spark):
    rules = [("block", "n.net", p) for p in ("/", "/a", "/ab", "/abc", "/b", "/ba", "/a/", "/a/x", "/\U0010ffff", "/\U0010fffe")] + [("allow", "n.net", p) for p in ("/abcd", "/ac", "/c")]
    urls = [f"http://n.net{p}{t}" for _, _, p in rules for t in ("", "z", "/", "\U0010ffff")]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = rows(uf.match(frame, uf.rules_frame(spark, rules)), "page_id", "rule", "verdict")
    assert found == sorted(((i, *brute(u, rules)[2:]) for i, u in enumerate(urls)), key=repr)


def test_empty_tables_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "http://net/")], "page_id long, url string").selectExpr("*", "5 as domain", "6 as slice", "7 as top", "8 as rule", "9 as verdict", "10 as host", "11 as found")
    assert rows(uf.match(frame, uf.rules_frame(spark, RULES)), "page_id", "verdict") == [(1, "block")]
    assert uf.match(frame.limit(0), uf.rules_frame(spark, RULES)).count() == 0
    assert rows(uf.match(frame, uf.rules_frame(spark, RULES).limit(0)), "rule", "verdict") == [(None, "allow")]


def test_plan_is_native(spark):
    frame = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    frame.write.mode("overwrite").format("noop").save()
    plan = uf.match(spark.range(5).selectExpr("id as page_id", "'http://a.net/' as url"), uf.rules_frame(spark, RULES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
