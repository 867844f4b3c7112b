"""Keys that hold much of the rows give the same results as others, whichever way they are joined."""

import pytest

from recollex.llm import simhash as sh
from recollex.llm import skew, url_filter
from recollex.llm import queries as Q

from .helpers import docs, rows


@pytest.fixture
def all_hot(monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    monkeypatch.setattr(skew, "HOT_KEYS", 1000)


def test_hot_and_cold_keys_meet_their_facts(spark, all_hot):
    left = spark.createDataFrame([(0 if i < 60 else i % 9, i) for i in range(100)] + [(99, -1)], "k long, i long")
    facts = left.filter("k <> 99").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 10 as f")
    found = skew.join_facts(left, facts, ["k"], total=101, n="n")
    assert rows(found, "k", "i", "f") == rows(left.join(facts, "k"), "k", "i", "f") and found.count() == 100
    assert skew.join_facts(left, facts, ["k"], total=2, n="n").count() == 100


def test_copies_of_a_url_and_urls_without_host(spark, all_hot, monkeypatch):
    urls = ["http://a.example.net/en/x"] * 30 + ["http://example.com/de/"] * 10 + ["no host"] * 20 + [None] * 5 + [f"https://h{i}.org/fr/{i}" for i in range(9)] + ["x://EXAMPLE.net/EN/" + "y" * 5000]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as n", "'z' as domain", "'q' as rule")
    match = lambda: rows(url_filter.match(frame, url_filter.rules_frame(spark, Q.URL_RULES)), "page_id", "host", "path", "rule", "verdict", "n", "domain")
    hot = match()
    monkeypatch.setattr(url_filter, "BROADCAST_DOMAINS", 0)
    assert match() == hot and len(hot) == len(urls)
    assert {(r[3], r[4]) for r in hot if r[0] < 30} == {("example.net/en/", "allow")} and {(r[3], r[4]) for r in hot if 40 <= r[0] < 65} == {(None, "allow")}


def test_boilerplate_fingerprints(spark, monkeypatch):
    texts = [""] * 20 + ["the same words again and again here"] * 20 + [f"text number {i} alone with its own words {i * 7}" for i in range(15)]
    frame = docs(spark, texts)
    plain = rows(sh.near_duplicates(frame), "doc_id", "fingerprint", "component_id")
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    monkeypatch.setattr(skew, "HOT_KEYS", 1000)
    assert rows(sh.near_duplicates(frame), "doc_id", "fingerprint", "component_id") == plain
