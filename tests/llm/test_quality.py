from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recollex.llm import quality_rules as qr
from recollex.llm import queries as Q

from .helpers import docs, rows


def plain(text):
    """The measures, word by word."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    held = {i + o for i, w in enumerate(windows) if often[w] > 1 for o in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held)


TEXTS = [None, "", " \t\n", "one", "a b c d e a b c d e", "a a a a a a", "x y z \x1c q", "line\nline\n \n\nline \nline", "# * $ % & | < > #*", "é " * 30, "a b c d e f a b c d e g a b c d", "w" * 100_000, "\x00 a\x00b", "a\r\na\r\na"]


def test_measures(spark):
    assert [qr.measures(t or "") for t in TEXTS] == [plain(t) for t in TEXTS]
    found = rows(qr.measure(docs(spark, TEXTS)), "doc_id", *qr.MEASURES)
    assert found == sorted(((i, *plain(t)) for i, t in enumerate(TEXTS)), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\xa0#é", max_size=120))
def test_measures_of_any_text(text):
    assert qr.measures(text) == plain(text)


def test_query_and_twin(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(con.execute(Q.OP13_SQL).fetchall())
    found = Q.op13_quality(spark, sf_dir)
    assert rows(found, *found.columns) == sorted(want, key=repr)


GOOD = "all these words differ from each other so nothing fails in this text"
BAD = "too short"


def hosts(spark, plan, start=0):
    """Documents of hosts: (host, good, bad)."""
    rows_, i = [], start
    for host, good, bad in plan:
        for text in [GOOD] * good + [BAD] * bad:
            rows_.append((i, text, "en", host, len(text)))
            i += 1
    return spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")


PLAN = [("clean", 200, 2), ("fair", 60, 10), ("awful", 5, 95), ("small", 0, 1), ("hot", 900, 30), (None, 1, 9)]


def prior(plan):
    plan = [(h, g + b, b) for h, g, b in plan if h is not None]
    n, f = sum(p[1] for p in plan), sum(p[2] for p in plan)
    m = f / n
    v = sum(k * (b / k - m) ** 2 for _, k, b in plan) / n - len(plan) * m * (1 - m) / n
    if v <= 0:
        return {h: m for h, _, _ in plan}
    s = max(m * (1 - m) / v - 1, 0)
    return {h: (b + m * s) / (k + s) for h, k, b in plan}


def test_host_rates_and_verdicts(spark):
    frame = hosts(spark, PLAN)
    rates = {r["host"]: r for r in qr.host_rates(qr.measure(frame)).collect()}
    want = prior(PLAN)
    assert set(rates) == set(want)
    for host, rate in want.items():
        assert rates[host]["rate"] == pytest.approx(rate, rel=1e-9) and rates[host]["rejected"] == (rate > 0.5)
    # One failed document tells less against a host than ninety-five.
    assert rates["awful"]["rejected"] and rates["small"]["rate"] < rates["awful"]["rate"] < 0.95
    judged = qr.judge(frame)
    kept = {(r["source"], r["base_failed"]): (r["kept"], r["count"]) for r in judged.groupBy("source", "base_failed", "kept").count().collect()}
    assert kept[("awful", False)] == (False, 5) and kept[("clean", False)] == (True, 200) and kept[(None, False)] == (True, 1)
    assert all(not k for (_, failed), (k, _) in kept.items() if failed)


def test_many_rejected_hosts_join_without_broadcast(spark, monkeypatch):
    frame = hosts(spark, PLAN)
    want = rows(qr.judge(frame), "doc_id", "kept", "host_rejected")
    monkeypatch.setattr(qr, "few", lambda *a: False)
    monkeypatch.setattr("recollex.llm.skew.HOT_ROWS", 100)
    monkeypatch.setattr("recollex.llm.skew.HOT_KEYS", 3)
    assert rows(qr.judge(frame), "doc_id", "kept", "host_rejected") == want


def test_equal_hosts_have_the_pooled_rate(spark):
    frame = hosts(spark, [("a", 9, 1), ("b", 9, 1), ("c", 18, 2)])
    assert {round(r["rate"], 9) for r in qr.host_rates(qr.measure(frame)).collect()} == {0.1}


def test_empty_tables_and_clashing_columns(spark):
    frame = docs(spark, [GOOD, None]).selectExpr("*", "1 as n_words", "true as kept", "2 as rate", "3 as host", "4 as __host", "5 as rejected", "6 as __measures")
    judged = qr.judge(frame)
    assert rows(judged, "doc_id", "n_words", "kept", "host") == [(0, 13, True, 3), (1, 0, False, 3)]
    assert len(set(judged.columns)) == len(judged.columns)
    assert qr.judge(frame.limit(0)).count() == 0
    assert qr.decide(qr.measure(frame), qr.host_rates(qr.measure(frame))).select("text").count() == 2
