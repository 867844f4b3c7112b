"""Causal maps: laws of merging on random histories, and what survives what."""

import random

import pytest

from recollex.operators import causal as cr


def entries(replica):
    return {(r["uri"], r["key"], r["value"], r["actor"], r["n"]) for r in replica.entries.collect()}


def context(replica):
    return {(r["actor"], r["first"], r["last"]) for r in replica.context.collect()}


def state(replica):
    return entries(replica), context(replica)


def rows(spark, found):
    return spark.createDataFrame(found, "uri string, key string, value string")


class Plain:
    """The same by sets of dots."""

    def __init__(self, live=(), seen=()):
        self.live, self.seen = dict(live), set(seen)

    def put(self, found, actor):
        n = max([k for a, k in self.seen if a == actor], default=0)
        for (uri, key), value in sorted({(u, k): v for u, k, v in sorted(found)}.items()):
            n += 1
            self.live = {d: e for d, e in self.live.items() if e[:2] != (uri, key)} | {(actor, n): (uri, key, value)}
            self.seen.add((actor, n))

    def remove(self, keys):
        self.live = {d: e for d, e in self.live.items() if e[:2] not in keys}

    def merge(self, other):
        live = {d: e for d, e in self.live.items() if d in other.live or d not in other.seen} | {d: e for d, e in other.live.items() if d in self.live or d not in self.seen}
        return Plain(live, self.seen | other.seen)

    def state(self):
        runs, last = set(), {}
        for a, n in sorted(self.seen):
            if a in last and last[a][1] == n - 1:
                last[a][1] = n
            else:
                if a in last:
                    runs.add((a, *last[a]))
                last[a] = [n, n]
        runs |= {(a, *x) for a, x in last.items()}
        return {(*e, *d) for d, e in self.live.items()}, runs


def history(spark, seed, steps=7):
    """Three replicas after random puts, removals and one-sided merges, and the same in plain sets."""
    rng = random.Random(seed)
    real, plain = [cr.empty(spark) for _ in range(3)], [Plain() for _ in range(3)]
    for step in range(steps):
        i, j = rng.randrange(3), rng.randrange(3)
        pick = [(f"u{rng.randrange(3)}", f"k{rng.randrange(2)}", f"v{step}-{n}") for n in range(rng.randrange(1, 4))]
        what = rng.choice(["put", "put", "remove", "merge"])
        if what == "put":
            real[i] = cr.put(real[i], rows(spark, pick), f"actor{i}")
            plain[i].put(pick, f"actor{i}")
        elif what == "remove":
            real[i] = cr.remove(real[i], rows(spark, pick).select("uri", "key"))
            plain[i].remove({p[:2] for p in pick})
        else:
            real[i], plain[i] = cr.merge(real[i], real[j]), plain[i].merge(plain[j])
        real[i] = real[i].kept()
    return real, plain


@pytest.mark.parametrize("seed", range(4))
def test_laws_of_merging(spark, seed):
    (a, b, c), (pa, pb, pc) = history(spark, seed)
    assert [state(x) for x in (a, b, c)] == [x.state() for x in (pa, pb, pc)]
    ab = cr.merge(a, b).kept()
    assert state(ab) == pa.merge(pb).state() == state(cr.merge(b, a))
    assert state(cr.merge(ab, c)) == state(cr.merge(a, cr.merge(b, c).kept()))
    assert state(cr.merge(a, a)) == state(a) and state(cr.merge(ab, a)) == state(ab)


def test_a_put_survives_a_removal_that_did_not_see_it(spark):
    base = cr.put(cr.empty(spark), rows(spark, [("d", "tag", "old"), ("e", "tag", "stays")]), "x").kept()
    writer = cr.put(base, rows(spark, [("d", "tag", "new")]), "y")
    remover = cr.remove(base, rows(spark, [("d", "tag", "")]).select("uri", "key"))
    assert {(e[0], e[2]) for e in entries(cr.merge(writer, remover))} == {("d", "new"), ("e", "stays")}
    # A removal that saw the put takes it away for good.
    knowing = cr.remove(cr.merge(writer, base), rows(spark, [("d", "", "")]).select("uri"))
    assert {e[0] for e in entries(cr.merge(knowing, writer))} == {"e"}


def test_concurrent_puts_are_siblings_until_one_has_seen_both(spark):
    base = cr.empty(spark)
    one, two = cr.put(base, rows(spark, [("d", "k", "1")]), "x"), cr.put(base, rows(spark, [("d", "k", "2")]), "y")
    both = cr.merge(one, two).kept()
    found = cr.read(both).collect()
    assert [(r["value"], r["siblings"]) for r in found] == [("2", ["1", "2"])]
    settled = cr.put(both, rows(spark, [("d", "k", "3")]), "x")
    assert [r["siblings"] for r in cr.read(cr.merge(settled, two)).collect()] == [["3"]]


def test_odd_rows(spark):
    r = cr.put(cr.empty(spark), rows(spark, [(None, "k", "v"), ("u", None, "v"), ("u", "k", None), ("u", "k", "a"), ("u", "k", "b")]), "x")
    assert entries(r) == {("u", "k", "b", "x", 1)} and context(r) == {("x", 1, 1)}
    assert state(cr.put(r, rows(spark, []), "x")) == state(r)
    assert state(cr.merge(cr.empty(spark), cr.empty(spark))) == (set(), set())


OP = "actor string, seq long, kind string, doc_id long, payload string, seen map<string,bigint>"


def test_survivors_of_a_log(spark):
    ops = [
        ("a", 1, "put", 1, "first", {}), ("b", 1, "put", 1, "over", {"a": 1}), ("c", 1, "put", 1, "beside", {"a": 1}),
        ("a", 2, "put", 2, "kept", None), ("b", 2, "delete", 2, None, {"a": 1}), ("a", 3, "put", 3, "gone", {}), ("c", 2, "delete", 3, None, {"a": 3}),
        ("a", 4, "put", 4, "own", {}), ("a", 5, "put", 4, "own later", {}), ("a", 5, "put", 4, "own later", {}),
    ]
    found = {(r["doc_id"], tuple(r["payloads"])) for r in cr.siblings(spark.createDataFrame(ops, OP)).collect()}
    assert found == {(1, ("beside", "over")), (2, ("kept",)), (4, ("own later",))}
    rng = random.Random(7)
    log = [(f"a{rng.randrange(3)}", n, rng.choice(["put", "put", "delete"]), rng.randrange(6), f"p{n}", {f"a{i}": rng.randrange(60) for i in range(3)}) for n in range(1, 60)]
    live = set()
    for a, n, kind, d, p, _ in log:
        hidden = any(d == e and (m > n if b == a else (s or {}).get(a, 0) >= n) for b, m, _, e, _, s in log)
        if kind == "put" and not hidden:
            live.add((a, n, d, p))
    got = cr.survivors(spark.createDataFrame(log, OP))
    assert {(r["actor"], r["seq"], r["doc_id"], r["payload"]) for r in got.collect()} == live
