import re

import numpy as np
import xxhash

from recollex.llm import queries as Q
from recollex.llm import simhash as sh

from .helpers import docs


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, radius=4):
    """Smallest key reachable over links, for {key: fingerprint}."""
    keys, root = list(fps), {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprints_match_the_definition():
    for text in [None, "", " \t\n", "One", "a b c", "a b c d", "A b\x0bC d\x0ce É é e", "x y " * 50, "ÄÖ ß z q r s t"]:
        assert sh.fingerprint(text or "") == brute_fingerprint(text)


def test_close_pairs_match_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    flips = base ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), False)) for _ in base], np.uint64)
    for fps in (np.unique(np.concatenate([base, flips])), base[:1], np.array([0, 2**64 - 1, 1], np.uint64)):
        for radius in (0, 3, 4, 6):
            i, j = sh.close_pairs(fps, radius)
            want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if bin(int(fps[a] ^ fps[b])).count("1") <= radius}
            assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_links_lose_nothing_with_hot_keys(spark):
    rng = np.random.default_rng(2)
    # A ball of near copies around one fingerprint overfills its block keys.
    centre = int(rng.integers(0, 2**62))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), False)) for _ in range(400)} | {int(x) for x in rng.integers(0, 2**62, 300)}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components({s: int(np.int64(s).view(np.uint64)) for s in signed})
    from recollex.llm.components import components

    for blocks in (6, 7, 8):
        found = {r["node"]: r["component"] for r in components(sh.links(frame, blocks=blocks, tile=32)).collect()}
        groups = {}
        for s in signed:
            groups.setdefault(want[s], set()).add(found.get(s, s))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    from recollex.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (5, 5)], "src long, dst long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert all(found[i] == 0 for i in range(101)) and found[201] == 200


def test_odd_rows(spark):
    frame = docs(spark, ["", None, "a b c d e f", "a b c d e f", "zz"]).union(docs(spark, ["a b c d e f"], start=2)).unionByName(spark.createDataFrame([(None, "zz", "en", "s", 2)], docs(spark, []).schema)).selectExpr("*", "1 as fp", "2 as component_id")
    found = {(r["doc_id"], r["component_id"], r["fingerprint"]) for r in sh.near_duplicates(frame).collect()}
    assert {(a, b) for a, b, _ in found} == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (None, 4)}
    assert all(len(f) == 16 for *_, f in found) and sh.near_duplicates(frame).count() == 7
    assert sh.near_duplicates(docs(spark, [])).count() == 0


def test_query_matches_brute_force(spark, sf_dir):
    table = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {k: brute_fingerprint(t) for k, t in table.items()}
    want = brute_components(fps)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op2_simhash(spark, sf_dir).collect()}
    assert found == {k: (f"{fps[k]:016x}", want[k]) for k in table}
