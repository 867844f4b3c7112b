"""SQL twins of queries whose results take many steps to say in SQL."""

from __future__ import annotations

import numpy as np

from recollex.plans.models import BASE, DECISIONS, DOCS, EVENTS, GRAPH, MEMORIES, NOW, VECTORS
from recollex.plans.search_queries import _ANY_TERMS, _COS, _D6, _D64, _LEXLEG, _Q, _VECLEG, _I8, _I8SRC, _SCALE, _SPARSE, _TOK, POST, _bm25, _rrf

QUERIES: dict = {}

_DE = "de AS (SELECT source_uri AS from_uri, uri AS to_uri FROM decisions WHERE source_uri IS NOT NULL UNION SELECT uri, target_uri FROM decisions WHERE source_uri IS NOT NULL)"
_WEIGHT = "CASE coalesce(memory_type, 'raw') WHEN 'fact' THEN 1.20 WHEN 'decision' THEN 1.10 WHEN 'lesson' THEN 1.05 WHEN 'preference' THEN 1.15 WHEN 'episodic' THEN 0.95 ELSE 1.00 END::DOUBLE"


def _numbers(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]"


def _traverse(start: int, depth: int, top: int, decay: float) -> str:
    parts = [f"steps AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY weight DESC, to_id, rel) <= {top}), t0 AS (SELECT {start}::BIGINT AS id, 1.0::DOUBLE AS score), s0 AS (SELECT id FROM t0)"]
    for i in range(1, depth + 1):
        parts.append(f"t{i} AS (SELECT to_id AS id, max(score * weight * {decay**i!r}) AS score FROM t{i - 1} JOIN steps ON from_id = t{i - 1}.id WHERE to_id NOT IN (SELECT id FROM s{i - 1}) GROUP BY to_id), s{i} AS (SELECT id FROM s{i - 1} UNION SELECT id FROM t{i})")
    return f"WITH {GRAPH}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT id, {i} AS depth, round(score, 6) AS score FROM t{i}" for i in range(1, depth + 1))


def _labels(rounds: int) -> str:
    parts = ["b0 AS (SELECT from_id, to_id, sum(weight) AS weight FROM (SELECT from_id, to_id, weight FROM edges UNION ALL SELECT to_id, from_id, weight FROM edges) WHERE from_id <> to_id GROUP BY 1, 2), b AS (SELECT * FROM b0 UNION ALL SELECT from_id, from_id, min(weight) * 0.999 FROM b0 GROUP BY from_id), l0 AS (SELECT DISTINCT from_id AS id, from_id AS label FROM b)"]
    for i in range(rounds):
        parts.append(f"l{i + 1} AS (SELECT from_id AS id, label FROM (SELECT from_id, label, round(sum(weight), 9) AS w FROM b JOIN l{i} ON to_id = id GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY w DESC, label) = 1)")
    return f"WITH {GRAPH}, " + ", ".join(parts)


def _reached(start: str, depth: int) -> str:
    return f"{EVENTS}, {DECISIONS}, {_DE}, walk(uri, depth) AS (SELECT uri, 0 FROM (SELECT from_uri AS uri FROM de UNION SELECT to_uri FROM de) WHERE uri = '{start}' UNION SELECT to_uri, depth + 1 FROM walk JOIN de ON from_uri = uri WHERE depth + 1 < {depth})"


def _bm25_of(terms: list[str], needed: int, limit: int, name: str, idf: str = "ln(1 + (n - df + 0.5) / (df + 0.5))") -> str:
    """A ranking over the CTEs post and stat that are there already."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"{name} AS (SELECT id, sum({idf} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM post WHERE term IN ({listed})), stat GROUP BY id HAVING count(*) >= {needed} ORDER BY round(score, 9) DESC, id LIMIT {limit})"


def _batch(queries: list[tuple[int, list[str], int]], limit: int) -> str:
    parts = [_bm25_of(terms, needed, limit, f"h{qid}") for qid, terms, needed in queries]
    rows = " UNION ALL ".join(f"SELECT {qid}::BIGINT AS qid, row_number() OVER (ORDER BY round(score, 9) DESC, id)::INT AS rank, id, round(score, 6) AS score FROM h{qid}" for qid, _, _ in queries)
    return f"WITH {DOCS}, src AS (SELECT * FROM docs), {POST}, {', '.join(parts)} {rows}"


def _buckets(planes: int, seed: int, vector: str) -> str:
    normals = np.random.default_rng(seed).standard_normal((planes, 64))
    return " + ".join(f"CASE WHEN list_dot_product({vector}, {_numbers(p)}) > 0 THEN {1 << i} ELSE 0 END" for i, p in enumerate(normals))


_FDE = f"""part AS (SELECT id, {_buckets(3, 5, 'e')} AS b, e FROM tok), flat AS (SELECT id, b * 64 + i - 1 AS "at", sum(x) AS x FROM (SELECT id, b, unnest(e) AS x, unnest(range(1, 65)) AS i FROM part) GROUP BY 1, 2)"""


def _recall(hops: int) -> str:
    """Fused legs, spread over edges, weighted by type and age."""
    head = f"WITH {'RECURSIVE ' if hops else ''}{DOCS}, {VECTORS}, {GRAPH}, {MEMORIES}, {_Q}, vs AS (SELECT id, embedding FROM vectors), {_bm25(_ANY_TERMS, 1, 80)}, {_LEXLEG}, {_VECLEG.replace('LIMIT 60', 'LIMIT 80')}, base AS ({_rrf([('lex', '1.0'), ('vec', '1.0')], 80)})"
    legs = ["SELECT id, 1.0 / (60.0 + row_number() OVER (ORDER BY score DESC, id)) AS s FROM base"]
    if hops:
        head += f", steps AS (SELECT DISTINCT from_id, to_id FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY weight DESC, to_id, rel) <= 64)), walk(id, hop) AS (SELECT id, 0 FROM base UNION SELECT to_id, hop + 1 FROM walk JOIN steps ON from_id = id WHERE hop < {hops}), near AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id)"
        legs += [f"SELECT id, {0.6**h!r} / (60.0 + row_number() OVER (ORDER BY id)) FROM (SELECT id FROM near WHERE hop = {h} ORDER BY id LIMIT 200)" for h in range(1, hops + 1)]
    return f"""{head}, f AS (SELECT id, sum(s) AS score FROM ({' UNION ALL '.join(legs)}) GROUP BY id),
ty AS (SELECT doc_id AS id, memory_type, updated_ts FROM memories WHERE superseded_by IS NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_ts DESC, id DESC) = 1),
ww AS (SELECT * FROM (SELECT f.id, memory_type, f.score * {_WEIGHT} * greatest(pow(0.97, greatest(({NOW} - coalesce(updated_ts, {NOW})) / 86400.0, 0.0)), 0.3) AS score FROM f LEFT JOIN ty USING (id)) ORDER BY round(score, 12) DESC, id LIMIT 15)
SELECT ww.id, round(ww.score, 6) AS score, memory_type, uri FROM ww LEFT JOIN docs USING (id)"""


_SHARDS = ", ".join(
    _bm25(_ANY_TERMS, 1, 20, source=f"SELECT * FROM docs WHERE id % 2 = {i}", name=f"h{i}").replace("src AS", f"src{i} AS").replace("FROM src)", f"FROM src{i})").replace("w AS (SELECT id, list", f"w{i} AS (SELECT id, list").replace("FROM w)", f"FROM w{i})")
    .replace("post AS", f"post{i} AS").replace("stat AS", f"stat{i} AS").replace("FROM post ", f"FROM post{i} ").replace("live AS", f"live{i} AS").replace("FROM live, stat", f"FROM live{i}, stat{i}")
    for i in range(2)
)
_RATE = {"digit": "[0-9]", "upper": "[A-Z]", "mark": "[^0-9A-Za-z_\\s\\x0b]", "line": "\\n", "brace": "[{}\\[\\]<>]"}
_NOISE = ", ".join(f"(len(regexp_extract_all(text, '{p}')) / nn) AS {k}" for k, p in _RATE.items())
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, (strlen(w) + 1)), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::INT, 2))::INT::HUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_EST = "CASE WHEN text = '' THEN 0 ELSE greatest(ceil(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) * 13 / 10)::BIGINT + len(regexp_extract_all(text, '[^\\p{L}\\p{N}_\\s\\x0b]+')), ceil(length(text) / 3)::BIGINT, 1) END"
_WORDS3 = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 2))"

ORACLE_SQL = {
    "gr5_traverse": _traverse(1, 3, 5, 0.8),
    "gr12_communities": f"{_labels(5)} SELECT id, label FROM l5",
    "sl10_community_sizes": f"{_labels(5)} SELECT label, count(*) AS members FROM l5 GROUP BY label",
    "gr21_supersession": "WITH RECURSIVE s AS (SELECT doc_id AS a, CASE WHEN doc_id = 150 THEN 140 ELSE doc_id + 1 END AS b FROM documents WHERE doc_id % 120 <> 119), walk(id, current, path, n) AS (SELECT a, b, [a, b], 1 FROM s UNION ALL SELECT id, b, list_append(path, b), n + 1 FROM walk JOIN s ON a = current WHERE NOT list_contains(path, b)) SELECT id, arg_max(current, n) AS current FROM walk GROUP BY id",
    "gr8_dot": f"WITH RECURSIVE {_reached('mem://5', 3)}, l AS (SELECT DISTINCT '  \"' || from_uri || '\" -> \"' || to_uri || '\" [label=\"caused\"];' AS line FROM de WHERE from_uri IN (SELECT uri FROM walk) AND to_uri IN (SELECT uri FROM walk)) SELECT 'digraph g {{' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY line), '') || chr(10) || '}}' AS text FROM l",
    "aj9_graph_json": f"WITH {GRAPH}, t AS (SELECT to_id, rel, (weight * 10)::INT AS w FROM edges WHERE from_id = 5 ORDER BY weight DESC, to_id LIMIT 10) SELECT '[' || string_agg('{{\"to_id\":' || to_id || ',\"rel\":\"' || rel || '\",\"w\":' || w || '}}', ',' ORDER BY to_id, rel, w) || ']' AS json FROM t",
    "aj10_ud5_table_functions": f"""WITH RECURSIVE {GRAPH}, walk(id, depth) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT e.to_id, w.depth + 1 FROM walk w JOIN edges e ON e.from_id = w.id WHERE w.depth < 8),
h AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id), o AS (SELECT from_id AS id, count(*) AS n_out FROM edges GROUP BY 1), i AS (SELECT to_id AS id, count(*) AS n_in FROM edges GROUP BY 1)
SELECT o.id, n_out, coalesce(n_in, 0) AS n_in, coalesce(h.depth, -1) AS depth FROM o LEFT JOIN i ON i.id = o.id LEFT JOIN h ON h.id = o.id""",
    "aj10_graph_views": f"WITH {GRAPH} SELECT from_id, count(*) AS n, count(*) AS edges FROM edges GROUP BY from_id",
    "sl15_search_batch": _batch([(1, _ANY_TERMS, 1), (2, ["eringble", "the"], 2), (3, ["nichtch"], 1)], 10),
    "jn24_shard_fanout": f"WITH {DOCS}, {_SHARDS}, r AS (SELECT uri, row_number() OVER (ORDER BY score DESC, uri) AS rank FROM h0 JOIN docs USING (id) UNION ALL SELECT uri, row_number() OVER (ORDER BY score DESC, uri) FROM h1 JOIN docs USING (id)) SELECT uri, round(sum(1 / (60.0 + rank)), 6) AS score FROM r GROUP BY uri ORDER BY round(sum(1 / (60.0 + rank)), 12) DESC, uri LIMIT 20",
    "xt1_search_hybrid_where": f"WITH {DOCS}, {_Q}, {_bm25(_ANY_TERMS, 1, 30, source="SELECT * FROM docs WHERE lang = 'en'")}, vs AS (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id IN (SELECT id FROM src)), {_LEXLEG}, {_VECLEG.replace('LIMIT 60', 'LIMIT 30')}, f AS ({_rrf([('lex', '1.0'), ('vec', '1.0')], 10)}) SELECT id, round(score, 6) AS score FROM f",
    "wn7_space_rrf": f"WITH {DOCS}, {_Q}, {_bm25(_ANY_TERMS, 1, 10, source="SELECT * FROM docs WHERE source = 'src3'")}, vs AS (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id IN (SELECT id FROM src)), {_LEXLEG}, {_VECLEG.replace('LIMIT 60', 'LIMIT 30')}, f AS ({_rrf([('lex', '1.0'), ('vec', '1.0')], 10)}) SELECT id, round(score, 6) AS score FROM f",
    "wn5_rrf_two": f"WITH {VECTORS}, {_Q}, a AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank FROM (SELECT id, {_COS} AS d FROM vectors, q ORDER BY round(d, 9), id LIMIT 30)), b AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS rank FROM ({_I8SRC.format(i8=_I8, a=_SCALE.format('embedding'), b=_SCALE.format('q'), src='vectors')} ORDER BY round(d, 9) DESC, id LIMIT 30)) SELECT id, round(sum(1.0 / (20.0 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id",
    "jn17_vs26_consolidate": f"WITH {VECTORS}, b AS (SELECT id, {_D64} AS e, {_buckets(8, 3, _D64)} AS bucket FROM vectors), p AS (SELECT a.id AS keep, b.id AS drop, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM b a JOIN b ON a.bucket = b.bucket AND a.id < b.id) SELECT keep, drop, round(c, 6) AS cosine FROM p WHERE c > 0.3",
    "ag24_vs23_bucket_sums": f"WITH {_TOK}, {_FDE}, n AS (SELECT id, sqrt(sum(x * x)) AS l FROM flat GROUP BY id) SELECT id, \"at\"::INT AS \"at\", round(x / l, 6) AS x FROM flat JOIN n USING (id) WHERE abs(x / l) > 1e-12",
    "vs22_late_two_stage": f"WITH {_TOK}, {_FDE}, n AS (SELECT id, sqrt(sum(x * x)) AS l FROM flat GROUP BY id), u AS (SELECT id, \"at\", x / l AS x FROM flat JOIN n USING (id)), qt AS (SELECT * FROM tok WHERE id = 3 AND token < 5), qp AS (SELECT {_buckets(3, 5, 'e')} AS b, e FROM qt), qf AS (SELECT b * 64 + i - 1 AS \"at\", sum(x) AS x FROM (SELECT b, unnest(e) AS x, unnest(range(1, 65)) AS i FROM qp) GROUP BY 1), ql AS (SELECT sqrt(sum(x * x)) AS l FROM qf), near AS (SELECT u.id, sum(u.x * qf.x / ql.l) AS s FROM u JOIN qf USING (\"at\"), ql GROUP BY u.id), pool AS (SELECT n.id FROM n LEFT JOIN near USING (id) ORDER BY round(-coalesce(s, 0), 9), n.id LIMIT 20) SELECT id, round(sum(best), 6) AS score FROM (SELECT a.id, b.token, max(list_dot_product(a.e, b.e)) AS best FROM tok a JOIN pool USING (id), qt b GROUP BY 1, 2) GROUP BY id ORDER BY round(sum(best), 9) DESC, id LIMIT 5",
    "vs24_full_fusion": f"WITH {VECTORS}, {_Q}, {_TOK}, {_SPARSE}, d AS (SELECT id, row_number() OVER (ORDER BY d, id) AS rank FROM (SELECT id, {_COS} AS d FROM vectors, q ORDER BY round(d, 9), id LIMIT 100)), sx AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT id, sum(weight * CASE term WHEN 'eringble' THEN 1.0 ELSE 0.5 END) AS s FROM sp WHERE term IN ('eringble', 'thined') GROUP BY id ORDER BY round(s, 9) DESC, id LIMIT 100)), pool AS ({_rrf([('d', '1.0'), ('sx', '1.0')], 50)}) SELECT id, round(sum(best), 6) AS score FROM (SELECT a.id, b.token, max(list_dot_product(a.e, b.e)) AS best FROM tok a JOIN pool USING (id), tok b WHERE b.id = 0 AND b.token < 4 GROUP BY 1, 2) GROUP BY id ORDER BY round(sum(best), 9) DESC, id LIMIT 10",
    "vs12_ma9_rotated_signs": f"WITH {VECTORS}, {_Q}, e AS (SELECT id, {_D64} AS e FROM vectors UNION ALL SELECT -1, list_transform(q, lambda x: x::DOUBLE) FROM q), r AS (SELECT id, e, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, 64), lambda j: e[j + 1] * CASE WHEN bit_count((i & j)::BIGINT) % 2 = 1 THEN -1 ELSE 1 END * CASE WHEN ((j * 39816536415::BIGINT) >> 16) & 1 = 1 THEN -1 ELSE 1 END)) / 8) AS t FROM e), s AS (SELECT a.id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.t[i] >= 0 THEN b.t[i] ELSE -b.t[i] END)) * sqrt(list_dot_product(a.e, a.e)) / 8 AS est FROM r a, r b WHERE a.id >= 0 AND b.id = -1 ORDER BY round(est, 9) DESC, id LIMIT 200) SELECT id, {_D6} AS distance FROM (SELECT id, {_COS} AS d FROM vectors, q WHERE id IN (SELECT id FROM s)) ORDER BY round(d, 9), id LIMIT 10",
    "pf14_noise_learned": f"WITH t AS (SELECT doc_id AS id, text, greatest(length(text), 1)::DOUBLE AS nn, list_filter(regexp_split_to_array(text, '[\\s\\x0b]+'), lambda w: w <> '') AS ws FROM documents), f AS (SELECT id, text, nn, greatest(len(ws), 1)::DOUBLE AS c, len(list_distinct(ws)) AS dist, {_NOISE} FROM t), z AS (SELECT id, -0.5 + 0.1 * ln(1 + nn) - 0.2 * ln(1 + c) + 0.05 * nn / c + dist / c + 2 * digit - upper + 0.5 * mark + 0.3 * line + 0.2 * brace + 0.7 * regexp_matches(text, 'https?://')::INT - 0.4 * regexp_matches(text, '[.!?][\\s\\x0b]*$')::INT AS z FROM f) SELECT id, round(1 / (1 + exp(-z)), 6) AS p FROM z",
    "ag11_health": f"WITH {DOCS}, {VECTORS}, {MEMORIES}, c AS (SELECT 'empty_text' AS \"check\", count(*) AS n FROM docs WHERE text IS NULL OR trim(text) = '' UNION ALL SELECT 'duplicate_text', count(*) FROM (SELECT sha256(text) FROM docs GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'without_vector', count(*) FROM docs WHERE id NOT IN (SELECT id FROM vectors) UNION ALL SELECT 'memory_without_document', count(*) FROM memories WHERE doc_id NOT IN (SELECT id FROM docs)) SELECT \"check\", n, n = 0 AS ok FROM c",
    "ag16_gate": "WITH g AS (SELECT doc_id AS q FROM documents), m AS (SELECT q, i + 1 AS rank, q % 9 = i AS hit, q % 9 + 1 = i AS other FROM g, (SELECT unnest(range(0, 7)) AS i)), p AS (SELECT q, max((hit AND rank <= 5)::INT) AS r0, max((other AND rank <= 5)::INT) AS r1, min(CASE WHEN hit THEN rank END) AS f0, min(CASE WHEN other THEN rank END) AS f1, sum((rank <= 5)::INT) AS shown, sum((rank <= 5 AND NOT hit)::INT) AS w0, sum((rank <= 5 AND NOT other)::INT) AS w1 FROM m GROUP BY q), a AS (SELECT avg(r0) AS r0, avg(r1) AS r1, avg(coalesce(1 / f0, 0)) AS m0, avg(coalesce(1 / f1, 0)) AS m1, sum(w0) / sum(shown) AS e0, sum(w1) / sum(shown) AS e1, count(*) AS n FROM p) SELECT r1 > r0 AND m1 > m0 AND e1 < e0 AND n >= 10 AS passed FROM a",
    "ag19_drift": f"WITH c AS (SELECT avg(list_cosine_similarity({_D64}, list_transform(embedding, lambda x: (x * 2)::DOUBLE))) AS m FROM embeddings) SELECT round(m, 6) AS mean_cosine, CASE WHEN m >= 0.98 THEN 'ok' WHEN m >= 0.9 THEN 'warn' ELSE 'error' END AS status FROM c",
    "ag26_wn14_libsvm": f"WITH {EVENTS}, q AS (SELECT kind, row_number() OVER (ORDER BY kind) AS qid FROM (SELECT DISTINCT kind FROM ev)) SELECT printf('%d qid:%d 1:%.6f 2:%.6f 3:%d 4:%.6f', (event_id % 4 = 0)::INT, qid, event_id % 10 / 10.0::DOUBLE, event_id % 7 / 7.0::DOUBLE, event_id % 5, event_id % 3 / 3.0::DOUBLE) AS line FROM ev JOIN q USING (kind)",
    "cx6_session_replay": f"SELECT session_id, turn, used FROM (SELECT conv_id::VARCHAR AS session_id, turn, sum({_EST}) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations) WHERE used <= 100",
    "cx7_ft7_index_in_scope": f"WITH {DOCS}, i AS (SELECT *, lower(concat_ws(' ', title, text)) AS t FROM docs WHERE starts_with(uri, 'src1')), p AS (SELECT * FROM (SELECT * FROM i WHERE contains(t, 'eringble') OR contains(t, 'thined') ORDER BY id DESC LIMIT 240) UNION SELECT * FROM (SELECT * FROM i ORDER BY ts DESC, id DESC LIMIT 240)) SELECT id, contains(t, 'eringble thined')::BIGINT * 1000000 + (contains(t, 'eringble')::BIGINT + contains(t, 'thined')::BIGINT) * 10000 + id AS score FROM p ORDER BY score DESC, id DESC LIMIT 20",
    "so5_sf9_simhash": f"WITH w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '')) AS w FROM documents), h AS (SELECT w, {_FNV}::UBIGINT AS h FROM (SELECT DISTINCT w FROM w)), b AS (SELECT id, bit, 2 * sum(((h >> bit) & 1)::INT) > count(*) AS s FROM w JOIN h USING (w), (SELECT unnest(range(0, 64))::UBIGINT AS bit) GROUP BY 1, 2), f AS (SELECT id, sum(CASE WHEN s THEN (1::HUGEINT << bit::INT) ELSE 0 END)::HUGEINT AS f FROM b GROUP BY id) SELECT d.doc_id AS id, (CASE WHEN coalesce(f, 0) >= 9223372036854775808::HUGEINT THEN f - 18446744073709551616::HUGEINT ELSE coalesce(f, 0) END)::BIGINT AS simhash FROM documents d LEFT JOIN f ON d.doc_id = f.id",
    "sf13_decompose": "WITH c AS (SELECT conv_id * 1000 + turn AS id, role || ' vs ' || text AS t, lower(role || ' vs ' || text) AS l FROM conversations) SELECT id, array_to_string(list_filter(CASE WHEN strpos(l, ' after ') > 0 THEN [trim(substr(t, 1, strpos(l, ' after ') - 1)), trim(substr(t, strpos(l, ' after ') + 7))] WHEN strpos(l, ' before ') > 0 THEN [trim(substr(t, 1, strpos(l, ' before ') - 1)), trim(substr(t, strpos(l, ' before ') + 8))] WHEN strpos(l, ' and then ') > 0 THEN [trim(substr(t, 1, strpos(l, ' and then ') - 1)), trim(substr(t, strpos(l, ' and then ') + 10))] WHEN strpos(l, ' while ') > 0 THEN [trim(substr(t, 1, strpos(l, ' while ') - 1)), trim(substr(t, strpos(l, ' while ') + 7))] WHEN strpos(l, ' vs ') > 0 THEN [trim(substr(t, 1, strpos(l, ' vs ') - 1)), trim(substr(t, strpos(l, ' vs ') + 4))] WHEN strpos(l, ' versus ') > 0 THEN [trim(substr(t, 1, strpos(l, ' versus ') - 1)), trim(substr(t, strpos(l, ' versus ') + 8))] ELSE [trim(t)] END, lambda p: p <> ''), '|') AS parts FROM c",
    "sf10_compress_facts": "WITH t AS (SELECT doc_id AS id, string_split(text, chr(10)) AS l FROM documents) SELECT id, length(array_to_string(list_filter(l, lambda x: regexp_matches(x, '[0-9]|:|=') OR regexp_matches(x, '(?i)(^|[^0-9A-Za-z_À-ɏß-ÿ])(is|are|was|must|should|never|always)($|[^0-9A-Za-z_À-ɏß-ÿ])')), chr(10)))::INT AS n, list_max(list_transform(l, lambda x: length(trim(x))))::INT AS m FROM t",
    "mm5_recall": _recall(0),
    "mm5_recall_hops": _recall(2),
}
