"""The same rows in DuckDB's SQL. Permutations are inlined as constants."""

from __future__ import annotations

import zlib

from pyspark.sql import SparkSession

from ..functions.hashing import permutations
from ..functions.params import RATIOS
from ..operators.hll import HllSpec, bias_tables
from ..operators.lsh import EnsembleSpec, LshSpec
from ..operators.minhash import BBitSpec

NUM_PERM, TREES = 128, 8
LSH = LshSpec(0.5, NUM_PERM)
ENSEMBLE = EnsembleSpec(0.5, NUM_PERM, 16, 8)


def _signature(table: str, key: str, name: str, tokens: str = "") -> str:
    a, b = permutations(NUM_PERM, 1)
    perms = ", ".join(f"({i}, {int(x)}::HUGEINT, {int(y)}::HUGEINT)" for i, (x, y) in enumerate(zip(a, b)))
    tokens = tokens or f"SELECT DISTINCT {key}, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '')) AS t FROM {table}"
    return f"""{name}_t AS MATERIALIZED ({tokens}),
{name}_d AS (SELECT t, sha1(t) AS d FROM (SELECT DISTINCT t FROM {name}_t)),
{name}_v AS (SELECT t, ('0x' || substr(d, 7, 2) || substr(d, 5, 2) || substr(d, 3, 2) || substr(d, 1, 2))::UBIGINT::HUGEINT AS h FROM {name}_d),
{name}_p(i, a, b) AS (VALUES {perms}),
{name}_x AS MATERIALIZED (SELECT t, i, ((((a * h + b) % 18446744073709551616::HUGEINT) % 2305843009213693951::HUGEINT) % 4294967296::HUGEINT)::BIGINT AS v FROM {name}_v, {name}_p),
{name} AS MATERIALIZED (SELECT k.{key}, i AS pos, coalesce(value, 4294967295) AS value FROM (SELECT {key} FROM {table}) k CROSS JOIN (SELECT i FROM {name}_p) LEFT JOIN (SELECT {key}, i, min(v) AS value FROM {name}_t JOIN {name}_x USING (t) GROUP BY ALL) m USING ({key}, i))"""


def _tokens(table: str, key: str) -> str:
    return f"""t AS MATERIALIZED (SELECT DISTINCT {key}, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '')) AS t FROM {table})"""


def sql() -> dict[str, str]:
    b, r = LSH.b, LSH.r
    sig = _signature("documents", "doc_id", "s")
    bands = f"bands AS MATERIALIZED (SELECT doc_id, (pos // {r})::INTEGER AS band, string_agg(value::VARCHAR, ',' ORDER BY pos) AS slice FROM s WHERE pos < {b * r} GROUP BY doc_id, pos // {r})"
    head = f"WITH {sig}, {bands}"
    found = "found AS MATERIALIZED (SELECT DISTINCT q.doc_id AS query_id, x.doc_id FROM bands q JOIN bands x USING (band, slice) WHERE q.doc_id % 50 = 0)"
    pairs = f"{head}, {found}, pr AS (SELECT query_id, f.doc_id, x.pos, x.value AS x, y.value AS y FROM found f JOIN s x ON x.doc_id = query_id JOIN s y ON y.doc_id = f.doc_id AND y.pos = x.pos WHERE query_id <> f.doc_id)"
    counted = f"round({NUM_PERM}.0 / sum(value / 4294967295.0::DOUBLE) - 1.0, 6)"
    sizes = "z AS (SELECT doc_id, count(t) AS n FROM (SELECT doc_id FROM documents) d LEFT JOIN s_t USING (doc_id) GROUP BY doc_id)"
    exact = "SELECT f.query_id, f.doc_id, count(y.t) AS same FROM {f} f JOIN s_t x ON x.doc_id = f.query_id LEFT JOIN s_t y ON y.doc_id = f.doc_id AND y.t = x.t WHERE f.query_id <> f.doc_id GROUP BY ALL"
    ranked = "j AS (SELECT e.query_id, e.doc_id, e.same / (a.n + c.n - e.same) AS jaccard FROM e JOIN z a ON a.doc_id = e.query_id JOIN z c ON c.doc_id = e.doc_id), rk AS (SELECT query_id, doc_id, round(jaccard, 6) AS jaccard, (row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, doc_id))::INTEGER AS rank FROM j QUALIFY rank <= 10)"
    topk = f"{head}, {found}, {sizes}, e AS ({exact.format(f='found')}), {ranked}"
    k = NUM_PERM // TREES
    forest = f"""{head}, tr AS MATERIALIZED (SELECT doc_id, pos // {k} AS tree, list(value ORDER BY pos) AS hv FROM s WHERE pos < {k * TREES} GROUP BY ALL),
m AS (SELECT q.doc_id AS query_id, x.doc_id, max(CASE {' '.join(f'WHEN q.hv[{i + 1}] <> x.hv[{i + 1}] THEN {i}' for i in range(k))} ELSE {k} END) AS depth FROM tr q JOIN tr x ON q.tree = x.tree AND q.hv[1] = x.hv[1] WHERE q.doc_id % 50 = 0 GROUP BY ALL)"""
    top = lambda n: f"ft AS (SELECT query_id, doc_id, depth::INTEGER AS depth FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY depth DESC, doc_id) <= {n})"
    spec = HllSpec(8)
    m = spec.m

    def regs(name: str, source: str, group: str, value: str, bits: int = 32, where: str = "") -> str:
        n = bits // 8
        own = f"{group}, " if group else ""
        hexes = " || ".join(f"substr(d, {2 * i + 1}, 2)" for i in reversed(range(n)))
        return f"""{name}_h AS (SELECT {own}('0x' || {hexes})::UBIGINT AS h FROM (SELECT DISTINCT {own}sha1({value}::VARCHAR) AS d FROM {source} {where})),
{name} AS MATERIALIZED (SELECT {own}(h & {m - 1})::INTEGER AS idx, max({bits - 8 + 1} - CASE WHEN h >> 8 = 0 THEN 0 ELSE length(bin(h >> 8)) END)::INTEGER AS rank FROM {name}_h GROUP BY {own}h & {m - 1})"""

    e = f"({spec.alpha * m * m!r}::DOUBLE / (sum(pow(2.0::DOUBLE, -rank)) + ({m} - count(*))))"
    z, linear = f"({m} - count(*))", f"({float(m)}::DOUBLE * ln({float(m)}::DOUBLE / ({m} - count(*))))"

    def estimate() -> str:
        return f"round(CASE WHEN {e} <= {2.5 * m} THEN CASE WHEN {z} > 0 THEN {linear} ELSE {e} END ELSE {e} END, 6)"

    def plus(source: str, group: str) -> str:
        """HyperLogLog++ of registers by group: linear counting below the threshold, then less the mean bias of the six nearest known estimates."""
        threshold, known, biases = bias_tables(SparkSession.getActiveSession(), 8)
        own = f"{group}, " if group else ""
        rows = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, (x, y) in enumerate(zip(known, biases)))
        by = f"PARTITION BY {group}" if group else ""
        return f"""kb(i, x, b) AS (VALUES {rows}),
es AS (SELECT {own}{e} AS e, {z} AS z, CASE WHEN {z} > 0 THEN {linear} END AS lin FROM {source} {'GROUP BY ' + group if group else ''}),
nb AS (SELECT {own}sum(b) / 6 AS bias FROM (SELECT {own}b, row_number() OVER ({by} ORDER BY pow(x - e, 2), i) AS rn FROM es, kb) WHERE rn <= 6 {'GROUP BY ' + group if group else ''})
SELECT {own}round(CASE WHEN lin <= {threshold!r} THEN lin WHEN e <= {5 * m} THEN e - bias ELSE e END, 6) AS estimate FROM es {f'JOIN nb USING ({group})' if group else ', nb'}"""

    two = regs("ra", "customer", "", "c_custkey", where="WHERE c_acctbal > 0") + ", " + regs("rb", "orders", "", "o_custkey") + ", ru AS (SELECT idx, max(rank) AS rank FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY idx)"
    raw = estimate().replace("round(", "(").replace(", 6)", ")")
    three = f"WITH {two}, c AS (SELECT (SELECT {raw} FROM ra) AS a, (SELECT {raw} FROM rb) AS b, (SELECT {raw} FROM ru) AS u)"
    bb = BBitSpec(4)
    overlap = f"""WITH {_tokens('documents', 'doc_id')}, {_tokens('benchmark', 'item_id').replace('t AS MATERIALIZED', 'u AS MATERIALIZED', 1)},
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), mm AS (SELECT item_id, count(*) AS m FROM u GROUP BY 1),
o AS (SELECT item_id, doc_id, count(*) AS k FROM t JOIN u USING (t) GROUP BY ALL), p AS (SELECT o.*, m, n FROM o JOIN n USING (doc_id) JOIN mm USING (item_id))"""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    shingles = f"SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM (SELECT doc_id, regexp_extract_all({low}, '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents) WHERE len(w) > 0)"
    klass = f"sh AS MATERIALIZED ({shingles}), cl AS (SELECT d.doc_id, list(t ORDER BY t) AS l FROM (SELECT doc_id FROM documents) d LEFT JOIN sh USING (doc_id) GROUP BY d.doc_id), of AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS rep FROM cl)"
    near = f"""{klass}, rs AS (SELECT doc_id, t FROM sh JOIN of USING (doc_id) WHERE doc_id = rep), rn AS (SELECT doc_id, count(*) AS n FROM rs GROUP BY 1),
np AS MATERIALIZED (SELECT a, b, k / (x.n + y.n - k) AS jaccard FROM (SELECT p.doc_id AS a, o.doc_id AS b, count(*) AS k FROM rs p JOIN rs o ON p.t = o.t AND p.doc_id < o.doc_id GROUP BY ALL) JOIN rn x ON x.doc_id = a JOIN rn y ON y.doc_id = b WHERE k / (x.n + y.n - k) >= 0.8)"""
    es = ENSEMBLE
    choices = es.choices()
    step = lambda p: f"b{p} AS MATERIALIZED (SELECT j, best, cut FROM (SELECT co.j, p.best + co.cost AS best, co.i AS cut, row_number() OVER (PARTITION BY co.j ORDER BY p.best + co.cost, co.i) AS rn FROM co JOIN b{p - 1} p ON p.j = co.i - 1 WHERE co.i >= {p}) WHERE rn = 1)"
    last = es.num_part - 1
    # dynamic programming over the distinct sizes, a step for each interval, and back
    intervals = f"""hs AS MATERIALIZED (SELECT n AS s, count(*) AS c, row_number() OVER (ORDER BY n) - 1 AS i, sum(count(*)) OVER (ORDER BY n) AS tc, sum(n * count(*)) OVER (ORDER BY n) AS ts FROM z WHERE n > 0 GROUP BY n),
co AS MATERIALIZED (SELECT a.i, b.i AS j, (b.tc - a.tc + a.c)::DOUBLE - (b.ts - a.ts + a.c * a.s)::DOUBLE / b.s AS cost FROM hs a JOIN hs b ON a.i <= b.i),
b0 AS (SELECT j, cost AS best, 0 AS cut FROM co WHERE i = 0), {', '.join(step(p) for p in range(1, last + 1))},
u{last} AS (SELECT cut, j FROM b{last} WHERE j = (SELECT max(i) FROM hs)), {', '.join(f"u{p} AS (SELECT cut, j FROM b{p} WHERE j = (SELECT cut - 1 FROM u{p + 1}))" for p in reversed(range(last)))},
parts AS MATERIALIZED (SELECT part, x.s AS lower, y.s AS upper FROM ({' UNION ALL '.join(f"SELECT {p} AS part, cut, j FROM u{p}" for p in range(last + 1))}) JOIN hs x ON x.i = cut JOIN hs y ON y.i = j)"""
    rs = sorted({r for _, r in choices})
    way = "CASE " + " ".join(f"WHEN upper::DOUBLE / n <= {float(x)!r}::DOUBLE THEN {i}" for i, x in enumerate(RATIOS)) + f" ELSE {len(RATIOS) - 1} END"
    ensemble = f"""WITH {sig}, {sizes}, {intervals},
ch(c, b, r) AS (VALUES {', '.join(f'({i}, {b}, {r})' for i, (b, r) in enumerate(choices))}),
bd AS MATERIALIZED (SELECT doc_id, r, pos // r AS band, string_agg(value::VARCHAR, ',' ORDER BY pos) AS slice FROM s, (VALUES {', '.join(f'({r})' for r in rs)}) v(r) WHERE pos < ({NUM_PERM} // r) * r GROUP BY ALL),
q AS (SELECT doc_id AS query_id, part, {way} AS c FROM z, parts WHERE doc_id % 50 = 0 AND n > 0),
zp AS (SELECT doc_id, part FROM z JOIN parts ON n BETWEEN lower AND upper)
SELECT DISTINCT q.query_id, x.doc_id FROM q JOIN ch USING (c) JOIN bd y ON y.doc_id = q.query_id AND y.r = ch.r AND y.band < ch.b JOIN bd x ON x.r = y.r AND x.band = y.band AND x.slice = y.slice JOIN zp ON zp.doc_id = x.doc_id AND zp.part = q.part"""
    dist = {
        "l2": "sqrt(list_sum(list_transform(list_zip(q.v, x.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))",
        "cosine": "1.0 - list_inner_product(q.v, x.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(x.v, x.v)))",
    }
    knn = {k: f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT q.vec_id AS query_id, x.vec_id AS key, {x} AS distance FROM e q, e x WHERE q.vec_id % 50 = 0)
SELECT query_id, key, round(distance, 6) + 0.0 AS distance, (row_number() OVER (PARTITION BY query_id ORDER BY distance, key))::INTEGER AS rank FROM d QUALIFY rank <= 10""" for k, x in dist.items()}
    error = f"{sig and 'WITH ' + sig}, {sizes}, c AS (SELECT doc_id, {counted} AS estimate FROM s GROUP BY doc_id), er AS (SELECT doc_id, round(abs(estimate - n) / greatest(n, 1), 6) AS error FROM c JOIN z USING (doc_id))"
    nearest = lambda where: f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT q.vec_id AS query_id, x.vec_id AS key, {dist['l2']} AS distance FROM e q, e x WHERE q.vec_id % 50 = 0 AND {where.format(k='x.vec_id')})
SELECT query_id, key, round(distance, 6) + 0.0 AS distance, (row_number() OVER (PARTITION BY query_id ORDER BY distance, key))::INTEGER AS rank FROM d QUALIFY rank <= 10"""  # noqa: E731
    little = "".join(f"{x:02X}" for x in (1).to_bytes(8, "little") + NUM_PERM.to_bytes(4, "little"))
    turned = " || ".join(f"substr(lpad(upper(hex(value)), 8, '0'), {i}, 2)" for i in (7, 5, 3, 1))
    mated = "mt AS (SELECT query_id AS buffer, min(doc_id) AS mate FROM found WHERE query_id <> doc_id GROUP BY 1), ak AS (SELECT buffer, unnest([buffer, mate]) AS asks FROM mt)"
    crc = []
    for k in range(1, 26):
        crc.append(f"('Brand#{k}', {zlib.crc32(f'Brand#{k}'.encode()) % 25})")
    vectors = f"""br(b, slot) AS (VALUES {', '.join(crc)}), vv AS (SELECT l_suppkey, slot, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey JOIN br ON b = p_brand GROUP BY ALL)"""
    seen = f"{head} SELECT doc_id, doc_id IN (SELECT q.doc_id FROM bands q JOIN bands x USING (band, slice) WHERE x.doc_id % 50 <> 0) AS seen FROM documents WHERE doc_id % 50 = 0"
    count = "SELECT band, n AS bucket_size, count(*) AS buckets FROM (SELECT band, slice, count(*) AS n FROM bands {w} GROUP BY ALL) GROUP BY ALL"
    h64 = " || ".join(f"substr(sha1(token), {2 * i + 1}, 2)" for i in reversed(range(8)))
    h32 = " || ".join(f"substr(sha1(token), {2 * i + 1}, 2)" for i in reversed(range(4)))
    slot = lambda b: next(s for s in (1, 2, 4, 8, 16, 32) if s >= b)
    recall = f"{forest}, {top(10)}, {found}, {sizes}, e AS ({exact.format(f='found')}), {ranked} SELECT rk.query_id, round(avg(CASE WHEN ft.doc_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall FROM rk LEFT JOIN ft ON ft.query_id = rk.query_id AND ft.doc_id = rk.doc_id GROUP BY rk.query_id"
    found_sql = {
        "hash_tokens": f"SELECT token, ('0x' || {h32})::UBIGINT::BIGINT AS h32, CASE WHEN u >= 9223372036854775808::HUGEINT THEN (u - 18446744073709551616::HUGEINT)::BIGINT ELSE u::BIGINT END AS h64 FROM (SELECT *, ('0x' || {h64})::UBIGINT::HUGEINT AS u FROM (SELECT DISTINCT t AS token FROM ({_tokens('documents', 'doc_id').split('(', 1)[1][:-1]})))",
        "minhash_signature": f"WITH {sig} SELECT doc_id, pos, value FROM s",
        "minhash_signature_native": f"WITH {sig} SELECT doc_id, pos, value FROM s",
        "minhash_count": f"WITH {sig} SELECT doc_id, {counted} AS estimate FROM s GROUP BY doc_id",
        "minhash_is_empty": f"WITH {sig} SELECT doc_id, bool_and(value = 4294967295) AS empty FROM s GROUP BY doc_id",
        "minhash_union_by_source": f"WITH {sig} SELECT source, pos, min(value) AS value FROM s JOIN documents USING (doc_id) GROUP BY ALL",
        "minhash_union_by_lang": f"WITH {sig} SELECT lang, pos, min(value) AS value FROM s JOIN documents USING (doc_id) GROUP BY ALL",
        "minhash_jaccard_pairs": f"{pairs} SELECT query_id, doc_id, count(*) FILTER (x = y) / {NUM_PERM}.0::DOUBLE AS estimate FROM pr GROUP BY ALL",
        "minhash_merge_pairs": f"{pairs}, mg AS (SELECT query_id, doc_id, least(x, y) AS value FROM pr) SELECT query_id, doc_id, {counted} AS estimate FROM mg GROUP BY ALL",
        "lean_bytesize": f"SELECT doc_id, {12 + 4 * NUM_PERM}::BIGINT AS bytes FROM documents",
        "lean_hex": f"WITH {sig} SELECT doc_id, '{1:016X}{NUM_PERM:08X}' || string_agg(lpad(upper(hex(value)), 8, '0'), '' ORDER BY pos) AS hex FROM s GROUP BY doc_id",
        "lean_round_trip": f"WITH {sig} SELECT doc_id, sha256('{little}' || string_agg({turned}, '' ORDER BY pos)) AS bytes_sha256, 1::BIGINT AS seed, sha256(string_agg(value::VARCHAR, ',' ORDER BY pos)) AS values_sha256 FROM s GROUP BY doc_id",
        "bbit_signature": f"WITH {sig} SELECT doc_id, pos, value & 15 AS value FROM s",
        "bbit_jaccard": f"{pairs} SELECT query_id, doc_id, round((count(*) FILTER (x & 15 = y & 15) / {NUM_PERM}.0::DOUBLE - {bb.base()!r}) / {1 - bb.base()!r}, 6) AS estimate FROM pr GROUP BY ALL",
        "bbit_bytesize": "SELECT b::BIGINT AS b, (bytes * (SELECT count(*) FROM documents))::BIGINT AS bytes FROM (VALUES " + ", ".join(f"({x}, {21 + 8 * -(-NUM_PERM // (64 // slot(x)))})" for x in (1, 2, 3, 4, 9, 32)) + ") v(b, bytes)",
        "bbit_equal": f"{pairs} SELECT query_id, doc_id, bool_and(x & 15 = y & 15) AS equal FROM pr GROUP BY ALL",
        "exact_jaccard_topk": f"{overlap} SELECT item_id, doc_id, round(k / (m + n - k), 6) AS jaccard, (row_number() OVER (PARTITION BY item_id ORDER BY k / (m + n - k) DESC, doc_id))::INTEGER AS rank FROM p QUALIFY rank <= 10",
        "exact_containment_threshold": f"{overlap} SELECT item_id, doc_id, round(k / m, 6) AS containment FROM p WHERE k / m >= 0.7",
        "set_size_hist": f"WITH {_tokens('documents', 'doc_id')} SELECT n AS size, count(*) AS n FROM (SELECT d.doc_id, count(t) AS n FROM (SELECT doc_id FROM documents) d LEFT JOIN t USING (doc_id) GROUP BY 1) GROUP BY 1",
        "hll_registers": f"WITH {regs('r', 'lineitem', 'l_returnflag', 'l_partkey')} SELECT l_returnflag, idx, rank FROM r",
        "hll_count": f"WITH {regs('r', 'lineitem', 'l_returnflag', 'l_partkey')} SELECT l_returnflag, {estimate()} AS estimate FROM r GROUP BY 1",
        "hll_count_small": f"WITH {regs('r', 'customer', 'c_mktsegment', 'c_nationkey')} SELECT c_mktsegment, {estimate()} AS estimate FROM r GROUP BY 1",
        "hll_bytesize": f"SELECT DISTINCT l_returnflag, {spec.bytes}::BIGINT AS bytes FROM lineitem",
        "hll_serialized": f"WITH {regs('r', 'lineitem', 'l_returnflag', 'l_partkey')}, g AS (SELECT DISTINCT l_returnflag FROM r) SELECT l_returnflag, '08' || string_agg(lpad(upper(hex(coalesce(rank, 0))), 2, '0'), '' ORDER BY i) AS sketch FROM (SELECT l_returnflag, i FROM g CROSS JOIN range(256) x(i)) c LEFT JOIN r ON r.l_returnflag = c.l_returnflag AND r.idx = c.i GROUP BY 1".replace("SELECT l_returnflag, '08'", "SELECT c.l_returnflag, '08'"),
        "hll_deserialized": f"WITH {regs('r', 'lineitem', 'l_returnflag', 'l_partkey')} SELECT l_returnflag, idx, rank FROM r WHERE rank > 0",
        "hll_union": f"WITH {two} SELECT {estimate()} AS estimate FROM ru",
        "hll_jaccard": f"{three} SELECT round(CASE WHEN u = 0 THEN 1.0 ELSE (a + b - u) / u END, 6) AS jaccard FROM c",
        "hll_inclusion": f"{three} SELECT round(CASE WHEN a = 0 THEN 1.0 ELSE (a + b - u) / a END, 6) AS inclusion FROM c",
        "hllpp_registers": f"WITH {regs('r', 'lineitem', 'l_returnflag', 'l_partkey', 64)} SELECT l_returnflag, idx, rank FROM r",
        "minhash_inclusion": f"{pairs}, g AS (SELECT query_id, doc_id, count(*) FILTER (x = y) / {NUM_PERM}.0::DOUBLE AS j, {NUM_PERM}.0 / sum(x / 4294967295.0::DOUBLE) - 1.0 AS a, {NUM_PERM}.0 / sum(y / 4294967295.0::DOUBLE) - 1.0 AS b FROM pr GROUP BY ALL) SELECT query_id, doc_id, round((j / (j + 1.0)) * (1.0 + b / a), 6) AS inclusion FROM g",
        "lsh_bands": f"{head} SELECT doc_id, band, slice FROM bands",
        "lsh_query": f"{head}, {found} SELECT * FROM found",
        "lsh_query_b": f"{head} SELECT DISTINCT q.doc_id AS query_id, x.doc_id FROM bands q JOIN bands x USING (band, slice) WHERE q.doc_id % 50 = 0 AND band < 3",
        "lsh_query_buffer": f"{head}, {found}, {mated}, qb AS (SELECT DISTINCT q.doc_id AS query_id, x.doc_id FROM bands q JOIN bands x USING (band, slice) WHERE q.doc_id IN (SELECT asks FROM ak)) SELECT buffer, doc_id FROM qb JOIN ak ON asks = query_id GROUP BY ALL HAVING count(*) = 2",
        "lsh_query_ranked": f"{head}, {found}, pr AS (SELECT query_id, f.doc_id, count(*) FILTER (x.value = y.value) / {NUM_PERM}.0::DOUBLE AS estimate FROM found f JOIN s x ON x.doc_id = query_id JOIN s y ON y.doc_id = f.doc_id AND y.pos = x.pos GROUP BY ALL) SELECT query_id, doc_id, estimate, (row_number() OVER (PARTITION BY query_id ORDER BY estimate DESC, doc_id))::INTEGER AS rank FROM pr QUALIFY rank <= 10",
        "lsh_bucket_counts": f"{head} SELECT band, slice, count(*) AS n FROM bands GROUP BY ALL HAVING count(*) > 1",
        "lsh_contains": "SELECT DISTINCT k AS doc_id, k IN (SELECT doc_id FROM documents) AS present FROM (SELECT doc_id AS k FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT -doc_id FROM documents WHERE doc_id % 50 = 0)",
        "lsh_remove": f"{head}, {found} SELECT * FROM found WHERE doc_id % 50 <> 0",
        "lsh_merge": f"{head} {count.format(w='')}",
        "lsh_counts": f"{head} {count.format(w='')}",
        "lsh_subset_counts": f"{head} {count.format(w='WHERE doc_id % 50 = 0')}",
        "lsh_duplicate_keys": "SELECT doc_id, 2::BIGINT AS n FROM documents WHERE doc_id % 6 = 0",
        "lsh_verify_topk": f"{topk} SELECT * FROM rk",
        "near_dup_classes": f"WITH {klass} SELECT doc_id, rep FROM of",
        "near_dup_pairs": f"WITH {near} SELECT a, b, round(jaccard, 6) AS jaccard FROM np",
        "near_dup_clusters": f"WITH RECURSIVE {near}, ed AS (SELECT a, b FROM np UNION ALL SELECT b, a FROM np), rc AS (SELECT a AS x, a AS y FROM ed UNION SELECT x, b FROM rc JOIN ed ON y = a), lo AS (SELECT x, min(y) AS c FROM rc GROUP BY x) SELECT doc_id, coalesce(c, rep) AS cluster FROM of LEFT JOIN lo ON x = rep",
        "forest_topk": f"{forest}, {top(10)} SELECT query_id, doc_id, depth FROM ft",
        "forest_hashvalues": f"WITH {sig} SELECT doc_id, pos, value FROM s WHERE doc_id % 50 = 0 AND pos < {k * TREES}",
        "forest_rerank_topk": f"{forest}, {top(20)}, {sizes}, e AS ({exact.format(f='ft').replace('WHERE f.query_id <> f.doc_id ', '')}), {ranked} SELECT * FROM rk",
        "ensemble_query": ensemble,
        "ensemble_partitions": f"WITH {_signature('documents', 'doc_id', 's').split(',' + chr(10) + 's_d AS', 1)[0]}, {sizes}, {intervals} SELECT part, lower::INTEGER AS lower, upper::INTEGER AS upper FROM parts",
        "bloom_exact_membership": seen,
        "bloom_query": seen,
        "bloom_agreement": "SELECT 1.0::DOUBLE AS agreement FROM (SELECT count(*) AS n FROM documents WHERE doc_id % 50 = 0) WHERE n > 0",
        "weighted_exact_jaccard": f"WITH {vectors}, sp AS (SELECT DISTINCT l_suppkey FROM vv), sl AS (SELECT unnest(range(25)) AS slot), dn AS (SELECT l_suppkey, slot, coalesce(w, 0) AS w FROM sp CROSS JOIN sl LEFT JOIN vv USING (l_suppkey, slot)), j AS (SELECT q.l_suppkey AS query_id, x.l_suppkey, sum(least(q.w, x.w)) / sum(greatest(q.w, x.w)) AS jaccard FROM dn q JOIN dn x USING (slot) WHERE q.l_suppkey % 50 = 0 GROUP BY ALL) SELECT query_id, l_suppkey, round(jaccard, 6) AS jaccard, (row_number() OVER (PARTITION BY query_id ORDER BY 1 - jaccard, l_suppkey))::INTEGER AS rank FROM j QUALIFY rank <= 10",
        "hnsw_topk": nearest("true"),
        "hnsw_soft_remove": nearest("{k} % 7 <> 0"),
        "hnsw_hard_remove": nearest("{k} % 7 <> 0 AND {k} % 11 <> 0"),
        "hnsw_recall": "SELECT vec_id AS query_id, 1.0::DOUBLE AS recall FROM embeddings WHERE vec_id % 50 = 0",
        "knn_exact_l2": knn["l2"],
        "knn_exact_cosine": knn["cosine"],
        "hnsw_items": "SELECT vec_id AS key, (CASE WHEN vec_id % 10 = 0 THEN embedding[-1] ELSE embedding[1] END)::DOUBLE AS first FROM embeddings WHERE vec_id % 7 <> 0",
        "hnsw_popitem": "SELECT vec_id AS key, (CASE WHEN vec_id % 10 = 0 THEN embedding[-1] ELSE embedding[1] END)::DOUBLE AS first FROM embeddings WHERE vec_id % 7 <> 0 ORDER BY vec_id DESC LIMIT 1",
        "hnsw_merge": "SELECT vec_id AS key, (CASE WHEN vec_id % 3 = 0 THEN embedding[-1] ELSE embedding[1] END)::DOUBLE AS first FROM embeddings WHERE vec_id % 2 = 0 OR vec_id < 100 OR vec_id % 3 = 0",
        "similarity_at_k": f"{topk} SELECT query_id, round(avg(jaccard), 6) AS mean, min(jaccard) AS at_k FROM rk GROUP BY 1",
        "ensemble_expected_fp": f"WITH {_signature('documents', 'doc_id', 's').split(',' + chr(10) + 's_d AS', 1)[0]}, {sizes}, {intervals} SELECT part, round(count(*) - sum(n) / max(n), 6) AS expected FROM z JOIN parts ON n BETWEEN lower AND upper GROUP BY 1",
        "recall_at_k": recall,
        "precision_recall_f": f"{head}, {found}, b3 AS (SELECT DISTINCT q.doc_id AS query_id, x.doc_id FROM bands q JOIN bands x USING (band, slice) WHERE q.doc_id % 50 = 0 AND band < 3), n AS (SELECT query_id, count(b3.doc_id) AS nf, count(*) AS nt FROM found LEFT JOIN b3 USING (query_id, doc_id) GROUP BY 1), p AS (SELECT query_id, CASE WHEN nf > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS precision, nf / nt AS recall FROM n) SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM p",
        "pareto_frontier": "WITH d AS (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n, max(o_totalprice) AS price FROM orders GROUP BY ALL), b AS (SELECT n, max(price) AS price FROM d GROUP BY n) SELECT n, price FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.n > x.n AND y.price >= x.price)",
        "estimation_error": f"{error} SELECT doc_id, error FROM er",
        "error_summary": f"{error} SELECT lang, round(avg(error), 6) AS mean, round(stddev_samp(error), 6) AS std, round(quantile_cont(error, 0.9), 6) AS p90 FROM er JOIN documents USING (doc_id) GROUP BY lang",
        "hll_daily": f"WITH ev AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id FROM events), {regs('r', 'ev', 'day', 'user_id')} SELECT day, {estimate()} AS estimate FROM r GROUP BY 1",
    }
    if SparkSession.getActiveSession() is not None:  # the table of known biases is Spark's own
        found_sql["hllpp_count"] = f"WITH {regs('r', 'lineitem', 'l_returnflag', 'l_partkey', 64)}, {plus('r', 'l_returnflag')}"
        found_sql["hllpp_count_biased"] = f"WITH {regs('r', 'events', 'event_type', 'user_id', 64)}, {plus('r', 'event_type')}"
        found_sql["hllpp_union"] = f"WITH {regs('ra', 'customer', '', 'c_custkey', 64, where='WHERE c_acctbal > 0')}, {regs('rb', 'orders', '', 'o_custkey', 64)}, ru AS (SELECT idx, max(rank) AS rank FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY idx), {plus('ru', '')}"
    return found_sql
