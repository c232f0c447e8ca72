"""Golden values, algebra and oracles of the sketches and indexes."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import params
from millrace.operators import evaluate, hll, knn, lsh, nodes
from millrace.operators import minhash as mh
from millrace.plans import registry
from millrace.operators.graph import components
from millrace.operators.setjoin import Join
from millrace.sources import kept as keeping
from millrace.sources.store import IndexStore, read_sets
from millrace.streaming.sketches import deletion_sink, live, near_duplicate_sink, windowed_registers

SF = "/root/testdata/sf0.001"


def sets(spark, data):
    return spark.createDataFrame(data, "doc_id long, tokens array<string>")


def test_golden_signature_both_ways(spark):
    one, spec = sets(spark, [(1, ["Hello"]), (2, []), (3, None)]), mh.MinHashSpec(4, 1)
    want = {1: [734825475, 960773806, 359816889, 342714745], 2: [2**32 - 1] * 4, 3: [2**32 - 1] * 4}
    assert {r.doc_id: r.sig for r in mh.signatures(one, spec).collect()} == want
    assert {r.doc_id: r.sig for r in mh.signatures_native(one, spec).collect()} == want


def test_union_is_the_signature_of_the_union(spark):
    spec = mh.MinHashSpec(16)
    parts = mh.signatures(sets(spark, [(1, ["a", "b"]), (2, ["c"]), (3, ["a", "b", "c"])]), spec)
    got = parts.where("doc_id < 3").agg(mh.union("sig", 16).alias("sig")).first().sig
    assert got == parts.where("doc_id = 3").first().sig


def test_parameters():
    assert params.band_params(0.9, 128) == (5, 25)
    assert params.size_partitions([1, 2, 10, 11], [5, 5, 5, 5], 2) == [(1, 2), (10, 11)]
    assert params.size_partitions([], [], 3) == [] and params.size_partitions([4], [1], 3) == [(4, 4)]


@pytest.mark.parametrize("bad", [lambda: lsh.LshSpec(1.5), lambda: lsh.LshSpec(0.5, 128, (0.3, 0.3)), lambda: lsh.LshSpec(0.5, 8, params=(1, 4)), lambda: mh.BBitSpec(33), lambda: hll.HllSpec(3), lambda: lsh.ForestSpec(4, 8), lambda: lsh.BloomSpec(0, 0.1), lambda: lsh.EnsembleSpec(0.5, 8, 4, 1)])
def test_specs_refuse(bad):
    with pytest.raises(ValueError):
        bad()


def test_packing_round_trips():
    sig = [int(x) for x in np.random.RandomState(1).randint(0, 2**32, 37, dtype=np.uint64)]
    for order in "<>=!":
        assert mh.lean_unpack(mh.lean_pack(5, sig, order), order) == (5, sig)
    assert len(mh.lean_pack(5, sig)) == mh.lean_bytes(37)
    for b in (1, 2, 3, 9, 27, 32):
        spec = mh.BBitSpec(b)
        values = [v & ((1 << b) - 1) for v in sig]
        raw = mh.b_bit_pack(values, 7, spec)
        assert mh.b_bit_unpack(raw) == (7, spec, values) and len(raw) == spec.bytes(37)


def test_hll_registers_of_known_hashes(spark):
    df = spark.createDataFrame([(0b00011111,), (0xFFFFFFF1,), (0x000000F5,)], "h long")
    got = {r.idx: r["rank"] for r in hll.registers(df, [], F.col("h"), hll.HllSpec(4), hashed=True).collect()}
    assert got == {15: 28, 1: 1, 5: 25}
    df = spark.createDataFrame([(0b00011111,), (-15,), (0xF5,)], "h long")
    got = {r.idx: r["rank"] for r in hll.registers(df, [], F.col("h"), hll.HllSpec(4, plus=True), hashed=True).collect()}
    assert got == {15: 60, 1: 1, 5: 57}


def test_hll_plus_bias(spark):
    df = spark.range(700)
    for plus in (False, True):
        spec = hll.HllSpec(8, plus)
        assert abs(hll.estimates(hll.registers(df, [], F.col("id"), spec), [], spec).first().estimate - 700) < 120


def test_lsh_three_documents(spark):
    data = sets(spark, [(0, ["a", "b", "c"]), (1, ["a", "b", "d"]), (2, ["x", "y", "z"])])
    spec = lsh.LshSpec(0.5, 32)
    ix = lsh.bands(mh.signatures(data, mh.MinHashSpec(32)), spec)
    got = {r.doc_id for r in lsh.query(ix.where("doc_id = 0"), ix).collect()}
    assert got == {0, 1}
    with pytest.raises(ValueError):
        lsh.bands(mh.signatures(data, mh.MinHashSpec(18)), spec)
    with pytest.raises(ValueError):
        lsh.merged(ix, ix, check_overlap=True)
    assert lsh.removed(ix, spark.range(1).select(F.col("id").alias("doc_id"))).where("doc_id = 0").count() == 0


def test_ensemble_finds_nested_sets(spark):
    data = sets(spark, [(n, [str(i) for i in range(n)]) for n in range(1, 100, 3)])
    spec = lsh.EnsembleSpec(0.9, 64, 4, 4)
    sized = mh.signatures(data, mh.MinHashSpec(64)).join(data.select("doc_id", F.size("tokens").alias("size")), "doc_id")
    parts = lsh.partitions(sized, spec)
    got = lsh.ensemble_query(sized, lsh.ensemble_index(sized, parts, spec), parts, spec)
    assert got.where("query_id = doc_id").count() == 33


def test_bloom_has_no_false_negatives(spark, tmp_path):
    data = sets(spark, [(i, [f"t{i}", f"u{i}"]) for i in range(50)])
    ix = lsh.bands(mh.signatures(data, mh.MinHashSpec(16)), lsh.LshSpec(0.5, 16, params=(4, 4)))
    spec = lsh.BloomSpec(200, 1e-4)
    filter_ = lsh.bloom_union(lsh.bloom_filter(ix.where("doc_id < 10"), spec), lsh.bloom_filter(ix.where("doc_id BETWEEN 10 AND 24"), spec))
    store = IndexStore(spark, {"type": "parquet", "path": str(tmp_path), "basename": "b"})
    lsh.bloom_save(store, "filter", filter_, spec)
    filter_, spec = lsh.bloom_load(store, "filter")
    got = lsh.bloom_query(ix, filter_, spec)
    assert got.where("doc_id < 25 AND NOT seen").count() == 0 and got.where("doc_id >= 25 AND seen").count() <= 1


def test_bloom_query_is_sized_by_its_table(spark, tmp_path):
    assert registry._bloom_spec(spark, SF) == lsh.BloomSpec(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 50 <> 0").count(), 1e-6)
    spark.range(0, 3_000_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    assert registry._bloom_spec(spark, str(tmp_path)).bits > lsh.BloomSpec(2_900_000, 1e-6).bits
    seen = {r.doc_id: r.seen for r in registry.queries()["bloom_query"](spark, SF).collect()}
    exact = {r.doc_id: r.seen for r in registry.queries()["bloom_exact_membership"](spark, SF).collect()}
    assert seen.keys() == exact.keys() and all(seen[k] for k in exact if exact[k]) and sum(seen.values()) == sum(exact.values())


def test_near_pairs_lose_no_link(spark, tmp_path):
    r = np.random.RandomState(6)
    texts = []
    for k in range(300):  # 40 of 50 shingles in common
        own = [f"w{k}x{i}" for i in range(54)]
        texts += [" ".join(own[:44]), " ".join(own)]
    for _ in range(40):  # around 0.8, with shingles that many share
        base = ["a", "b", "c", "d", "e", "f"] * 4 + [str(x) for x in r.randint(0, 3, 12)]
        texts += [" ".join(base), " ".join(base[: r.randint(25, 36)])]
    texts += ["", "  ", "one", "ONE", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    first = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        if w:
            first.setdefault(frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))), i)
    reps = list(first.items())
    want = {(i, j): round(len(x & y) / len(x | y), 6) for x, i in reps for y, j in reps if i < j and len(x & y) >= 0.8 * len(x | y)}
    got = [((p.a, p.b), p.jaccard) for p in registry.queries()["near_dup_pairs"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) > 300 and dict(got) == want


def test_weighted(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 3.0])], "k long, v array<double>")
    got = {r.k: r.wsig for r in mh.weighted_signatures(df, mh.WeightedSpec(2, 16), "k", "v").collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] and len(got[1]) == 16


def test_partitions_are_the_best_ones():
    r = np.random.RandomState(8)
    for n, parts in ((1, 3), (7, 3), (40, 6), (40, 40)):
        sizes = sorted(r.choice(500, n, replace=False) + 1)
        counts = r.randint(1, 50, n).tolist()
        cost = lambda i, j: params.expected_false_positives(sizes, counts, i, j)  # noqa: B023, E731
        best = [cost(0, j) for j in range(n)]
        for _ in range(1, min(parts, n)):
            best = [min((best[i - 1] + cost(i, j) for i in range(1, j + 1)), default=float("inf")) for j in range(n)]
        found = params.size_partitions(sizes, counts, parts)
        at = {s: i for i, s in enumerate(sizes)}
        assert len(found) == min(parts, n) and sum(cost(at[lo], at[hi]) for lo, hi in found) == pytest.approx(best[-1])
        assert [at[lo] for lo, _ in found] == [0] + [at[hi] + 1 for _, hi in found[:-1]]
    assert params.expected_false_positives([2, 4], [3, 5], 0, 1, uniform=True) == 8 * 2 / 8
    with pytest.raises(ValueError):
        params.expected_false_positives([2, 4], [3, 5], 1, 0)
    assert len(params.size_partitions(list(range(1, 30_001)), [1] * 30_000, 4)) == 4


def test_bloom_error_model():
    net, fp, fn = params.bloom_rates(10, 0.01, 0.1, 0.2)
    assert net == pytest.approx(1 - 0.99**10) and fp == pytest.approx(0.1 + 0.9 * net) and fn == pytest.approx((1 - net) * 0.2)
    a, b = params.band_rates(0.5, 5, 5)
    assert 0 < a < 0.5 and 0 < b < 0.5


def test_index_sessions(spark):
    data = sets(spark, [(i, [f"a{i}", f"b{i}"]) for i in range(6)])
    spec = lsh.LshSpec(0.5, 16, params=(4, 4))
    ix = lsh.bands(mh.signatures(data, mh.MinHashSpec(16)), spec)
    some, more = ix.where("doc_id < 4"), ix.where("doc_id >= 3")
    with pytest.raises(ValueError):
        lsh.inserted(some, more)
    assert lsh.inserted(some, ix.where("doc_id >= 4")).count() == 24 and lsh.inserted(some, more, check=False).count() == 28
    with pytest.raises(ValueError):
        lsh.inserted(some.where("doc_id < 0"), more.union(more))
    with pytest.raises(KeyError):
        lsh.removed(some, spark.range(9).withColumnRenamed("id", "doc_id"), check=True)
    assert lsh.removed(some, spark.range(2).withColumnRenamed("id", "doc_id"), check=True).select("doc_id").distinct().count() == 2
    assert not lsh.is_empty(ix) and lsh.is_empty(ix.where("band > 0")) and lsh.is_empty(ix.limit(0))
    with pytest.raises(ValueError):
        lsh.query(ix, ix, first_bands=5)
    other = lsh.bands(mh.signatures(data, mh.MinHashSpec(16, 2)), spec)
    with pytest.raises(ValueError):
        lsh.merged(ix, other)
    with pytest.raises(ValueError):
        lsh.merged(ix, lsh.bands(mh.signatures(data, mh.MinHashSpec(16)), lsh.LshSpec(0.5, 16, params=(2, 8))))
    assert lsh.occupancy(ix).agg(F.sum("n")).first()[0] == 24 and lsh.occupancy(ix, spark.range(1).withColumnRenamed("id", "doc_id")).count() == 4
    t = lsh.trees(mh.signatures(data, mh.MinHashSpec(16)), lsh.ForestSpec(16, 4))
    assert lsh.is_empty(t.limit(0)) and not lsh.is_empty(t)
    assert [r.present for r in lsh.contained(spark.createDataFrame([(1,), (99,)], "doc_id long").orderBy("doc_id"), t).orderBy("doc_id").collect()] == [True, False]
    best = lsh.ranked(lsh.query(ix.where("doc_id = 2"), ix), mh.signatures(data, mh.MinHashSpec(16)), 16).where("rank = 1").first()
    assert (best.doc_id, best.estimate) == (2, 1.0)


def test_other_hashes_and_given_signatures(spark):
    import zlib

    data, spec = sets(spark, [(1, ["x", "y"]), (2, ["y"])]), mh.MinHashSpec(8)
    by_crc = {r.doc_id: r.sig for r in mh.signatures(data, spec, hash_func="crc32").collect()}
    assert by_crc == {r.doc_id: r.sig for r in mh.signatures_native(data, spec, hash_name="crc32").collect()}
    own = mh.signatures(data, spec, hash_func=lambda tokens: [zlib.crc32(t.encode()) for t in tokens])
    assert by_crc == {r.doc_id: r.sig for r in own.collect()}
    for name in ("murmur3", "xxhash32"):
        assert mh.signatures_native(data, spec, hash_name=name).count() == 2
    sig = mh.signatures(data, spec)
    again = mh.given(sig.select("doc_id", "sig"), spec)
    assert all(r.equal for r in mh.equal(sig, again).collect()) and not any(r.equal for r in mh.equal(sig, mh.given(sig.select("doc_id", "sig"), mh.MinHashSpec(8, 2))).collect())
    with pytest.raises(Exception, match="not a signature"):
        mh.given(sig.select("doc_id", F.slice("sig", 1, 3).alias("sig")), spec).collect()
    assert sig.select(F.size(F.array_distinct(F.array(mh.hash_of("sig", 1), mh.hash_of("sig", 1), mh.hash_of("sig", 2))))).first()[0] == 2
    two, four = mh.b_bit_signatures(sig, mh.BBitSpec(2)), mh.b_bit_signatures(sig, mh.BBitSpec(4))
    assert all(r.equal for r in mh.equal(two, two).collect()) and not any(r.equal for r in mh.equal(two, four).collect())
    with pytest.raises(ValueError):
        mh.b_bit_jaccard("x", "y", 8, mh.BBitSpec(2), mh.BBitSpec(4))


def test_column_forms_of_serialised_sketches(spark):
    sig = [int(x) for x in np.random.RandomState(1).randint(0, 2**32, 37, dtype=np.uint64)]
    df = spark.createDataFrame([(1, sig)], "k long, sig array<bigint>")
    for order in "<>":
        raw = bytes(df.select(mh.lean_write("sig", -5, 37, order).alias("raw")).first().raw) if order == "<" else mh.lean_pack(5, sig, ">")
        assert mh.lean_unpack(raw, order)[1] == sig
        back = spark.createDataFrame([(raw,), (raw[:-1],)], "raw binary").select(mh.lean_read("raw", order).alias("x")).collect()
        assert back[0].x.sig == sig and back[0].x.seed == (-5 if order == "<" else 5) and back[1].x is None
    for b in (1, 2, 3, 9, 27, 32):
        spec = mh.BBitSpec(b, 0.25)
        got = df.select(mh.b_bit_packed(mh.b_bit("sig", spec), 37, 7, spec).alias("raw")).first().raw
        assert bytes(got) == mh.b_bit_pack([v & ((1 << b) - 1) for v in sig], 7, spec)
    assert mh.BBitSpec(2, 0.25).base() == pytest.approx(0.25 * 0.75**3 / (1 - 0.75**4))
    regs = hll.registers(spark.range(40).withColumn("g", F.col("id") % 2), ["g"], F.col("id"), hll.HllSpec(4))
    back = hll.undense(hll.dense(regs, ["g"], hll.HllSpec(4)), ["g"], hll.HllSpec(4))
    assert all(r.equal for r in hll.equal(regs, back, ["g"]).collect()) and hll.equal(regs, back.where("idx > 3"), ["g"]).where("NOT equal").count() == 2
    with pytest.raises(Exception, match="not a sketch"):
        hll.undense(hll.dense(regs, ["g"], hll.HllSpec(4)), ["g"], hll.HllSpec(5)).collect()


def test_hll_ranges(spark):
    """All registers set high: beyond the small range, and beyond 2^32 / 30."""
    full = spark.range(16).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("idx"), F.lit(27).alias("rank"))
    e = 0.673 * 256 / (16 * 2.0**-27)
    assert hll.estimates(full, ["g"], hll.HllSpec(4)).first().estimate == pytest.approx(-(2.0**32) * np.log(1 - e / 2**32))
    low = full.withColumn("rank", F.lit(1))
    assert hll.estimates(low, ["g"], hll.HllSpec(4)).first().estimate == pytest.approx(0.673 * 256 / 8)


def test_padded_signatures_find_by_containment(spark):
    data = sets(spark, [(1, ["a", "b"]), (2, ["a", "b", "c", "d", "e", "f"])])
    spec = mh.MinHashSpec(64)
    sized = mh.signatures(data, spec).join(data.select("doc_id", F.size("tokens").alias("n")), "doc_id")
    got = {r.doc_id: r.sig for r in mh.padded(sized, "n", spec).collect()}
    want = mh.signatures(sets(spark, [(1, ["a", "b", *(f"{i}_padding" for i in range(4))]), (2, ["a", "b", "c", "d", "e", "f"])]), spec)
    assert got == {r.doc_id: r.sig for r in want.collect()}


def weighted_brute(v, spec, many):
    rs, ln_cs, betas = spec.draws()
    out = []
    for s in range(spec.samples):
        best = None
        for k, x in enumerate(np.array(v, np.float32)):
            if x:
                t = np.floor(np.log(x) / rs[s, k] + betas[s, k])
                a = ln_cs[s, k] - (t - betas[s, k] + 1) * rs[s, k] if many else ln_cs[s, k] - (t - betas[s, k]) * rs[s, k] - rs[s, k]
                if best is None or a < best[0]:
                    best = (a, k, int(t))
        out.append(best[1:])
    return out


@pytest.mark.parametrize("many", [False, True])
def test_weighted_samples_match_brute_force(spark, many):
    r = np.random.RandomState(3)
    rows = [(i, [float(x) for x in r.randint(0, 5, 12)]) for i in range(30)] + [(90, [0.0] * 12), (91, None)]
    spec = mh.WeightedSpec(12, 32)
    got = {x.k: x.wsig for x in mh.weighted_signatures(spark.createDataFrame(rows, "k long, v array<double>").repartition(3), spec, "k", "v", many).collect()}
    for k, v in rows:
        assert got[k] is None if not v or not any(v) else [tuple(x) for x in got[k]] == weighted_brute(v, spec, many)
    with pytest.raises(Exception, match="3 of 12"):
        mh.weighted_signatures(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "k long, v array<double>"), spec, "k", "v").collect()


def test_weighted_index_and_forest_find_themselves(spark):
    r = np.random.RandomState(5)
    df = spark.createDataFrame([(i, [float(x) if k % 10 == i % 10 else 0.0 for k, x in enumerate(r.randint(1, 100, 40))]) for i in range(40)] + [(99, None)], "k long, v array<double>")
    s = mh.weighted_signatures(df, mh.WeightedSpec(40, 32), "k", "v", many=True)
    ix = lsh.bands(s, lsh.LshSpec(0.5, 32, params=(8, 4)), "k", "wsig")
    assert lsh.query(ix, ix, "k").where("query_id = k").count() == 40
    t = lsh.trees(s, lsh.ForestSpec(32, 8), "k", "wsig")
    assert lsh.forest_top(t, t, 10, lsh.ForestSpec(32, 8), "k").where("query_id = k").count() == 40
    with pytest.raises(ValueError):
        lsh.bands(s, lsh.LshSpec(0.5, 64, params=(8, 4)), "k", "wsig")


def test_containment_by_rare_tokens(spark):
    r = np.random.RandomState(7)
    words = lambda n: [f"t{int(x)}" for x in set((r.zipf(1.3, n) % 60).tolist())]
    queries, docs_ = [(i, words(12)) for i in range(20)] + [(50, [])], [(i, words(60)) for i in range(60)] + [(70, None)]
    q, d = spark.createDataFrame(queries, "item_id long, tokens array<string>"), sets(spark, docs_)
    for least in (0.5, 0.8, 1.0):
        want = {(i, j) for i, x in queries for j, y in docs_ if x and len(set(x) & set(y or [])) >= least * len(x) - 1e-9}
        assert {(x.item_id, x.doc_id) for x in lsh.containment(q, d, least).collect()} == want


def test_set_join_clusters_and_pairs_match_brute_force(spark, monkeypatch):
    import millrace.operators.setjoin as setjoin

    r = np.random.RandomState(9)
    base = [[f"w{k}x{i}" for i in range(40)] for k in range(6)]
    texts = []
    for k in range(90):
        own = list(base[k % 6])
        for at in r.choice(40, r.randint(0, 4), replace=False):
            own[at] = f"e{k}"
        texts.append(" ".join(own))
    texts += ["", None, "one two", "One  TWO", "same words here in all " * 30]
    docs_ = list(enumerate(texts))
    shingles = {}
    for i, t in docs_:
        w = (t or "").lower().split()
        shingles[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))) if w else frozenset()
    first = {}
    for i, x in shingles.items():
        first.setdefault(x, i)
    links = [(i, j) for x, i in first.items() for y, j in first.items() if i < j and x and y and len(x & y) >= 0.8 * len(x | y)]
    up = {i: first[x] for i, x in shingles.items()}
    for i, j in links:
        a, b = up[i], up[j]
        up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
    df = spark.createDataFrame(docs_, "doc_id long, text string").repartition(5)
    for bits, flush in ((setjoin.BITS, setjoin.FLUSH), (64, 200)):  # full bit arrays and many flushes change nothing
        monkeypatch.setattr(setjoin, "BITS", bits)
        monkeypatch.setattr(setjoin, "FLUSH", flush)
        join = Join(df, 0.8, 5)
        assert {x.id: x.component for x in join.classes().collect()} == up
    assert Join(df.limit(0), 0.8, 5).classes().count() == 0


def test_hnsw_recall(spark):
    r = np.random.RandomState(2)
    p = spark.createDataFrame([(i, r.rand(8).tolist()) for i in range(400)], "key long, vector array<double>")
    q = p.where("key % 50 = 0")
    out = evaluate.recall_at_k(knn.hnsw(p, q, 10, knn.HnswSpec(), shards=2), knn.exact(p, q, 10))
    assert out.agg(F.avg("recall")).first()[0] >= 0.9


def exact_keys(points, q, k, gone=()):
    far = sorted((float(np.linalg.norm(p - q)), i) for i, p in points.items() if i not in gone)
    return [i for _, i in far[:k]]


def test_checked_graph_answers_are_exact():
    """A graph that misses much, with copies of points that go over the k-th place; soft and hard removed ones stay away."""
    r = np.random.RandomState(5)
    for metric in ("l2", lambda a, b: np.abs(a[:, None, :] - b[None, :, :]).sum(-1)):
        points = {i: r.rand(6) for i in range(300)}
        points |= {i: points[i - 300] for i in range(300, 330)} | {i: points[7] for i in range(330, 350)}
        graph = knn.Graph(knn.HnswSpec(m=2, ef_construction=2, metric=metric))
        for i, p in points.items():
            graph.insert(i, p)
        for i in range(0, 350, 9):
            graph.remove(i, hard=i % 2 == 0)
        qs = np.array([points[i] for i in range(0, 350, 13)])
        far = knn.measure(metric)(qs, np.array(list(points.values())))
        want = [sorted((d, i) for i, d in enumerate(row.tolist()) if i % 9)[:10] for row in far]
        missed = [[i for _, i in graph.query(q, 10, 10)] != [i for _, i in w] for q, w in zip(qs, want)]
        got = graph.checked(qs, 10, 10)
        assert any(missed) and [[i for _, i in f] for f in got] == [[i for _, i in w] for w in want]
        assert [d for f in got for d, _ in f] == pytest.approx([d for w in want for d, _ in w])
    assert knn.Graph(knn.HnswSpec()).checked(qs, 10, 10) == [[]] * len(qs)


def test_graph_inserts_choose_neighbours_seldom(monkeypatch):
    """Choosing the neighbours of a node anew takes most of an insert's time: their calls are counted."""
    r = np.random.RandomState(8)
    points = r.randint(0, 3, (600, 16)).astype(float)
    calls, plain = [], knn.METRICS["minhash"]
    monkeypatch.setitem(knn.METRICS, "minhash", lambda q, x: (calls.append(1), plain(q, x))[1])
    assert plain(points[:3], points) == pytest.approx(1 - (points[:3, None, :] == points[None, :, :]).mean(-1))
    assert plain(points[:1], points) == pytest.approx(1 - (points[:1, None, :] == points[None, :, :]).mean(-1))
    graph = knn.Graph(knn.HnswSpec(metric="minhash"))
    for i, p in enumerate(points):
        graph.insert(i, p)
    assert len(calls) / len(points) < 150
    assert all(len(to) <= graph.spec.m * (3 if h == 0 else 1.5) for h, layer in enumerate(graph.out) for to in layer.values())
    far = plain(points[::20], points)
    hit = [sum(d <= np.sort(row)[9] + 1e-12 for d, _ in graph.query(q, 10, 100)) / 10 for q, row in zip(points[::20], far)]
    assert np.mean(hit) >= 0.95


def test_graph_removals_and_updates():
    r = np.random.RandomState(4)
    points = {i: r.rand(6) for i in range(300)}
    graph = knn.Graph(knn.HnswSpec(m=6, ef_construction=30))
    for i, p in points.items():
        graph.insert(i, p)
    hit = lambda gone=(): np.mean([len({i for _, i in graph.query(points[q], 10, 80)} & set(exact_keys(points, points[q], 10, gone))) / 10 for q in range(0, 300, 19)])
    assert len(graph) == 300 and hit() >= 0.95
    soft = set(range(0, 300, 5))
    for i in soft:
        graph.remove(i)
        graph.remove(i)
    assert len(graph) == 240 and hit(soft) >= 0.95 and not {i for q in range(0, 300, 9) for _, i in graph.query(points[q], 10, 80)} & soft
    graph.clean()
    hard = set(range(1, 300, 5))
    for i in hard:
        graph.remove(i, hard=True)
    with pytest.raises(KeyError):
        graph.remove(1, hard=True)
    gone = soft | hard
    assert len(graph) == 180 and hit(gone) >= 0.95
    assert all(x in layer and n in graph.back[h][x] for h, layer in enumerate(graph.out) for n, to in layer.items() for x in to)
    for i in range(2, 300, 5):  # moved, and two come back
        points[i] = r.rand(6)
        graph.insert(i, points[i])
    for i in (0, 1):
        graph.insert(i, points[i])
    assert len(graph) == 182 and hit(gone - {0, 1}) >= 0.95
    for i in sorted(set(points) - gone | {0, 1}):
        graph.remove(i)
    assert len(graph) == 0 and graph.query(points[0], 5, 50) == []
    graph.insert(7, points[7])
    assert [k for _, k in graph.query(points[7], 5, 50)] == [7]


def test_index_of_graphs_is_changed_in_place(spark, tmp_path):
    r = np.random.RandomState(2)
    data = {i: r.rand(5) for i in range(240)}
    p = spark.createDataFrame([(i, x.tolist()) for i, x in data.items()], "key long, vector array<double>")
    spec = knn.HnswSpec()
    index, shards = knn.built(p, spec, shards=3)
    index.write.parquet(str(tmp_path / "a"))
    index = spark.read.parquet(str(tmp_path / "a"))
    assert index.agg(F.sum("points")).first()[0] == 240
    log = knn.changes(p.where("key % 7 = 0").drop("vector"), "remove", 1).union(knn.changes(p.where("key % 11 = 0 AND key % 7 <> 0").drop("vector"), "remove_hard", 2)).union(knn.changes(p.where("key < 30").drop("vector"), "clean", 3)).union(knn.changes(p.where("key = 14"), "insert", 4))
    index = knn.applied(index, log, spec, shards)
    gone = {i for i in data if (i % 7 == 0 or i % 11 == 0) and i != 14}
    got: dict = {}
    for x in knn.searched(index, p.where("key % 40 = 0"), 5, spec).orderBy("rank").collect():
        got.setdefault(x.query_id, []).append(x.key)
    assert got == {q: exact_keys(data, data[q], 5, gone) for q in range(0, 240, 40)}
    with pytest.raises(Exception, match="KeyError"):
        knn.applied(index, knn.changes(p.where("key = 11").drop("vector"), "remove"), spec, shards).collect()


def test_exact_neighbours_in_blocks_and_with_own_metric(spark, monkeypatch):
    r = np.random.RandomState(6)
    data = [(i, [float(x) for x in r.randint(0, 4, 6)]) for i in range(400)]
    p = spark.createDataFrame(data, "key long, vector array<double>").repartition(3)
    q = p.where("key % 20 = 0")
    want = {i: sorted((float(np.linalg.norm(np.subtract(v, w))), j) for j, w in data)[:7] for i, v in data if i % 20 == 0}
    for block in (knn.BLOCK, 6):
        monkeypatch.setattr(knn, "BLOCK", block)
        got: dict = {}
        for x in knn.exact(p, q, 7).orderBy("rank").collect():
            got.setdefault(x.query_id, []).append((x.distance, x.key))
        assert got == want
    city = lambda a, b: np.abs(a[:, None, :] - b[None, :, :]).sum(-1)
    one = knn.exact(p, p.where("key = 20"), 3, city).orderBy("rank").collect()
    assert [(x.distance, x.key) for x in one] == sorted((float(np.abs(np.subtract(data[20][1], w)).sum()), j) for j, w in data)[:3]
    sets_ = knn.METRICS["jaccard"](np.array([[1, 1, 2], [3, 4, 5]]), np.array([[2, 1, 1], [5, 9, 9]]))
    assert sets_ == pytest.approx(np.array([[0.0, 1.0], [1.0, 0.75]]))
    assert knn.exact(p, q.limit(0), 3).count() == 0



def test_store(spark, tmp_path):
    store = IndexStore(spark, {"type": "parquet", "path": str(tmp_path), "basename": "x"})
    store.save("bands", spark.range(3))
    store.append("bands", spark.range(2))
    assert store.load("bands").count() == 5
    with pytest.raises(ValueError):
        IndexStore(spark, {"type": "other"})
    shared = IndexStore(spark, {"type": "parquet", "path": str(tmp_path), "basename": "x"})
    assert shared.load("bands").count() == 5
    memory = IndexStore(spark, {"type": "memory"})
    memory.save("t", spark.range(4))
    memory.append("t", spark.range(1))
    assert memory.load("t").count() == 5


def test_store_setting_from_the_environment(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("INDEX_AT", str(tmp_path))
    store = IndexStore(spark, {"type": "parquet", "path": {"env": "INDEX_AT"}, "basename": {"env": "NOT_SET", "default": "d"}})
    assert store.path == str(tmp_path) and store.base == "d"


def test_set_files_with_headers(spark, tmp_path):
    import gzip

    (tmp_path / "a.txt").write_text("# header\n2\t1,2\n1\t7\n")
    (tmp_path / "b.txt").write_text("# another\n3\t4,5,6\n")
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("# third\n1\t9\n")
    got = read_sets(spark, str(tmp_path)).collect()
    assert sorted((r["size"], r.tokens) for r in got) == [(1, ["7"]), (1, ["9"]), (2, ["1", "2"]), (3, ["4", "5", "6"])]
    assert len({r.key for r in got}) == 4 and sorted(r.place for r in got) == [1, 1, 1, 2]
    many = "# header\n" + "".join(f"1\t{i}\n" for i in range(20_000))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "big.txt").write_text(many)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        big = read_sets(spark, str(tmp_path / "d"))
        assert big.select("block").distinct().count() > 3
        assert big.select("key").distinct().count() == 20_000 == big.select("tokens").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "d" / "big.txt").write_text("# header\nno tab\n")
    with pytest.raises(Exception, match="no tab"):
        read_sets(spark, str(tmp_path / "d")).collect()


def test_near_duplicate_sink_survives_a_lost_batch(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, {"type": "parquet", "path": str(tmp_path), "basename": "s"})
    spec, sketch = lsh.LshSpec(0.5, 16, params=(4, 4)), mh.MinHashSpec(16)
    take = near_duplicate_sink(store, spec, sketch)
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    one = spark.createDataFrame([(1, text(1)), (2, text(1)), (2, text(1)), (3, text(3))], "doc_id long, text string")
    two = spark.createDataFrame([(4, text(3)), (5, text(5)), (1, text(1))], "doc_id long, text string")
    put, calls = store.put, []

    def failing(name, df, epoch):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("lost")
        put(name, df, epoch)

    monkeypatch.setattr(store, "put", failing)
    with pytest.raises(RuntimeError):
        take(one, 0)
    monkeypatch.setattr(store, "put", put)
    take(one, 0)
    take(two, 1)
    take(two, 1)
    take(one, 0)
    assert sorted(r.doc_id for r in store.load("unique").collect()) == [1, 3, 5]
    assert store.load("bands").groupBy("doc_id").count().where("count <> 4").count() == 0
    deletion_sink(store)(spark.createDataFrame([(3,)], "doc_id long"), 2)
    assert sorted({r.doc_id for r in live(store).collect()}) == [1, 5]


def test_kept_tables_are_deleted(spark):
    df = keeping.kept(spark.range(5), "t")
    assert df.count() == 5
    keeping.dropped(df)
    with pytest.raises(Exception, match="(?i)not.exist|path"):
        spark.read.parquet(df._kept_at).count()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(40, 41), (41, 40), (50, 50)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {**{i: 0 for i in range(1, 31)}, 41: 40}
    assert components(links.limit(0)).count() == 0


def test_stream_agrees_with_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    q = windowed_registers(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.col("user_id"), hll.HllSpec(8)).writeStream.format("memory").queryName("regs").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = hll.registers(events.withColumn("day", F.to_date("ts")), ["day"], F.col("user_id"), hll.HllSpec(8))
    assert spark.table("regs").count() == want.count()


def test_buffered_queries(spark):
    found = spark.createDataFrame([(0, 2, 5), (0, 2, 5), (0, 2, 6), (1, 1, 6)], "buffer long, n long, doc_id long")
    got = lsh.in_all(found, F.col("n"), by=["buffer", "n"]).select("buffer", "doc_id").collect()
    assert sorted(map(tuple, got)) == [(0, 5), (1, 6)]
    assert [r.doc_id for r in lsh.in_all(found.where("buffer = 0"), 2).collect()] == [5]


@pytest.mark.parametrize("strip", [evaluate.STRIP, 7])
def test_pareto_in_strips(spark, monkeypatch, strip):
    monkeypatch.setattr(evaluate, "STRIP", strip)
    r = np.random.RandomState(4)
    data = [(int(a), float(b)) for a, b in zip(r.randint(0, 60, 200), r.randint(0, 500, 200))] + [(None, 1.0), (70, None)]
    best = {}
    for x, y in data:
        if x is not None and y is not None:
            best[x] = max(best.get(x, y), y)
    want = sorted((x, y) for x, y in best.items() if all(y > v for u, v in best.items() if u > x))
    points = spark.createDataFrame(data, "n long, price double")
    assert sorted(map(tuple, evaluate.pareto(points, "n", "price").collect())) == want
    assert evaluate.pareto(points.limit(0), "n", "price").count() == 0


def test_log_of_points(spark):
    rows = [(1, [1.0], 0, False), (2, [2.0], 1, False), (1, [9.0], 2, False), (3, [3.0], 3, False), (3, None, 4, True), (None, [5.0], 5, False)]
    log = spark.createDataFrame(rows, "key long, vector array<double>, seq long, deleted boolean")
    assert sorted((r.key, r.vector, r.place) for r in nodes.items(log).collect()) == [(1, [9.0], 0), (2, [2.0], 1)]
    assert [r.key for r in nodes.popped(log).collect()] == [2] and [r.key for r in nodes.popped(log, last=False).collect()] == [1]
    both = {r.key: r.vector for r in nodes.merged(log, log.where("key = 3 AND NOT deleted").union(log.where("seq = 0"))).collect()}
    assert both == {1: [1.0], 2: [2.0], 3: [3.0]}
    assert nodes.items(log.limit(0)).count() == 0 and nodes.popped(log.limit(0)).count() == 0


def test_graph_shards_grow_with_the_points(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD", 20)
    r = np.random.RandomState(3)
    p = spark.createDataFrame([(i, r.rand(4).tolist()) for i in range(300)], "key long, vector array<double>")
    q = p.where("key % 50 = 0")
    assert evaluate.recall_at_k(knn.hnsw(p, q, 5, knn.HnswSpec()), knn.exact(p, q, 5)).agg(F.avg("recall")).first()[0] >= 0.9


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in ("documents", "benchmark", "lineitem", "embeddings", "customer", "orders", "events", "part"):
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def same_as_sql(spark, con, name):
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("name", ["bloom_query", "bloom_agreement"])
def test_bloom_queries_are_exact_where_the_filter_errs(spark, con, monkeypatch, name):
    monkeypatch.setattr(registry, "BLOOM_FP", 0.5)
    same_as_sql(spark, con, name)


def test_bands_with_equal_sums_are_told_apart(spark):
    sigs = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [2, 1, 9, 9]), (2, [5, 5, 3, 4]), (3, [7, 7, 7, 7])], "doc_id long, sig array<long>")
    ix, spec = lsh.bands(sigs, lsh.LshSpec(0.5, 4, params=(2, 2))), lsh.BloomSpec(100, 1e-6)
    probes = ix.where("doc_id <> 1")
    for others, want in ((ix.where("doc_id = 1"), {0: False, 2: False, 3: False}), (ix.where("doc_id IN (1, 2)"), {0: True, 2: True, 3: False})):
        found = lsh.bloom_query(probes, lsh.bloom_filter(others, spec), spec)
        assert {r.doc_id: r.seen for r in found.collect()}[0]
        assert {r.doc_id: r.seen for r in lsh.bloom_checked(found, probes, others).collect()} == want


@pytest.mark.parametrize("name", ["hnsw_topk", "hnsw_soft_remove", "hnsw_hard_remove", "hnsw_recall"])
def test_graph_queries_are_exact_where_walks_miss(spark, con, monkeypatch, name):
    """Walks over a poor graph miss here what those over a good one miss among very many points."""
    monkeypatch.setattr(registry, "HNSW", knn.HnswSpec(m=2, ef_construction=2, ef=1))
    same_as_sql(spark, con, name)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"minhash_signature_native"}))
def test_query_against_sql(spark, con, name):
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert name in ("weighted_minhash_jaccard", "weighted_forest_topk", "hnsw_minhash_topk")
        assert registry.queries()[name](spark, SF).count() >= 0
        return
    want = con.sql(sql)
    got = registry.queries()[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())) and (got or name in ("near_dup_pairs",))
