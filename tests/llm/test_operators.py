"""Each operator against a brute-force version on small tables with nulls, empties, ties, repeats and extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import chat, decontaminate, lines, mixing, pii, quality, queries, radix, simhash, substring, warc
from millrace.llm.common import Text
from millrace.operators.graph import components

KEY = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
POOL = ["a b c", "", "  ", "one two three four five six seven eight nine ten", "x. y z! w v u t s r. A B c d e", "a b C D E", "q\tw e r t y. ", "é è. ê ë ô â î! u"]


def rows(seed=1, n=60):
    r = random.Random(seed)
    out = [(i, "\n".join(r.choice(POOL) for _ in range(r.randrange(9)))) for i in range(n)]
    return out + [(None, "A b C D E\na b c"), (900, None), (901, ""), (902, "p q r s t u v w x y")]


def frame(spark, data, extra=True):
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    return df.withColumns({"n_words": F.lit("mine"), "fp": F.lit(1), "dk": F.lit(2), "id": F.lit(3)}) if extra else df


def test_decontamination_matches_brute_force(spark):
    docs = rows() + [(950, "x " * 5000 + "One two-three FOUR five six seven eight nine ten. tail")]
    bench = [(1, "one two three four five six seven eight nine ten eleven"), (2, "w v u"), (3, None), (None, "p q R s"), (4, "zz yy"), (2, "one two three four five six seven eight nine ten")]
    got = decontaminate.report(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=KEY) == sorted(decontaminate.brute(docs, bench), key=KEY)
    left = decontaminate.removed(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"))
    assert left.columns == frame(spark, docs).columns
    assert left.count() == sum(not x[5] for x in decontaminate.brute(docs, bench))


def test_decontamination_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ROUND_BYTES", 60)
    docs = rows()
    bench = [(i, x) for i, x in enumerate(["one two three four five six seven eight nine ten", "w v u", "q w", "three four five", "a b c", "e ë"])]
    got = decontaminate.report(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted((tuple(r)[:6] for r in got.collect()), key=KEY) == sorted(decontaminate.brute(docs, bench), key=KEY)


def test_longest_match_of_the_suffix_array():
    import pyarrow as pa

    r = random.Random(11)
    word = lambda k: " ".join(r.choice("abcdef") for _ in range(k))
    bench = [word(r.randrange(1, 40)) for _ in range(30)] + ["a b c d e f a b c d"] * 3
    docs = [word(r.randrange(0, 80)) + " zz " + r.choice(bench) + " " + word(9) for _ in range(40)]
    for window in (3, 5):
        n, _, _, longest = decontaminate.search(Text(pa.array(docs)), decontaminate.Queries([str(i) for i in range(len(bench))], bench, window))
        for t, got in zip(docs, longest):
            w, want = t.split(), 0
            for x in (b.split() for b in bench):
                for i in range(len(w)):
                    for j in range(len(x)):
                        k = 0
                        while i + k < len(w) and j + k < len(x) and w[i + k] == x[j + k]:
                            k += 1
                        if k >= window or k == len(x):
                            want = max(want, k)
            assert got == want


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(frame(spark, rows()), none).where("contaminated").count() == 0
    assert decontaminate.report(frame(spark, rows()).limit(0), none).count() == 0


@pytest.mark.parametrize("module", [lines, substring])
def test_line_and_unit_dedup_match_brute_force(spark, module):
    got = module.report(frame(spark, rows()))
    assert sorted((tuple(r) for r in got.collect()), key=KEY) == sorted(module.brute(rows()), key=KEY)
    assert module.report(frame(spark, rows()).limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    twice = [(1, POOL[3] + "\n" + POOL[4]), (1, POOL[3] + "\n" + POOL[4])]
    for module in (lines, substring):
        got = [tuple(r) for r in module.report(frame(spark, twice)).collect()]
        assert len(got) == 2 and got[0] == got[1] and got[0][2] == 0
        with pytest.raises(TypeError):
            module.report(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("least, lone", [(1, 3), (2, 10), (3, 1)])
def test_runs_of_lines_match_brute_force(spark, least, lone):
    r = random.Random(least)
    pool = ["a", "b", "c d", "e f g", " a ", "h i j k l m n o p q"]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(30)))) for i in range(25)]
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, docs[4][1] + "\n" + docs[5][1]), (103, "\n".join(["a"] * 14)), (None, docs[6][1]), (104, None), (105, pool[5]), (106, pool[5])]
    got = sorted((tuple(x) for x in lines.report(frame(spark, docs), least, lone).collect()), key=KEY)
    assert got == sorted(lines.brute(docs, least, lone), key=KEY)


def test_line_dedup_of_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b\nc d", 7), (2, "a b\nc d", 8), (3, None, 9)], "doc_id long, text string, dk int").withColumns({"__dk": F.lit(1), "gone": F.lit(2), "TH": F.lit("x"), "i": F.lit(0), "__l_lines": F.lit(3)})
    got = lines.deduplicated(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.dk, r["__l_lines"]) for r in got.collect()) == [(1, 7, 3), (3, 9, 3)]


def test_line_dedup_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b\nc d", "en", 7, 9), (2, "a b\nc d", "en", 7, 9), (3, None, None, None, 9)], "doc_id long, text string, lang string, n_chars long, n int")
    got = lines.deduplicated(docs)
    assert got.columns == docs.columns and [r.doc_id for r in got.orderBy("doc_id").collect()] == [1, 3]


def fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def linked(fps):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    a = np.array(fps, dtype=np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)):
        i, j = find(i), find(j)
        up[max(i, j)] = min(i, j)
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    docs = [(i, t) for i, t in rows() if i is not None] + [(2000, "One TWO"), (2001, "\x0b\x0c"), (2002, "é " * 300)]
    got = {r.id: r for r in simhash.near_duplicates(frame(spark, docs)).collect()}
    fps = [fingerprint(t) for _, t in docs]
    roots = linked(fps)
    least = {}
    for (i, _), r in zip(docs, roots):
        least[r] = min(least.get(r, i), i)
    for (i, _), f, r in zip(docs, fps, roots):
        assert got[i].fp % 2**64 == f and got[i].component == least[r]
    assert {r.doc_id for r in simhash.deduplicated(frame(spark, docs)).collect()} == set(least.values())
    assert simhash.near_duplicates(frame(spark, docs).limit(0)).count() == 0


def test_pipeline_near_duplicates_match_brute_force(spark):
    r = random.Random(8)
    texts = [t for i, t in rows() if i is not None]
    for k in range(40):  # 40 of 50 shingles in common, and chains of such
        own = [f"w{k}x{i}" for i in range(64)]
        texts += [" ".join(own[:44]), " ".join(own[:54]), " ".join(own)]
    core = [f"c{i}" for i in range(200)]
    for k in range(60):  # a dense cluster
        own = core[:]
        for at in r.sample(range(200), 4):
            own[at] = f"e{k}"
        texts.append(" ".join(own))
    r.shuffle(texts)
    docs = list(enumerate(texts))
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set())
    up = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    got = corpus_pipeline.near_duplicates(spark, frame(spark, docs), "")
    assert sorted(x.doc_id for x in got.collect()) == sorted(set(up))
    assert corpus_pipeline.near_duplicates(spark, frame(spark, docs).limit(0), "").count() == 0


@pytest.mark.parametrize("share", [simhash.SHARE, 16])
def test_trie_join_of_dense_clusters(spark, monkeypatch, share):
    monkeypatch.setattr(simhash, "SHARE", share)
    r = random.Random(5)
    fps = set()
    for _ in range(6):
        core = r.getrandbits(64)
        for _ in range(60):
            fps.add(core ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))))
    fps = sorted(fps)
    table = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    roots = {r.node % 2**64: r.root for r in components(simhash.links(table)).collect()}
    name = [roots.get(f, f - 2**64 if f >= 2**63 else f) for f in fps]
    want = linked(fps)
    assert len(set(zip(name, want))) == len(set(name)) == len(set(want))


def test_radix_dedup_matches_brute_force(spark, monkeypatch):
    r = random.Random(1)
    text = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    base = text("abcdé ", 400)
    docs = [(i, text("ab", r.choice([0, 5, 49, 50, 51, 60, 300]))) for i in range(40)]
    for i in range(40, 120):
        a = r.randrange(300)
        b = a + r.randrange(30, 140)
        docs.append((r.randrange(40, 90), r.choice(["", "x" * r.randrange(200)]) + base[a:b] + text("xyz", 20) + base[b // 2 : b // 2 + 70]))
    docs += [(None, base[:120]), (3, None), (200, "a" * 500), (201, "a" * 300), (202, "ab" * 200), (202, "ab" * 200)]
    want = sorted(radix.brute(docs), key=KEY)
    for flush in (400, 1 << 20):
        monkeypatch.setattr(radix, "FLUSH", flush)
        assert sorted((tuple(x) for x in radix.report(frame(spark, docs)).collect()), key=KEY) == want
    monkeypatch.setattr(radix, "BUCKET_BYTES", 1000)
    assert sorted((tuple(x) for x in radix.report(frame(spark, docs)).collect()), key=KEY) == want
    assert radix.report(frame(spark, docs).limit(0)).count() == 0


def test_quality_counts_match_brute_force(spark):
    junk = ["word " * 40, "a b c d e f g h " * 5, "# $ | " * 30, "ok line here.\nok line here.\n\n" * 4, "x" * 3000]
    docs = rows() + [(5000 + i, t) for i, t in enumerate(junk)]
    got = {r.doc_id: tuple(r)[1:7] for r in quality.report(frame(spark, docs), None).collect()}
    assert got == {i: quality.brute(t) for i, t in docs}
    assert quality.report(frame(spark, docs).limit(0), None).count() == 0


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(3)
    first = np.array([0, 3, 3, 8, 9])
    x = r.normal(size=(9, quality.FEATURES))
    field = quality.Field(r.normal(size=quality.FEATURES), r.normal(size=(2, 2)))
    got = quality.viterbi(x, first, field)
    for a, b in zip(first, first[1:]):
        u = x[a:b] @ field.weights
        score = lambda y: sum(v if k else -v for v, k in zip(u, y)) + sum(field.steps[p, q] for p, q in zip(y, y[1:]))
        paths = [tuple(int(c) for c in f"{k:0{b - a}b}") if b > a else () for k in range(2 ** (b - a))]
        assert not paths or score(tuple(got[a:b])) == pytest.approx(max(map(score, paths)))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels, docs = queries.table(spark, sf, "labels"), queries.table(spark, sf, "documents").repartition(8, "doc_id")
    field = quality.fitted(docs, labels.where("doc_id % 3 <> 0"))
    out, c = quality.judged(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), field)
    got = out.where(~F.col(c["failed"])).groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col(c["kept"]).cast("int")).alias("kept"))
    found = {r.quality: r for r in got.collect()}
    assert found[1].kept >= 0.98 * found[1].n and found[0].n - found[0].kept >= 0.8 * found[0].n


def test_quality_verdicts_match_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    labels, docs = queries.table(spark, sf, "labels"), queries.table(spark, sf, "documents")
    junk = [(9000, None), (9001, ""), (9002, "a b c. " * 900), (9003, "BUY # NOW $\n" * 50 + "word " * 30), (9003, "BUY # NOW $\n" * 50 + "word " * 30), (9004, "Én tëxt héré wïth möre wörds.\n\n" * 20)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(junk, "doc_id long, text string")).withColumns({"kept": F.lit("mine"), "N_WORDS": F.lit(1)})
    field = quality.fitted(docs, labels)
    got = sorted((r.doc_id, r.kept, r.content_share) for r in quality.report(docs, labels).collect())
    want = []
    for r in docs.collect():
        share = quality.brute_share(r.text, field)
        want.append((r.doc_id, not quality.brute(r.text)[5] and share >= field.share, round(share, 6)))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in sorted(want)]
    assert max(abs(x[2] - y[2]) for x, y in zip(got, sorted(want))) < 2e-6
    left = quality.accepted(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(k for _, k, _ in want)


def test_quality_fit_is_bound_by_bytes(spark):
    docs = spark.createDataFrame([(i, ("word " * 40 + "\n") * 3 if i % 2 else "# $ %\n" * 60) for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert quality.fitted(docs, labels, most_bytes=0) is quality.DEFAULT and quality.fitted(docs, labels.limit(0)) is quality.DEFAULT


MODEL = pii.boosted(pii.generated(2000, [("some words before ", " and after")]))


def test_pii_base_spans_match_brute_force(spark):
    r = random.Random(3)
    alphabet = list("ab1234567890.-+@() é\n") + ["1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "x@y.z", "𝒳"]
    docs = [(i, "".join(r.choice(alphabet) for _ in range(r.randrange(120)))) for i in range(1500)]
    docs += [(5000, None), (5001, "a@b.cd@e.f a@b.c_d@e.f %@x.y."), (5002, "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1"), (5003, "1" * 30000 + "@"), (5004, "1 " * 20000), (5004, "1 " * 20000)]
    got = sorted((x.doc_id, x.base_sha256, x.n_email, x.n_ip, x.n_card, x.n_phone) for x in pii.report(frame(spark, docs), MODEL).collect())
    plain = [(i, *pii.brute(t)) for i, t in docs]
    want = sorted((i, sha, *(sum(s[0] == k for s in found) for k in pii.BASE)) for i, found, sha in plain)
    assert got == want


def test_pii_long_runs_take_linear_time(spark):
    docs = [(1, "a" * 200_000), (2, "a." * 50_000 + "@" + "b." * 50_000 + "c"), (3, "+" * 100_000), (4, "1." * 100_000)]
    got = {x.doc_id: x for x in pii.report(frame(spark, docs), MODEL).collect()}
    assert got[2].n_email == 1 and got[1].n_email == 0


LONG = "A1b2" * 45


def test_pii_method_adds_spans_and_spares_clean_text(spark):
    docs = [(1, 'set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" now'), (2, "call (212) 555-0134 today"), (3, "ssn 123-45-6789"), (4, "plain words-with-hyphens/and/slashes in 2020 or 2021"), (5, "phone: +1 (212) 555-0134"), (6, f"key = {LONG} end"), (7, "key = eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P end"), (8, "mail: " + "x" * 90 + " (at) " + "y" * 80 + " (dot) org")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit(1), "TH": F.lit(2), "cuts": F.lit(3)})
    got = {x.doc_id: x for x in pii.report(df).collect()}
    assert [got[k].spans for k in (1, 2, 3, 4, 5)] == ["secret:13:53", "phone:5:19", "ssn:4:15", "", "phone:7:24"]
    assert got[6].spans == "secret:6:186" and got[7].spans == f"secret:6:{len(docs[6][1]) - 4}" and got[8].spans == f"email:6:{len(docs[7][1])}"
    assert [(got[k].n_spans, got[k].n_further) for k in (1, 4, 5)] == [(1, 1), (0, 0), (1, 0)]
    clean = pii.redacted(df, model=MODEL)
    text = {x.doc_id: x.text for x in clean.collect()}
    assert clean.columns == df.columns and text[1] == 'set token = "[SECRET]" now' and text[4] == docs[3][1] and text[5] == "phone: [PHONE]"


def test_pii_of_nothing_and_of_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(none).count() == 0 and pii.redacted(none).count() == 0
    df = spark.createDataFrame([(None, None), (1, "a@b.c"), (1, "a@b.c"), (1, "x"), (None, "a@b.c")], "doc_id long, text string")
    assert sorted((x.n_email, x.spans) for x in pii.report(df, MODEL).where("doc_id = 1").collect()) == [(0, ""), (1, "email:0:5"), (1, "email:0:5")]
    assert sorted(str(x.text) for x in pii.redacted(df, model=MODEL).collect()) == ["None", "[EMAIL]", "[EMAIL]", "[EMAIL]", "x"]


def test_pii_scores_are_those_of_the_trees(spark):
    r = random.Random(2)
    model = pii.boosted(pii.generated(600, [("some words ", " more")]))
    rows_ = [[float(r.randrange(0, 60)) for _ in pii.FEATURES] for _ in range(50)]
    df = spark.createDataFrame([(x,) for x in rows_], "x array<double>")
    for kind, (rate, trees) in model.trees.items():
        got = [(list(z.x), z.s) for z in df.select("x", pii.scored(model, kind, "x").alias("s")).collect()]
        assert all(s == pytest.approx(sum(rate * pii._value(t, x) for t in trees)) for x, s in got)


def test_pii_on_the_documents(spark):
    """Secrets are planted as token = "40 hex digits"; nothing else that the trees add should be there."""
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents").repartition(8)
    model = pii.fitted(docs)
    assert all(precision >= pii.PRECISION and recall >= 0.6 for _, precision, recall in model.held.values())
    planted = docs.select("doc_id", F.regexp_count("text", F.lit('token = "[0-9a-f]{40}"')).alias("n")).where("n > 0")
    got = pii.spans(docs, model=model).where("kind IS NOT NULL AND NOT base").groupBy("id").agg(F.count("*").alias("found"))
    both = planted.join(got, planted.doc_id == got.id, "full").agg(F.sum("n"), F.sum("found"), F.sum(F.least(F.coalesce("n", F.lit(0)), F.coalesce("found", F.lit(0))))).first()
    assert both[2] >= 0.98 * both[0] and both[2] >= 0.9 * both[1]


def test_chat_round_trip(spark):
    turns = [(1, 0, "us\ner\\", "a<|im_end|>\n<\\|x|><"), (1, 1, "assistant", "<\\\\|im_end|>é<"), (1, 1, "assistant", None), (1, 2, None, "|x"), (2, 0, "assistant", ""), (None, 0, "assistant", "<|im_start|>assistant\nok<|im_end|>\n"), (3, None, "<|im_end|>", "$1\\|"), (4, 0, "\\n", "\\")]
    turns += [(7, k, "assistant", f"t{k}") for k in range(700)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.rendered(chat.folded(chat.as_events(df)))).collect()}
    for c in {t[0] for t in turns}:
        want = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for _, r, t in want]
        masked = [got[c].formatted[m.start : m.end] for m in got[c].mask]
        assert [re.sub(r"<(\\*)\\\|", r"<\1|", m) for m in masked] == [t for _, r, t in want if r == "assistant"]
    report = {r.conv_id: r for r in chat.report(df).collect()}
    assert report[7].loss_sha256 == hashlib.sha256("".join(f"t{k}" for k in range(700)).encode()).hexdigest()
    assert chat.report(df.limit(0)).count() == 0


def test_chat_folds_events(spark):
    log = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "He"), (1, 3, 1, "delta", "assistant", "llo"), (1, 4, 1, "regenerate", "assistant", None), (1, 5, 1, "delta", "assistant", "Yo"), (1, 6, 1, "delta", "assistant", " man"), (1, 7, 2, "delta", "user", "x"), (1, 8, 2, "edit", "user", "y"), (1, 9, 2, "delta", "user", "z")]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = chat.read_back(chat.rendered(chat.folded(df))).first()
    assert [(t.role, t.text) for t in got.turns] == [("user", "hi"), ("assistant", "Yo man"), ("user", "yz")]


def test_chat_folds_messages_with_their_turn(spark):
    log = [(1, 1, 0, "message", "user", "hello"), (1, 2, 0, "edit", "user", "hello!")]
    log += [(2, 1, 0, "message", "assistant", "Hel"), (2, 2, 0, "delta", "assistant", "lo")]
    log += [(3, 1, 0, "message", "assistant", "void"), (3, 2, 0, "regenerate", "assistant", None), (3, 3, 0, "delta", "assistant", "n"), (3, 4, 0, "delta", "assistant", "ew")]
    log += [(4, 1, 0, "message", "user", "old"), (4, 2, 0, "message", "user", "b"), (4, 2, 0, "message", "user", "a"), (4, 2, 0, "message", "user", "a"), (4, 3, 1, "message", "assistant", "c")]
    log += [(5, 1, None, "message", "user", "x"), (5, 2, None, "edit", "user", "y"), (5, None, 2, "message", "user", "p"), (5, None, 2, "message", "user", "q"), (5, 9, 2, "delta", "user", "r")]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(3)
    got = {r.conv_id: [t.text for t in r.turns] for r in chat.read_back(chat.rendered(chat.folded(df))).collect()}
    assert got == {1: ["hello!"], 2: ["Hello"], 3: ["new"], 4: ["a", "a", "b", "c"], 5: ["y", "p", "qr"]}
    with pytest.raises(Exception, match="unknown kind"):
        chat.folded(df.withColumn("kind", F.lit("other"))).collect()


def fold(log):
    """Texts of one conversation's messages by replaying events (seq, turn, kind, role, text) one after another; turns and seqs are not null."""
    said = {}
    for seq, turn, kind, role, text in sorted(log, key=lambda e: (e[0], e[2], e[3], e[4])):
        if kind == "regenerate":
            said = {t: v for t, v in said.items() if t < turn} | {turn: [role, []]}
        elif kind in ("message", "edit"):
            said[turn] = [role, [text]]
        else:
            said.setdefault(turn, [role, []])
            said[turn][0] = role
            said[turn][1].append(text)
    return [(r, "".join(x)) for _, (r, x) in sorted(said.items())]


def test_chat_fold_replays_the_log(spark):
    r = random.Random(9)
    log = {c: [(s, r.randrange(5), r.choice(chat.KINDS), r.choice(["user", "assistant"]), r.choice(["a", "b<|im_end|>", "", "ccc"])) for s in range(r.randrange(1, 25))] for c in range(60)}
    df = spark.createDataFrame([(c, *e) for c, es in log.items() for e in es], "conv_id long, seq long, turn long, kind string, role string, text string").repartition(5)
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat.read_back(chat.rendered(chat.folded(df))).collect()}
    assert got == {c: fold(es) for c, es in log.items()}


def test_chat_log_holds_every_kind_and_discards_what_is_void(spark):
    rows_ = [(1, 0, "user", "q" * 30), (1, 1, "assistant", "answer " * 200), (1, 2, "user", "thanks"), (2, 0, "system", "s"), (2, 1, "assistant", "")]
    log = chat.as_events(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string"))
    assert {x.kind for x in log.select("kind").distinct().collect()} == set(chat.KINDS) and log.count() > 2 * len(rows_)
    got = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat.read_back(chat.rendered(chat.folded(log))).collect()}
    assert got == {c: [(r, t) for k, _, r, t in rows_ if k == c] for c in (1, 2)}


def test_raking_meets_the_marginals(spark):
    r = random.Random(4)
    cells = {(f"s{i}", f"l{j}", f"t{k}"): r.randrange(1, 1000) for i in range(4) for j in range(3) for k in range(2)}
    targets = mixing.Targets({"s0": 0.1, "s1": 0.2, "s2": 0.3, "s3": 0.4}, {"l0": 0.2, "l1": 0.3, "l2": 0.5}, {"t0": 0.9, "t1": 0.1})
    f, off = mixing.rake(cells, targets)
    assert off < 1e-12
    total = sum(cells.values())
    for d, want in enumerate((targets.source, targets.lang, targets.topic)):
        for k, share in want.items():
            assert sum(n * f[c] for c, n in cells.items() if c[d] == k) / total == pytest.approx(share)


def test_mixing_is_exact_in_expectation_and_repeatable(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 3}", "en" if i % 4 else None, 5) for i in range(4000)] + [(None, None, None, None, 5)], "doc_id long, text string, source string, lang string, sample_copies int")
    targets = mixing.Targets({"s0": 0.6, "s1": 0.2, "s2": 0.2}, {"en": 0.5, "other": 0.5}, {"note": 1.0})
    docs = docs.withColumns({"rate": F.lit(1), "SOURCE_class": F.lit("x"), "__m_source": F.lit("y")})
    assert mixing.sampled(docs, targets).columns == ["doc_id", "text", "source", "lang", "rate", "SOURCE_class", "__m_source", "sample_rate", "sample_copies"]
    got = mixing.report(docs, targets).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.report(docs.repartition(3), targets).collect()), key=str)
    total = sum(x.n_tokens for x in got)
    mix = sum(x.n_tokens * x.copies for x in got if x.source_class == "s0") / total
    assert abs(mix - 0.6) < 0.05 and all(int(x.rate) <= x.copies <= int(x.rate) + 1 for x in got)
    assert mixing.sampled(docs, targets).count() == sum(x.sampled for x in got)
    assert mixing.report(docs.limit(0), targets).count() == 0


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    pages = [(1, "u", "x" * 2000), (5, "a b\r\nc", "x" * 2000), (5, None, "x" * 2000), (3, "v", None), (None, "w", "x" * 2000), (7, "v", "é" * 499), (8, "v", "é" * 499), (9, "v", "é" * 500), (10, "v", "é" * 500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    first = warc.write(df, f"file://{tmp_path}/a", file_bytes=400).orderBy("file").collect()
    again = warc.write(df.repartition(5), f"file://{tmp_path}/b", file_bytes=400).orderBy("file").collect()
    assert first == again and len(first) > 1
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/a").collect()), key=KEY)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    x, e = sha("x" * 2000), sha("é" * 500)
    assert got == [(None, 2000, x, "revisit", 5), (1, 2000, x, "revisit", 5), (3, 0, sha(""), "response", None), (5, 2000, x, "response", None), (5, 2000, x, "revisit", 5), (7, 998, sha("é" * 499), "response", None), (8, 998, sha("é" * 499), "response", None), (9, 1000, e, "revisit", 10), (10, 1000, e, "response", None)]
    assert warc.report(df.limit(0)).count() == 0


def test_warc_shards_follow_bytes_and_not_ids(spark, tmp_path):
    far = [(i, "u", f"{i} " * 700) for i in range(2000)]
    for k, data in enumerate((far, [*far, (1 << 62, "u", "x")], [(2 * i, u, h) for i, u, h in far])):
        df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
        base = df.withColumn("html", F.coalesce("html", F.lit("")))
        starts = warc.shard_starts(base, 200_000)
        total = sum(len(h) + 512 for *_, h in data)
        assert total / 200_000 - 1 <= len(starts) <= total / 200_000 + 1
        manifest = warc.write(df, f"file://{tmp_path}/{k}", shard_bytes=200_000)
        spans = sorted((r.shard, r.first_id, r.last_id) for r in manifest.collect())
        assert all(a[2] < b[1] for a, b in zip(spans, spans[1:])) and manifest.agg(F.sum("records")).first()[0] == len(data)


def test_warc_refuses_damage(spark, tmp_path):
    from pyspark.errors import PythonException

    df = spark.createDataFrame([(1, "u", "x" * 50)], "page_id long, url string, html string")
    name = warc.write(df, f"file://{tmp_path}/a").first().file
    record = warc.record(1, "u", b"x" * 50, None)
    (tmp_path / "a" / name).write_bytes(record)
    assert warc.read(spark, f"file://{tmp_path}/a").count() == 1
    (tmp_path / "a" / name).write_bytes(record + record)
    with pytest.raises(PythonException):
        warc.read(spark, f"file://{tmp_path}/a").count()


def test_text_of_slices():
    import pyarrow as pa

    t = Text(pa.array(["ab", None, "é", "z"]).slice(1, 2))
    assert t.n == 2 and t.row(0) == b"" and t.row(1) == "é".encode()


def test_near_duplicates_come_by_the_trie_and_are_checked(spark, monkeypatch):
    """Every pair that the trie links is measured; those it does not link are found by the set join. A budget of 64 links everything, one of 0 only equal fingerprints."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdef") for _ in range(6))
    data = []
    for i in range(24):
        own = [word() for _ in range(r.randrange(40, 90))]
        data.append((4 * i, " ".join(own)))
        for k in (1, 2, 3):  # the last word, two or many words differ
            for _ in range((0, 1, 2, 12)[k]):
                own[-1 if k == 1 else r.randrange(len(own))] = word()
            data.append((4 * i + k, " ".join(own)))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in data)]
    pairs = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    up = list(range(len(sets)))
    for i, j in sorted(pairs):
        up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    join = simhash.Join(docs, 0.8, 5)
    node = {x.id: x.node for x in join.owners.collect()}
    real = {tuple(sorted((node[i], node[j]))) for i, j in pairs}
    plain, asked = simhash.links, []
    for budget in (0, 5, 64):
        monkeypatch.setattr(simhash, "links", lambda fps, _, b=budget: (asked.append(fps.count()), plain(fps, b))[1] if b < 64 else fps.alias("x").crossJoin(fps.alias("y")).selectExpr("x.fp AS a", "y.fp AS b").where("a < b"))
        known = simhash.fingerprint_links(join, docs, "doc_id", "text")
        got = {tuple(sorted(x)) for x in known.collect()}
        assert got <= real and (got or not budget) and (budget < 64 or got == real)
        assert {x.id: x.component for x in join.classes(known).collect()} == dict(enumerate(up))
    asked.clear()
    monkeypatch.setattr(simhash, "links", lambda fps, budget: (asked.append(fps.count()), plain(fps, budget))[1])
    assert {x.doc_id for x in simhash.similar_deduplicated(docs).collect()} == set(up) and asked == [len(data)]


@pytest.mark.parametrize("find", [simhash.deduplicated, simhash.similar_deduplicated])
def test_one_row_of_each_group_stays(spark, find):
    one, two = "alpha beta gamma delta epsilon zeta", "eins zwei drei vier fünf sechs"
    data = [(5, one), (3, two), (5, two), (5, two), (None, one), (None, one), (7, "other words stand in this text here"), (7, "other words stand in this text here")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({"key": F.lit(1), "__stay": F.lit(2), "out": F.lit(3), "id": F.lit(4)})
    got = find(docs)
    assert got.columns == docs.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(3, two), (5, one), (7, data[6][1])]
    alone = spark.createDataFrame([(None, one), (None, one)], "doc_id long, text string")
    assert find(alone).count() == 1 and find(alone.limit(0)).count() == 0
