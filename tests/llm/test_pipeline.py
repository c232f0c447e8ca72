"""The pipeline's stages and the registered queries against DuckDB on the smallest tables."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from millrace.llm import decontaminate, lines, mixing, quality

SF = "/root/testdata/sf0.001"


def normal(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_substring_dedup", "op4_warc", "op7_chat_format", "op8_mixing", "op9_line_dedup", "op10_radix_dedup"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SF)
    assert normal(got.select(*want.columns).collect()) == normal(want.fetchall())


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        docs = docs.cache()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


def brute(docs, labels, bench, field):
    """Ids that run() returns, with their texts, by plain Python; docs are (id, text, lang, source), ids without ties."""
    kept = [d for d in docs if not quality.brute(d[1])[5] and quality.brute_share(d[1], field) >= field.share]
    texts = {}
    done = {r[0]: r for r in lines.brute([(d[0], d[1]) for d in kept], texts=texts)}
    kept = [(d[0], texts[d[0]], *d[2:]) for d in kept if done[d[0]][2] < done[d[0]][1] or not done[d[0]][1]]
    sets = []
    for d in kept:
        w = d[1].lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set())
    up = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b, key=lambda k: kept[k][0]) if x in (a, b) else x for x in up]
    kept = [d for i, d in enumerate(kept) if up[i] == i]
    hit = {r[0] for r in decontaminate.brute([(d[0], d[1]) for d in kept], bench) if r[5]}
    kept = [d for d in kept if d[0] not in hit]
    targets = mixing.Targets()

    def cell(d):
        n, k = len(d[1]), d[1].count("\n")
        topic = "list" if k >= 4 and n < k * 60 else "note" if n < 600 else "article" if n < 4000 else "essay"
        return tuple(v if v in own else "other" for v, own in ((d[3], targets.source), (d[2], targets.lang), (topic, targets.topic)))

    cells = {}
    for d in kept:
        cells[cell(d)] = cells.get(cell(d), 0) + len(d[1].split())
    rates, _ = mixing.rake(cells, targets)
    out = {}
    for d in kept:
        draw = int(hashlib.sha1(f"{targets.seed}:{d[0]}".encode()).hexdigest()[:13], 16) / 2**52
        rate = rates.get(cell(d), 1.0)
        copies = int(rate) + (draw < rate % 1)
        if copies:
            out[d[0]] = (d[1], copies)
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    line = lambda: " ".join(word() for _ in range(r.randrange(5, 14))).capitalize() + "."
    shared, docs = [line() for _ in range(4)], []
    bench = [(k, " ".join(word() for _ in range(14))) for k in range(4)]
    for i in range(90):
        own = [line() for _ in range(r.randrange(4, 12))]
        if i % 6 == 0:
            own += shared
        if i % 9 == 0:
            own.insert(2, bench[i % 4][1])
        if i % 11 == 0:
            own = ["BUY # NOW $ $ |"] * 12
        if i % 7 == 3 and i > 10:  # a near copy on other lines
            own = [" ".join(docs[i - 7][1].split()[:-1]) + " changed"]
        if i % 13 == 5:
            own = docs[i - 5][1].split("\n")
        docs.append((i, "\n".join(own), r.choice(["en", "de", "xx"]), f"src{r.randrange(3)}"))
    docs += [(200, None, None, None), (201, "", "en", "src0"), (202, "too short", "en", "src0")]
    labels = [(i, 0 if i % 11 == 0 else 1, 0) for i in range(0, 90, 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    field = quality.fitted(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    got = {x.doc_id: (x.text, x.sample_copies) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute(docs, labels, bench, field)
    assert got == want and 20 < len(want) < 90
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/empty/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
