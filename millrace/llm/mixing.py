"""Mixing: token weights are raked to source, language and topic marginals, and documents sampled to match.

The targets are a parameter, so the number of cells is bound by their number: a value that no target
names is of class other. Only the cells' token counts (at most MAX_CELLS) reach the driver.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, plain

OTHER = "other"
MAX_CELLS = 100_000


@dataclass(frozen=True)
class Targets:
    """Shares of tokens by class; each dimension is scaled to sum to one over the classes that have tokens."""

    source: dict = field(default_factory=lambda: {"src0": 0.24, **{f"src{k}": 0.04 for k in range(1, 20)}, OTHER: 0.04})
    lang: dict = field(default_factory=lambda: {"en": 0.5, "de": 0.15, "fr": 0.15, "es": 0.15, OTHER: 0.05})
    topic: dict = field(default_factory=lambda: {"note": 0.05, "article": 0.45, "essay": 0.4, "list": 0.1, OTHER: 0.05})
    #: Tokens of the mix for each token of the input.
    size: float = 1.0
    seed: int = 17


def topic_of(text: Column) -> Column:
    """The form of a text, which stands for its topic where a table has no such column: list (many short lines), note, article or essay by length."""
    n, lines = F.length(text), F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when((lines >= 4) & (n < lines * 60), "list").when(n < 600, "note").when(n < 4000, "article").otherwise("essay")


DIMENSIONS = ("source", "lang", "topic")


def classed(docs: DataFrame, targets: Targets) -> tuple[DataFrame, list[str]]:
    """docs with the classes of DIMENSIONS and the number of tokens (words between white space; a null text has none); and these columns' names, which are free in docs."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def known(value: Column, named: dict) -> Column:
        return F.when(value.isin(*[k for k in named if k != OTHER]), value).otherwise(F.lit(OTHER))

    column = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(OTHER)
    topic = column("topic") if "topic" in docs.columns else topic_of(text)
    names = free(docs.columns, *(f"{d}_class" for d in DIMENSIONS), "n_tokens")
    values = [known(column("source"), targets.source), known(column("lang"), targets.lang), known(topic, targets.topic), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")]
    return docs.withColumns(dict(zip(names, values))), names


def rake(cells: dict[tuple, float], targets: Targets, rounds: int = 1000, near: float = 1e-13) -> tuple[dict[tuple, float], float]:
    """Factors by cell that scale its tokens so that every marginal has its target share of the total, and how far the worst marginal was off in the last round.

    Iterative proportional fitting from the cells' own tokens. Classes without tokens drop out and the
    others share their target. Where empty cells make the marginals contradict each other, the last
    dimension (topic) holds exactly and the others as nearly as the rounds bring them.
    """
    live = {c: float(n) for c, n in cells.items() if n > 0}
    total = sum(live.values())
    weight = dict(live)
    want = []
    for d, name in enumerate(DIMENSIONS):
        there = {c[d] for c in live}
        shares = {k: max(getattr(targets, name).get(k, 0.0), 0.0) for k in there}
        scale = sum(shares.values())
        want.append({k: total * (v / scale if scale else 1 / len(there)) for k, v in shares.items()})
    off = 0.0
    for _ in range(rounds):
        off = 0.0
        for d in range(len(DIMENSIONS)):
            sums: dict = {}
            for c in sorted(weight):
                sums[c[d]] = sums.get(c[d], 0.0) + weight[c]
            factor = {k: want[d][k] / s if s else 0.0 for k, s in sums.items()}
            off = max(off, *(abs(f - 1) for f in factor.values())) if factor else 0.0
            weight = {c: w * factor[c[d]] for c, w in weight.items()}
        if off < near:
            break
    return {c: weight[c] / live[c] for c in live}, off


def mixed(docs: DataFrame, targets: Targets | None = None) -> tuple[DataFrame, list[str]]:
    """docs with the classes, tokens, rate and copies of each document; and these columns' names, which are free in docs.

    rate is the expected number of times that a document is in the mix: its cell's factor times
    targets.size. copies is its whole part, and one more with the probability of the rest, drawn from a
    hash of doc_id, so that equal ids fare alike and a second run gives the same mix; documents without an id
    are drawn by their text. Null source, lang or topic is of class other. Documents without tokens take
    their cell's rate, or targets.size in a cell without tokens. Targets that contradict each other for
    want of documents give a warning with what is left of the difference.
    """
    targets = targets or Targets()
    if len(targets.source) * len(targets.lang) * len(targets.topic) > MAX_CELLS:
        raise ValueError(f"targets make more than {MAX_CELLS} cells")
    rows, names = classed(docs, targets)
    cells = {tuple(r[:3]): r[3] for r in rows.groupBy(*names[:3]).agg(F.sum(names[3]).alias("n")).collect()}
    factors, off = rake(cells, targets)
    if off > 1e-6:
        warnings.warn(f"the targets cannot all be met: a marginal is off by a factor of {1 + off:.6f}", stacklevel=2)
    # the rates as one constant array, looked up by the cell's number
    classes = [sorted({*getattr(targets, d), OTHER}) for d in DIMENSIONS]
    cell = F.lit(0)
    for name, own in zip(names, classes):
        cell = cell * len(own) + F.array_position(F.array(*[F.lit(c) for c in own]), F.col(name)).cast("int") - 1
    rates = [factors.get(c, 1.0) * targets.size for c in product(*classes)]
    rate, copies = free(rows.columns, "rate", "copies")
    who = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha1(F.coalesce("text", F.lit("")))))
    draw = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(targets.seed)), who)), 1, 13), 16, 10).cast("double") / float(1 << 52)
    out = rows.withColumn(rate, F.element_at(F.array(*[F.lit(r) for r in rates]), cell + 1))
    out = out.withColumn(copies, F.floor(rate).cast("int") + (draw < F.col(rate) - F.floor(rate)).cast("int"))
    return out, [*names, rate, copies]


def report(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """doc_id, classes, n_tokens, rate and copies of every document."""
    out, names = mixed(docs, targets)
    *classes, tokens, rate, copies = names
    return out.select("doc_id", *[F.col(c).alias(f"{d}_class") for c, d in zip(classes, DIMENSIONS)], F.col(tokens).alias("n_tokens"), F.round(rate, 6).alias("rate"), F.col(copies).alias("copies"), (F.col(copies) > 0).alias("sampled"))


def sampled(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The documents in the mix, once each, with their columns and sample_rate, sample_copies, which take the place of columns of these names."""
    out, (*_, rate, copies) = mixed(docs, targets)
    own = [c for c in docs.columns if c.lower() not in ("sample_rate", "sample_copies")]
    return out.where(F.col(copies) > 0).select(*plain(docs.select(*own)), F.col(rate).alias("sample_rate"), F.col(copies).alias("sample_copies"))


def sql(targets: Targets | None = None, rounds: int = 300) -> str:
    """The report in DuckDB's SQL, the raking as a recursive query. Targets are inlined; each class must have a positive share."""
    t = targets or Targets()
    shares = lambda d: ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in getattr(t, d).items())
    known = lambda d: ", ".join(f"'{k}'" for k in getattr(t, d) if k != OTHER)
    lines = "(length(x) - length(replace(x, chr(10), '')))"
    topic = f"CASE WHEN {lines} >= 4 AND length(x) < {lines} * 60 THEN 'list' WHEN length(x) < 600 THEN 'note' WHEN length(x) < 4000 THEN 'article' ELSE 'essay' END"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS x, CASE WHEN source IN ({known('source')}) THEN source ELSE 'other' END AS source_class,
  CASE WHEN lang IN ({known('lang')}) THEN lang ELSE 'other' END AS lang_class FROM documents),
c AS (SELECT *, CASE WHEN p IN ({known('topic')}) THEN p ELSE 'other' END AS topic_class, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM (SELECT *, {topic} AS p FROM d)),
g AS (SELECT source_class AS s, lang_class AS l, topic_class AS p, sum(n_tokens)::DOUBLE AS n FROM c GROUP BY ALL HAVING sum(n_tokens) > 0),
ts(k, v) AS (VALUES {shares('source')}), tl(k, v) AS (VALUES {shares('lang')}), tp(k, v) AS (VALUES {shares('topic')}),
ws AS (SELECT k, v / sum(v) OVER () * (SELECT sum(n) FROM g) AS v FROM ts WHERE k IN (SELECT s FROM g)),
wl AS (SELECT k, v / sum(v) OVER () * (SELECT sum(n) FROM g) AS v FROM tl WHERE k IN (SELECT l FROM g)),
wp AS (SELECT k, v / sum(v) OVER () * (SELECT sum(n) FROM g) AS v FROM tp WHERE k IN (SELECT p FROM g)),
r AS (SELECT 0 AS i, s, l, p, ws.v AS a, wl.v AS b, wp.v AS e, n AS w FROM g JOIN ws ON ws.k = s JOIN wl ON wl.k = l JOIN wp ON wp.k = p
  UNION ALL
  SELECT i + 1, s, l, p, a, b, e, w * e / sum(w) OVER (PARTITION BY p) FROM (SELECT * REPLACE (w * b / sum(w) OVER (PARTITION BY l) AS w) FROM (SELECT * REPLACE (w * a / sum(w) OVER (PARTITION BY s) AS w) FROM r WHERE i < {rounds}))),
f AS (SELECT g.s, g.l, g.p, w / n AS rate FROM r JOIN g USING (s, l, p) WHERE i = {rounds}),
o AS (SELECT c.*, coalesce(rate, 1.0) * {t.size!r}::DOUBLE AS rate, ('0x' || substr(sha1('{t.seed}:' || doc_id), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw FROM c LEFT JOIN f ON s = source_class AND l = lang_class AND p = topic_class)
SELECT doc_id, source_class, lang_class, topic_class, n_tokens, round(rate, 6) AS rate, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies,
  floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END > 0 AS sampled FROM o
""".replace("AND p = topic_class", "AND f.p = topic_class")


SQL = sql()
