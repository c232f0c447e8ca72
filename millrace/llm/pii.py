"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select what is redacted.

Spans of the four base kinds (email, ip, card, phone) are fixed by their patterns and always stay. Looser
generators propose more, overlapping ones too; gradient-boosted trees over format and context score these,
and those from a threshold on join that was calibrated for precision on spans held out from the fit. The fit
is on the driver, of a bounded sample: spans that the generators find in the documents themselves, and
generated ones that stand in the contexts found there. Found spans are labelled by their context (a word such as
token or phone before them); in half of them that word is hidden, so that the format has to tell, too. The
trees run as a column expression: the whole main path is DataFrame functions.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, plain

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
#: The sample of the fit: documents (those with the least hash of the id), spans found in them, and generated spans.
FIT_DOCS, FIT_SPANS, FIT_SAMPLES = 2_000, 20_000, 4_000
#: Precision that the spans from a threshold on must have on the held-out half.
PRECISION = 0.95
#: Characters of context on the left and on the right.
LEFT, RIGHT = 24, 8

#: The base patterns, in forms that Java's matcher runs in time linear in the text: a match can only begin
#: where a run of its first class begins (or the last match ended), and loops do not recur without bound.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind; cheap to see.
HINT = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "+"}
#: Generators of further spans: kind, pattern, hint. Each match begins where a run of its characters begins, and runs are taken whole, however long.
LOOSE = (
    ("phone", r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", "[0-9]{4}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]"),
    ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}+", "[A-Za-z0-9+/_-]{16}"),
    ("secret", r"(?<![A-Za-z0-9._-])(?=[A-Za-z._-]*+[0-9])[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+)++", "[A-Za-z0-9_-]{8}\\.[A-Za-z0-9_-]{8}"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{2,}+)++", r"[(\[]at[)\]]"),
)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

FEATURES = ("length", "digits", "uppers", "marks", "kinds", "changes", "hex", "cue", "joined")
CUE = r"(?i)(?:phone|tel|call|fax|mobile|token|secret|password|passwd|api|key|ssn|social|mail|contact|write)[^A-Za-z]{0,6}(?:is|no|number|=|:)?[^A-Za-z]{0,6}$"
JOINED = ("[A-Za-z0-9=_/-]$", "^[A-Za-z0-9=_/-]")


def features(m: Column, left: Column, right: Column) -> dict[str, Column]:
    count = lambda p: F.regexp_count(m, F.lit(p))
    digits, uppers = count("[0-9]"), count("[A-Z]")
    return {
        "length": F.length(m),
        "digits": digits,
        "uppers": uppers,
        "marks": count("[^A-Za-z0-9]"),
        "kinds": (digits > 0).cast("int") + (uppers > 0).cast("int") + (count("[a-z]") > 0).cast("int"),
        "changes": count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
        "hex": m.rlike("^[0-9a-f]+$").cast("int"),
        "cue": left.rlike(CUE).cast("int"),
        "joined": (left.rlike(JOINED[0]) | right.rlike(JOINED[1])).cast("int"),
    }


def measured(m: str, left: str, right: str) -> list[int]:
    """The same features in plain Python, for the fit."""
    count = lambda p: len(re.findall(p, m))
    d, u = count("[0-9]"), count("[A-Z]")
    return [len(m), d, u, count("[^A-Za-z0-9]"), (d > 0) + (u > 0) + (count("[a-z]") > 0), count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), int(bool(re.search("^[0-9a-f]+$", m))), int(bool(re.search(CUE, left))), int(bool(re.search(JOINED[0], left) or re.search(JOINED[1], right)))]


def generated(n: int, contexts: list[tuple[str, str]], seed: int = 7) -> list[tuple[str, list[int], int]]:
    """Generated spans (kind, features, 1 if personal) in contexts (left, right). Some personal ones have no word before them that says so, some others do."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    text = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    word = lambda: text("abcdefghijklmnopqrstuvwxyz", r.randrange(2, 9))
    mixed, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    cues = {"phone": ("phone: ", "tel. ", "call ", "fax ", "mobile: "), "ssn": ("ssn ", "SSN: ", "social no: "), "secret": ('token = "', "password: ", "api key: ", "secret=", "key = "), "email": ("mail: ", "contact ", "write ")}
    out = []
    for _ in range(n):
        kind, good = r.choice(("phone", "ssn", "secret", "email")), r.random() < 0.5
        left, right = r.choice(contexts)
        left, right = left.rstrip() + " ", " " + right.lstrip()
        if kind == "phone":
            sep = r.choice("-. ")
            span = r.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}"))
        elif kind == "ssn":
            span = f"{digits(3)}-{digits(2)}-{digits(4)}"
        elif kind == "secret":
            jwt = ".".join(text(mixed + "_-", r.randrange(20, 90)) for _ in range(3))
            own = (text(hexes, r.choice((32, 40, 64))), text(mixed, r.randrange(18, 60)), text(mixed + "+/", r.randrange(60, 300)), jwt)
            other = ("-".join(word() for _ in range(6)) + digits(2), "/".join(word() for _ in range(5)) + digits(1), word() + word() + word() + digits(12), "_" * 24 + digits(1), "-".join(text(hexes, k) for k in (8, 4, 4, 4, 12)), digits(r.randrange(16, 24)), f"{word()}{word()}.{word()}{digits(3)}xyz.{word()}")
            span = r.choice(own if good or r.random() < 0.1 else other)
        else:
            span = f"{word()} (at) {word()} (dot) {word()}" if r.random() < 0.5 else f"{word()}[at]{word()}.{word()}"
            if not good and r.random() < 0.8:
                span = f"{word()} (at) {word()} . {text('0123456789', 4)}"
        if r.random() < (0.85 if good else 0.02):
            left += r.choice(cues[kind])
        elif not good and kind != "email" and r.random() < 0.8:
            left, right = r.choice(((left + r.choice("vpx"), right), (left, "/" + digits(2)), (left + r.choice(("id=", "no=", "commit/", "rev-")), right)))
        out.append((kind, measured(span, left[-LEFT:], right[:RIGHT]), int(good)))
    return out


def _tree(x, g, rows, depth):
    """A regression tree by exact search over thresholds: (feature, threshold, left, right) or a leaf's value."""
    import numpy as np

    total, best = g[rows].sum(), (1e-9, None)
    if depth and len(rows) >= 20:
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, c = x[order, f], np.cumsum(g[order])
            n = np.arange(1, len(order))
            gain = c[:-1] ** 2 / n + (total - c[:-1]) ** 2 / (len(order) - n) - total**2 / len(order)
            gain[(v[1:] == v[:-1]) | (n < 8) | (len(order) - n < 8)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, (v[k] + v[k + 1]) / 2))
    if best[1] is None:
        return float(total / max(len(rows), 1))
    f, t = best[1]
    below = x[rows, f] < t
    return (f, float(t), _tree(x, g, rows[below], depth - 1), _tree(x, g, rows[~below], depth - 1))


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


@dataclass(frozen=True)
class Model:
    """By kind: boosted trees, the score from which spans join, and of the held-out half the spans, their precision and recall at that score."""

    trees: dict
    bars: dict
    held: dict


def boosted(data: list[tuple[str, list[int], int]], rounds: int = 10, depth: int = 3, rate: float = 0.5) -> Model:
    """Trees fitted on every second span (kind, features, label) of each kind and calibrated on the others: the bar is the least score from which
    on at least PRECISION of the held-out spans are personal. A kind that never comes there adds no spans."""
    import numpy as np

    trees, bars, report = {}, {}, {}
    for kind in dict.fromkeys(k for k, _, _ in LOOSE):
        own = [(f, y) for k, f, y in data if k == kind]
        x, y = np.array([f for f, _ in own], float).reshape(-1, len(FEATURES)), np.array([y for _, y in own], float)
        fit, held = np.arange(0, len(own), 2), np.arange(1, len(own), 2)
        score, mine = np.zeros(len(own)), []
        for _ in range(rounds if len(fit) else 0):
            g = 4 * (y - 1 / (1 + np.exp(-score)))
            tree = _tree(x, g, fit, depth)
            mine.append(tree)
            score += rate * np.array([_value(tree, row) for row in x])
        trees[kind], bars[kind], report[kind] = (rate, mine), float("inf"), (len(held), 1.0, 0.0)
        for bar in np.unique(score[held]):
            over = score[held] >= bar
            if y[held][over].mean() >= PRECISION:
                # in the middle of the gap below, so that sums in another order come out alike
                below = score[held][~over]
                bars[kind] = float((bar + below.max()) / 2 if len(below) else bar - 1e-6)
                report[kind] = (len(held), float(y[held][over].mean()), float(y[held][over].sum() / max(y[held].sum(), 1)))
                break
    return Model(trees, bars, report)


def found_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = FIT_DOCS, most_spans: int = FIT_SPANS) -> list[tuple[str, str, str, str]]:
    """(kind, span, left, right) that the generators find in at most most_docs documents, at most most_spans of them, both by least hash."""
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(most_docs)
    own = docs.join(F.broadcast(ids), F.col(id_col) == F.col("i"), "left_semi").select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    arrays = [_matches(g, KINDS.index(k), False, F.col("text"), p, h) for g, (k, p, h) in enumerate(LOOSE)]
    rows = own.select(F.explode(F.concat(*arrays)).alias("z")).select("z.kind", "z.m", "z.left", "z.right").distinct()
    got = rows.orderBy(F.xxhash64("m", "left", "right", "kind"), "m", "left", "right", "kind").limit(most_spans).collect()
    return sorted((KINDS[r.kind], r.m, r.left, r.right) for r in got)


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = FIT_DOCS, most_spans: int = FIT_SPANS, samples: int = FIT_SAMPLES) -> Model:
    """A model of these documents' spans."""
    found = found_samples(docs, id_col, text_col, most_docs, most_spans)
    contexts = [(a, b) for _, _, a, b in found if not re.search(CUE, a)] or [("", "")]
    data = generated(samples, contexts)
    cue = FEATURES.index("cue")
    for n, (kind, m, left, right) in enumerate(found):
        x = measured(m, left, right)
        y = x[cue]
        if y and n % 2:
            x[cue] = 0
        data.append((kind, x, y))
    random.Random(3).shuffle(data)
    return boosted(data)


def _complete(tree, depth: int = 3) -> tuple[list[int], list[float], list[float]]:
    """Features and thresholds of the inner nodes of a tree, level by level, and the values of its leaves; where a branch ends early, both sides have its value."""
    level, tests, bars = [tree], [], []
    for _ in range(depth):
        tests += [t[0] if isinstance(t, tuple) else 0 for t in level]
        bars += [t[1] if isinstance(t, tuple) else 0.0 for t in level]
        level = [side for t in level for side in (t[2:] if isinstance(t, tuple) else (t, t))]
    return tests, bars, level


def scored(model: Model, kind: str, x: str) -> Column:
    """The score of a span as a column, from its features in an array column: a sum over the trees, which are a constant."""
    rate, trees = model.trees[kind]
    if not trees:
        return F.lit(0.0)
    many = lambda values, unit="": "array(" + ", ".join(f"{v!r}{unit}" for v in values) + ")"
    rows = ", ".join(f"named_struct('f', {many(f)}, 't', {many(t, 'D')}, 'v', {many(v, 'D')})" for f, t, v in map(_complete, trees))
    step = lambda i: f"IF({x}[t.f[{i}]] < t.t[{i}], 1, 2)"
    one = step("0")
    two = f"(2 * {one} + {step(one)})"
    return F.expr(f"aggregate(array({rows}), 0D, (s, t) -> s + {rate!r}D * t.v[2 * {two} + {step(two)} - 7])")


def _luhn(digits: Column) -> Column:
    """Whether the digit sum from the right, every second digit doubled, is a multiple of ten."""
    n = F.length(digits)
    at = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, at(i)).otherwise(F.when(at(i) > 4, at(i) * 2 - 9).otherwise(at(i) * 2)))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    if kind == "card":
        return _luhn(F.regexp_replace(m, "[^0-9]", ""))
    if kind == "phone":
        n = F.length(F.regexp_replace(m, "[^0-9]", ""))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _span(gen, kind, base, i, gap, m, left, right) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(gen).alias("gen"), lit(kind).cast("int").alias("kind"), lit(base).alias("base"), lit(i).alias("i"), lit(gap).alias("gap"), lit(m).alias("m"), lit(left).alias("left"), lit(right).alias("right"))


def _matches(gen: int, kind: int, base: bool, text: Column, pattern: str, hint: str) -> Column:
    """Of each match of a generator: its number, kind, place in their order, characters since the match before, match, context."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(found.alias("m"), between.alias("p"), F.slice(between, 2, F.greatest(F.size(between), F.lit(1))).alias("q")),
        lambda z, i: _span(gen, kind, base, i, F.length(z["p"]), z["m"], F.right(z["p"], F.lit(LEFT)), F.left(F.coalesce(z["q"], F.lit("")), F.lit(RIGHT))),
    )
    rows = F.filter(rows, lambda z: z["m"].isNotNull())
    seen = text.rlike(hint) if len(hint) > 1 else text.contains(hint)
    return F.when(seen, rows).otherwise(F.filter(F.array(_span(0, 0, base, 0, 0, "", "", "")), lambda z: F.lit(False)))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, th, copies, kind, start, end, base, score): spans that are selected, code points, end exclusive; and a row without kind for each text.

    Each match is a row of its own, and places are running sums over the rows of one text, so no text is
    moved and nothing grows with the square of a text's matches. Rows alike in id and text are one text with
    as many copies; th is a hash that tells texts of one id apart. A base span always stays. A further one must
    reach its kind's bar and must not overlap a base span or a further one that begins before it or is longer.
    A null text is empty. Without a model one is fitted on these documents.
    """
    model = model or fitted(docs, id_col, text_col)
    text = F.col("text")
    wanted = text.rlike("[0-9@]|[(\\[]at[)\\]]")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    generators = [(k, True, p, HINT[k]) for k, p in BASE.items()] + [(k, False, p, h) for k, p, h in LOOSE]
    arrays = [_matches(g, KINDS.index(k), b, text, p, h) for g, (k, b, p, h) in enumerate(generators)]
    blank = F.array(_span(-1, F.lit(None), False, 0, 0, "", "", ""))
    rows = base.select("id", "th", F.explode(F.concat(blank, F.when(wanted, F.concat(*arrays)).otherwise(F.slice(blank, 1, 0)))).alias("z"))
    # repeated rows are counted before anything moves
    once = rows.groupBy("id", "th", "z.gen", "z.i").agg(F.count("*").alias("copies"), *[F.first(f"z.{c}").alias(c) for c in ("kind", "base", "gap", "m", "left", "right")])
    order = W.partitionBy("id", "th", "gen").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    own = W.partitionBy("id", "th")
    placed = once.repartition("id", "th").withColumn("n", F.length("m")).withColumn("end", F.sum(F.col("gap").cast("bigint") + F.col("n")).over(order)).withColumn("start", F.col("end") - F.col("n"))
    verdict = F.lit(True)
    score = F.lit(None).cast("double")
    mine = F.col("kind").isNotNull() & ~F.col("base")
    placed = placed.withColumn("x", F.when(mine, F.array(*[c.cast("double") for c in features(F.col("m"), F.col("left"), F.col("right")).values()])))
    for k in BASE:
        verdict = F.when(F.col("base") & (F.col("kind") == KINDS.index(k)), _valid(k, F.col("m"))).otherwise(verdict)
    for k in model.bars:
        mine = ~F.col("base") & (F.col("kind") == KINDS.index(k))
        score = F.when(mine, scored(model, k, "x")).otherwise(score)
        verdict = F.when(mine, F.col("score") >= F.lit(model.bars[k])).otherwise(verdict)
    judged = placed.withColumn("score", score).where(F.col("kind").isNull() | verdict).select("id", "th", "copies", "kind", "base", "start", "end", "score")
    sorted_ = own.orderBy("start", F.col("base").desc(), F.col("end").desc(), "kind")
    before, after = sorted_.rowsBetween(W.unboundedPreceding, -1), sorted_.rowsBetween(1, W.unboundedFollowing)
    based = lambda c: F.when(F.col("base"), F.col(c))
    clear = judged.withColumns({"base_end": F.max(based("end")).over(before), "base_next": F.min(based("start")).over(after)})
    clear = clear.where(F.col("kind").isNull() | F.col("base") | ((F.coalesce("base_end", F.lit(0)) <= F.col("start")) & (F.coalesce("base_next", F.col("end")) >= F.col("end"))))
    clear = clear.withColumn("any_end", F.max("end").over(before))
    return clear.where(F.col("kind").isNull() | F.col("base") | (F.coalesce("any_end", F.lit(0)) <= F.col("start"))).select("id", "th", "copies", "kind", "start", "end", "base", "score")


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 of the base spans; spans holds all selected ones, n_spans and n_further count them and those that the trees have added.

    Repeated rows are reported as often as they come. Documents without spans are there with zeros.
    """
    found = spans(docs, model=model)
    names = F.array(*[F.lit(k) for k in KINDS])
    item = F.struct("start", "kind", "end", "base")
    got = found.groupBy("id", "th").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), item))).alias("s"))
    got = got.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    said = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("s", lambda s: s["base"])
    of = lambda k: F.size(F.filter("s", lambda s: s["base"] & (s["kind"] == KINDS.index(k)))).cast("bigint")
    n = F.size("s").cast("bigint")
    return got.select(F.col("id").alias("doc_id"), *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(F.concat_ws(",", F.transform(base, said)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("s", said)).alias("spans"), n.alias("n_spans"), (n - F.size(base)).alias("n_further"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """docs with [KIND] in place of each selected span; spans that overlap are one, of the first one's kind. A null text stays null; all columns and rows stay."""
    found = spans(docs, id_col, text_col, model).where("kind IS NOT NULL")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    before = W.partitionBy("id", "th").orderBy("start", F.col("base").desc(), F.col("end").desc(), "kind").rowsBetween(W.unboundedPreceding, -1)
    placed = found.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0).cast("bigint")))
    cut = F.struct("start", "from", "end", F.element_at(names, F.col("kind") + 1).alias("label"))
    cuts = placed.groupBy("id", "th").agg(F.sort_array(F.collect_list(cut)).alias("cuts"), F.max("end").alias("last"))
    i, th, c, last = free(docs.columns, "id", "th", "cuts", "last")
    met = docs.join(cuts.select(F.col("id").alias(i), F.col("th").alias(th), F.col("cuts").alias(c), F.col("last").alias(last)), F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(th)), "left")
    piece = lambda x: F.when(x["start"] >= x["from"], F.concat(F.substr(text_col, (x["from"] + 1).cast("int"), (x["start"] - x["from"]).cast("int")), x["label"])).otherwise("")
    text = F.when(F.col(c).isNull(), F.col(text_col)).otherwise(F.concat(F.concat_ws("", F.transform(c, piece)), F.substr(text_col, (F.col(last) + 1).cast("int"))))
    return met.withColumn(text_col, text).select(*plain(docs))


def brute(text: str | None) -> tuple[list[tuple[str, int, int]], str]:
    """The base spans of one text by Python's re and the patterns as they are stated, for tests."""
    import hashlib

    t, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d: str) -> bool:
        v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in v) % 10 == 0

    for kind, p, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(p, t) if ok(m[0])]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in out).encode()).hexdigest()
