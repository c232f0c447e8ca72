"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, Text, U, blocks, free, get, mixed, of_rows, plain, run_hashes, whole_ids, words

#: Labelled documents that the field is fitted on: so many of the least hashes of doc_id, in their order as
#: long as their texts together have no more bytes than this. Each of them counts with all its lines.
FIT_DOCS, FIT_BYTES = 1_500, 64 << 20
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
FEATURES = 10


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


UPPER, LOWERCASE, DIGIT, MARK = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789"), _class("!?;:{}[]()/\\=_~^@")


@dataclass
class Field:
    """Weights of the features for content (boilerplate has their negatives), of the steps between labels, and the share that keeps."""

    weights: np.ndarray
    steps: np.ndarray
    share: float = 0.5


#: Where no labels are given: symbols, capitals and repetition speak against a line.
DEFAULT = Field(np.array([1.0, 0.3, -8.0, -3.0, -1.0, -0.5, -1.0, 0.4, -3.0, 0.0]), np.array([[0.6, -0.6], [-0.6, 0.6]]))


class Lines:
    """Counts of a block of texts: base counts by row, features by line."""

    def __init__(self, text: Text, window: int = 8):
        b, n_rows = text.bytes, text.n
        white = SPACE[b] if len(b) else np.zeros(0, bool)
        ws, we = words(~white, text.offsets)
        first = of_rows(ws, text.offsets)
        self.n_words = np.diff(first)
        total = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        points = total((b & 0xC0) != 0x80)
        in_words = total(((b & 0xC0) != 0x80) & ~white)
        symbols = total(SYMBOL[b] if len(b) else b)
        o = text.offsets
        self.word_chars, self.n_symbols = np.diff(in_words[o]), np.diff(symbols[o])
        # words in windows that are found twice or more in the row
        wh = run_hashes(b, ws, we)
        row = np.repeat(np.arange(n_rows), self.n_words)
        self.n_repeat = np.zeros(n_rows, np.int64)
        n = len(wh)
        if n >= window:
            g = np.zeros(n - window + 1, U)
            for i in range(window):
                g = g * U(0x9E3779B97F4A7C15) + wh[i : n - window + 1 + i]
            inside = row[: n - window + 1] == row[window - 1 :]
            at = np.flatnonzero(inside)
            twice = at[_repeated(mixed(g[at]) + mixed(row[at].astype(U)))[0]]
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + window, -1)
            self.n_repeat = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n_rows)
        # lines with a word
        newline = b == 10 if len(b) else np.zeros(0, bool)
        ls, le = words(~newline, o)
        has = of_rows(ws, ls) < of_rows(ws, le)
        ls, le = ls[has], le[has]
        self.first_line = of_rows(ls, o)
        self.n_lines = np.diff(self.first_line)
        line_row = np.repeat(np.arange(n_rows), self.n_lines)
        lh = run_hashes(b, ls, le)
        _, later = _repeated(mixed(lh) + mixed(line_row.astype(U) + U(1 << 40)))
        self.n_dup = np.bincount(line_row[later], minlength=n_rows)
        self.chars = points[le] - points[ls]
        w1, w2 = of_rows(ws, ls), of_rows(ws, le)
        n_w = w2 - w1
        line_of_word = np.repeat(np.arange(len(ls)), n_w)
        _, again = _repeated(mixed(wh) + mixed(line_of_word.astype(U) + U(1 << 41))) if n else (0, np.zeros(0, bool))
        same = np.bincount(line_of_word[again], minlength=len(ls)) if n else np.zeros(len(ls))
        count = lambda table: (lambda c: (c[le] - c[ls]).astype(float))(total(table[b] if len(b) else b))
        chars, up, down = np.maximum(self.chars, 1), count(UPPER), count(LOWERCASE)
        dup = np.zeros(len(ls))
        dup[later] = 1
        mark = np.isin(b[le - 1], np.frombuffer(b".!?\"'", np.uint8)) if len(ls) else dup
        x = np.zeros((len(ls), FEATURES))
        x[:, 0] = 1
        x[:, 1] = np.minimum(np.log1p(n_w) / 3, 2)
        x[:, 2] = np.minimum(8 * (symbols[le] - symbols[ls]) / chars, 2)
        x[:, 3] = up / np.maximum(up + down, 1)
        x[:, 4] = np.minimum(8 * count(DIGIT) / chars, 2)
        x[:, 5] = np.minimum(8 * count(MARK) / chars, 2)
        x[:, 6] = np.where(n_w >= 8, same / np.maximum(n_w, 1), 0)
        x[:, 7] = mark
        x[:, 8] = dup
        x[:, 9] = np.minimum(chars / np.maximum(n_w, 1) / 8, 3)
        self.x = x

    def failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat > 30 * self.n_words)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are there twice or more; which have an earlier equal."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    later = np.zeros(len(k), bool)
    later[1:] = k[1:] == k[:-1]
    both = later.copy()
    both[:-1] |= later[1:]
    a, b = np.zeros(len(k), bool), np.zeros(len(k), bool)
    a[order], b[order] = both, later
    return a, b


def _step_rows(first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For t = 0, 1, ...: the sequences with more than t elements, the longest first."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    lens = -n[order]
    for t in range(int(n.max(initial=0))):
        yield t, order[: np.searchsorted(lens, -t, side="left")]


def viterbi(x: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """The likeliest labels (1: content) of all sequences; equal scores go to content."""
    u = x @ field.weights
    score = np.zeros((len(first) - 1, 2))
    back = np.zeros((len(x), 2), np.int8)
    steps = list(_step_rows(first))
    for t, r in steps:
        at = first[r] + t
        own = np.stack([-u[at], u[at]], 1)
        if t == 0:
            score[r] = own
            continue
        via = score[r][:, :, None] + field.steps[None]
        best = (via[:, 1] >= via[:, 0]).astype(np.int8)
        back[at] = best
        score[r] = np.where(best == 1, via[:, 1], via[:, 0]) + own
    label = np.zeros(len(x), np.int8)
    state = (score[:, 1] >= score[:, 0]).astype(np.int8)
    n = np.diff(first)
    for t, r in reversed(steps):
        at = first[r] + t
        label[at] = state[r]
        state[r] = back[at, state[r]]
    del n
    return label


def shares(lines: Lines, field: Field) -> np.ndarray:
    """Of each row, the share of its lines' characters on content lines; 0 without lines."""
    label = viterbi(lines.x, lines.first_line, field)
    row = np.repeat(np.arange(len(lines.n_lines)), lines.n_lines)
    good = np.bincount(row, weights=lines.chars * label, minlength=len(lines.n_lines))
    return good / np.maximum(np.bincount(row, weights=lines.chars, minlength=len(lines.n_lines)), 1)


def _gradient(x, first, y, field):
    """Gradient of the mean log likelihood by forward and backward passes over all sequences at once."""
    u = x @ field.weights
    e = np.stack([-u, u], 1)
    alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    lse = lambda a: (m := a.max(-1)) + np.log(np.exp(a - m[..., None]).sum(-1))
    rows = list(_step_rows(first))
    for t, r in rows:
        at = first[r] + t
        alpha[at] = e[at] if t == 0 else e[at] + lse((alpha[at - 1][:, :, None] + field.steps[None]).transpose(0, 2, 1))
    n = np.diff(first)
    for t, r in reversed(rows):
        at = first[r] + t
        go = n[r] > t + 1
        beta[at[go]] = lse(field.steps[None] + (e[at[go] + 1] + beta[at[go] + 1])[:, None, :])
    p = alpha + beta
    p = np.exp(p - lse(p)[:, None])
    dw = ((y - p[:, 1]) * 2) @ x
    inner = np.ones(len(x), bool)
    inner[first[:-1][n > 0]] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] + field.steps[None] + (e[at] + beta[at])[:, None, :]
    pair = np.exp(pair - lse(pair.reshape(len(at), 4))[:, None, None]) if len(at) else np.zeros((0, 2, 2))
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    return dw / len(x), (seen - pair.sum(0)) / len(x)


def fit(x: np.ndarray, n_lines: np.ndarray, chars: np.ndarray, good: np.ndarray, rounds: int = 3, steps: int = 60, lose: float = 0.005) -> Field:
    """A field from documents of known quality. Lines begin with their document's label; each later round
    relabels the lines of bad documents by the field, so that good lines there need not count against it.
    The share that keeps a document is set so that at most `lose` of the good ones go.
    """
    first = np.concatenate([[0], np.cumsum(n_lines)])
    if not len(x) or good.all() or not good.any():
        return DEFAULT
    row = np.repeat(np.arange(len(n_lines)), n_lines)
    y = good[row].astype(np.int64)
    field = Field(DEFAULT.weights.copy(), DEFAULT.steps.copy())
    for k in range(rounds):
        if k:
            label = viterbi(x, first, field)
            y = np.where(good[row], 1, label).astype(np.int64)
            if not (y == 0).any():
                break
        gw, gs = np.zeros(FEATURES), np.zeros((2, 2))
        for _ in range(steps):
            dw, ds = _gradient(x, first, y, field)
            gw, gs = gw + dw**2, gs + ds**2
            field.weights += 0.5 * (dw - 1e-4 * field.weights) / np.sqrt(gw + 1e-9)
            field.steps += 0.2 * (ds - 1e-4 * field.steps) / np.sqrt(gs + 1e-9)
    label = viterbi(x, first, field)
    share = np.bincount(row, weights=chars * label, minlength=len(n_lines)) / np.maximum(np.bincount(row, weights=chars, minlength=len(n_lines)), 1)
    some = good & (n_lines > 0)
    field.share = float(min(0.5, np.quantile(share[some], lose))) if some.any() else 0.5
    return field


def fitted(docs: DataFrame, labels: DataFrame | None, most: int = FIT_DOCS, most_bytes: int = FIT_BYTES) -> Field:
    """A field fitted on at most `most` labelled documents with `most_bytes` of text, those with the least hash of doc_id; DEFAULT without labels.

    Of several labels of one id the best counts, of several texts the least. Only the chosen documents' texts leave the JVM.
    """
    if labels is None:
        return DEFAULT
    spark = docs.sparkSession
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    if not chosen:
        return DEFAULT
    quality = {r.doc_id: r.quality > 0 for r in chosen}
    # at most `most` ids
    ids = spark.createDataFrame([(int(r.doc_id), k) for k, r in enumerate(chosen)], "id long, place int")
    own = whole_ids(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("id", "place").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sizes = sorted((r.place, r.id, r.n) for r in own.select("id", "place", F.octet_length("text").alias("n")).collect())
    fit_ids = [i for (_, i, _), n in zip(sizes, np.cumsum([n for *_, n in sizes])) if n <= most_bytes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            lines = Lines(Text(get(b, "text")))
            bad = lines.failed()
            for i, doc in enumerate(get(b, "id").to_pylist()):
                s, e = lines.first_line[i], lines.first_line[i + 1]
                if not bad[i]:
                    yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([lines.x[s:e].ravel().tolist()], pa.list_(pa.float64())), pa.array([lines.chars[s:e].tolist()], pa.list_(pa.int64()))], ["doc_id", "x", "chars"])

    rows = own.where(F.col("id").isin(*fit_ids)).select("id", "text").mapInArrow(run, "doc_id bigint, x array<double>, chars array<bigint>").collect() if fit_ids else []
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([v for r in rows for v in r.x]).reshape(-1, FEATURES)
    return fit(x, np.array([len(r.chars) for r in rows], np.int64), np.array([c for r in rows for c in r.chars], float), np.array([quality[r.doc_id] for r in rows], bool))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What `judged` adds to each document.
ADDED = (*COUNTS, "failed", "kept", "share")


def judged(docs: DataFrame, field: Field) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns ADDED: base counts, whether a base rule fails, the verdict and the content share; and their names, which are free in docs."""
    names = docs.columns
    added = free(names, *ADDED)
    kinds = [T.LongType()] * len(COUNTS) + [T.BooleanType(), T.BooleanType(), T.DoubleType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(added, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            lines = Lines(Text(get(b, "text")))
            share, failed = shares(lines, field), lines.failed()
            counts = [lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup, lines.n_repeat]
            new = [*(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(~failed & (share >= field.share)), pa.array(share)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *new], [*names, *added])

    return docs.mapInArrow(run, schema), dict(zip(ADDED, added))


def report(docs: DataFrame, labels: DataFrame | None, most: int = FIT_DOCS, most_bytes: int = FIT_BYTES) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and content_share of each document.

    Null and empty texts have no words, fail the base rules and are not kept. Repeated rows are
    reported as often as they come; an empty table gives an empty result. most, most_bytes: see fitted().
    """
    out, c = judged(docs.select("doc_id", "text"), fitted(docs, labels, most, most_bytes))
    return out.select("doc_id", *[F.col(c[k]).alias(k) for k in COUNTS], F.col(c["failed"]).alias("base_failed"), F.col(c["kept"]).alias("kept"), F.round(c["share"], 6).alias("content_share"))


def accepted(docs: DataFrame, labels: DataFrame | None, most: int = FIT_DOCS, most_bytes: int = FIT_BYTES) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    out, c = judged(docs, fitted(docs, labels, most, most_bytes))
    return out.where(F.col(c["kept"])).select(*plain(docs))


def brute_share(text: str | None, field: Field) -> float:
    """The content share of one text by plain Python: features by regular expressions, the best path by a table. For tests."""
    import math
    import re

    seen, rows, chars = set(), [], []
    for line in (text or "").split("\n"):
        w = [x for x in re.split("[\x20\x09-\x0d]+", line) if x]
        if not w:
            continue
        c = max(len(line), 1)
        count = lambda p: len(re.findall(p, line))  # noqa: B023, E731
        up, down = count("[A-Z]"), count("[a-z]")
        again = sum(x in w[:i] for i, x in enumerate(w))
        rows.append([1, min(math.log1p(len(w)) / 3, 2), min(8 * count(r"[#*$%&|<>]") / c, 2), up / max(up + down, 1), min(8 * count("[0-9]") / c, 2), min(8 * count(r"[!?;:{}\[\]()/\\=_~^@]") / c, 2), again / len(w) if len(w) >= 8 else 0, line[-1] in ".!?\"'", line in seen, min(c / len(w) / 8, 3)])
        seen.add(line)
        chars.append(len(line))
    if not rows:
        return 0.0
    best: list = []
    for k, x in enumerate(rows):
        u = sum(a * b for a, b in zip(x, field.weights.tolist()))
        own = (-u, u)
        if not k:
            best.append([(own[0], None), (own[1], None)])
        else:
            best.append([max((best[-1][p][0] + field.steps[p, y] + own[y], p) for p in (0, 1)) for y in (0, 1)])
    y = 1 if best[-1][1][0] >= best[-1][0][0] else 0
    good = 0
    for k in reversed(range(len(rows))):
        good += y * chars[k]
        y = best[k][y][1]
    return good / max(sum(chars), 1)


def brute(text: str | None) -> tuple:
    """The base counts of one text by plain Python, for tests."""
    import re

    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
    t = text or ""
    w = split(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    at: dict = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)
