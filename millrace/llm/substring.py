"""Substring dedup: sentences and lines are normalised and hashed; of equal ones the earliest stays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Text, U, blocks, get, mixed, of_rows, run_hashes, words
from .lines import keyed

#: Words that a unit has at least to take part.
MIN_WORDS = 5
#: Units that a task gathers before it sends them on.
FLUSH = 1_000_000
STOP = np.zeros(256, dtype=bool)
STOP[[ord(c) for c in ".!?"]] = True


def units(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the non-empty runs between separators: a line feed, or a blank or tab after . ! or ?"""
    b = text.bytes
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    after = np.zeros(len(b), bool)
    after[1:] = STOP[b[:-1]]
    after[text.offsets[:-1][text.offsets[:-1] < len(b)]] = False
    return words(~((b == 10) | (after & ((b == 32) | (b == 9)))), text.offsets)


def digests(text: Text, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of units with enough words: their number in the row, row and two hashes of their words, A-Z lower-cased."""
    low = LOWER[text.bytes]
    s, e = units(text)
    ws, we = words(~SPACE[low] if len(low) else np.zeros(0, bool), text.offsets)
    w1 = of_rows(ws, s)
    n = of_rows(ws, e) - w1
    first = of_rows(s, text.offsets)
    row = np.repeat(np.arange(text.n), np.diff(first))
    long = np.flatnonzero(n >= min_words)
    out = []
    if len(long):
        rep = np.cumsum(n[long]) - n[long]
        k = np.arange(int(n[long].sum())) - np.repeat(rep, n[long])
        at = k + np.repeat(w1[long], n[long])
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            power = np.full(int(n[long].max()), U(odd), dtype=U)
            power[0] = U(1)
            np.multiply.accumulate(power, out=power)
            out.append(mixed(np.add.reduceat(run_hashes(low, ws, we, odd)[at] * power[k], rep) + n[long].astype(U)))
    else:
        out = [np.zeros(0, U)] * 2
    return (np.arange(len(s)) - first[row])[long], row[long], *out


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(dk, th, ks): numbers of the units of each text of which an equal one comes earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> pa.RecordBatch:
            a, b, d, t, k = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((k, t, d, b, a))
            a, b, d, t, k = (x[order] for x in (a, b, d, t, k))
            later = np.zeros(len(a), bool)
            later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            # rows alike in id and text are the same document: its unit k is one unit
            first = np.maximum.accumulate(np.where(later, 0, np.arange(len(a))))
            twin = later & (d == d[first]) & (t == t[first]) & (k == k[first])
            later &= ~twin
            a = np.where(later, mixed(d.astype(U) + mixed(k.astype(U))), a)  # decided already: these rows need no company
            stay = ~twin
            cols = [a.view(np.int64), b.view(np.int64), d, t, k.astype(np.int32), later]
            return pa.RecordBatch.from_arrays([pa.array(c[stay]) for c in cols], ["a", "b", "dk", "th", "k", "later"])

        size = 0
        for batch in blocks(batches, "text"):
            k, row, a, b = digests(Text(get(batch, "text")), min_words)
            if len(k):
                held.append((a, b, get(batch, "dk").to_numpy()[row], get(batch, "th").to_numpy()[row], k))
                size += len(k)
            if size > FLUSH:
                yield flush()
                size = 0
        if held:
            yield flush()

    table = docs.select("dk", "th", "text").mapInArrow(run, "a bigint, b bigint, dk bigint, th bigint, k int, later boolean")
    earliest = F.min(F.struct("dk", "th", "k")).over(W.partitionBy("a", "b", "later"))
    gone = table.withColumn("first", earliest).where(F.col("later") | (F.struct("dk", "th", "k") > F.col("first")))
    return gone.groupBy("dk", "th").agg(F.collect_set("k").alias("ks"))


def cuts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text, n_units, cuts: byte spans [start, end) of the original text that repeat earlier units.

    A unit is what stands between line feeds, or between blanks after a full stop, question or
    exclamation mark. Two are equal if their words are, A-Z lower-cased. Units are ranked by doc_id, then
    by place; the first stays. Units with fewer than `min_words` words stay. A cut takes the one
    separator after the unit along. A null text has no units; a null id ranks first; rows alike in
    id and text are one document, and each is returned.
    """
    own = keyed(docs)
    found = repeats(own, min_words).withColumnsRenamed({"dk": "dk2", "th": "th2"})
    met = own.join(found, (F.col("dk") == F.col("dk2")) & (F.col("th") == F.col("th2")), "left").select("doc_id", "text", "ks")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            text = Text(get(batch, "text"))
            s, e = units(text)
            first = of_rows(s, text.offsets)
            spans = []
            for r, ks in enumerate(get(batch, "ks").to_pylist()):
                o, end = int(text.offsets[r]), int(text.offsets[r + 1])
                spans.append([{"start": int(s[first[r] + k]) - o, "end": min(int(e[first[r] + k]) + 1, end) - o} for k in sorted(ks or ())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([get(batch, "doc_id"), get(batch, "text"), pa.array(np.diff(first).astype(np.int64)), pa.array(spans, kind)], ["doc_id", "text", "n_units", "cuts"])

    return met.mapInArrow(run, f"doc_id {kind}, text string, n_units bigint, cuts array<struct<start:bigint,end:bigint>>")


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_units, n_removed, removed_bytes, kept_sha256, spans (start:end of the original bytes, comma-joined)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            text = Text(get(batch, "text"))
            cols: list[list] = [[], [], [], []]
            for r, spans in enumerate(get(batch, "cuts").to_pylist()):
                raw, at, h = text.row(r), 0, hashlib.sha256()
                for x in spans:
                    h.update(raw[at : x["start"]])
                    at = x["end"]
                h.update(raw[at:])
                for c, v in zip(cols, (len(spans), sum(x["end"] - x["start"] for x in spans), h.hexdigest(), ",".join(f"{x['start']}:{x['end']}" for x in spans))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([get(batch, "doc_id"), get(batch, "n_units"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["doc_id", "n_units", "n_removed", "removed_bytes", "kept_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cuts(docs, min_words).mapInArrow(run, f"doc_id {kind}, n_units bigint, n_removed bigint, removed_bytes bigint, kept_sha256 string, spans string")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])[ \t]', '\1' || chr(10), 'g'), chr(10)) AS u FROM d),
p AS (SELECT doc_id, text, unnest(u) AS unit, generate_subscripts(u, 1) AS k FROM s),
o AS (SELECT doc_id, k, unit, coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, text FROM p),
w AS (SELECT *, regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS ws FROM o),
g AS (SELECT *, len(ws) >= 5 AND row_number() OVER (PARTITION BY ws ORDER BY doc_id, k) > 1 AS gone, substr(text, pos::BIGINT + 1, length(unit) + 1) AS whole,
        strlen(substr(text, 1, pos::BIGINT)) AS start FROM w)
SELECT doc_id, count(*) FILTER (unit <> '') AS n_units, count(*) FILTER (gone) AS n_removed, coalesce(sum(strlen(whole)) FILTER (gone), 0)::BIGINT AS removed_bytes,
  sha256(coalesce(string_agg(whole, '' ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256,
  coalesce(string_agg(start || ':' || (start + strlen(whole)), ',' ORDER BY k) FILTER (gone), '') AS spans
FROM g GROUP BY doc_id
"""


def brute(docs: list, min_words: int = MIN_WORDS) -> list[tuple]:
    """The report by plain Python, for tests."""
    import re

    seen: dict = {}
    out = []
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        raw = (t or "").encode()
        ends = [m.start() for m in re.finditer(rb"(?<=[.!?])[ \t]|\n", raw)] + [len(raw)]
        at = n = 0
        spans = []
        for end in ends:
            if end > at:
                n += 1
                key = tuple(w for w in re.split(rb"[\x20\x09-\x0d]+", raw[at:end].lower()) if w)
                if len(key) >= min_words:
                    if seen.setdefault(key, (i, at)) != (i, at):
                        spans.append((at, min(end + 1, len(raw))))
            at = end + 1
        left = b"".join(raw[a:b] for a, b in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(raw)]))
        out.append((i, n, len(spans), sum(e - s for s, e in spans), hashlib.sha256(left).hexdigest(), ",".join(f"{s}:{e}" for s, e in spans)))
    return out
