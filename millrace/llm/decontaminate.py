"""Benchmark decontamination: suffix arrays of the training text, searched for every suffix of the benchmark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Text, U, blocks, dropped, free, get, kept, of_rows, plain, run_hashes, words

#: Bytes of benchmark text that go to the tasks at once; a larger benchmark goes in several rounds.
ROUND_BYTES = 8 << 20
#: Pairs of a row and an item that are looked at at once.
CHUNK = 1 << 20
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
FOUND = "array<struct<start:bigint,end:bigint>>"


def tokens(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words, first word of each row."""
    low = LOWER[text.bytes]
    starts, ends = words(WORD[low], text.offsets)
    return low, starts, ends, of_rows(starts, text.offsets)


def _two(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return run_hashes(low, starts, ends), run_hashes(low, starts, ends, 0xC2B2AE3D27D4EB4F)


class Queries:
    """Benchmark items: their vocabulary, their windows, and the suffix array of all their words."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        text = Text(pa.array(texts, pa.large_string()))
        low, starts, ends, first = tokens(text)
        h, h2 = _two(low, starts, ends)
        self.window, self.ids = window, ids
        self.vocabulary, place, number = np.unique(h, return_index=True, return_inverse=True)
        self.second = h2[place] if len(h) else h2  # a second hash settles what a word is
        self.hint = np.zeros(1 << 18, dtype=bool)
        self.hint[(self.vocabulary & U((1 << 18) - 1)).astype(np.int64)] = True
        n = np.diff(first)
        m = np.maximum(n - window + 1, np.minimum(n, 1))
        item = np.repeat(np.arange(text.n), m)
        at = np.arange(len(item)) - np.repeat(np.cumsum(m) - m, m)
        padded = np.concatenate([number.astype(np.uint32) + np.uint32(1), np.zeros(window, np.uint32)])
        rows = padded[(first[item] + at)[:, None] + np.arange(window)]
        rows[np.arange(window) >= (n[item] - at)[:, None]] = 0
        self.least = int(n[n > 0].min(initial=window))
        keys = packed(rows) if len(rows) else np.zeros(0, f"S{4 * window}")
        self.keys, which = np.unique(keys, return_inverse=True)
        pairs = np.unique(np.stack([which, item], 1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
        self.items, self.lists = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.keys) + 1))
        flat = self.keys.view(">u4").reshape(-1, window) if len(self.keys) else np.zeros((0, window))
        self.lengths = np.count_nonzero(flat, axis=1)
        self._sorted(number, first)

    def _sorted(self, number: np.ndarray, first: np.ndarray) -> None:
        """The suffix array of all items' words, a mark after each item, with the ranks by prefixes of 1, 2, 4, ... words that it is sorted by."""
        n = np.diff(first)
        flat = np.ones(len(number) + len(n), np.int64)  # 1: the mark; 0: behind the end, or no word of the benchmark
        flat[np.arange(len(number)) + np.repeat(np.arange(len(n)), n)] = number + 2
        self.ranks, self.names = [np.append(flat, 0)], []
        while 1 << len(self.names) <= int(n.max(initial=0)):
            now, step = self.ranks[-1], 1 << len(self.names)
            pair = (now[:-1].astype(U) << U(32)) | now[np.minimum(np.arange(len(flat)) + step, len(flat))].astype(U)
            names, rank = np.unique(pair, return_inverse=True)
            self.names.append(names)
            self.ranks.append(np.append(rank + 1, 0))
        self.array = np.argsort(self.ranks[-1][:-1], kind="stable")

    def matched(self, ids: np.ndarray, run: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """For each of the places pos of a text (ids: numbers of its words in the vocabulary, from 1; run: how many of them follow without a break),
        the words from there on that stand in some item: down the halves of lengths, each by bisection in the interval of the suffix array."""
        own = [np.append(np.where(ids > 0, ids.astype(np.int64) + 1, 0), 0)]
        for j, names in enumerate(self.names[:-1]):
            now = own[-1]
            a, b = now[:-1], now[np.minimum(np.arange(len(now) - 1) + (1 << j), len(now) - 1)]
            pair = (a.astype(U) << U(32)) | b.astype(U)
            at = np.minimum(np.searchsorted(names, pair), len(names) - 1)
            own.append(np.append(np.where((a > 0) & (b > 0) & (names[at] == pair), at + 1, 0), 0))
        lo, hi, have = np.zeros(len(pos), np.int64), np.full(len(pos), len(self.array)), np.zeros(len(pos), np.int64)

        def bound(rank: np.ndarray, want: np.ndarray, a: np.ndarray, b: np.ndarray, skip: np.ndarray, equal: bool) -> np.ndarray:
            a, b = a.copy(), b.copy()
            while (a < b).any():
                m = (a + b) >> 1
                v = rank[np.minimum(self.array[np.minimum(m, len(self.array) - 1)] + skip, len(rank) - 1)]
                up = (a < b) & ((v <= want) if equal else (v < want))
                b = np.where((a < b) & ~up, m, b)
                a = np.where(up, m + 1, a)
            return a

        for j in reversed(range(len(own))):
            want = own[j][np.minimum(pos + have, len(own[j]) - 1)]
            go = np.flatnonzero((want > 0) & (have + (1 << j) <= run[pos]))
            a = bound(self.ranks[j], want[go], lo[go], hi[go], have[go], False)
            b = bound(self.ranks[j], want[go], a, hi[go], have[go], True)
            some = b > a
            lo[go[some]], hi[go[some]] = a[some], b[some]
            have[go[some]] += 1 << j
        return have


def packed(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as strings that sort the same way."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def search(text: Text, q: Queries) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set], np.ndarray]:
    """Of each row: words; merged spans of words inside occurrences; items that occur; longest verbatim match in words.

    The shard's suffix array holds the suffixes that begin with enough words of the benchmark's
    vocabulary to match anything at all; every benchmark suffix is looked up in it by bisection.
    """
    low, starts, ends, first = tokens(text)
    n_words = np.diff(first)
    spans: list[list] = [[] for _ in range(text.n)]
    items: list[set] = [set() for _ in range(text.n)]
    longest = np.zeros(text.n, np.int64)
    n, w = len(starts), q.window
    if n == 0 or len(q.keys) == 0:
        return n_words, spans, items, longest
    h = run_hashes(low, starts, ends)
    ids = np.zeros(n + w, np.uint32)
    some = np.flatnonzero(q.hint[(h & U((1 << 18) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(q.vocabulary, h[some]), len(q.vocabulary) - 1)
    same = q.vocabulary[at] == h[some]
    some, at = some[same], at[same]
    same = run_hashes(low, starts[some], ends[some], 0xC2B2AE3D27D4EB4F) == q.second[at]
    ids[some[same]] = at[same] + 1
    # how many words of the vocabulary follow without a break, within the row
    stop = np.zeros(n + 1, dtype=bool)
    stop[:n] = ids[:n] == 0
    stop[n] = True
    edge = np.union1d(np.flatnonzero(stop), first[1:])
    run = edge[np.searchsorted(edge, np.arange(n), side="right")] - np.arange(n)
    run[stop[:n]] = 0
    suffix = np.flatnonzero(run >= q.least)
    if len(suffix) == 0:
        return n_words, spans, items, longest
    deep = ids[suffix[:, None] + np.arange(w)]
    deep[np.arange(w) >= run[suffix][:, None]] = 0
    keys = packed(deep)
    order = np.argsort(keys, kind="stable")  # the suffix array, to the depth that the windows need
    array, sa = keys[order], suffix[order]
    del deep, keys
    hits = []
    for length in np.unique(q.lengths):  # full windows, and whole items of fewer words
        of = np.flatnonzero(q.lengths == length)
        if length == w:
            a, b = np.searchsorted(array, q.keys[of], "left"), np.searchsorted(array, q.keys[of], "right")
        else:
            cut = q.keys[of].view(">u4").reshape(-1, w).copy()
            a = np.searchsorted(array, q.keys[of], "left")
            cut[:, length:] = 0xFFFFFFFF
            b = np.searchsorted(array, np.ascontiguousarray(cut).view(f"S{4 * w}").ravel(), "right")
        m = b - a
        place = np.repeat(a, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        hits.append((sa[place], np.repeat(of, m)))
    pos, key = (np.concatenate(x) for x in zip(*hits))
    if len(pos) == 0:
        return n_words, spans, items, longest
    length = q.lengths[key]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + length, -1)
    a, b = words(np.cumsum(cover[:-1]) > 0, first)
    row = np.searchsorted(first, a, side="right") - 1
    for r, s, e in zip(row.tolist(), (a - first[row]).tolist(), (b - first[row]).tolist()):
        spans[r].append((s, e))
    row = np.searchsorted(first, pos, side="right") - 1
    both = np.unique(np.stack([row, key], 1), axis=0)  # a window counts once in a row, however often it is there
    m = np.diff(q.lists)[both[:, 1]]
    cuts = np.searchsorted(np.cumsum(m), np.arange(0, int(m.sum()), CHUNK), side="left").tolist() + [len(both)]
    for s, e in zip(cuts, cuts[1:]):
        k = m[s:e]
        entry = np.repeat(q.lists[both[s:e, 1]], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        for r, i in set(zip(np.repeat(both[s:e, 0], k).tolist(), q.items[entry].tolist())):
            items[r].add(q.ids[i])
    full = length == w
    best = length.copy()
    best[full] = np.maximum(length[full], q.matched(ids, run, pos[full]))
    np.maximum.at(longest, row, best)
    return n_words, spans, items, longest


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


#: What `scanned` adds to each document.
ADDED = ("words", "spans", "items", "longest")


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with four more columns: words, spans of words hit, items found, longest verbatim match in words; and their names, which are free in docs.

    The benchmark goes to the tasks in rounds of at most ROUND_BYTES; each round adds to what the
    earlier ones found and is written before the next, so no more than one round is in memory.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("id"), F.coalesce(item_text, F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    rounds = -(-total // ROUND_BYTES) or 1
    names = docs.columns
    added = free(names, *ADDED)
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.LongType()), T.StructField(added[1], T._parse_datatype_string(FOUND)), T.StructField(added[2], T.ArrayType(T.StringType())), T.StructField(added[3], T.LongType())])
    out, q = docs, None
    for k in range(rounds):
        rows = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(rounds)) == k).collect()
        q = docs.sparkSession.sparkContext.broadcast(Queries([r.id for r in rows], [r.t for r in rows], window))

        def run(batches: Iterator[pa.RecordBatch], q=q, again=k > 0) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches, text_col):
                n_words, spans, found, longest = search(Text(get(b, text_col)), q.value)
                if again:
                    spans = [merged([(x["start"], x["end"]) for x in old] + new) for old, new in zip(get(b, added[1]).to_pylist(), spans)]
                    found = [set(old) | new for old, new in zip(get(b, added[2]).to_pylist(), found)]
                    longest = np.maximum(longest, get(b, added[3]).to_numpy())
                columns = [b.column(i) for i in range(len(names))] + [pa.array(n_words.astype(np.int64)), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(longest)]
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

        out, before = out.mapInArrow(run, schema), out
        if k + 1 < rounds:
            out = kept(out, "scanned")
            q.unpersist()
            dropped(before)
    return out, added


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, longest_match.

    A null or wordless text has n_words 0 and is clean; so is every document where the benchmark is
    empty. Repeated rows are reported as often as they come; items that share an id count once, and an
    item without an id is named null. longest_match is the longest run of words from the start of a window
    that stands in one item. Further columns of docs are not looked at.
    """
    found, (n_words, spans, items, longest) = scanned(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), window)
    hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))).alias("spans"),
        F.col(longest).alias("longest_match"),
    )


def removed(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; all columns as they were."""
    found, (_, spans, _, _) = scanned(docs, benchmark, window)
    return found.where(F.size(spans) == 0).select(*plain(docs))


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
k AS (SELECT item_id, o, least(len(w), 10) AS n, array_to_string(w[o:o + least(len(w), 10) - 1], ' ') AS key FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS o FROM b WHERE len(w) > 0)),
v AS (SELECT DISTINCT n FROM k),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, v WHERE len(w) >= n)),
m AS MATERIALIZED (SELECT p.doc_id, p.i, k.n, k.item_id, k.o FROM p JOIN k USING (n, key)),
c AS (SELECT DISTINCT doc_id, i, n FROM m),
s AS (SELECT *, max(i + n) OVER (PARTITION BY doc_id ORDER BY i, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i, n) AS part FROM s),
u AS (SELECT doc_id, min(i) - 1 AS a, max(i + n) - 1 AS e FROM g GROUP BY doc_id, part),
h AS (SELECT doc_id, sum(e - a)::BIGINT AS n_hit, string_agg(a || ':' || e, ',' ORDER BY a) AS spans FROM u GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items FROM m GROUP BY doc_id),
l AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, max(i) - min(i) + max(n) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - o ORDER BY i) AS island FROM (SELECT DISTINCT * FROM m)) GROUP BY doc_id, item_id, i - o, island) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans, coalesce(longest, 0) AS longest_match
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def brute(docs: list, bench: list, window: int = 10) -> list[tuple]:
    """The report's first six columns by plain search, for tests."""
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: word.findall((t or "").translate(low))
    out = []
    for i, t in docs:
        own, hit, items = split(t), set(), set()
        for item, bt in bench:
            w = split(bt)
            for p in range(max(len(w) - window + 1, min(len(w), 1))):
                want = w[p : p + window]
                for s in range(len(own) - len(want) + 1):
                    if own[s : s + len(want)] == want:
                        hit |= set(range(s, s + len(want)))
                        items.add(str(item) if item is not None else "null")
        out.append((i, len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out
