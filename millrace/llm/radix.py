"""Suffix-array deduplication: a radix sort of suffixes that stops at the threshold length.

Only the suffixes that could matter are sorted. Every string of `length` bytes holds one anchor: the
place, among its SEED-byte substrings, of the one with the least hash. Equal strings have their anchor
at the same place, so equal anchors are the first, most significant digit of the sort: suffixes whose
anchor is in one document only are finished at once. An anchor's context is all the bytes of the strings
that it stands for; of equal contexts the first speaks for all. What then still shares its anchor with
other contexts goes on, digit by digit of eight bytes, until the threshold length; groups that are then
still together are exactly the repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Text, U, blocks, get, mixed, whole_ids, words

#: Bytes of the substrings that anchors are chosen from.
SEED = 20
#: Bytes of text whose anchors share one bucket of the sort.
BUCKET_BYTES = 32 << 20
#: Bytes of text taken at once, so that the arrays stay in the processor's cache.
CACHE_BYTES = 1 << 18
#: Anchors that a task gathers before it sends them on.
FLUSH = 1_500_000
LOW40 = U((1 << 40) - 1)
LOWEST = -(2**63)


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over a[i : i + width] for every i where that is whole."""
    r, have = a, 1
    while have * 2 <= width:
        r = pick(r[:-have], r[have:])
        have *= 2
    if have < width:
        r = pick(r[: len(r) - (width - have)], r[width - have :])
    return r


class Anchors:
    """Anchors of a text block: place, first and last start of the strings they stand for, 64-bit hash of the seed."""

    def __init__(self, text: Text, length: int):
        n, o = len(text.bytes), text.offsets
        none = np.zeros(0, np.int64)
        self.at = self.lo = self.hi = self.row = none
        self.pad = np.zeros(n + 2 * length + 16, np.uint8)
        self.pad[length : length + n] = text.bytes
        self.length = length
        if n < length or SEED >= length:
            if SEED >= length:
                raise ValueError(f"length must be above {SEED}")
            return
        eight = np.ndarray((n - 7,), "<u8", self.pad, length, (1,)) if n >= 8 else none
        k = n - SEED + 1
        h = (eight[:k] * U(0x9E3779B97F4A7C15)) ^ (eight[8 : 8 + k] * U(0xC2B2AE3D27D4EB4F)) ^ ((eight[12 : 12 + k] >> U(32)) * U(0x165667B19E3779F9))
        h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
        order = np.maximum((h >> U(32)).astype(np.uint32), np.uint32(1))  # 0 stands for no string
        width = length - SEED + 1
        m = _slide(order, width, np.minimum)  # of each start of a string
        whole = np.zeros(len(m), np.uint32)
        for a, b in zip(o[:-1].tolist(), o[1:].tolist()):
            if b - a >= length:
                whole[a : b - length + 1] = 1
        m = np.where(whole == 1, m, 0) if whole.min() == 0 else m
        top = np.zeros(len(m) + 2 * (width - 1), np.uint32)
        top[width - 1 : width - 1 + len(m)] = m
        best = _slide(top, width, np.maximum)  # of each place, the greatest least hash of strings that hold it
        at = np.flatnonzero((best == order) & (best > 0))
        row = np.searchsorted(o, at, side="right") - 1
        lo, hi = at - width + 1, at.copy()
        near = row[1:] == row[:-1]
        lower = order[at[1:]] < order[at[:-1]]
        lo[1:] = np.where(near & ~lower, np.maximum(lo[1:], at[:-1] + 1), lo[1:])
        hi[:-1] = np.where(near & lower, np.minimum(hi[:-1], at[1:] - width), hi[:-1])
        lo, hi = np.maximum(lo, o[row]), np.minimum(hi, o[row + 1] - length)
        live = lo <= hi
        self.at, self.lo, self.hi, self.row = at[live], lo[live], hi[live], row[live]
        self.hash = mixed(h[self.at])

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """Bytes from the first string's start to the last one's end, placed so that the anchor is at a fixed column; else zero."""
        reach = self.length - SEED
        wide = np.lib.stride_tricks.sliding_window_view(self.pad, reach + self.length)
        out = wide[self.at[which] - reach + self.length].copy()
        column = np.arange(reach + self.length)
        a, b = self.lo[which] - self.at[which] + reach, self.hi[which] + self.length - self.at[which] + reach
        out[(column < a[:, None]) | (column >= b[:, None])] = 0
        return out

    def names(self, contexts: np.ndarray, which: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each context and its bounds."""
        w = contexts.shape[1] // 8 * 8
        digits = np.concatenate([np.ascontiguousarray(contexts[:, :w]).view("<u8"), np.ascontiguousarray(contexts[:, -8:]).view("<u8")], axis=1)
        h = (self.at[which] - self.lo[which]).astype(U) * U(64) + (self.hi[which] - self.lo[which]).astype(U)
        for j in range(digits.shape[1]):
            h = mixed(h * U(0x9E3779B97F4A7C15) + digits[:, j])
        return h


def _key() -> F.Column:
    """A null id counts as the smallest."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST))


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _low5(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from5(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _ids(keys: np.ndarray) -> bytes:
    """Integers as a base and 4-byte distances, or as they are where they lie too far apart."""
    if not len(keys):
        return b""
    base = int(keys.min())
    far = int(keys.max()) - base
    return base.to_bytes(8, "little", signed=True) + ((keys - base).astype("<u4").tobytes() if far < 1 << 32 else b"\0" + keys.astype("<i8").tobytes())


def _from_ids(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    if (len(raw) - 8) % 4:
        return np.frombuffer(raw, "<i8", offset=9)
    return np.frombuffer(raw, "<u4", offset=8).astype(np.int64) + int.from_bytes(raw[:8], "little", signed=True)


ROW = "bucket int, done boolean, a binary, b binary, c binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "done", "a", "b", "c"])


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    """Arrays of 64-bit numbers as columns."""
    kind = pa.schema([(n, pa.int64()) for n in names])
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(np.asarray(c).view(np.int64)) for c in x], schema=kind) for x in parts], kind)


def _listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number of each element of a column of lists, and the elements; a null list is empty."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), n), column.flatten()


def _fields(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, flat = _listed(column)
    name, mask = flat.flatten()
    return rows, name.to_numpy(zero_copy_only=False).view(U), mask.to_numpy(zero_copy_only=False).view(U)


def _first_digit(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(dk, h): 40-bit hashes of each document's anchors that another document has too, a row for each."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> pa.RecordBatch:
            h, d = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[new], d[new]
            cut = _firsts(h)
            count = np.diff(np.append(cut, len(h)))
            own = np.repeat(count > 1, count)  # shared within what was gathered here
            rows = []
            if own.any():
                rows.append((int(h[0] % U(buckets)), True, _low5(h[own]), _ids(d[own]), None))
            hh, dd, twice = h[cut], d[cut], count > 1
            b = ((hh >> U(40)) % U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            hh, dd, twice, b = hh[order], dd[order], twice[order], b[order]
            edge = _firsts(b)
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(b)]):
                rows.append((int(b[s]), False, _low5(hh[s:e]), _ids(dd[s:e]), np.packbits(twice[s:e]).tobytes()))
            held.clear()
            return _rows(rows)

        size = 0
        for batch in blocks(batches, "text", CACHE_BYTES):
            x = Anchors(Text(get(batch, "text")), length)
            if len(x.at):
                held.append((x.hash, get(batch, "dk").to_numpy()[x.row]))
                size += len(x.at)
            if size > FLUSH:
                yield flush()
                size = 0
        if held:
            yield flush()

    def shared(table: pa.Table) -> pa.Table:
        out, hs, ds, ts = [], [], [], []
        for done, a, b, c in zip(*(table.column(k).to_pylist() for k in ("done", "a", "b", "c"))):
            if done:
                out.append((_from_ids(b), _from5(a)))
            else:
                hs.append(_from5(a))
                ds.append(_from_ids(b))
                ts.append(np.unpackbits(np.frombuffer(c, np.uint8))[: len(hs[-1])])
        if hs:
            h, d, t = np.concatenate(hs), np.concatenate(ds), np.concatenate(ts)
            order = np.argsort(h, kind="stable")
            h, d, t = h[order], d[order], t[order]
            count = np.diff(np.append(_firsts(h), len(h)))
            many = np.repeat(count > 1, count)
            if many.any():
                out.append((d[many], h[many]))
        return _table(out, ["dk", "h"])

    return docs.mapInArrow(emit, ROW).groupBy("bucket").applyInArrow(shared, "dk bigint, h bigint")


def _resolve(ctx: np.ndarray, lo: np.ndarray, hi: np.ndarray, dk: np.ndarray, length: int) -> np.ndarray:
    """A bit for each string of each context that a document with a smaller key has as well."""
    reach = length - SEED
    wide = np.zeros((len(ctx), ctx.shape[1] + 8), np.uint8)
    wide[:, : ctx.shape[1]] = ctx

    def digit(which: np.ndarray, a: int, b: int) -> np.ndarray:
        """Up to eight bytes of the columns a to b as one number."""
        out = np.ascontiguousarray(wide[which, a : a + 8]).view(">u8").ravel().astype(U)
        return out >> U(8 * (8 - (b - a))) if b - a < 8 else out

    def refine(which: np.ndarray, group: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Most significant digit first: split groups by the next digit, drop those of one document."""
        for a, b in spans:
            if not len(which):
                break
            d = digit(which, a, b)
            order = np.lexsort((d, group))
            which, group, d = which[order], group[order], d[order]
            new = np.ones(len(which), bool)
            new[1:] = (group[1:] != group[:-1]) | (d[1:] != d[:-1])
            group = np.cumsum(new) - 1
            cut = np.flatnonzero(new)
            many = (np.maximum.reduceat(dk[which], cut) != np.minimum.reduceat(dk[which], cut))[group]
            which, group = which[many], group[many]
        return which, group

    spans = lambda a, b: [(i, min(i + 8, b)) for i in range(a, b, 8)]
    which, group = refine(np.arange(len(ctx)), np.zeros(len(ctx), np.int64), spans(reach, reach + SEED))
    mask = np.zeros(len(ctx), U)
    for o in range(reach + 1):
        inside = (lo[which] <= o) & (hi[which] >= o)
        w, g = refine(which[inside], group[inside], spans(reach + SEED, o + length) + spans(o, reach))
        if len(w):
            order = np.argsort(g, kind="stable")
            w, g = w[order], g[order]
            cut = _firsts(g)
            least = np.repeat(np.minimum.reduceat(dk[w], cut), np.diff(np.append(cut, len(g))))
            mask[w[dk[w] > least]] |= U(1) << U(o)
    return mask


#: Stands for every string of a context; the context's own bounds say which.
ALL = U((1 << 63) - 1)
OUT = ["dk", "name", "mask"]


def _lists(table: DataFrame, value: str | F.Column, name: str) -> DataFrame:
    return table.groupBy(F.col("dk").alias(f"dk_{name}")).agg(F.collect_list(value).alias(name))


def _chosen(x: Anchors, rows: np.ndarray, values: np.ndarray, low40: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors whose seed (low40) or context is among the values of their row, their contexts and the names of these."""
    want = values + mixed(rows.astype(U))
    if low40:
        which = np.flatnonzero(np.isin((x.hash & LOW40) + mixed(x.row.astype(U)), want))
        ctx = x.contexts(which)
        return which, ctx, x.names(ctx, which)
    which = np.flatnonzero(np.isin(x.row, rows))
    ctx = x.contexts(which)
    name = x.names(ctx, which)
    own = np.isin(name + mixed(x.row[which].astype(U)), want)
    return which[own], ctx[own], name[own]


def _whole_contexts(docs: DataFrame, shared: DataFrame, length: int, buckets: int) -> DataFrame:
    """(dk, name, mask): names of contexts that a smaller document has as a whole (mask ALL), and, where an anchor stands in
    different contexts, of the first of each (mask 0): only these go on digit by digit."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> pa.RecordBatch:
            name, d, h = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((d, name))
            name, d, h = name[order], d[order], h[order]
            cut = _firsts(name)
            later = d > np.repeat(d[cut], np.diff(np.append(cut, len(name))))
            rows = []
            if later.any():  # a smaller document gathered here has the same context
                rows.append((int(name[0] % U(buckets)), True, name[later].astype("<u8").tobytes(), _ids(d[later]), None))
            name, d, h = name[cut], d[cut], h[cut]
            b = ((h >> U(40)) % U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            edge = _firsts(b[order])
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(b)]):
                w = order[s:e]
                rows.append((int(b[w[0]]), False, name[w].astype("<u8").tobytes(), _ids(d[w]), _low5(h[w])))
            return _rows(rows)

        size = 0
        for batch in blocks(batches, "text", CACHE_BYTES):
            x = Anchors(Text(get(batch, "text")), length)
            if not len(x.at):
                continue
            own, values = _listed(get(batch, "vs"))
            which, _, name = _chosen(x, own, values.to_numpy(zero_copy_only=False).view(U), True)
            if len(which):
                held.append((name, get(batch, "dk").to_numpy()[x.row[which]], x.hash[which]))
                size += len(which)
            if size > FLUSH:
                yield flush()
                size = 0
        if held:
            yield flush()

    def settled(table: pa.Table) -> pa.Table:
        out, parts = [], []
        for done, a, b, c in zip(*(table.column(k).to_pylist() for k in ("done", "a", "b", "c"))):
            if done:
                out.append((_from_ids(b), np.frombuffer(a, "<u8"), np.full(len(a) // 8, ALL)))
            else:
                parts.append((np.frombuffer(a, "<u8"), _from_ids(b), _from5(c)))
        if parts:
            name, d, h = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((d, name, h))
            name, d, h = name[order], d[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (name[1:] != name[:-1])
            cut = np.flatnonzero(new)
            later = d > np.repeat(d[cut], np.diff(np.append(cut, len(h))))
            if later.any():
                out.append((d[later], name[later], np.full(int(later.sum()), ALL)))
            seed = _firsts(h[cut])
            many = np.repeat(np.diff(np.append(seed, len(cut))), np.diff(np.append(seed, len(cut)))) > 1
            if many.any():
                out.append((d[cut][many], name[cut][many], np.zeros(int(many.sum()), U)))
        return _table(out, OUT)

    met = docs.join(_lists(shared, "h", "vs"), F.col("dk") == F.col("dk_vs")).select("dk", "text", "vs")
    return met.mapInArrow(emit, ROW).groupBy("bucket").applyInArrow(settled, "dk bigint, name bigint, mask bigint")


def _further_digits(docs: DataFrame, whole: DataFrame, length: int, buckets: int) -> DataFrame:
    """(dk, name, mask): names of contexts with the strings in them that a smaller document has, of those that `whole` has left open."""
    reach = length - SEED

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> pa.RecordBatch:
            name, d, ctx, lo, hi, h = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((d, name))
            cut = order[_firsts(name[order])]
            b = ((h[cut] >> U(40)) % U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            edge = _firsts(b[order])
            rows = []
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(b)]):
                w = cut[order[s:e]]
                rows.append((int(b[order[s]]), False, name[w].astype("<u8").tobytes(), _ids(d[w]), lo[w].astype(np.uint8).tobytes() + hi[w].astype(np.uint8).tobytes() + ctx[w].tobytes()))
            return _rows(rows)

        size = 0
        for batch in blocks(batches, "text", CACHE_BYTES):
            own, names, masks = _fields(get(batch, "vs"))
            if not (masks == 0).any():
                continue
            x = Anchors(Text(get(batch, "text")), length)
            which, ctx, name = _chosen(x, own[masks == 0], names[masks == 0], False)
            if len(which):
                held.append((name, get(batch, "dk").to_numpy()[x.row[which]], ctx, x.lo[which] - x.at[which] + reach, x.hi[which] - x.at[which] + reach, x.hash[which]))
                size += len(which)
            if size > FLUSH // 8:
                yield flush()
                size = 0
        if held:
            yield flush()

    def resolved(table: pa.Table) -> pa.Table:
        parts = []
        for a, b, c in zip(*(table.column(k).to_pylist() for k in ("a", "b", "c"))):
            n, c = len(a) // 8, np.frombuffer(c, np.uint8)
            parts.append((np.frombuffer(a, "<u8"), _from_ids(b), c[:n], c[n : 2 * n], c[2 * n :].reshape(n, -1)))
        name, d, lo, hi, ctx = (np.concatenate(x) for x in zip(*parts))
        del parts, table
        mask = _resolve(ctx, lo, hi, d, length)
        some = mask > 0
        return _table([(d[some], name[some], mask[some])], OUT)

    met = docs.join(_lists(whole, F.struct("name", "mask"), "vs"), F.col("dk") == F.col("dk_vs")).select("dk", "text", "vs")
    return met.mapInArrow(emit, ROW).groupBy("bucket").applyInArrow(resolved, "dk bigint, name bigint, mask bigint")


def repeated(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, text, cuts: the byte spans [start, end) of each text that a document with a smaller id has too.

    Strings are of `length` bytes (21 to 83) and judged on the input; their spans are merged. A null text
    is empty. A null id counts as smaller than any other; rows that share an id are never each other's copies.
    Texts below the length have no cuts; an empty table gives an empty result.
    """
    if not SEED < length <= SEED + 63:
        raise ValueError("length must be 21 to 83")
    base = whole_ids(docs).select(_key().alias("dk"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    slim = base.select("dk", "text")
    shared = _first_digit(slim, length, buckets)
    whole = _whole_contexts(slim, shared, length, buckets)
    parts = _further_digits(slim, whole, length, buckets)
    reach = length - SEED

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", CACHE_BYTES):
            rows, names, masks = (np.concatenate(c) for c in zip(_fields(get(batch, "vs")), _fields(get(batch, "ws"))))
            cuts: list[list] = [[] for _ in range(batch.num_rows)]
            if len(rows):
                text = Text(get(batch, "text"))
                x = Anchors(text, length)
                mine, _, name = _chosen(x, rows, names, False)
                name = name + mixed(x.row[mine].astype(U))
                known = names + mixed(rows.astype(U))
                order = np.argsort(known)
                known, masks = known[order], masks[order]
                left, right = np.searchsorted(known, name, "left"), np.searchsorted(known, name, "right")
                delta = np.zeros(len(text.bytes) + 1, np.int64)
                for i in np.flatnonzero(right > left).tolist():
                    start = int(x.at[mine[i]]) - reach
                    lo, hi = int(x.lo[mine[i]]) - start, int(x.hi[mine[i]]) - start
                    bits = int(np.bitwise_or.reduce(masks[left[i] : right[i]])) & ((2 << hi) - (1 << lo))
                    while bits:  # runs of set bits
                        a = (bits & -bits).bit_length() - 1
                        run = bits >> a
                        n = (~run & (run + 1)).bit_length() - 1
                        delta[start + a] += 1
                        delta[start + a + n - 1 + length] -= 1
                        bits &= ~(((1 << n) - 1) << a)
                covered = np.cumsum(delta[:-1]) > 0
                s, e = words(covered, text.offsets)
                r = np.searchsorted(text.offsets, s, side="right") - 1
                for i, a, b in zip(r.tolist(), (s - text.offsets[r]).tolist(), (e - text.offsets[r]).tolist()):
                    cuts[i].append({"start": a, "end": b})
            spans = pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([get(batch, "dk"), get(batch, "text"), spans], ["dk", "text", "cuts"])

    met = slim.join(_lists(whole, F.struct("name", "mask"), "vs"), F.col("dk") == F.col("dk_vs"), "left").join(_lists(parts, F.struct("name", "mask"), "ws"), F.col("dk") == F.col("dk_ws"), "left").select("dk", "text", "vs", "ws")
    out = met.mapInArrow(cut, "dk bigint, text string, cuts array<struct<start:bigint,end:bigint>>")
    return out.select(F.expr(f"CASE WHEN dk <> {LOWEST + 1} - 1 THEN dk END").alias("doc_id"), "text", "cuts")


def report(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            text = Text(get(batch, "text"))
            cuts = get(batch, "cuts").to_pylist()
            sizes, removed, digests = [], [], []
            for i, spans in enumerate(cuts):
                raw, at, h = text.row(i), 0, hashlib.sha256()
                for s in spans:
                    h.update(raw[at : s["start"]])
                    at = s["end"]
                h.update(raw[at:])
                sizes.append(len(raw))
                removed.append(sum(s["end"] - s["start"] for s in spans))
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([get(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in cuts], pa.int64()), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated(docs, length).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


#: Bytes as two hexadecimal digits each.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(x, p, 100)) AS h FROM (SELECT doc_id, x, unnest(generate_series(1, length(x) - 99, 2)) AS p FROM d)),
f AS (SELECT h, min(doc_id) AS least FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
m AS (SELECT doc_id, p, least FROM s JOIN f USING (h)),
k AS (SELECT doc_id, p, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m WHERE least < doc_id),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR p > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS part FROM k),
u AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS e FROM g GROUP BY doc_id, part),
c AS (SELECT doc_id, a AS o, 0 AS side FROM u UNION ALL SELECT doc_id, e, 1 FROM u UNION ALL SELECT doc_id, 1, 1 FROM d UNION ALL SELECT doc_id, length(x) + 1, 0 FROM d),
b AS (SELECT doc_id, o, side, lead(o) OVER (PARTITION BY doc_id ORDER BY o, side DESC) AS upto FROM c),
t AS (SELECT b.doc_id, string_agg(substr(x, o, upto - o), '' ORDER BY o) AS left_ FROM b JOIN d USING (doc_id) WHERE side = 1 AND upto > o GROUP BY b.doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum((e - a) // 2)::BIGINT AS n_removed FROM u GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def brute(docs: list, length: int = 50) -> list[tuple]:
    """The report by a dictionary of all strings, for tests."""
    raw = [(LOWEST if i is None else i, (t or "").encode()) for i, t in docs]
    least: dict = {}
    for i, t in raw:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            least[s] = min(least.get(s, i), i)
    out = []
    for (i, t), (doc, _) in zip(raw, docs):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(t)))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out
