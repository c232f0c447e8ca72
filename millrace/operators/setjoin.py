"""Documents whose shingle sets have a Jaccard similarity of at least a threshold: candidates by prefixes, which lose none, then an exact check.

In any one order of all shingles, two sets of at least that similarity share a shingle among the first
n - ceil(least * n) + 1 of each. The order here is by hash, with the shingles of many documents last, so
that common passages lead to few comparisons, and shingles of one document are not looked at further. In
how many documents a shingle is, is counted over all of them and told to the tasks as bit arrays of BITS bits,
one for each of LEVELS; shingles that share a bit, or a full array, cost time and nothing else, because any
order serves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOWER, SPACE, Text, U, blocks, get, mixed, of_rows, run_hashes, words
from ..sources.kept import dropped, kept
from .graph import components

#: Documents from which a shingle is shared, and then the more common; 255 at most.
LEVELS = (2, 4, 32, 255)
#: Bits of each of the arrays that go to all tasks: of shingles by level, and of documents that have candidates.
BITS = 1 << 26
#: Shingles that a task gathers before it sends their counts on, and those of one bucket of the count.
FLUSH, BUCKET = 2_000_000, 8_000_000


def shingle_hashes(text: Text, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each row's shingles of `size` words, ascending, and the row of each: words between white space, A-Z lower-cased; fewer words are one shingle."""
    low = LOWER[text.bytes]
    starts, ends = words(~SPACE[low] if len(low) else np.zeros(0, bool), text.offsets)
    first = of_rows(starts, text.offsets)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    wh = run_hashes(low, starts, ends)
    n = np.diff(first)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(text.n), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
    end = first[row + 1]
    h = np.zeros(len(row), U)
    for i in range(size):
        inside = at + i < end
        h = np.where(inside, h * U(0x9E3779B97F4A7C15) + wh[np.minimum(at + i, len(wh) - 1)] + U(1), h)
    h = mixed(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _names(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """A hash of each row's set."""
    out = np.zeros(n, U)
    if len(h):
        head = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[head]] = np.add.reduceat(mixed(h * U(0xC2B2AE3D27D4EB4F)), head)
    return mixed(out + np.bincount(row, minlength=n).astype(U) * U(0xD6E8FEB86659FD93)).view(np.int64)


def _bit_array(positions: DataFrame, bits: int) -> np.ndarray:
    """The bit array of a column p of positions from 1 to bits - 1: at most bits / 8 bytes come to the driver."""
    rows = positions.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    out = np.zeros((bits // 32768 + 1) * 4096, np.uint8)
    for r in rows:
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)
    return out


def _has(bits: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Bit numbers count from 1 in the aggregate's blocks: position p is bit p - 1 of the array."""
    p = p.astype(np.int64) - 1
    return (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h % U(bits - 1) + U(1)).astype(np.int64)


def common_shingles(docs: DataFrame, size: int, text: str = "text") -> list[np.ndarray]:
    """For each of LEVELS the bit array of the shingles that as many documents have. Counts of what a task has gathered go to buckets, 5 bytes a shingle."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, bits, most = max(1, -(-total // (6 * BUCKET))), BITS, FLUSH

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            b = ((h >> U(32)) % U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            h, n, b = (h & U(0xFFFFFFFF)).astype(np.uint32)[order], np.minimum(n, 255).astype(np.uint8)[order], b[order]
            cut = np.flatnonzero(np.diff(b, prepend=-1)).tolist()
            ends = [*cut[1:], len(b)]
            return pa.RecordBatch.from_arrays([pa.array(b[cut].astype(np.int32)), pa.array([h[s:e].tobytes() for s, e in zip(cut, ends)], pa.binary()), pa.array([n[s:e].tobytes() for s, e in zip(cut, ends)], pa.binary())], ["bucket", "h", "n"])

        have = 0
        for batch in blocks(batches, text):
            h, _ = shingle_hashes(Text(get(batch, text)), size)
            if len(h):
                held.append(h)
                have += len(h)
            if have > most:
                yield flush()
                have = 0
        if held:
            yield flush()

    def often(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("h").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("n").to_pylist()])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        head = np.flatnonzero(np.diff(h.astype(np.int64), prepend=-1))
        n = np.add.reduceat(n.astype(np.int64), head)
        p, level = _place(h[head].astype(U), bits), np.searchsorted(LEVELS, n, side="right")
        return pa.table({"level": pa.array(level[level > 0].astype(np.int32)), "p": pa.array(p[level > 0])})

    counted = kept(docs.select(text).mapInArrow(count, "bucket int, h binary, n binary").groupBy("bucket").applyInArrow(often, "level int, p bigint"), "common")
    out = [_bit_array(counted.where(F.col("level") > k), bits) for k in range(len(LEVELS))]
    dropped(counted)
    return out


def prefixes(docs: DataFrame, size: int, least: float, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, node, n, hs) of each document: the name and size of its set, and what other documents may have of the set's prefix in the common order."""
    bits = BITS
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            t = Text(get(batch, text))
            h, row = shingle_hashes(t, size)
            n = np.bincount(row, minlength=t.n)
            node = _names(h, row, t.n)
            place = _place(h & U(0xFFFFFFFF), bits)
            level = np.zeros(len(h), np.int8)
            for one in shared.value:
                level += _has(one, place)
            order = np.lexsort((h, level, row))
            at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            stay = order[(at < lead(n, least)[row]) & (level[order] > 0)]
            ends = np.searchsorted(row[stay], np.arange(t.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([get(batch, id_col), pa.array(node), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[stay].view(np.int64)))], ["id", "node", "n", "hs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, node bigint, n int, hs array<bigint>")


def lead(n: np.ndarray, least: float) -> np.ndarray:
    """Length of the prefixes of sets of n shingles."""
    return n - np.ceil(n * least - 1e-9).astype(np.int64) + 1


def _sets(docs: DataFrame, ids: DataFrame, size: int, id_col: str, text: str) -> DataFrame:
    """(node, hs): the whole sets of the documents whose id is in `ids`, made anew from their texts; a few others may be there too, and one set twice."""
    shared = docs.sparkSession.sparkContext.broadcast(_bit_array(ids.select((F.pmod(F.xxhash64("id"), F.lit(BITS - 1)) + 1).alias("p")), BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(_has(shared.value, get(batch, "p").to_numpy())))
            for part in blocks(iter([batch]), text):
                t = Text(get(part, text))
                h, row = shingle_hashes(t, size)
                node = _names(h, row, t.n)
                cuts = np.searchsorted(row, np.arange(t.n + 1)).tolist()
                rows = [i for i in range(t.n) if cuts[i + 1] > cuts[i]]
                new = [i for i in rows if node[i] not in seen]
                if len(seen) < 1_000_000:
                    seen.update(node[new].tolist())
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array([h[cuts[i] : cuts[i + 1]].view(np.int64) for i in new], pa.list_(pa.int64()))], ["node", "hs"])

    return docs.select((F.pmod(F.xxhash64(id_col), F.lit(BITS - 1)) + 1).alias("p"), text).mapInArrow(run, "node bigint, hs array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b) whose sets (node, hs), ascending hashes, have at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = []
            sides = [(np.diff(c.offsets.to_numpy()), c.flatten().to_numpy(zero_copy_only=False).view(U)) for c in (batch.column(2), batch.column(3))]
            row = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n, _ in sides])
            key = mixed(np.concatenate([v for _, v in sides])) + row.astype(U) * U(0x9E3779B97F4A7C15)
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            both = np.bincount(row[order][1:][same], minlength=batch.num_rows)
            j = both / np.maximum(sides[0][0] + sides[1][0] - both, 1)
            near = pa.array(j >= least - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j)], ["a", "b", "jaccard"]).filter(near)

    x, y = sets.select(F.col("node").alias("a"), F.col("hs").alias("x")), sets.select(F.col("node").alias("b"), F.col("hs").alias("y"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return met.mapInArrow(run, "a bigint, b bigint, jaccard double")


def _sized(least: float) -> F.Column:
    return F.least("m", "n") >= F.greatest("m", "n") * least - 1e-9


class Join:
    """The join of one table of documents with itself. least is above 0.

    Equal sets are one node. Empty sets, of null texts and those without words, are one node without
    links. `owners` has (id, node) of every document, `shared` the prefix entries that two nodes have.
    """

    def __init__(self, docs: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text: str = "text"):
        if not 0 < least <= 1:
            raise ValueError("least must be above 0 and at most 1")
        self.docs, self.least, self.size, self.id_col, self.text = docs, least, size, id_col, text
        self.table = kept(prefixes(docs, size, least, id_col, text), "prefixes")
        self.owners = self.table.select("id", "node")
        self.reps = kept(self.table.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("hs").alias("hs")), "reps")
        # where in the common order of its set a shingle stands: those of one document only come before
        before = F.least(F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1, F.col("n")) - F.size("hs")
        some = self.reps.select("node", "n", before.cast("int").alias("before"), F.posexplode("hs").alias("place", "h")).select("node", "n", (F.col("before") + F.col("place")).alias("place"), "h")
        heads = kept(self._heads(some, 0).where("c > 1").select("g", "head"), "heads")
        self.shared = kept(some.join(heads, F.col("h") == F.col("g")).select("node", "n", "place", "h", "head"), "shared")
        dropped(heads)

    @staticmethod
    def _heads(rows: DataFrame, turn: int) -> DataFrame:
        """(g, head, c): of each shingle's nodes one by chance, and their number; another one at another turn, and for each shingle."""
        return rows.groupBy(F.col("h").alias("g")).agg(F.min_by("node", F.xxhash64("node", "h", F.lit(turn))).alias("head"), F.count("*").alias("c"))

    def _met(self, rows: DataFrame, rooted: bool) -> DataFrame:
        """(a, b, i, j) of the nodes of rows (node, n, place, h, root) that meet in a shingle and may be similar; only those of different roots, where `rooted` says so.

        A pair counts where it meets first: by what stands before in both prefixes. What stands behind, and what the
        prefixes share, must be enough.
        """
        own = self.reps.select(F.col("node").alias("of"), "hs", F.col("id").alias("owner"))
        rows = rows.join(own, F.col("node") == F.col("of")).withColumn("early", F.slice("hs", 1, F.array_position("hs", F.col("h")).cast("int") - 1))
        left = rows.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("place").alias("place2"), F.col("h").alias("g"), F.col("hs").alias("x"), F.col("early").alias("early2"), F.col("owner").alias("i"), *([F.col("root").alias("r")] if rooted else []))
        right = rows.select(F.col("node").alias("b"), "n", "place", "h", F.col("hs").alias("y"), "early", F.col("owner").alias("j"), *(["root"] if rooted else []))
        both = (F.col("m") + F.col("n")) * (self.least / (1 + self.least)) - 1e-6
        near = _sized(self.least) & (F.col("n") - F.col("place") >= both) & (F.col("m") - F.col("place2") >= both)
        met = (F.col("g") == F.col("h")) & (F.col("a") < F.col("b")) & near & ~F.arrays_overlap("early", "early2") & self._enough()
        return left.join(right, met & (F.col("r") != F.col("root")) if rooted else met).select("a", "b", "i", "j")

    def _enough(self) -> F.Column:
        """Whether what two prefixes x and y share, and all that stands behind them, is enough."""
        behind = F.greatest(F.ceil(F.col("m") * self.least - 1e-9), F.ceil(F.col("n") * self.least - 1e-9)) - 1
        return F.size(F.array_intersect("x", "y")) + behind >= (F.col("m") + F.col("n")) * (self.least / (1 + self.least)) - 1e-6

    def _checked(self, pairs: DataFrame) -> DataFrame:
        """(a, b, jaccard) of the candidates (a, b) that are similar: whole sets are compared of those whose prefixes share enough."""
        x = self.reps.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("hs").alias("x"), F.col("id").alias("i"))
        y = self.reps.select(F.col("node").alias("b"), "n", F.col("hs").alias("y"), F.col("id").alias("j"))
        return self._compared(pairs.join(x, "a").join(y, "b").where(_sized(self.least) & self._enough()).select("a", "b", "i", "j"))

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """(a, b, jaccard) of the pairs (a, b, i, j) that are similar, by their whole sets; i and j are ids of documents that have them."""
        pairs = kept(pairs, "candidates")
        ids = pairs.select(F.col("i").alias("id")).union(pairs.select("j")).distinct()
        sets = kept(_sets(self.docs, ids, self.size, self.id_col, self.text), "sets")
        out = kept(verified(pairs.select("a", "b"), sets, self.least).distinct(), "near")
        dropped(pairs, sets)
        return out

    def pairs(self) -> DataFrame:
        """(a, b, jaccard) with a < b: all pairs of nodes of at least that similarity."""
        return self._compared(self._met(self.shared, False))

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of some pairs (a, b) of nodes that are similar, as links (a, b)."""
        return self._checked(pairs).select("a", "b")

    def links(self, known: DataFrame | None = None) -> DataFrame:
        """Links (a, b) that connect all nodes of at least that similarity, directly or over others. Nodes that links (a, b) in `known` connect are not compared again.

        First each node is compared with one node of each of its shingles, taken by chance: no more
        comparisons than entries. Where many pairs of unconnected nodes would be left, that is done again with other
        nodes, as long as it connects more. In the end all pairs that are not connected and meet are
        compared, so none is lost; a dense cluster is connected by then.
        """
        stars = self._stars(self.shared)
        if known is not None:
            roots = components(known)
            x, y = roots.select(F.col("node").alias("of"), F.col("root").alias("r")), roots.select(F.col("node").alias("of2"), F.col("root").alias("r2"))
            met = stars.join(x, F.col("a") == F.col("of"), "left").join(y, F.col("b") == F.col("of2"), "left")
            stars = met.where(F.coalesce("r", "a") != F.coalesce("r2", "b")).select("a", "b")
        found = self.similar(stars)
        found = found if known is None else found.union(known)
        turn, left = 1, None
        while True:
            roots = components(found).select(F.col("node").alias("of"), "root")
            placed = kept(self.shared.join(roots, F.col("node") == F.col("of"), "left").select("node", "n", "place", "h", F.coalesce("root", "node").alias("root")), "placed")
            # only shingles whose nodes are not yet connected, and the pairs that they would make
            sizes = placed.groupBy("h", "root").agg(F.count("*").alias("k")).groupBy("h").agg(F.count("*").alias("roots"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
            apart = kept(sizes.where("roots > 1").select(F.col("h").alias("o"), "k", ((F.col("k") * F.col("k") - F.col("kk")) / 2).alias("pairs")), "apart")
            open_ = placed.join(apart.select("o"), F.col("h") == F.col("o"), "left_semi")
            entries, pairs = apart.agg(F.sum("k"), F.sum("pairs")).first()
            if not entries or pairs <= 2 * entries or (left is not None and pairs > 0.7 * left):
                break
            left = pairs
            heads = self._heads(open_, turn).select("g", "head")
            roots = placed.select(F.col("node").alias("of"), F.col("root").alias("other")).distinct()
            met = open_.join(heads, F.col("h") == F.col("g")).join(roots, F.col("head") == F.col("of")).where("root <> other")
            found = kept(found.union(self._checked(self._stars(met)).select("a", "b")), "found")
            dropped(placed, apart)
            turn += 1
        return found.union(self._compared(self._met(open_, True)).select("a", "b"))

    @staticmethod
    def _stars(rows: DataFrame) -> DataFrame:
        return rows.where("head <> node").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()

    def classes(self, known: DataFrame | None = None) -> DataFrame:
        """(id, node, component): component is the least id that a document reaches over links; null ids name none where others are there. known: see links()."""
        roots = components(self.links(known)).select(F.col("node").alias("of"), "root")
        names = self.owners.groupBy("node").agg(F.min("id").alias("least"))
        named = kept(names.join(roots, F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "named")
        least = named.groupBy("root").agg(F.min("least").alias("component"))
        table = named.join(least, "root").select(F.col("node").alias("of"), "component")
        return self.owners.join(table, F.col("node") == F.col("of")).select("id", "node", "component")

