"""SimHash near-duplicates: fingerprints of word shingles, joined with themselves by a binary trie."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.setjoin import Join
from .common import LOWER, SPACE, Text, U, blocks, dropped, free, get, kept, of_rows, plain, words

#: Node pairs that the trie join expands at once.
FRONTIER = 1 << 19
#: Distinct fingerprints below one trie node that a task joins by itself; more are dealt out in pairs of shares.
SHARE = 16_384


def shingles_of(text: Text, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the `size`-word shingles of all rows, and how many each row has: words between white space, A-Z lower-cased."""
    low = LOWER[text.bytes]
    white = SPACE[low]
    starts, ends = words(~white, text.offsets)
    first = of_rows(starts, text.offsets)
    if len(starts) == 0:
        return np.zeros(0, U), np.zeros(text.n, np.int64)
    # words joined by single spaces, all rows in one string
    lens = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lens + 1, out=at[1:])
    joined = np.full(int(at[-1]), 32, np.uint8)
    local = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
    joined[local + np.repeat(at[:-1], lens)] = low[local + np.repeat(starts, lens)]
    begin, end = at[:-1], at[1:] - 1
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(text.n), n_shingles)
    base = np.cumsum(n_shingles) - n_shingles
    k = np.arange(len(row)) - base[row] + first[row]
    last = np.minimum(k + size, first[row + 1]) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], seed) for a, b in zip(begin[k].tolist(), end[last].tolist())), dtype=U, count=len(k))
    return h, n_shingles


def fingerprints_of(text: Text, size: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each row, of its `size`-word shingles."""
    h, n_shingles = shingles_of(text, size, seed)
    base = np.cumsum(n_shingles) - n_shingles
    out = np.zeros(text.n, U)
    some = np.flatnonzero(n_shingles)
    if len(some):
        two, half = U(0x0000000100000001), n_shingles[some].astype(U)
        for bit in range(32):  # two counters of 32 bits in each sum
            sums = np.add.reduceat((h >> U(bit)) & two, base[some])
            lo, hi = sums & U(0xFFFFFFFF), sums >> U(32)
            out[some] |= ((lo * U(2) > half).astype(U) << U(bit)) | ((hi * U(2) > half).astype(U) << U(bit + 32))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint's bits as a bigint. Null texts and texts without words have fingerprint zero."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col):
            yield pa.RecordBatch.from_arrays([get(b, id_col), pa.array(fingerprints_of(Text(get(b, text_col)), size).view(np.int64))], ["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, fp bigint")


def _settle(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of each link the same label, the least that they reach."""
    while True:
        la, lb = lab[a], lab[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(lab, la, low)
        np.minimum.at(lab, lb, low)
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab[:] = up


def trie_links(fps: np.ndarray, group: np.ndarray, budget: int = 3, across: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join all fingerprints of a group within `budget` bits of each other, as few as that takes.

    fps: ascending within each group, groups one after another. Each group is a binary trie, held as a
    sorted array: a node is a range of it. Pairs of nodes of the same depth go down together; a pair
    whose paths differ in more than `budget` bits is dropped with all below it. Links already implied
    by others are dropped as they come, so a dense cluster gives a link for each member and no more.
    across: where given, a flag for each fingerprint. Groups in which it is set are two ascending halves, first those with flag 1, then
    those with flag 2, and only fingerprints of different halves are compared (two shares of a large group).
    """
    n = len(fps)
    lab = np.arange(n)
    if n < 2:
        return np.zeros(0, U), np.zeros(0, U)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [n]])
    lo, hi = cuts[:-1], cuts[1:]
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    far = np.zeros(len(lo), bool) if across is None else across[lo] > 0
    stack = [(63, lo[~far], hi[~far], lo[~far], hi[~far], np.zeros(int((~far).sum()), np.int8))]
    if far.any():  # the two halves' tries side by side
        seconds = np.concatenate([[0], np.cumsum(across == 2)])
        middle = hi[far] - (seconds[hi[far]] - seconds[lo[far]])
        stack.append((63, lo[far], middle, middle, hi[far], np.zeros(len(middle), np.int8)))
    while stack:
        bit, l1, h1, l2, h2, d = stack.pop()
        if len(l1) > FRONTIER:
            m = len(l1) // 2
            stack += [(bit, *(x[:m] for x in (l1, h1, l2, h2, d))), (bit, *(x[m:] for x in (l1, h1, l2, h2, d)))]
            continue
        single = (h1 - l1 == 1) & (h2 - l2 == 1)
        if single.any() or bit < 0:
            a, b = l1[single], l2[single]
            near = (a != b) & (lab[a] != lab[b])
            a, b = a[near], b[near]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= budget
            _settle(lab, a[near], b[near])
            rest = ~single
            l1, h1, l2, h2, d = (x[rest] for x in (l1, h1, l2, h2, d))
        if bit < 0 or len(l1) == 0:
            continue
        ones = np.zeros(n + 1, np.int64)
        np.cumsum((fps >> U(bit)) & U(1), out=ones[1:], dtype=np.int64) if len(l1) * 4 > n else None
        if len(l1) * 4 > n:
            m1, m2 = h1 - (ones[h1] - ones[l1]), h2 - (ones[h2] - ones[l2])
        else:
            m1, m2 = _split(fps, l1, h1, bit), _split(fps, l2, h2, bit)
        own = l1 == l2
        two = ~own
        kids = (
            (l1, m1, l2, m2, d),
            (m1, h1, m2, h2, d),
            (l1, m1, m2, h2, d + np.int8(1)),
            tuple(x[two] for x in (m1, h1, l2, m2, d + np.int8(1))),
        )
        out = [np.concatenate(x) for x in zip(*kids)]
        a1, b1, a2, b2, dd = out
        live = (b1 > a1) & (b2 > a2) & (dd <= budget) & ~((a1 == a2) & (b1 - a1 == 1))
        # both nodes are single and already joined: nothing to learn below
        live &= ~((b1 - a1 == 1) & (b2 - a2 == 1) & (lab[np.minimum(a1, n - 1)] == lab[np.minimum(a2, n - 1)]))
        stack.append((bit - 1, *(x[live] for x in out)))
    tied = np.flatnonzero(lab != np.arange(n))
    return fps[tied], fps[lab[tied]]


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First place of each range whose fingerprint has the bit set, by bisection (all above the bit are equal)."""
    a, b = lo.copy(), hi.copy()
    while True:
        open_ = a < b
        if not open_.any():
            return a
        m = (a + b) >> 1
        one = ((fps[np.minimum(m, len(fps) - 1)] >> U(bit)) & U(1)).astype(bool)
        b = np.where(open_ & one, m, b)
        a = np.where(open_ & ~one, m + 1, a)


def _turns(n: int, budget: int) -> list[list[int]]:
    """Orders of the 64 bits, so that any two fingerprints within the budget agree on the first `lead` bits of one order.

    With m blocks and a budget of k bits, m - k blocks agree. More fingerprints take more blocks, so
    that the subtries below the agreed bits stay small.
    """
    m = budget + (1 if n <= 1 << 22 else 2 if n <= 1 << 32 else 3)
    edges = [64 * i // m for i in range(m + 1)]
    parts = [list(range(edges[i], edges[i + 1])) for i in range(m)]
    orders = []
    for same in combinations(range(m), m - budget):
        head = [b for i in same for b in parts[i]]
        orders.append((head, [b for i in range(m) if i not in same for b in parts[i]]))
    return orders


def links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within `budget` bits, directly or over others.

    The trie is laid out once for each order of the bits; only its subtries below the agreed bits are
    self-joined, each within one task. A subtrie with more than SHARE fingerprints is dealt out as
    pairs of shares, each pair joined on its own.
    """
    distinct = kept(fps.select("fp").distinct(), "fps")
    total = distinct.count()
    orders = _turns(total, budget)

    def below(k: int):
        head = orders[k][0]
        out = F.lit(0).cast("bigint")
        for i, b in enumerate(head):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("bigint")), i))
        return out

    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), below(k).alias("head")) for k in range(len(orders))])).alias("t")).select("fp", "t.turn", "t.head")
    sizes = keyed.groupBy("turn", "head").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes.withColumnsRenamed({"turn": "turn_", "head": "head_"}), F.expr("turn = turn_ AND head = head_"))
    shares = F.ceil(F.col("n") / SHARE).cast("int")
    own = F.pmod(F.xxhash64("fp"), shares).cast("int")
    # a share meets itself in the pair of it twice, and each other share in the pair of both
    side = lambda o: F.when(own == o, 0).when(own < o, 1).otherwise(2)
    keyed = keyed.select("fp", "turn", "head", F.explode(F.transform(F.sequence(F.lit(0), shares - 1), lambda o: F.struct(F.least(own, o).alias("p"), F.greatest(own, o).alias("q"), side(o).alias("side")))).alias("s")).select("fp", "turn", "head", "s.p", "s.q", "s.side")
    parts = keyed.repartition("turn", "head", "p", "q").sortWithinPartitions("turn", "head", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def joined(rows: np.ndarray) -> pa.RecordBatch:
            """rows: columns fp, turn, head, p, q, side of whole groups."""
            left, right = [], []
            for turn in np.unique(rows[1]):
                own = rows[:, rows[1] == turn]
                fp = own[0].view(U)
                turned = np.zeros(len(fp), U)
                for i, b in enumerate(reversed([*orders[int(turn)][1], *orders[int(turn)][0]])):
                    turned |= ((fp >> U(b)) & U(1)) << U(63 - i)
                change = np.any(own[2:5, 1:] != own[2:5, :-1], axis=0)
                group = np.concatenate([[0], np.cumsum(change)])
                order = np.lexsort((turned, own[5], group))
                a, b = trie_links(turned[order], group[order], budget, own[5][order])
                back = {0: a, 1: b}
                for side, x in back.items():
                    y = np.zeros(len(x), U)
                    for i, bit in enumerate(reversed([*orders[int(turn)][1], *orders[int(turn)][0]])):
                        y |= ((x >> U(63 - i)) & U(1)) << U(bit)
                    (left if side == 0 else right).append(y.view(np.int64))
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cat(left)), pa.array(cat(right))], ["a", "b"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            size += batch.num_rows
            if size >= 100_000:
                rows = np.concatenate(held, axis=1)
                last = np.flatnonzero(np.any(rows[1:5, 1:] != rows[1:5, :-1], axis=0))
                if len(last):  # the last group may go on in the next batch
                    yield joined(rows[:, : last[-1] + 1])
                    rows = rows[:, last[-1] + 1 :]
                held, size = [rows], rows.shape[1]
        if size:
            yield joined(np.concatenate(held, axis=1))

    return parts.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 3) -> DataFrame:
    """(id, fp, component): the least id that a document reaches over links of at most `budget` differing bits.

    Nulls: a null text has no words, so fingerprint zero, which links like any other. A null id takes
    part with its text and gets its component, but is never the name of one unless all ids of it are null.
    Repeated rows are returned as often as they come. An empty table gives an empty result.
    """
    fps = kept(fingerprints(docs, id_col, text_col, size), "fingerprints")
    by_fp = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(fps, budget))
    named = by_fp.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = kept(named, "named")
    moved = named.groupBy("root").agg(F.min("least").alias("component"))
    table = named.join(moved, "root").select(F.col("fp").alias("fp_"), "component")
    return fps.join(table, F.col("fp") == F.col("fp_")).select("id", "fp", "component")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with a key that names a document: its id (null ids last) and a hash of its text; and the key's name."""
    (key,) = free(docs.columns, "key")
    return docs.withColumn(key, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"))), key


def _one_of_each(docs: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """Of docs with a column `key`, the rows whose key is the component of their class (id, component), one of each; without the key.

    What goes is joined and not what stays: it is the smaller part, and texts need not move where it is small.
    """
    names = [c for c in docs.columns if c != key]
    copies = kept(classes.groupBy("id").agg(F.min("component").alias("component"), F.count("*").alias("n")).where("id <> component OR n > 1"), "copies")
    match = lambda c: (F.col(f"{key}.none") == F.col(f"{c}.none")) & F.col(f"{key}.id").eqNullSafe(F.col(f"{c}.id")) & (F.col(f"{key}.th") == F.col(f"{c}.th"))
    (out,) = free(docs.columns, "out")
    stay = docs.join(copies.select(F.col("id").alias(out)), match(out), "left_anti").select(*plain(docs.select(*names)))
    twice = copies.where("id = component")
    if twice.isEmpty():
        return stay
    again = docs.join(twice.select(F.col("id").alias(out)), match(out), "left_semi").dropDuplicates([key])
    return stay.unionByName(again.select(*plain(stay)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 3) -> DataFrame:
    """One document of each group that near_duplicates() finds, with all its columns: that of the least id, and of equal ids that of the least hash of the text.

    Null ids come last; of repeated rows one stays.
    """
    own, key = _keyed(docs, id_col, text_col)
    found = near_duplicates(own.select(F.col(key).alias("k"), F.col(text_col).alias("t")), "k", "t", size, budget)
    return _one_of_each(own, key, found.select("id", "component"))


def fingerprint_links(join: Join, docs: DataFrame, id_col: str, text_col: str, size: int = 3, budget: int = 5) -> DataFrame:
    """Links (a, b) of a set join's nodes: those that the binary trie finds within `budget` bits of each other, and whose sets the join's exact check finds similar."""
    of = fingerprints(docs, id_col, text_col, size)
    fps = kept(join.reps.select("node", "id").join(of, "id").groupBy("node").agg(F.min("fp").alias("fp")), "fingerprints")
    heads = kept(fps.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = fps.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    x, y = heads.select(F.col("fp").alias("x"), F.col("head").alias("a")), heads.select(F.col("fp").alias("y"), F.col("head").alias("b"))
    near = links(fps, budget).select(F.col("a").alias("p"), F.col("b").alias("q"))
    near = near.join(x, F.col("p") == F.col("x")).join(y, F.col("q") == F.col("y")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return kept(join.similar(same.union(near).distinct()), "known")


def similar_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """As deduplicated(), but documents are linked where the Jaccard similarity of their sets of `size`-word shingles is `least` or more; equal sets, empty ones too, are one.

    Links come from the fingerprints' trie first, each checked exactly. Sets of that similarity may differ in more bits than a trie can
    be asked for, and a trie's links are no more than connect its fingerprints, so the exact set join adds those that are missing.
    """
    own, key = _keyed(docs, id_col, text_col)
    texts = own.select(F.col(key).alias("k"), F.col(text_col).alias("t"))
    found = Join(texts, least, size, "k", "t")
    known = fingerprint_links(found, texts, "k", "t")
    return _one_of_each(own, key, found.classes(known).select("id", "component"))
