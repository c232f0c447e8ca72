"""k nearest neighbours: exact in query blocks, and by an index of layered proximity graphs, one for each shard of the points."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.kept import kept

#: Query vectors that go to the tasks at once.
BLOCK = 8192
#: Open nodes of a walk whose neighbours are measured together.
AHEAD = 4
#: Points of a shard, on average: its graph lies in one task's memory.
SHARD = 20_000

Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _jaccard(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 - Jaccard similarity of rows of integers taken as sets."""

    def firsts(a: np.ndarray) -> np.ndarray:
        """Which values are not there further left."""
        order = np.argsort(a, axis=1, kind="stable")
        s = np.take_along_axis(a, order, 1)
        new = np.ones(a.shape, bool)
        new[:, 1:] = s[:, 1:] != s[:, :-1]
        out = np.empty(a.shape, bool)
        np.put_along_axis(out, order, new, 1)
        return out

    a, b = firsts(q), firsts(x)
    out = np.empty((len(q), len(x)))
    rows = max(1, (1 << 22) // max(x.size * q.shape[1], 1))
    for at in range(0, len(q), rows):
        same = (q[at : at + rows, None, :, None] == x[None, :, None, :]).any(-1) & a[at : at + rows, None, :]
        both = same.sum(-1)
        out[at : at + rows] = 1.0 - both / np.maximum(a[at : at + rows].sum(1)[:, None] + b.sum(1)[None, :] - both, 1)
    return out


def _l2(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(q), len(x)))
    rows = max(1, (1 << 22) // max(x.size, 1))
    for at in range(0, len(q), rows):
        out[at : at + rows] = np.sqrt(((q[at : at + rows, None, :] - x[None, :, :]) ** 2).sum(-1))
    return out


def _minhash(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Share of the places at which rows differ."""
    if len(q) == 1:
        return 1.0 - np.bitwise_count(np.packbits(x == q, axis=-1)).sum(-1, dtype=np.int64)[None, :] / max(x.shape[1], 1)
    out = np.empty((len(q), len(x)))
    rows = max(1, (1 << 22) // max(x.size, 1))
    for at in range(0, len(q), rows):
        same = np.packbits(q[at : at + rows, None, :] == x[None, :, :], axis=-1)
        out[at : at + rows] = np.bitwise_count(same).sum(-1, dtype=np.int64)
    return 1.0 - out / max(x.shape[1], 1)


METRICS: dict[str, Metric] = {
    "l2": _l2,
    "cosine": lambda q, x: 1.0 - (q @ x.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :], 1e-300),
    "minhash": _minhash,
    "jaccard": _jaccard,
}


def measure(metric: str | Metric) -> Metric:
    """A metric by name, or a function of two matrices that gives all distances of their rows."""
    return METRICS[metric] if isinstance(metric, str) else metric


def top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, ties by key."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _within(q: np.ndarray, x: np.ndarray, bound: np.ndarray, metric: str | Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, distance) of the pairs that are no farther apart than the query's bound."""
    if metric != "l2":
        d = measure(metric)(q, x)
        r, c = np.nonzero(d <= bound[:, None])
        return r, c, d[r, c]
    # what is surely farther need not be measured exactly
    norm, most = (q**2).sum(1)[:, None], bound[:, None] ** 2
    rough = norm + (x**2).sum(1)[None, :] - 2 * (q @ x.T)
    r, c = np.nonzero(rough <= most + 1e-9 * (1 + norm + most))
    d = np.empty(len(r))
    for at in range(0, len(r), 1 << 16):
        to = slice(at, at + (1 << 16))
        d[to] = np.sqrt(((q[r[to]] - x[c[to]]) ** 2).sum(1))
    near = d <= bound[r]
    return r[near], c[near], d[near]


FOUND = "query_id bigint, key bigint, distance double"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "key", "distance"])


def _in_blocks(queries: DataFrame, k: int, search: Callable) -> DataFrame:
    """The top k of what `search` (a broadcast of ids and vectors) finds for blocks of BLOCK queries. With several blocks each one's answers are written, and its vectors given up, before the next."""
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // BLOCK))
    out = None
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).select("key", "vector").collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r.key for r in rows], np.int64), np.array([r.vector for r in rows], np.float64)))
        part = top(search(shared), k)
        if blocks > 1:
            part = kept(part, "nearest")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], FOUND + ", rank int")


def exact(points: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2") -> DataFrame:
    """(query_id, key, distance, rank) of points and queries (key, vector): each task keeps its k best for each query."""
    far = measure(metric)

    def search(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            best_d, best_k = np.full((len(qid), 0), 0.0), np.zeros((len(qid), 0), np.int64)
            rows = max(32, (1 << 21) // max(len(qid), 1))
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    key = part.column(0).to_numpy()
                    if metric == "l2" and best_k.shape[1] == k:
                        r, c, d = _within(q, x, best_d[:, -1], metric)
                        if not len(r):
                            continue
                        order = np.lexsort((key[c], d, r))
                        r, c, d = r[order], c[order], d[order]
                        place = np.arange(len(r)) - np.searchsorted(r, r)
                        near = place < k
                        r, c, d, place = r[near], c[near], d[near], place[near]
                        width = int(place.max()) + 1
                        more_d, more_k = np.full((len(qid), width), np.inf), np.full((len(qid), width), np.iinfo(np.int64).max)
                        more_d[r, place], more_k[r, place] = d, key[c]
                    else:
                        more_d, more_k = far(q, x), np.broadcast_to(key, (len(qid), part.num_rows))
                    d, keys = np.concatenate([best_d, more_d], axis=1), np.concatenate([best_k, more_k], axis=1)
                    order = np.lexsort((keys, d))[:, :k]
                    best_d, best_k = np.take_along_axis(d, order, 1), np.take_along_axis(keys, order, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, best_k.shape[1])), pa.array(best_k.ravel()), pa.array(best_d.ravel())], ["query_id", "key", "distance"])

        return points.select("key", "vector").mapInArrow(run, FOUND)

    return _in_blocks(queries, k, search)


@dataclass(frozen=True)
class HnswSpec:
    m: int = 16
    ef_construction: int = 100
    ef: int = 100
    metric: str | Metric = "l2"
    seed: int = 1


class Graph:
    """A layered proximity graph over the points of one shard, with the edges of each layer in both directions."""

    def __init__(self, spec: HnswSpec, dim: int = 0):
        self.spec = spec
        self.keys: list[int] = []
        self.place: dict[int, int] = {}
        self.points = np.zeros((0, dim))
        self.out: list[dict[int, list[int]]] = []
        self._back: list[dict[int, set[int]]] | None = []
        self.deleted: set[int] = set()
        self.entry = -1
        self.draw = np.random.RandomState(spec.seed)

    def __len__(self) -> int:
        return len(self.place) - len(self.deleted)

    def __getstate__(self) -> dict:
        """Without the edges back, which searches do not need, and without room for more points."""
        return self.__dict__ | {"_back": None, "points": self.points[: len(self.keys)]}

    @property
    def back(self) -> list[dict[int, set[int]]]:
        """Of each layer, the nodes that point at a node."""
        if self._back is None:
            self._back = [{n: set() for n in layer} for layer in self.out]
            for layer, back in zip(self.out, self._back):
                for n, to in layer.items():
                    for x in to:
                        back[x].add(n)
        return self._back

    def _far(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return measure(self.spec.metric)(q[None, :], self.points[nodes])[0]

    def _search(self, q: np.ndarray, starts: list[int], ef: int, h: int, without: int = -1) -> list[tuple[float, int]]:
        """The ef nearest nodes of a layer that are not deleted; deleted ones are walked over. The neighbours of the AHEAD nearest open nodes are measured at once."""
        layer = self.out[h]
        seen = set(starts)
        near = list(zip(self._far(q, starts).tolist(), starts))
        open_ = near[:]
        heapq.heapify(open_)
        best = [(-d, n) for d, n in near if n not in self.deleted and n != without]
        heapq.heapify(best)
        ahead = min(ef, AHEAD)
        while open_:
            new: list[int] = []
            for _ in range(min(ahead, len(open_))):
                if len(best) >= ef and open_[0][0] > -best[0][0]:
                    open_.clear()
                    break
                more = [x for x in layer[heapq.heappop(open_)[1]] if x not in seen]
                seen.update(more)
                new += more
            if not new:
                continue
            for dx, x in zip(self._far(q, new).tolist(), new):
                if len(best) < ef or dx < -best[0][0]:
                    heapq.heappush(open_, (dx, x))
                    if x not in self.deleted and x != without:
                        heapq.heappush(best, (-dx, x))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def _top(self) -> int:
        """The highest layer of the entry point."""
        return max(h for h in range(len(self.out)) if self.entry in self.out[h])

    def _down(self, q: np.ndarray, to: int) -> list[int]:
        """Where a search of layer `to` starts."""
        starts = [self.entry]
        for h in range(self._top(), to, -1):
            found = self._search(q, starts, 1, h)
            starts = [found[0][1]] if found else starts
        return starts

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that lie nearer to the point than to each other, filled up with the nearest others."""
        if len(found) <= most:
            return [n for _, n in found]
        nodes = [n for _, n in found]
        d = np.array([d for d, _ in found])
        x = self.points[nodes]
        near = np.ones(len(nodes), bool)
        kept_: list[int] = []
        at = 0
        while at < len(nodes) and len(kept_) < most:
            kept_.append(at)
            near &= measure(self.spec.metric)(x[at : at + 1], x)[0] >= d
            ahead = np.flatnonzero(near[at + 1 :])
            at = at + 1 + int(ahead[0]) if len(ahead) else len(nodes)
        chosen = set(kept_)
        rest = [i for i in range(len(nodes)) if i not in chosen][: most - len(kept_)]
        return [nodes[i] for i in kept_ + rest]

    def _tie(self, h: int, n: int, to: list[int]) -> None:
        for x in self.out[h].get(n, ()):
            self.back[h][x].discard(n)
        self.out[h][n] = to
        for x in to:
            self.back[h][x].add(n)

    def _link(self, i: int, h: int, starts: list[int]) -> list[int]:
        """Give a node of a layer its neighbours, and them the node; where the next layer's search starts."""
        most = self.spec.m * (2 if h == 0 else 1)
        found = self._search(self.points[i], starts, self.spec.ef_construction, h, without=i)
        self._tie(h, i, self._spread(found, most))
        for n in self.out[h][i]:
            if i not in self.out[h][n]:
                to = [*self.out[h][n], i]
                if len(to) > most + most // 2:  # some more than it may have, so that choosing anew is not needed each time
                    self._tie(h, n, self._spread(sorted(zip(self._far(self.points[n], to).tolist(), to)), most))
                else:
                    self.out[h][n] = to
                    self.back[h][i].add(n)
        return [n for _, n in found] or starts

    def insert(self, key: int, point: np.ndarray) -> None:
        """A new point, or a new place for a key; a deleted key is live again."""
        if key in self.place:
            i = self.place[key]
            self.points[i] = point
            self.deleted.discard(i)
            if self.entry < 0:
                self.entry = i
            for h in range(len(self.out)):
                if i in self.out[h]:
                    around = sorted(self.back[h][i])
                    self._link(i, h, self._down(point, h) if h <= self._top() else [i])
                    for n in around:
                        self._repair(n, h)
            return
        i = len(self.keys)
        self.keys.append(key)
        self.place[key] = i
        if i >= len(self.points):
            grown = np.zeros((max(64, 2 * i), len(point)))
            if i:
                grown[: len(self.points)] = self.points
            self.points = grown
        self.points[i] = point
        level = int(-math.log(1.0 - self.draw.random_sample()) / math.log(self.spec.m))
        for h in range(level + 1):
            if h >= len(self.out):
                self.out.append({})
                self.back.append({})
            self.out[h][i], self.back[h][i] = [], set()
        if self.entry < 0:
            self.entry = i
            return
        most = self._top()
        starts = self._down(point, min(level, most))
        for h in range(min(level, most), -1, -1):
            starts = self._link(i, h, starts)
        if level > most:
            self.entry = i

    def _repair(self, n: int, h: int) -> None:
        """New neighbours for a node that has lost one."""
        starts = [x for x in self.out[h][n] if x not in self.deleted] or ([self.entry] if self.entry in self.out[h] else [n])
        most = self.spec.m * (2 if h == 0 else 1)
        found = self._search(self.points[n], [*dict.fromkeys([*starts, *([self.entry] if self.entry in self.out[h] else [])])], self.spec.ef_construction, h, without=n)
        self._tie(h, n, self._spread(found, most))

    def remove(self, key: int, hard: bool = False) -> None:
        """Soft: the point is walked over but no longer found or linked to. Hard: it goes, and those that pointed at it get new neighbours. An unknown key is an error."""
        if key not in self.place:
            raise KeyError(key)
        i = self.place[key]
        self.deleted.add(i)
        if not len(self):
            self.__init__(self.spec, self.points.shape[1])
            return
        if self.entry == i:
            self.entry = next(n for layer in reversed(self.out) for n in layer if n not in self.deleted)
        if not hard:
            return
        for h in range(len(self.out)):
            if i not in self.out[h]:
                break
            around = sorted(self.back[h][i])
            for n in around:
                self.out[h][n].remove(i)
            self._tie(h, i, [])
            del self.out[h][i], self.back[h][i]
            for n in around:
                self._repair(n, h)
        while self.out and not self.out[-1]:
            self.out.pop()
            self.back.pop()
        del self.place[key]
        self.deleted.discard(i)

    def clean(self) -> None:
        """Remove all soft removed points for good."""
        for i in sorted(self.deleted):
            if i in self.deleted:
                self.remove(self.keys[i], hard=True)

    def _nearest(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        return self._search(q, self._down(q, 0), max(ef, k), 0)[:k] if self.entry >= 0 else []

    def query(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        """(distance, key) of the nearest points."""
        return [(d, self.keys[n]) for d, n in self._nearest(q, k, ef)]

    def checked(self, qs: np.ndarray, k: int, ef: int) -> list[list[tuple[float, int]]]:
        """query() of each row, with what the walk has missed: of the points that are not deleted, those no farther than the k-th found. Ties by key."""
        found = [self._nearest(q, k, ef) for q in qs]
        live = np.array([i for i in self.place.values() if i not in self.deleted], np.int64)
        bound = np.array([f[-1][0] if len(f) == k else np.inf for f in found])
        out = [[(d, self.keys[n]) for d, n in f] for f in found]
        have = np.array(sorted(r * len(self.keys) + n for r, f in enumerate(found) for _, n in f), np.int64)
        rows = max(32, (1 << 21) // max(len(qs), 1))
        for at in range(0, len(live), rows):
            part = live[at : at + rows]
            r, c, d = _within(qs, self.points[part], bound, self.spec.metric)
            new = ~np.isin(r * len(self.keys) + part[c], have)
            for i, n, far in zip(r[new].tolist(), part[c[new]].tolist(), d[new].tolist()):
                out[i].append((far, self.keys[n]))
        return [sorted(f)[:k] for f in out]


INDEX = "shard int, points bigint, graph binary"


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def changes(points: DataFrame, op: str = "insert", seq: int = 0) -> DataFrame:
    """Rows (key, vector, op, seq) for applied(): op is insert (also an update), remove (soft), remove_hard or clean (of the key's shard). For removals a key is enough."""
    vector = F.col("vector").cast("array<double>") if "vector" in points.columns else F.lit(None).cast("array<double>")
    return points.select(F.col("key").cast("bigint").alias("key"), vector.alias("vector"), F.lit(op).alias("op"), F.lit(seq).cast("bigint").alias("seq"))


def applied(index: DataFrame, log: DataFrame, spec: HnswSpec, shards: int) -> DataFrame:
    """The index after a log of changes, each shard's in order of seq and key, in the task that holds its graph. Removing an unknown key is an error."""

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        graph = cloudpickle.loads(old.column("graph")[0].as_py()) if old.num_rows else Graph(spec)
        new = new.sort_by([("seq", "ascending"), ("key", "ascending")]).combine_chunks()
        vectors = new.column("vector").combine_chunks()
        at, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
        for i, (key, op) in enumerate(zip(new.column("key").to_pylist(), new.column("op").to_pylist())):
            if op == "insert":
                graph.insert(key, values[at[i] : at[i + 1]])
            elif op == "clean":
                graph.clean()
            elif op in ("remove", "remove_hard"):
                graph.remove(key, hard=op == "remove_hard")
            else:
                raise ValueError(f"unknown change {op}")
        shard = (old if old.num_rows else new).column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard], pa.int32()), "points": pa.array([len(graph)], pa.int64()), "graph": pa.array([cloudpickle.dumps(graph)], pa.binary())})

    dealt = log.where("key IS NOT NULL").withColumn("shard", _shard(shards))
    return index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(run, INDEX)


def built(points: DataFrame, spec: HnswSpec, shards: int | None = None) -> tuple[DataFrame, int]:
    """An index (shard, points, graph) of points (key, vector), and its number of shards, which grows with the points: SHARD of them each on average.

    It is a table as any other: write it, read it, change it by applied() and ask it by searched().
    """
    if shards is None:
        shards = max(8, -(-points.count() // SHARD))
    return applied(points.sparkSession.createDataFrame([], INDEX), changes(points), spec, shards), shards


def searched(index: DataFrame, queries: DataFrame, k: int, spec: HnswSpec, check: bool = False) -> DataFrame:
    """(query_id, key, distance, rank) of queries (key, vector): every shard's graph answers every block of queries, and the answers are merged.

    check: each graph's answers are then checked against all points that it holds, within the distance of the
    k-th answer, and what the walk has missed is added, so that the result is exact.
    """

    def search(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column(0):
                    graph = cloudpickle.loads(raw.as_buffer())
                    ids, qs = shared.value
                    found = graph.checked(qs, k, spec.ef) if check else (graph.query(q, k, spec.ef) for q in qs)
                    yield _found([(int(i), key, d) for i, near in zip(ids, found) for d, key in near])

        return index.select("graph").mapInArrow(run, FOUND)

    return _in_blocks(queries, k, search)


def hnsw(points: DataFrame, queries: DataFrame, k: int, spec: HnswSpec, shards: int | None = None) -> DataFrame:
    """Build an index, keep it and ask it."""
    return searched(kept(built(points, spec, shards)[0], "graphs"), queries, k, spec)
