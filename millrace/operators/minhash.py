"""MinHash, lean, b-bit and weighted MinHash: signatures as arrays of bigint."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import HASHES, MASK32, NP_HASHES, permutations, permuted


@dataclass(frozen=True)
class MinHashSpec:
    num_perm: int = 128
    seed: int = 1

    def __post_init__(self):
        if not 0 < self.num_perm <= 1 << 32:
            raise ValueError("num_perm must be 1 to 2^32")


def token_sets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): the distinct lower-cased words between white space. A null text has no tokens."""
    return docs.select(key, F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")).alias("tokens"))


def shingle_sets(docs: DataFrame, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): the distinct shingles of `size` words; a shorter text has itself."""
    split = docs.select(key, F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "").alias("__w"))
    last = F.greatest(F.size("__w") - size + 1, F.lit(1))
    shingles = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat_ws(" ", F.slice("__w", i, size)))
    return split.select(key, F.array_distinct(F.filter(shingles, lambda s: s != "")).alias("tokens"))


def signatures(sets: DataFrame, spec: MinHashSpec, key: str = "doc_id", hash_func: str | Callable[[list[str]], np.ndarray] = "sha1_32", drawn: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(key, tokens dropped, sig). Arrow batches: each distinct token of a batch is hashed once. An empty or null set is all 2^32 - 1.

    hash_func: a name of NP_HASHES, or a function from strings to numbers below 2^32. drawn: multipliers and offsets to use instead of the seed's.
    """
    a, b = drawn if drawn is not None else permutations(spec.num_perm, spec.seed)
    if len(a) != spec.num_perm or len(b) != spec.num_perm:
        raise ValueError("num_perm permutations are needed")
    hashed = NP_HASHES[hash_func] if isinstance(hash_func, str) else hash_func

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                words = lists.flatten().dictionary_encode()
                sig = np.full((part.num_rows, spec.num_perm), MASK32, np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    h = np.asarray(hashed(words.dictionary.to_pylist()), np.uint64)[words.indices.to_numpy(zero_copy_only=False)]
                    start = (np.cumsum(n) - n)[some]
                    for i in range(spec.num_perm):
                        v = ((a[i] * h + b[i]) % np.uint64((1 << 61) - 1)) & np.uint64(MASK32)
                        sig[some, i] = np.minimum.reduceat(v, start)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), spec.num_perm).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], [key, "sig"])

    kind = sets.schema[key].dataType
    name = hash_func if isinstance(hash_func, str) else getattr(hash_func, "__qualname__", "function")
    meta = {"kind": "minhash", "seed": spec.seed, "num_perm": spec.num_perm, "hash": name}
    out = sets.select(key, "tokens").mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("sig", T.ArrayType(T.LongType()))]))
    return out.withMetadata("sig", meta)


def signatures_native(sets: DataFrame, spec: MinHashSpec, key: str = "doc_id", hash_name: str = "sha1_32") -> DataFrame:
    """The same signatures by column expressions only: one aggregate with a partial step. Any hash of HASHES."""
    a, b = permutations(spec.num_perm, spec.seed)
    h = sets.select(key, F.explode_outer("tokens").alias("t")).select(key, HASHES[hash_name](F.col("t")).alias("h"))
    mins = [F.coalesce(F.min(permuted(F.col("h"), int(x), int(y))), F.lit(MASK32)).cast("bigint") for x, y in zip(a, b)]
    return h.groupBy(key).agg(F.array(*mins).alias("sig"))


def jaccard(x: str | Column, y: str | Column, n: int) -> Column:
    """Share of equal places."""
    same = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return same / F.lit(float(n))


def cardinality(sig: str | Column, n: int) -> Column:
    return F.lit(float(n)) / F.aggregate(sig, F.lit(0.0), lambda s, v: s + v / F.lit(float(MASK32))) - 1.0


def union(sig: str, n: int) -> Column:
    """Aggregate: the signature of the union of a group's sets (a minimum for each place, with a partial step)."""
    return F.array(*[F.min(F.col(sig)[i]) for i in range(n)])


def padded(sigs: DataFrame, size: str, spec: MinHashSpec, most: int | None = None, key: str = "doc_id") -> DataFrame:
    """(key, size, sig): each signature merged with that of most - size padding tokens, so that all sets are as large as the largest; plain LSH then searches by containment.

    The padding tokens are drawn once for all sets, so a signature of the first n of them is a running minimum over their hash values.
    """
    most = most if most is not None else sigs.agg(F.max(size)).first()[0] or 0
    a, b = permutations(spec.num_perm, spec.seed)
    pads = sigs.sparkSession.range(most).select((F.col("id") + 1).alias("__n"), F.concat(F.col("id").cast("string"), F.lit("_padding")).alias("t"))
    h = pads.select("__n", HASHES["sha1_32"](F.col("t")).alias("h"))
    least = h.select("__n", F.array(*[permuted(F.col("h"), int(x), int(y)) for x, y in zip(a, b)]).alias("p"))
    upto = W.orderBy("__n").rowsBetween(W.unboundedPreceding, 0)
    pad = least.select("__n", F.array(*[F.min(F.col("p")[i]).over(upto) for i in range(spec.num_perm)]).alias("pad"))
    met = sigs.join(pad, F.lit(most) - F.col(size) == F.col("__n"), "left")
    return met.select(key, size, F.when(F.col("pad").isNull(), F.col("sig")).otherwise(merged("sig", "pad")).alias("sig"))


def merged(x: str | Column, y: str | Column) -> Column:
    return F.zip_with(x, y, lambda p, q: F.least(p, q))


def is_empty(sig: str | Column) -> Column:
    return F.forall(sig, lambda v: v == MASK32)


def given(df: DataFrame, spec: MinHashSpec, key: str = "doc_id", sig: str = "sig", hash_name: str = "sha1_32") -> DataFrame:
    """(key, sig) from hash values that are there already; a value of another length or beyond 2^32 - 1 is an error when it is read."""
    good = (F.size(sig) == spec.num_perm) & F.forall(sig, lambda v: v.between(0, MASK32))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col(sig)).otherwise(F.raise_error(F.lit(f"not a signature of {spec.num_perm} values")).cast("array<bigint>"))
    return df.select(key, checked.cast("array<bigint>").alias("sig")).withMetadata("sig", {"kind": "minhash", "seed": spec.seed, "num_perm": spec.num_perm, "hash": hash_name})


def equal(x: DataFrame, y: DataFrame, key: str = "doc_id", column: str = "sig") -> DataFrame:
    """(key, equal) of the keys in both: the same values, and of the same seed and number of permutations; sketches of another seed are never equal."""
    mine, other = ((t.schema[column].metadata or {}) for t in (x, y))
    alike = all(mine.get(k) == other.get(k) for k in ("seed", "num_perm", "b", "r"))
    met = x.select(key, F.col(column).alias("__x")).join(y.select(key, F.col(column).alias("__y")), key)
    return met.select(key, (F.col("__x").eqNullSafe(F.col("__y")) & F.lit(alike)).alias("equal"))


def hash_of(sig: str | Column, seed: int) -> Column:
    """A 64-bit hash of a signature and its seed: equal sketches have equal hashes."""
    return F.xxhash64(F.lit(seed), sig)


def lean_bytes(n: int) -> int:
    """Bytes of a serialised lean signature: seed, count, four bytes a value."""
    return 8 + 4 + 4 * n


def lean_pack(seed: int, sig: list[int], order: str = "<") -> bytes:
    return struct.pack(f"{order}qi{len(sig)}I", seed, len(sig), *sig)


def lean_unpack(raw: bytes, order: str = "<") -> tuple[int, list[int]]:
    seed, n = struct.unpack_from(f"{order}qi", raw)
    return seed, list(struct.unpack_from(f"{order}{n}I", raw, struct.calcsize(f"{order}qi")))


def lean_hex(sig: str | Column, seed: int, n: int) -> Column:
    """The big-endian serialised form in hex, as a column expression."""
    return F.concat(F.lit(f"{seed:016X}{n:08X}"), F.concat_ws("", F.transform(sig, lambda v: F.lpad(F.hex(v), 8, "0"))))


def _hex_number(h: Column, at: Column | int, n: int, order: str) -> Column:
    """The unsigned number in n bytes of a hex string from byte `at` (0-based) on, as a decimal string."""
    digits = F.substr(h, F.lit(2) * at + 1, F.lit(2 * n))
    if order == "<":
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.conv(digits, 16, 10)


def lean_read(raw: str | Column, order: str = ">") -> Column:
    """struct(seed, sig) of a serialised lean signature in a binary column; order is > or < (no padding in either). Other lengths than the header says are null."""
    if order not in "<>":
        raise ValueError("order must be < or >")
    h = F.hex(raw)
    n = _hex_number(h, 8, 4, order).cast("int")
    seed = F.conv(_hex_number(h, 0, 8, order), 10, -10).cast("bigint")
    sig = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _hex_number(h, F.lit(12) + i * 4, 4, order).cast("bigint"))
    return F.when(F.length(raw) == 12 + 4 * n, F.struct(seed.alias("seed"), sig.alias("sig")))


def lean_write(sig: str | Column, seed: int, n: int, order: str = ">") -> Column:
    """The serialised form as a binary column."""
    if order == ">":
        return F.unhex(lean_hex(sig, seed, n))
    turned = lambda v: F.concat(*[F.substring(F.lpad(F.hex(v), 8, "0"), 2 * i + 1, 2) for i in (3, 2, 1, 0)])
    head = struct.pack("<qi", seed, n).hex().upper()
    return F.unhex(F.concat(F.lit(head), F.concat_ws("", F.transform(sig, turned))))


@dataclass(frozen=True)
class BBitSpec:
    b: int = 1
    r: float = 0.0

    def __post_init__(self):
        if not 0 <= self.b <= 32 or not 0.0 <= self.r <= 1.0:
            raise ValueError("b must be 0 to 32 and r 0 to 1")
        if self.b == 0 and self.r == 0.0:
            raise ValueError("b = 0 with r = 0 divides by zero")

    def base(self) -> float:
        """Expected share of equal b-bit values of unequal signatures. With r above 0 the exponent 2 b is kept as it is known for this estimator."""
        if self.r == 0.0:
            return 1.0 / (1 << self.b)
        return self.r * (1 - self.r) ** (2**self.b - 1) / (1 - (1 - self.r) ** (2 * self.b))

    def slot(self) -> int:
        return next(s for s in (1, 2, 4, 8, 16, 32) if s >= self.b)

    def bytes(self, n: int) -> int:
        """Header of 21 bytes and whole blocks of 64 bits."""
        return 21 + 8 * -(-n // (64 // self.slot()))


def b_bit(sig: str | Column, spec: BBitSpec) -> Column:
    return F.transform(sig, lambda v: v.bitwiseAND((1 << spec.b) - 1))


def b_bit_signatures(sigs: DataFrame, spec: BBitSpec, key: str = "doc_id") -> DataFrame:
    """(key, sig) of the lowest b bits; their b, r and seed go along as metadata, which equal() compares."""
    meta = {**(sigs.schema["sig"].metadata or {}), "kind": "b-bit", "b": spec.b, "r": spec.r}
    return sigs.select(key, b_bit("sig", spec).alias("sig")).withMetadata("sig", meta)


def b_bit_packed(sig: str | Column, n: int, seed: int, spec: BBitSpec) -> Column:
    """The serialised form (see b_bit_pack) as a binary column: blocks of 64 bits, little-endian, the first value in the highest bits."""
    per, slot = 64 // spec.slot(), spec.slot()
    head = struct.pack("<qBdi", seed, spec.b, spec.r, n).hex().upper()

    def block(k: Column) -> Column:
        bits = F.concat_ws("", F.transform(F.slice(sig, k * per + 1, per), lambda v: F.lpad(F.bin(v), slot, "0")))
        digits = F.lpad(F.conv(F.rpad(bits, 64, "0"), 2, 16), 16, "0")
        return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8))])

    return F.unhex(F.concat(F.lit(head), F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(-(-n // per) - 1)), block))))


def b_bit_jaccard(x: str | Column, y: str | Column, n: int, spec: BBitSpec, other: BBitSpec | None = None) -> Column:
    """The estimate; sketches of different b or r cannot be compared."""
    if other is not None and other != spec:
        raise ValueError("sketches of different b or r cannot be compared")
    c = spec.base()
    return (jaccard(x, y, n) - c) / F.lit(1.0 - c)


def b_bit_pack(values: list[int], seed: int, spec: BBitSpec) -> bytes:
    per = 64 // spec.slot()
    blocks = []
    for i in range(0, len(values), per):
        block = 0
        for j, v in enumerate(values[i : i + per]):
            block |= v << (64 - spec.slot() * (j + 1))
        blocks.append(block)
    return struct.pack("<qBdi", seed, spec.b, spec.r, len(values)) + struct.pack(f"<{len(blocks)}Q", *blocks)


def b_bit_unpack(raw: bytes) -> tuple[int, BBitSpec, list[int]]:
    seed, b, r, n = struct.unpack_from("<qBdi", raw)
    spec = BBitSpec(b, r)
    per = 64 // spec.slot()
    blocks = struct.unpack_from(f"<{-(-n // per)}Q", raw, 21)
    return seed, spec, [blocks[i // per] >> (64 - spec.slot() * (i % per + 1)) & ((1 << spec.slot()) - 1) for i in range(n)]


@dataclass(frozen=True)
class WeightedSpec:
    dim: int
    samples: int = 128
    seed: int = 1

    def draws(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = np.random.RandomState(self.seed)
        shape = (self.samples, self.dim)
        rs = g.gamma(2, 1, shape).astype(np.float32)
        ln_cs = np.log(g.gamma(2, 1, shape)).astype(np.float32)
        return rs, ln_cs, g.uniform(0, 1, shape).astype(np.float32)


def weighted_signatures(vectors: DataFrame, spec: WeightedSpec, key: str, vector: str, many: bool = False) -> DataFrame:
    """(key, wsig): consistent weighted samples, arrays of (k, t). A null or all-zero vector has none (null); a wrong length is an error.

    many: the formula that is in use for whole matrices, ln_y = (t - beta + 1) r without the last r; its samples differ from the others.
    The rows of a batch are sampled together, a few at a time.
    """
    drawn = vectors.sparkSession.sparkContext.broadcast(spec.draws())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rs, ln_cs, betas = drawn.value
        kind = pa.list_(pa.struct([("k", pa.int64()), ("t", pa.int64())]))
        rows = max(1, (4 << 20) // (spec.samples * spec.dim))
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            column = batch.column(1)
            n = column.value_lengths().fill_null(spec.dim).to_numpy(zero_copy_only=False)
            if (n != spec.dim).any():
                raise ValueError(f"a vector has {n[n != spec.dim][0]} of {spec.dim} dimensions")
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            v = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, spec.dim).astype(np.float32)
            some = (v != 0).any(axis=1)
            v, there = v[some], there[some]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.floor(np.log(v)[:, None, :] / rs + betas)
                ln_a = ln_cs - (t - betas + 1) * rs if many else ln_cs - (t - betas) * rs - rs
            ln_a[np.broadcast_to((v == 0)[:, None, :], ln_a.shape)] = np.inf
            k = np.argmin(ln_a, axis=2)
            picked = np.take_along_axis(t, k[:, :, None], 2)[:, :, 0].astype(np.int64)
            full = np.zeros(batch.num_rows, bool)
            full[there] = True
            flat = pa.StructArray.from_arrays([pa.array(k.astype(np.int64).ravel()), pa.array(picked.ravel())], ["k", "t"])
            ends = np.concatenate([[0], np.cumsum(full * spec.samples)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~full, False)), flat).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "wsig"])

    kind = vectors.schema[key].dataType.simpleString()
    out = vectors.select(key, vector).mapInArrow(run, f"{key} {kind}, wsig array<struct<k:bigint,t:bigint>>")
    return out.withMetadata("wsig", {"kind": "weighted", "seed": spec.seed, "num_perm": spec.samples})


def weighted_exact(x: str | Column, y: str | Column) -> Column:
    """Sum of minima over sum of maxima of two dense vectors."""
    total = lambda f: F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda s, v: s + v)
    return total(lambda p, q: F.least(p, q).cast("double")) / total(lambda p, q: F.greatest(p, q).cast("double"))
