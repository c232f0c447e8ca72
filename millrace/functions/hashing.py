"""Hash functions and permutations, as column expressions and as their NumPy twins."""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME, MASK32 = (1 << 61) - 1, (1 << 32) - 1


def _little_endian(text: Column, n: int) -> Column:
    digest = F.sha1(F.encode(text, "UTF-8"))
    return F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in reversed(range(n))])


def sha1_32(text: Column) -> Column:
    """The first four bytes of the SHA-1 digest, little-endian, as a bigint."""
    return F.conv(_little_endian(text, 4), 16, 10).cast("bigint")


def sha1_64(text: Column) -> Column:
    """The first eight bytes, little-endian; the bit pattern of an unsigned number in a bigint."""
    return F.conv(_little_endian(text, 8), 16, -10).cast("bigint")


HASHES = {
    "sha1_32": sha1_32,
    "xxhash32": lambda c: F.xxhash64(c).bitwiseAND(MASK32),
    "murmur3": lambda c: F.hash(c).cast("bigint").bitwiseAND(MASK32),
    "crc32": lambda c: F.crc32(F.encode(c, "UTF-8")),
    "identity": lambda c: c.cast("bigint").bitwiseAND(MASK32),
}


def np_sha1_32(tokens: list[str]) -> np.ndarray:
    raw = b"".join(hashlib.sha1(t.encode()).digest()[:4] for t in tokens)
    return np.frombuffer(raw, "<u4").astype(np.uint64)


def np_crc32(tokens: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(t.encode()) for t in tokens], np.uint64)


#: Hashes of tokens for the Arrow form of signatures; any function of a list of strings to unsigned numbers below 2^32 will do as well.
NP_HASHES = {"sha1_32": np_sha1_32, "crc32": np_crc32, "identity": lambda tokens: np.array([int(t) & MASK32 for t in tokens], np.uint64)}


@lru_cache(maxsize=32)
def permutations(num_perm: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets: drawn in turn, permutation by permutation, from the Mersenne twister."""
    r = np.random.RandomState(seed)
    pairs = [(r.randint(1, PRIME, dtype=np.uint64), r.randint(0, PRIME, dtype=np.uint64)) for _ in range(num_perm)]
    return np.array([a for a, _ in pairs], np.uint64), np.array([b for _, b in pairs], np.uint64)


def permuted(h: Column, a: int, b: int) -> Column:
    """((a h + b) mod 2^64 mod PRIME) & MASK32 for 0 <= h < 2^32, in pieces that never leave a bigint's range."""
    lit = lambda v: F.lit(v).cast("bigint")
    ah, al, bh, bl = a >> 32, a & MASK32, b >> 32, b & MASK32
    hh, hl = F.shiftright(h, 16), h.bitwiseAND(0xFFFF)
    low, mid = hl * lit(al), hh * lit(al)
    lo = low.bitwiseAND(MASK32) + F.shiftleft(mid.bitwiseAND(0xFFFF), 16) + lit(bl)
    hi = F.shiftright(low, 32) + F.shiftright(mid, 16) + h * lit(ah) + lit(bh) + F.shiftright(lo, 32)
    x = F.shiftleft(hi.bitwiseAND(MASK32), 32).bitwiseOR(lo.bitwiseAND(MASK32))
    y = x.bitwiseAND(PRIME) + F.shiftrightunsigned(x, 61)
    return F.when(y >= PRIME, y - PRIME).otherwise(y).bitwiseAND(MASK32)
