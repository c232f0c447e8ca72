"""Choice of band parameters and size partitions. Runs on the driver; inputs are a few numbers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=8)
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def _integral(f, a: float, b: float, n: int) -> float:
    if b <= a:
        return 0.0
    x, w = _nodes(n)
    return float(((b - a) / 2 * w * f((b - a) / 2 * x + (a + b) / 2)).sum())


def collision(s, b: int, r: int):
    """Probability that signatures of Jaccard similarity s share one of b bands of r values."""
    return 1 - (1 - s**r) ** b


@lru_cache(maxsize=64)
def band_params(threshold: float, num_perm: int, fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """(b, r) with the least weighted area of false positives below and false negatives above the threshold; the first of equals.

    The integrand is a polynomial of degree b * r at most, for which the quadrature is exact.
    """
    best, found = float("inf"), (0, 0)
    n = num_perm // 2 + 1
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            fp = _integral(lambda s: collision(s, b, r), 0.0, threshold, n)
            fn = _integral(lambda s: 1 - collision(s, b, r), threshold, 1.0, n)
            cost = fp_weight * fp + fn_weight * fn
            if cost < best:
                best, found = cost, (b, r)
    return found


@lru_cache(maxsize=256)
def containment_params(threshold: float, num_perm: int, max_r: int, ratio: float, fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """(b, r) for containment in sets `ratio` times the query's size; r is at most max_r."""
    jaccard = lambda t: t / (1 + ratio - t)
    top = min(1.0, ratio)
    best, found = float("inf"), (0, 0)
    for b in range(1, num_perm + 1):
        for r in range(1, min(max_r, num_perm // b) + 1):
            p = lambda t: collision(jaccard(t), b, r)
            cost = fp_weight * _integral(p, 0.0, min(threshold, top), 200) + fn_weight * _integral(lambda t: 1 - p(t), threshold, top, 200)
            if cost < best:
                best, found = cost, (b, r)
    return found


#: Ratios of set size to query size that parameters are prepared for.
RATIOS = np.exp(np.linspace(-5, 5, 10))


def ratio_index(upper: float, query: float) -> int:
    """The first prepared ratio that is at least upper / query, or the last."""
    return min(int(np.searchsorted(RATIOS, upper / query)), len(RATIOS) - 1)


def expected_false_positives(sizes: list[int], counts: list[int], lower: int, upper: int, uniform: bool = False) -> float:
    """Sets of sizes[lower..upper] that a query expects falsely if each is taken to be as large as the largest: by their real sizes, or as if these were spread evenly."""
    if lower > upper:
        raise ValueError("lower must not be above upper")
    s, c, u = np.array(sizes[lower : upper + 1], float), np.array(counts[lower : upper + 1], float), float(sizes[upper])
    return float(c.sum() * (u - s[0]) / (2 * u)) if uniform else float((c * (u - s) / u).sum())


def size_partitions(sizes: list[int], counts: list[int], parts: int) -> list[tuple[int, int]]:
    """Intervals [lower, upper] of set sizes with the least expected false positives, sum of (u - s) / u over the sets of size s.

    Dynamic programming over the distinct sizes, which are ascending. Costs come from running sums and no
    matrix is made: the best cut of a longer prefix is never before that of a shorter one, so each row is found
    by halves. Of equal cuts the first counts.
    """
    n = len(sizes)
    if n == 0:
        return []
    parts = max(1, min(parts, n))
    s, c = np.array(sizes, float), np.array(counts, float)
    total, weighted = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * s)])

    def cost(i, j):
        """Of an interval from sizes[i] to sizes[j]; i may be an array."""
        return (total[j + 1] - total[i]) - (weighted[j + 1] - weighted[i]) / s[j]

    best = np.array([cost(0, j) for j in range(n)])
    cut = np.zeros((parts, n), np.int32)
    for p in range(1, parts):
        new, todo = np.full(n, np.inf), [(p, n - 1, p, n - 1)]
        while todo:
            a, b, low, high = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            k = np.arange(low, min(j, high) + 1)
            options = best[k - 1] + cost(k, j)
            at = int(options.argmin())
            new[j], cut[p, j] = options[at], k[at]
            todo += [(a, j - 1, low, int(k[at])), (j + 1, b, int(k[at]), high)]
        best = new
    out, j = [], n - 1
    for p in range(parts - 1, -1, -1):
        i = int(cut[p, j]) if p else 0
        out.append((int(sizes[i]), int(sizes[j])))
        j = i - 1
    return out[::-1]


def bloom_rates(b: int, fp: float, fp_minhash: float, fn_minhash: float) -> tuple[float, float, float]:
    """What Bloom filters of rate fp, one for each of b bands, add: (net false positive rate, false positives, false negatives) from those of the index without them."""
    net = 1 - (1 - fp) ** b
    return net, fp_minhash + (1 - fp_minhash) * net, (1 - net) * fn_minhash


def band_rates(threshold: float, b: int, r: int) -> tuple[float, float]:
    """Areas of false positives below the threshold and of false negatives above it."""
    n = b * r // 2 + 1
    return _integral(lambda s: collision(s, b, r), 0.0, threshold, n), _integral(lambda s: 1 - collision(s, b, r), threshold, 1.0, n)
