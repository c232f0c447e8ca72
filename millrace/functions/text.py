"""Text columns as NumPy arrays: blocks of bytes, the words in them and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task turns into arrays at once; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


class Text:
    """One string column: the UTF-8 bytes of all rows, and where each row starts (n + 1 offsets). Null is empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        n = len(column)
        offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = n

    def row(self, i: int) -> bytes:
        return self.bytes[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = Text(batch.column(batch.schema.get_field_index(column))).offsets
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(ends, ends[a] + limit, side="right")) - 1
            b = min(max(b, a + 1), batch.num_rows)
            yield batch.slice(a, b - a)
            a = b


def get(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where `inside` holds; a run never crosses a row."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    out = ~inside
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = out[:-1]
    before |= edge[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = out[1:]
    after |= edge[1:]
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def of_rows(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First run of each row, n + 1 numbers."""
    return np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each of the non-empty, disjoint, ascending runs data[start:end]."""
    if len(starts) == 0:
        return np.zeros(0, U)
    lens = ends - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    local = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    power = np.full(int(lens.max()), U(odd), dtype=U)
    power[0] = U(1)
    np.multiply.accumulate(power, out=power)
    table = mixed(np.arange(1, 257, dtype=U) * U(odd))
    h = np.add.reduceat(table[data[local + np.repeat(starts, lens)]] * power[local], first)
    return mixed(h + lens.astype(U) * U(0xD6E8FEB86659FD93))


def hex64(h: np.ndarray) -> list[str]:
    return [f"{x:016x}" for x in h.tolist()]
