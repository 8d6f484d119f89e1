"""Vectorised text features: whole Arrow batches of UTF-8 become word and shingle hashes.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D after lower-casing ASCII A-Z, so
the byte view equals the code-point view.  Hashes are 64-bit: a polynomial over a fixed random
byte table, read from prefix sums and finished with a mixing step.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 21  # bytes hashed at a time
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    def __init__(self) -> None:
        rng = np.random.default_rng(20240229)
        self.byte = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.byte[65:91] = self.byte[97:123]
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        self.pow = np.cumprod(np.full(n, _BASE, np.uint64))
        self.inv = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))

    def words(self, data: np.ndarray, first: np.ndarray, heads: tuple[int, ...] = (), tails: tuple[int, ...] = ()):
        """data: bytes; first: ascending offsets where a document begins (0 first).

        Returns the hash of each word and the offset at which it starts; with heads or tails
        also one row of hashes for each: of the words' first or last so many bytes (0 where the
        word is no longer than that).
        """
        rows = len(heads) + len(tails)
        if not len(data):
            return (np.zeros(0, np.uint64), np.zeros(0, np.int64)) + ((np.zeros((rows, 0), np.uint64),) if rows else ())
        space = self.space[data]
        inside = ~space
        begin = inside.copy()
        begin[1:] &= space[:-1]
        cut = first[first < len(data)]
        begin[cut] = inside[cut]
        end = np.zeros(len(data) + 1, bool)
        end[1:][inside] = True
        end[1:-1] &= space[1:] | begin[1:]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
        out = np.empty(len(starts), np.uint64)
        parts = np.zeros((rows, len(starts)), np.uint64)
        at = 0
        while at < len(starts):
            lo = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
            hi = ends[to - 1]
            if len(self.pow) < hi - lo + 1:
                self._grow(int(hi - lo + 1))
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.byte[data[lo:hi]] * self.pow[: hi - lo], out=sums[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * self.inv[s] + (e - s).astype(np.uint64)
            for k, n in enumerate((*heads, *tails)):
                long = np.flatnonzero(e - s > n)
                a = s[long] if k < len(heads) else e[long] - n
                parts[k, at + long] = _mix((sums[a + n] - sums[a]) * self.inv[a] + np.uint64(k + 101))
            at = to
        return (_mix(out), starts, parts) if rows else (_mix(out), starts)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and n + 1 offsets of a string or binary Arrow array; nulls count as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words."""
    n = len(hashes) - width + 1
    out = np.full(max(n, 0), width, np.uint64)
    for j in range(width if n > 0 else 0):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(_BASE) + hashes[j : j + n]
    return _mix(out)


def shingle_sets(hasher: WordHasher, column, width: int = 5):
    """One ascending array of distinct shingle hashes per text.

    Fewer than width words: the whole sequence is the one shingle; no words or null: empty.
    """
    data, offs = column_bytes(column)
    hashes, starts = hasher.words(data, offs[:-1])
    runs = windows(hashes, width)
    bound = np.searchsorted(starts, offs)
    for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist()):
        n = hi - lo
        if n >= width:
            yield np.unique(runs[lo : hi - width + 1])
        else:
            yield windows(hashes[lo:hi], n) if n else hashes[:0]
