"""Word and shingle hashes of whole Arrow string columns, with numpy only.

A word is a longest run of ASCII letters, ASCII digits and other characters, lower-cased, where these end a
word: other ASCII, U+0080-U+00BF but for the letters U+00AA, U+00B5 and U+00BA, U+2000-U+2FFF, U+3000-U+303F.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

P = np.uint64(0x9E3779B97F4A7C15 | 1)
P_INV = np.uint64(pow(int(P), -1, 2**64))
BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)]), dtype=np.uint64) for p in (P, P_INV)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ASCII = np.zeros(256, bool)
_ASCII[[*range(48, 58), *range(97, 123), *range(65, 91)]] = True
_ASCII[128:] = True


def _mask(data: np.ndarray) -> np.ndarray:
    ok = _ASCII[data]
    for lead in (0xC2, 0xE2, 0xE3):
        at = np.flatnonzero(data == lead)
        if len(at):
            if lead == 0xC2:
                at = at[~np.isin(data[at + 1], (0xAA, 0xB5, 0xBA))]
                ok[at] = ok[at + 1] = False
            else:
                at = at if lead == 0xE2 else at[data[at + 1] == 0x80]
                ok[at] = ok[at + 1] = ok[at + 2] = False
    return ok


def slices(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes, or of one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends, i, n = np.cumsum(size), 0, len(size)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (uint64) of all words of the rows, the index of each row's first word (one more than rows), and for
    each word its first byte and the byte after it in the lower-cased data; the data. Null counts as empty."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    _, offs, buf = low.buffers()
    offs = np.frombuffer(offs, np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(buf, np.uint8)[offs[0] : offs[-1]] if buf is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(low) + 1, np.int64), none, none, data
    ok = _mask(data)
    first = offs[:-1][offs[:-1] < len(data)]
    edge = np.zeros(len(data) + 1, bool)
    edge[first] = True
    edge[-1] = True
    prev = np.concatenate([[False], ok[:-1]]) & ~edge[:-1]
    nxt = np.concatenate([ok[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(ok & ~prev), np.flatnonzero(ok & ~nxt) + 1
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        n = int(ends[j - 1] - base)
        pw, inv = _tables(n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[base : base + n].astype(np.uint64) + np.uint64(1)) * pw[:n], dtype=np.uint64)])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out), np.searchsorted(starts, offs), starts, ends, data


_STEPS = np.array([pow(0xA24BAED4963EE407, k + 1, 2**64) for k in range(64)], np.uint64)


def shingles(h: np.ndarray, rows: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each row the hashes of its runs of `size` words, in order and with repeats; one of all its words if it
    has fewer, none if it has none."""
    n = len(h)
    if n >= size:
        full = h[: n - size + 1] * _STEPS[0]
        for k in range(1, size):
            full = full + h[k : n - size + 1 + k] * _STEPS[k]
        full = mix(full)
    out = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= size:
            out.append(full[a : b - size + 1])
        elif b > a:
            out.append(mix((h[a:b] * _STEPS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class MinHash:
    """Minima of `n` linear maps of 32-bit shingle hashes."""

    def __init__(self, n: int, seed: int = 1):
        r = np.random.default_rng(seed)
        self.n = n
        self.a = (r.integers(0, 2**32, n, np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = r.integers(0, 2**32, n, np.uint64).astype(np.uint32)

    def signature(self, s: np.ndarray) -> np.ndarray:
        best = np.full(self.n, 0xFFFFFFFF, np.uint32)
        x = (s >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 256):
            np.minimum(best, (x[i : i + 256, None] * self.a + self.b).min(axis=0), out=best)
        return best
