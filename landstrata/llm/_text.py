"""Word and shingle hashes of Arrow text columns, a few megabytes at a time."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled at once; one longer text is handled alone.
SLICE = 1 << 20
#: Rows whose offsets are widened at once.
ROWS = 4096
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict = {}

#: Bytes of words: all but the space, the tab and the line breaks.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BACK = [U(pow(c, -1, 1 << 64)) for c in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` made this of."""
    x = x ^ (x >> U(31)) ^ (x >> U(62))
    x = x * _BACK[0]
    x = x ^ (x >> U(27)) ^ (x >> U(54))
    x = x * _BACK[1]
    return x ^ (x >> U(30)) ^ (x >> U(60))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U))[0])


def give_back() -> None:
    """Return memory that this Python worker has freed to the system; workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def slices(texts: pa.Array, size: int | None = None):
    """(first row, bytes, offsets) of successive parts of a text column, of ``size`` bytes (SLICE) or one text; a null text is empty."""
    size = SLICE if size is None else size
    for first in range(0, len(texts), ROWS):
        part = pc.fill_null(texts.slice(first, ROWS).cast(pa.large_string()), "")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8) if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        at = 0
        while at < len(part):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            if len(data):
                yield first + at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            else:
                yield first + at, data, np.zeros(to - at + 1, np.int64)
            at = to


def runs(member: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None):
    """(start, end, row) of maximal runs of true bytes; no run crosses a row, and a run ends before each byte in ``breaks``."""
    n = len(member)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    opens = np.zeros(n + 1, bool)
    opens[offsets[:-1]] = True
    opens[n] = True
    if breaks is not None:
        opens[:-1] |= breaks
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    starts = np.flatnonzero(member & (~before | opens[:-1]))
    ends = np.flatnonzero(member & (~after | opens[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _power(kind: str, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        p = np.full(max(n, SLICE + 1), _BASE if kind == "up" else _INVERSE, U)
        p[0] = 1
        _powers[kind] = np.multiply.accumulate(p)
    return _powers[kind]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run: polynomials from prefix sums, scrambled with the length."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, "right")))
        s, e = starts[at:to] - starts[at], ends[at:to] - starts[at]
        part = data[starts[at] : ends[to - 1]].astype(U) + U(1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * _power("up", len(part) + 1)[: len(part)], out=sums[1:])
        out[at:to] = mix((sums[e] - sums[s]) * _power("down", len(part) + 1)[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        at = to
    return out


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, k: int):
    """(hash, row) of all windows of ``k`` words, in order; a row with fewer words has its whole sequence as one."""
    n = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    coefficient = [U(mix_int(i + 1) | 1) for i in range(k)]
    windows = max(0, len(hashes) - k + 1)
    total = np.zeros(windows, U)
    for i in range(k):
        total += hashes[i : i + windows] * coefficient[i]
    whole = row[:windows] == row[k - 1 : k - 1 + windows] if windows else np.empty(0, bool)
    out, at = mix(total[whole]), row[:windows][whole]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        first = np.searchsorted(row, few)
        extra = np.array([sum(int(h) * int(c) for h, c in zip(hashes[f : f + m], coefficient)) + mix_int(1000 + m) & (2**64 - 1)
                          for f, m in zip(first.tolist(), n[few].tolist())], U)
        out, at = np.concatenate([out, mix(extra)]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def distinct(hashes: np.ndarray, row: np.ndarray, rows: int):
    """Distinct hashes per row, ascending; ``bounds[i]:bounds[i + 1]`` are those of row i."""
    hashes = hashes.copy()
    edges = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[first], np.searchsorted(row[first], np.arange(rows + 1))


def word_sets(texts: pa.Array, k: int):
    """(first row, distinct shingle hashes, bounds) for successive parts; words are runs of non-space bytes, A-Z lower-cased."""
    for at, data, offsets in slices(texts):
        starts, ends, row = runs(NOT_SPACE[data], offsets)
        hashes = hash_runs(LOWER[data], starts, ends)
        found, of = shingles(hashes, row, len(offsets) - 1, k)
        yield (at, *distinct(found, of, len(offsets) - 1))
    give_back()
