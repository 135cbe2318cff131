"""Vectorised text scans on Arrow buffers: words, their hashes, rolling windows and window minima."""

from __future__ import annotations

import numpy as np
import xxhash

from alertmill.llm.common import mix64

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True  # the class [\x20\x09-\x0D]
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes from which a word is hashed as a whole.
LONG = 256


def powers(base: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    got = cache.get(base)
    if got is None or len(got) < n:
        size = 1 << max(16, int(n).bit_length())
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        cache[base] = got = np.multiply.accumulate(got)
    return got[:n]


def words_of(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` in a buffer of rows, and the row of each; no word crosses rows. ``gap``: the bytes between words."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~gap[buf]
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offs[:-1]] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | first[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offs, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(buf), dtype=np.int64)
    at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(buf))))
    at[: starts[0]] = 0
    v = (buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, int(at.max()) + 1)[at]
    v[gap[buf]] = 0
    out = mix64(np.add.reduceat(v, starts) ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))
    for i in np.flatnonzero(ends - starts > LONG):  # sums modulo 2**64 have known collisions from some hundred letters on
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return out


class Rolling:
    """Polynomial prefix sums modulo 2**64; the hash of any run of units comes from two of them."""

    def __init__(self, units: np.ndarray, base: int = BASE):
        n = len(units)
        self.inv = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(units * powers(base, n), out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:n]) * self.inv[:n]) if n > 0 else np.zeros(0, np.uint64)

    def runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.inv[a])


def window_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost least value in each window of ``w``."""
    val, idx, span = v, np.arange(len(v), dtype=np.int32), 1
    while span < w:
        d = min(span, w - span)
        left = val[:-d] <= val[d:]
        val = np.where(left, val[:-d], val[d:])
        idx = np.where(left, idx[:-d], idx[d:])
        span += d
    return idx


def anchor_of_windows(units: np.ndarray, length: int, k: int) -> np.ndarray:
    """The hash of the anchor of each window of ``length`` units, wherever rows end."""
    pieces = Rolling(units).windows(k)
    return pieces[window_argmin((pieces >> np.uint64(32)).astype(np.uint32), length - k + 1)]


def anchored_chunks(units: np.ndarray, offs: np.ndarray, length: int, k: int) -> dict[str, np.ndarray] | None:
    """Cuts each row's windows of ``length`` units into runs that share an anchor.

    The anchor of a window is the leftmost of its ``k``-unit pieces with the least hash, so equal windows have
    equal anchors at equal offsets wherever they stand. A chunk is a maximal run of consecutive windows with one
    anchor: row, first window ``s`` (in the row), windows ``n``, offset ``o`` of the anchor from ``s``, hash
    ``anchor`` of the anchor piece and hash ``chunk`` of all units that the run covers. ``roll`` gives window hashes.
    """
    if len(units) < length:
        return None
    roll = Rolling(units)
    pieces = roll.windows(k)
    owner = window_argmin((pieces >> np.uint64(32)).astype(np.uint32), length - k + 1)
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int64), np.diff(offs))
    at = np.arange(len(units) - length + 1, dtype=np.int64)
    good = row[: len(at)] == row[length - 1 :]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | ~good[:-1]
    new &= good
    s = np.flatnonzero(new)
    if not len(s):
        return None
    stop = np.flatnonzero(good & np.append(new[1:] | ~good[1:], True)) + 1
    n = stop - s
    p = owner[s].astype(np.int64)
    o = p - s
    anchor = pieces[p]
    chunk = mix64(roll.runs(s, s + n + length - 1) ^ mix64((n << 32 | o).astype(np.uint64)))
    r = row[s]
    return {"row": r, "s": s - offs[r], "at": s, "n": n, "o": o, "anchor": anchor, "chunk": chunk, "roll": roll}


def covered(n_units: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Units covered by the windows ``starts[i] .. starts[i] + counts[i] - 1`` of ``length`` units."""
    d = np.zeros(n_units + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + counts + length - 1, -1)
    return np.cumsum(d[:-1]) > 0
