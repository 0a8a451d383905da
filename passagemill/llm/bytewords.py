"""Words of UTF-8 text as 64-bit hashes, computed with numpy straight on Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone and whole.
BLOCK = 1 << 20
#: Bytes of words that are hashed at once.
SLICE = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.multiply.accumulate(np.full(1024, _STEP, np.uint64))  # one step at the first place


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.multiply.accumulate(np.full(max(n, 2 * len(_powers)), _STEP, np.uint64))
    return _powers


def blocks(column: pa.Array):
    """(first row, bytes, row offsets) of runs of whole texts; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + BLOCK, "right")) - 1)
        end = min(end, len(column))
        yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE):
    """Starts, ends and rows of the words; words never cross a row's end."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    sep = space[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = sep[:-1], sep[1:]
    before[off[:-1][off[:-1] < n]] = True
    after[off[1:][off[1:] > 0] - 1] = True
    word = ~sep
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def _power_from(at: int, n: int) -> np.ndarray:
    """Powers of the step for places at, at + 1, ..."""
    return powers(n)[:n] * np.uint64(pow(int(_STEP), at, 1 << 64))


def _sums(buf: np.ndarray, starts: np.ndarray, size: np.ndarray, fold: np.ndarray) -> np.ndarray:
    first = np.cumsum(size) - size
    pos = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    got = _BYTE[fold[buf[pos + np.repeat(starts, size)]]]
    got *= powers(int(size.max()))[pos]
    return np.add.reduceat(got, first)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each span's folded bytes; spans neither overlap nor are empty.

    Spans are read in slices of SLICE bytes, cut between words and inside longer words alone, as each byte takes some 40.
    """
    size = ends - starts
    out, cum, i = np.empty(len(starts), np.uint64), np.cumsum(size), 0
    while i < len(starts):
        j = int(np.searchsorted(cum, cum[i] - size[i] + SLICE, "right"))
        if j > i:
            out[i:j] = _sums(buf, starts[i:j], size[i:j], fold)
        else:
            j, total = i + 1, 0
            for at in range(int(starts[i]), int(ends[i]), SLICE):
                part = _BYTE[fold[buf[at : min(at + SLICE, int(ends[i]))]]]
                part *= _power_from(at - int(starts[i]), len(part))
                total += int(part.sum(dtype=np.uint64))
            out[i] = total & 0xFFFFFFFFFFFFFFFF
        i = j
    return mix(out ^ (size.astype(np.uint64) * _STEP))


def hash_word(word: str) -> int:
    """The hash of one word, for tables of known words."""
    buf = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(buf, np.array([0]), np.array([len(buf)]))[0]) if len(buf) else 0


def windows(words: np.ndarray, rows: np.ndarray, k: int):
    """Hashes of k consecutive words of one row, with their rows and first words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = words[:n] * _MULT[0]
    for i in range(1, k):
        got += words[i : n + i] * _MULT[i]
    whole = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(got[whole]), rows[whole], whole


def shingle_sets(column: pa.Array, k: int):
    """For each row, in order, its sorted distinct shingles of k words.

    Fewer than k words give one shingle of all of them; no word gives an empty array.
    """
    for _, buf, off in blocks(column):
        starts, ends, rows = spans(buf, off)
        words = hashes(buf, starts, ends)
        got, got_rows, _ = windows(words, rows, k)
        n_rows = len(off) - 1
        count = np.bincount(rows, minlength=n_rows)
        first = np.cumsum(count) - count
        at = np.searchsorted(got_rows, np.arange(n_rows + 1))
        for r in range(n_rows):
            c = int(count[r])
            if c >= k:
                own = got[at[r] : at[r + 1]]
                own.sort()
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif c:
                own = words[first[r] : first[r] + c]
                yield mix(np.array([(own * _MULT[:c]).sum(dtype=np.uint64)], np.uint64) + np.uint64(c))
            else:
                yield np.zeros(0, np.uint64)
