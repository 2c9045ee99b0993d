"""Vectorised word segmentation and hashing over Arrow text columns.

Everything here works on the UTF-8 buffer of a string column, so no Python
string is made for a word.  Blocks are bounded in bytes, whatever the batch
size and however long a text is (one text is never split between blocks).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text bytes that are handled at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: spans of more bytes are hashed one by one
LONG = 256
#: keep the first bytes of a lane
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes that belong to words: all but those in `ranges`."""
    table = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = False
    return table


#: words `[^\x20\x09-\x0D]+`
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, element by element."""
    with np.errstate(over="ignore"):
        z = x + U64((salt * 0x9E3779B97F4A7C15 + 0x1234567) & _MASK)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


_MOST_POWERS = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _P) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is not None and len(have[0]) > max(n, _MOST_POWERS):  # those of a giant text
        have = None
    if have is None or len(have[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        inv = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, dtype=U64), np.full(size, inv, dtype=U64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        _POWERS[base] = have
    return have[0][:n], have[1][:n]


@dataclass
class Words:
    """Words of a block: bytes [start, end) of buf, hash, and first[d]..first[d+1] for text d.

    other() hashes the same bytes independently of hash.
    """

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    _other: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def other(self) -> np.ndarray:
        if self._other is None:
            self._other = span_hashes(self.buf, self.start, self.end, 1)
        return self._other

    def room(self, n: int) -> np.ndarray:
        """For each word whether n words of its text start there."""
        ok = np.zeros(len(self.start) + 1, dtype=np.int32)
        last = np.maximum(self.first[1:] - n + 1, self.first[:-1])
        np.add.at(ok, self.first[:-1], 1)
        np.add.at(ok, last, -1)
        return np.cumsum(ok[:-1]) > 0

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Segment the texts buf[offs[d]:offs[d+1]]; A-Z count as a-z where `lower`."""
    low = _LOWER[buf] if lower else buf
    inside = table[low]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        cut = offs[(offs > 0) & (offs < len(buf))]
        before[cut] = False
        after[cut - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(low, start, end, span_hashes(low, start, end), np.searchsorted(start, offs))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hash of each span: its bytes, eight at a time, go through the finaliser one after another.

    Spans of up to eight bytes and equal length never collide.  Longer than LONG, a span has a
    cryptographic digest, so that no letter pattern, however long, cancels out.
    """
    size = end - start
    out = mix(size.astype(U64), 101 + family)
    if not len(start):
        return out
    wide = np.zeros(len(buf) + 8, dtype=np.uint8)
    wide[: len(buf)] = buf
    lanes = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=wide, strides=(1,))  # the eight bytes from each place on
    todo = np.flatnonzero(size <= LONG)
    at, left = start[todo], size[todo]
    while len(todo):
        lane = lanes[at] & _LANE[np.minimum(left, 8)]
        out[todo] = mix(out[todo] ^ lane, 211 + family)
        on = left > 8
        todo, at, left = todo[on], at[on] + 8, left[on] - 8
    for i in np.flatnonzero(size > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([family])).digest(), "little")
    return out


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n values from each place on; the last n - 1 places are cut off."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    base = (_P * (2 * salt + 3)) & _MASK | 1
    with np.errstate(over="ignore"):
        v = mix(h, salt + 1)
        if n <= 6:
            acc = v[n - 1 :].copy()
            for i in range(n - 2, -1, -1):
                acc = acc * U64(base) + v[i : i + m]
        else:
            up, down = powers(len(h), base)
            total = np.zeros(len(h) + 1, dtype=U64)
            np.cumsum(v * up, out=total[1:])
            acc = (total[n:] - total[:-n]) * down[:m]
        return mix(acc, salt + 7)


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of values[cuts[d]:cuts[d+1]] for each d, each by itself: neighbours do not change a rounding."""
    out = np.zeros(len(cuts) - 1)
    has = np.diff(cuts) > 0
    if has.any():
        out[has] = np.add.reduceat(values[: cuts[-1]].astype(float), cuts[:-1][has])
    return out


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, row after the last, bytes, offsets) of runs of texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    offs = np.frombuffer(raw[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Leftmost place of the smallest value of each window of w values."""
    m = len(x) - w + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at, span = x.copy(), np.arange(len(x)), 1
    while span < w:  # doubling: best covers span values from each place on
        step = min(span, w - span)
        n = len(best) - step
        right = best[step:] < best[:n]
        at = np.where(right, at[step:], at[:n])
        best = np.where(right, best[step:], best[:n])
        span += step
    return at
