"""Words of Arrow string columns as numpy arrays: byte spans, hashes and hashes of word windows.

Everything works on the UTF-8 bytes of a whole batch at once. Temporary arrays cover a block of
bytes, never a whole long document times eight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that one block of temporary arrays covers.
BLOCK = 1 << 20

_MASK = (1 << 64) - 1
_BYTE_STEP = 0x9E3779B97F4A7C15
_WORD_STEP = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_STEP))


def _powers(step: int, count: int) -> np.ndarray:
    out = np.full(count, step, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, step: int) -> None:
        self.step, self.inverse = step, pow(step, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            self.up = _powers(self.step, count)
            self.down = _powers(self.inverse, count)
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTE_STEP), _Powers(_WORD_STEP)


def byte_class(kept) -> np.ndarray:
    return np.array([bool(kept(b)) for b in range(256)])


# White space is 20 and 09 to 0D (hex); a letter is 0-9, A-Z, a-z or beyond ASCII.
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
LETTERS = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    last = offsets[-1] if len(offsets) else 0
    return data[first:last], offsets - first


class Words:
    """Spans and hashes of the words of a batch of texts.

    ``starts``/``ends``: bytes of each word; ``first``: index of each text's first word, with the
    number of words at the end; ``hashes``: a 64-bit hash of each word.
    """

    def __init__(self, column: pa.Array, word_bytes: np.ndarray = NOT_SPACE, lower: bool = False) -> None:
        data, self.offsets = buffers(column)
        self.data = LOWER[data] if lower else data
        inside = word_bytes[self.data]
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        cut = self.offsets[self.offsets < len(data)]
        edge[cut] = inside[cut]
        self.starts = np.flatnonzero(edge)
        edge = inside.copy()
        edge[:-1] &= ~inside[1:]
        cut = self.offsets[self.offsets > 0] - 1
        edge[cut] = inside[cut]
        self.ends = np.flatnonzero(edge) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hash()

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + BLOCK, "right")))
            high = self.ends[to - 1]
            up, down = _BYTE_POWERS.upto(max(BLOCK, int(high - low)) + 1)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTES[self.data[low:high]] * up[:high - low], out=total[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
        return out

    def owner(self) -> np.ndarray:
        """Which text each word belongs to."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word]:self.ends[word]].tobytes()


def windows(hashes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` words; another lane gives an independent hash."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    if lane:
        hashes = mix(hashes + np.uint64(lane * 0xA0761D6478BD642F & _MASK))
    out = np.empty(count, np.uint64)
    for at in range(0, count, BLOCK):
        part = hashes[at:min(count, at + BLOCK) + width - 1]
        up, down = _WORD_POWERS.upto(BLOCK + width + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:len(part)], out=total[1:])
        n = len(part) - width + 1
        out[at:at + n] = mix((total[width:] - total[:n]) * down[:n])
    return out


def slices(column: pa.Array, most_bytes: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about so many bytes of text each, one row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.cumsum(np.diff(buffers(column)[1]))
    at = 0
    while at < len(column):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most_bytes, "right")))
        yield at, to
        at = to


def prefix_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of each run of words [start, end), also of its length; equal lanes agree with each other only."""
    if lane:
        hashes = mix(hashes + np.uint64(lane * 0xA0761D6478BD642F & _MASK))
    up, down = _WORD_POWERS.upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
