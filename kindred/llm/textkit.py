"""Vectorised word kernels on Arrow string columns.

Texts are handled as the UTF-8 bytes that Arrow already holds: a byte table says which bytes
belong to words; a word's hash is the sum of its 8-byte pieces, each mixed with its place, and a
window's hash is mixed anew at each doubling, so no words are known that collide by the arithmetic
alone. A salt gives a second, independent hash: what decides a result compares both, 128 bits.
No Python object is made per word. Slices bound the memory, whole documents stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of `[^\x20\x09-\x0D]+`.
PLAIN = ~_SPACE
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SLICE_BYTES = 2 << 20
_Q = U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks that keep the first 0 to 8 bytes of a little-endian piece.
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def _pieces(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 places where its rows start; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """The words of consecutive texts.

    first: n + 1 word indices, where each text's words start; starts, ends: byte places.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.table = data, table
        inside = table[data]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[heads] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        after[heads[heads > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.count = len(self.starts)

    def hashes(self, lower: bool, salt: int = 0) -> np.ndarray:
        """64 bits a word; lower: A-Z and a-z count as the same; hashes of unlike salts are independent."""
        if not self.count:
            return np.zeros(0, U)
        data = _LOWER[self.data] if lower else self.data
        eight = _pieces(data)
        length = self.ends - self.starts
        many = (length + 7) >> 3
        first = np.cumsum(many) - many
        if int(many.max()) == 1:
            place, at, rest = np.zeros(self.count, np.int64), self.starts, length
        else:
            place = np.arange(int(first[-1] + many[-1])) - np.repeat(first, many)
            at = np.repeat(self.starts, many) + 8 * place
            rest = np.minimum(np.repeat(self.ends, many) - at, 8)
        x = eight[at] & _TAIL[rest]
        x = mix(x + mix(place.astype(U) * _Q + U(salt)))
        return mix(np.add.reduceat(x, first) + length.astype(U) * _Q)

    def room(self) -> np.ndarray:
        """For each word, the words of its text from there on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(self.count)


def hashed_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of many texts and where each text's begin, made slice by slice."""
    parts, firsts, base = [np.zeros(0, U)], [np.zeros(1, np.int64)], 0
    for lo, hi in slices(offsets):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
        parts.append(words.hashes(lower, salt))
        firsts.append(words.first[1:] + base)
        base += words.count
    return np.concatenate(parts), np.concatenate(firsts)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a window and the next one, told from those of both."""
    return mix(a * _Q + b)


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each place on; n - length + 1 of them, to be mixed.

    Built by doubling: a window of 2 n words is one of n and the next one of n.
    """
    n = len(words)
    if n < length:
        return np.zeros(0, U)
    block, size, have, out = words, 1, 0, None
    while have < length:
        if length & size:
            part = block[have : have + n - length + 1]
            out = part.copy() if out is None else _joined(out, part)
            have += size
        if have < length:
            block = _joined(block[:-size], block[size:]) if len(block) > size else block[:0]
            size *= 2
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values; n - width + 1 of them."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted keys."""
    if not len(sorted_keys) or not len(x):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x


class Lookup:
    """Places of keys among distinct ones, all of which are there: near where a uniform hash says."""

    def __init__(self, keys: np.ndarray):
        hashed = mix(keys)
        self.order = np.argsort(hashed)
        self.hashed = hashed[self.order]
        self.shift = U(64 - max(1, int(len(keys)).bit_length() + 1))
        self.start = np.searchsorted(self.hashed >> self.shift, np.arange(1 << (64 - int(self.shift)), dtype=U))

    def find(self, x: np.ndarray) -> np.ndarray:
        hashed = mix(x)
        at = self.start[(hashed >> self.shift).astype(np.int64)]
        off = np.flatnonzero(self.hashed[at] != hashed)
        while len(off):
            at[off] += 1
            off = off[self.hashed[at[off]] != hashed[off]]
        return self.order[at]
