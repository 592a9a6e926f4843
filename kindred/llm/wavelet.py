"""A wavelet matrix of token ids in one compressed file, readable in parts.

Plane by plane, from the highest bit of the ids to the lowest, the file holds one bit of each id; behind
each plane the ids are dealt anew, those with a 0 before those with a 1, both in their order. Planes are
cut into blocks, each compressed by itself (zstd, or as it is where that is smaller), beside the number
of ones before each block. With these,

    rank(plane, bit, i)    how many of the first i bits are `bit`
    select(plane, bit, k)  where the bit's k-th occurrence is, from 0

read one block, and so access, counting and occurrence lookup of an id read as many blocks as there are
planes (for occurrences: those of which there are any), never the whole file. Decoding the whole
sequence merges plane into plane from the lowest up.

File: `KWM1`, the header's length (4 bytes), the header (JSON: counts, each plane's zeros, the places of all
sections), the sections. Numbers are little-endian.
"""

from __future__ import annotations

import json
import struct
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import zstandard

MAGIC = b"KWM1"
#: Bits of a block, and blocks that a reader holds unpacked.
BLOCK_BITS, HELD = 1 << 16, 64


def _packed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def encode(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of these ids, of documents with these ids and numbers of tokens."""
    n = len(ids)
    bits = max(int(ids.max(initial=0)).bit_length(), 1)
    ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    sections: list[bytes] = []
    places, at = {}, 0

    def put(name: str, raw: bytes) -> None:
        nonlocal at
        places[name] = [at, len(raw)]
        sections.append(raw)
        at += len(raw)

    put("doc_ids", _packed(np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes()))
    put("nameless", _packed(np.array([x is None for x in doc_ids], np.uint8).tobytes()))
    put("lengths", _packed(np.asarray(lengths, "<i8").tobytes()))
    zeros, squeeze = [], zstandard.ZstdCompressor(level=1)
    for plane in range(bits):
        one = (ids >> (bits - 1 - plane) & 1).astype(bool)
        raw = np.packbits(one, bitorder="little")
        blocks, ends, ones = [], [0], [0]
        for begin in range(0, len(raw), BLOCK_BITS // 8):
            plain = raw[begin : begin + BLOCK_BITS // 8]
            small = squeeze.compress(plain.tobytes())
            blocks.append(small if len(small) < len(plain) else plain.tobytes())
            ends.append(ends[-1] + len(blocks[-1]))
            ones.append(ones[-1] + int(np.bitwise_count(plain).sum()))
        put(f"ones{plane}", _packed(np.array(ones, "<i8").tobytes()))
        put(f"ends{plane}", _packed(np.array(ends, "<i8").tobytes()))
        put(f"bits{plane}", b"".join(blocks))
        low = ids[~one]
        zeros.append(len(low))
        ids = np.concatenate([low, ids[one]])
    header = json.dumps({"tokens": n, "docs": len(doc_ids), "block_bits": BLOCK_BITS, "zeros": zeros, "places": places}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])


class Matrix:
    """A file's wavelet matrix; read(offset, length) gives bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes]):
        head = read(0, 8)
        if head[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        size = struct.unpack("<I", head[4:])[0]
        self.header = json.loads(read(8, size))
        self.read, self.base = read, 8 + size
        self.tokens, self.docs, self.zeros = self.header["tokens"], self.header["docs"], self.header["zeros"]
        self.block = self.header["block_bits"]
        self._tables: dict[str, np.ndarray] = {}
        self._held: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    @property
    def planes(self) -> int:
        return len(self.zeros)

    def _section(self, name: str) -> bytes:
        at, size = self.header["places"][name]
        return self.read(self.base + at, size)

    def _table(self, name: str, kind: str = "<i8") -> np.ndarray:
        if name not in self._tables:
            self._tables[name] = _numbers(self._section(name), kind)
        return self._tables[name]

    def doc_ids(self) -> list[int | None]:
        ids, nameless = self._table("doc_ids").tolist(), self._table("nameless", "u1").tolist()
        return [None if gone else x for x, gone in zip(ids, nameless)]

    def lengths(self) -> np.ndarray:
        return self._table("lengths")

    def _block(self, plane: int, number: int) -> np.ndarray:
        """A block's bits, one byte each."""
        key = (plane, number)
        if key in self._held:
            self._held.move_to_end(key)
            return self._held[key]
        ends = self._table(f"ends{plane}")
        begin, end = int(ends[number]), int(ends[number + 1])
        raw = self.read(self.base + self.header["places"][f"bits{plane}"][0] + begin, end - begin)
        many = min(self.block, self.tokens - number * self.block)
        out = np.unpackbits(self._plain(raw, many), count=many, bitorder="little")
        self._held[key] = out
        if len(self._held) > HELD:
            self._held.popitem(last=False)
        return out

    @staticmethod
    def _plain(raw: bytes, bits: int) -> np.ndarray:
        size = -(-bits // 8)
        return np.frombuffer(raw if len(raw) == size else zstandard.ZstdDecompressor().decompress(raw, max_output_size=size), np.uint8)

    def rank(self, plane: int, bit: int, places: np.ndarray) -> np.ndarray:
        """For each place, how many bits before it are `bit`."""
        places = np.asarray(places, np.int64)
        blocks = places // self.block
        ones = self._table(f"ones{plane}")[blocks]
        for number in np.unique(blocks[places % self.block > 0]):
            mine = blocks == number
            before = np.concatenate([[0], np.cumsum(self._block(plane, int(number)), dtype=np.int64)])
            ones[mine] += before[places[mine] - number * self.block]
        return ones if bit else places - ones

    def select(self, plane: int, bit: int, ranks: np.ndarray) -> np.ndarray:
        """Where the bits number `ranks` (from 0) among those equal to `bit` are."""
        ranks = np.asarray(ranks, np.int64)
        before = self._table(f"ones{plane}")
        if not bit:
            before = np.minimum(np.arange(len(before)) * self.block, self.tokens) - before
        blocks = np.searchsorted(before, ranks, "right") - 1
        out = np.empty(len(ranks), np.int64)
        for number in np.unique(blocks):
            mine = blocks == number
            out[mine] = np.flatnonzero(self._block(plane, int(number)) == bit)[ranks[mine] - before[number]] + number * self.block
        return out

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        at = np.asarray(places, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.tokens):
            raise IndexError("a place beyond the shard")
        ids = np.zeros(len(at), np.uint32)
        for plane, zeros in enumerate(self.zeros):
            one = np.zeros(len(at), bool)
            for number in np.unique(at // self.block):
                mine = at // self.block == number
                one[mine] = self._block(plane, int(number))[at[mine] - number * self.block] == 1
            ids = ids << np.uint32(1) | one.astype(np.uint32)
            up = self.rank(plane, 1, at)
            at = np.where(one, zeros + up, at - up)
        return ids

    def _span(self, token: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of an id among the places from begin to end stand behind the last plane."""
        if token < 0 or token >> self.planes:
            return 0, 0
        span = np.array([begin, end], np.int64)
        for plane, zeros in enumerate(self.zeros):
            bit = token >> (self.planes - 1 - plane) & 1
            span = self.rank(plane, bit, span) + bit * zeros
            if span[0] == span[1]:
                return 0, 0
        return int(span[0]), int(span[1])

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often an id is there, from one place to before another."""
        lo, hi = self._span(token, begin, self.tokens if end is None else end)
        return hi - lo

    def occurrences(self, token: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The places of an id, ascending."""
        at = np.arange(*self._span(token, begin, self.tokens if end is None else end))
        for plane in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - plane) & 1
            at = self.select(plane, bit, at - bit * self.zeros[plane])
        return at

    def decode(self) -> np.ndarray:
        """All ids."""
        ids = np.zeros(self.tokens, np.uint16 if self.planes <= 16 else np.uint32)
        for plane in range(self.planes - 1, -1, -1):
            ends = self._table(f"ends{plane}").tolist()
            raw = self._section(f"bits{plane}")
            parts = [self._plain(raw[a:b], min(self.block, self.tokens - k * self.block)) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
            one = np.unpackbits(np.concatenate([np.zeros(0, np.uint8), *parts]), count=self.tokens, bitorder="little").view(bool)
            # what stood before the ids were dealt by this plane
            out = np.empty_like(ids)
            out[~one], out[one] = ids[: self.zeros[plane]], ids[self.zeros[plane] :] | (1 << (self.planes - 1 - plane))
            ids = out
        return ids
