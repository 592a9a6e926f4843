"""Token ids of whole texts by the `tokenizers` library, each distinct piece encoded once.

The byte-level pre-tokenizer of these vocabularies splits a text by the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

which looks at nothing before the place it is at, and ahead only after white space. So a text may be cut,
and has the ids of its pieces one after the other,

* before white space, behind anything else, and before a space between white space and anything else;
* behind one line break or tab alone, where something else follows;
* where a run of ASCII letters or digits ends, and behind other visible ASCII but the apostrophe where
  one begins.

Pieces are cut only at such places; longer ones are as right. Arrow tells the distinct ones of a slice of
texts; the library gets those that a worker does not remember, in one text with an added token between
them. Texts that hold an added token's string are given to it whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kindred.llm import textkit as K

SLICE_BYTES = 8 << 20
#: Pieces that a worker remembers: at most twice so many, of at most so many bytes.
REMEMBERED, SHORT = 250_000, 32


_LETTER, _DIGIT, _OTHER, _QUOTE, _SPACE, _BREAK, _LEAD, _TAIL = (1 << k for k in range(8))
_VISIBLE, _WHITE = _LETTER | _DIGIT | _OTHER | _QUOTE, _SPACE | _BREAK


def _kinds() -> bytes:
    """What each byte is: an ASCII letter, digit, other visible character or apostrophe, a space, another ASCII white
    space, the first byte of a character that is not white space, the second byte of one of two bytes."""
    out = [0] * 256
    for kind, ranges in (
        (_OTHER, [(0x21, 0x7E)]), (_LETTER, [(65, 90), (97, 122)]), (_DIGIT, [(48, 57)]), (_QUOTE, [(39, 39)]),
        (_SPACE, [(32, 32)]), (_BREAK, [(9, 13)]), (_LEAD, [(0xC3, 0xDF), (0xE4, 0xF4)]), (_TAIL, [(0x80, 0xBF)]),
    ):
        for lo, hi in ranges:
            out[lo : hi + 1] = [kind] * (hi - lo + 1)
    return bytes(out)


_KINDS = _kinds()


def _ahead(kind: int) -> int:
    """Of the kinds that may follow this one behind a cut."""
    out = _WHITE if kind & _VISIBLE else 0
    if kind & _LETTER:
        out |= _VISIBLE & ~_LETTER
    if kind & _DIGIT:
        out |= _VISIBLE & ~_DIGIT
    if kind & _OTHER:
        out |= _LETTER | _DIGIT
    return out


#: By the byte before: the kinds of the next byte before which a text may be cut, whatever stands around them.
_FOLLOWING = bytes(_ahead(kind) for kind in _KINDS)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Where a text of these bytes may be cut: a flag for each byte; True: before it."""
    n = len(data)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    raw = data.tobytes()
    kind = np.frombuffer(raw.translate(_KINDS), np.uint8)
    cut = np.frombuffer(raw.translate(_FOLLOWING), np.uint8)[:-1] & kind[1:]
    begins = kind[1:] & (_VISIBLE | _LEAD)  # surely begins something else than white space
    latin = ((data[:-1] >= 0xC3) & (data[:-1] <= 0xDF) & (kind[1:] == _TAIL)).view(np.uint8)  # ends a character of two bytes
    cut[1:] |= latin[:-1] & (kind[2:] & _WHITE != 0)
    solid = kind & _VISIBLE  # surely ends a character that is not white space
    solid[1:] |= latin
    cut[1:] |= (solid[:-2] != 0) & (kind[1:-1] == _BREAK) & (begins[1:] != 0)
    cut[:-1] |= (kind[1:-1] == _SPACE) & (begins[1:] != 0)
    out[1:] = cut != 0
    return out


def vocabulary(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        return str(public_tokenizers.path("byte_bpe_50k.json"))
    return path


class Encoder:
    """A vocabulary file of the `tokenizers` library. `apart` tells whether texts may be cut as above: byte-level
    pre-tokenizing by the usual pattern, no normalizer, an added token to stand between pieces, and none that
    holds or swallows white space."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = vocabulary(path)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        added = kind.get("added_tokens", [])
        split = kind.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        odd = any(t["lstrip"] or t["rstrip"] or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in added)
        self.apart = bool(plain and not kind.get("normalizer") and added and not odd)
        self.added = [t["content"] for t in added]
        self.between = (added[0]["content"], added[0]["id"]) if added else None
        self.seen: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as bytes."""
        if len(self.seen) > REMEMBERED:
            self.seen, self.before = {}, self.seen
        seen, before = self.seen, self.before
        out = list(map(seen.get, pieces))
        lost = [i for i, ids in enumerate(out) if ids is None]
        for i in lost:
            if (ids := before.get(pieces[i])) is not None:
                out[i] = seen[pieces[i]] = ids
        new = [i for i in lost if out[i] is None]
        if new:
            string, token = self.between
            got = self.whole(string.encode().join([pieces[i] for i in new]).decode())
            ends = np.append(np.flatnonzero(got == token), len(got)).tolist()
            raw, begin = got.tobytes(), 0
            for i, end in zip(new, ends):
                out[i] = raw[4 * begin : 4 * end]
                begin = end + 1
                if len(pieces[i]) <= SHORT:
                    seen[pieces[i]] = out[i]
        return out

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, and where each text's begin."""
        filled = offsets[:-1][np.diff(offsets) > 0]
        if not len(filled):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = filled
        if self.apart:
            # a byte that no text has stands between the texts, so that no rule looks over their ends
            between = np.zeros(len(data) + len(filled) - 1, bool)
            between[filled[1:] + np.arange(len(filled) - 1)] = True
            apart = np.full(len(between), 0xFF, np.uint8)
            apart[~between] = data
            cut = cut_places(apart)[~between]
            cut[filled] = True
            starts = np.flatnonzero(cut)
        at = np.append(starts, len(data)).astype(np.int64)
        told = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = self._encoded(told.dictionary.to_pylist())
        size = np.array([len(x) for x in distinct], np.int64) >> 2
        pool = np.frombuffer(b"".join(distinct), np.uint32)
        piece = told.indices.to_numpy()
        many = size[piece]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = pool[np.repeat((np.cumsum(size) - size)[piece] - ends[:-1], many) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(starts, offsets)]

    def _windows(self, data: np.ndarray) -> list[int]:
        """Where one long text is cut into windows of about a slice."""
        out = [0]
        while self.apart and len(data) - out[-1] > SLICE_BYTES:
            end = min(out[-1] + SLICE_BYTES, len(data))
            while not len(places := np.flatnonzero(cut_places(data[max(out[-1], end - SLICE_BYTES - 2) : end])[3:])) and end < len(data):
                end = min(end + SLICE_BYTES, len(data))
            if not len(places):
                break
            out.append(max(out[-1], end - SLICE_BYTES - 2) + 3 + int(places[-1]))
        return [*out, len(data)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a string column's texts, one after the other, and the n + 1 places where each text's begin; null is empty."""
        data, offsets = K.utf8(column)
        special = np.zeros(len(column), bool)
        for string in self.added:
            special |= np.asarray(pc.fill_null(pc.match_substring(column, string), False))
        parts, firsts, base = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        # slices end before and behind a text that holds an added token's string: it is encoded whole
        bounds = np.unique(np.concatenate([[0, len(special)], np.flatnonzero(special), np.flatnonzero(special) + 1]))
        for begin, end in zip(bounds, bounds[1:]):
            for lo, hi in K.slices(offsets[begin : end + 1], SLICE_BYTES):
                lo, hi = lo + begin, hi + begin
                some, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                if special[lo] or not self.apart:
                    each = [self.whole(some[a:b].tobytes().decode()) for a, b in zip(at, at[1:])]
                    ids, first = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
                elif hi - lo == 1 and len(some) > SLICE_BYTES:
                    cuts = self._windows(some)
                    ids = np.concatenate([self._slice(some[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:])])
                    first = np.array([0, len(ids)])
                else:
                    ids, first = self._slice(some, at)
                parts.append(ids)
                firsts.append(first[1:] + base)
                base = int(firsts[-1][-1])
        return np.concatenate(parts), np.concatenate(firsts)


def ended(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text's."""
    n = len(first) - 1
    out, at = np.empty(len(ids) + n, ids.dtype), first + np.arange(n + 1)
    last = np.zeros(len(out), bool)
    last[at[1:] - 1] = True
    out[last], out[~last] = end, ids
    return out, at


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """A worker's encoder of a vocabulary file."""
    path = vocabulary(path)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
