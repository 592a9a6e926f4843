"""Edit distances of many pairs of texts at once, bit-parallel with a cutoff.

A column of the distance matrix is kept as vertical differences in 64-bit words; one step of all pairs of a
batch advances each by one character of its longer text. Pairs go through the batch in the order of
their lengths, so a step works on those alone that have characters left, and pairs that cannot get back
below their cutoff leave early.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONE, _TOP = U(1), U(63)
#: Words of bits that a batch of pairs holds in each of its arrays.
BATCH_WORDS = 1 << 16
#: Characters between two looks at the cutoffs.
LOOK = 64


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Texts:
    """Distinct texts as numbers of a dense alphabet, with how often each character is in each."""

    def __init__(self, texts: list[str]):
        points = code_points("".join(texts))
        self.length = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        there = np.bincount(points) > 0 if len(points) else np.zeros(0, bool)
        self.chars = (np.cumsum(there) - 1)[points]
        self.alphabet = int(there.sum())
        # of a large alphabet the counts are kept in classes of characters: a bound that is as right, if weaker
        self.kinds = min(max(self.alphabet, 1), 64)
        row = np.repeat(np.arange(len(texts)), self.length)
        self.counts = np.bincount(row * self.kinds + self.chars % self.kinds, minlength=len(texts) * self.kinds).reshape(-1, self.kinds).astype(np.int32)

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the distances of pairs are at least, by their characters' counts."""
        out = np.empty(len(a), np.int64)
        for lo in range(0, len(a), 1 << 16):
            more = self.counts[a[lo : lo + (1 << 16)]] - self.counts[b[lo : lo + (1 << 16)]]
            up = np.maximum(more, 0).sum(1)
            out[lo : lo + (1 << 16)] = np.maximum(up, up - more.sum(1))
        return out


def distances(texts: Texts, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The edit distances of pairs of texts; any number above `most` where they are above it."""
    out = np.zeros(len(a), np.int64)
    swap = texts.length[a] > texts.length[b]
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    out[:] = texts.length[long]  # also what an empty text has
    open_ = (texts.length[short] > 0) & (short != long)
    out[short == long] = 0
    least = np.zeros(len(a), np.int64)
    at = np.flatnonzero(open_)
    least[at] = texts.least(short[at], long[at])
    out[at] = np.maximum(least[at], 1)
    todo = at[least[at] <= most[at]]
    words = (texts.length[short] + 63) >> 6
    for w in np.unique(words[todo]):
        mine = todo[words[todo] == w]
        mine = mine[np.argsort(-texts.length[long[mine]], kind="stable")]
        step = max(1, BATCH_WORDS // int(w))
        for lo in range(0, len(mine), step):
            some = mine[lo : lo + step]
            out[some] = _batch(texts, short[some], long[some], most[some], int(w))
    return out


def _matches(texts: Texts, patterns: np.ndarray, words: int) -> np.ndarray:
    """Patterns x characters x words: the places of each character in each pattern."""
    table = np.zeros((len(patterns), texts.alphabet, words), U)
    size = texts.length[patterns]
    row = np.repeat(np.arange(len(patterns)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    char = texts.chars[np.repeat(texts.first[patterns], size) + place]
    np.bitwise_or.at(table, (row, char, place >> 6), _ONE << (place & 63).astype(U))
    return table


def _batch(texts: Texts, short: np.ndarray, long: np.ndarray, most: np.ndarray, words: int) -> np.ndarray:
    """Pairs in the order of falling length of their longer texts; short ones have so many words."""
    own, pattern = np.unique(short, return_inverse=True)
    n = len(short)
    result = np.empty(n, np.int64)
    if words * texts.alphabet * len(own) > 8 * BATCH_WORDS * max(words, 8) and len(own) > 1:
        half = n // 2  # so large an alphabet that the tables of fewer patterns are made at a time
        result[:half], result[half:] = (_batch(texts, short[k], long[k], most[k], words) for k in (slice(None, half), slice(half, None)))
        return result
    table = _matches(texts, own, words)
    live = np.arange(n)
    length, size = texts.length[long], texts.length[short]
    begin = texts.first[long]
    up, down = np.full((words, n), ~U(0)), np.zeros((words, n), U)
    score, last = size.copy(), ((size - 1) & 63).astype(U)
    step = 0
    while len(live):
        k = int(np.searchsorted(-length, -step, "left"))  # those with a character left
        if k < len(live):
            result[live[k:]] = score[k:]
            live, length, size, begin, score, last, pattern, most = (x[:k] for x in (live, length, size, begin, score, last, pattern, most))
            up, down = up[:, :k], down[:, :k]
            if not k:
                break
        char = texts.chars[begin + step]
        plus, minus = np.ones(k, U), np.zeros(k, U)
        for w in range(words):
            eq = table[pattern, char, w]
            xv = eq | down[w]
            eq = eq | minus
            xh = (((eq & up[w]) + up[w]) ^ up[w]) | eq
            ph, mh = down[w] | ~(xh | up[w]), up[w] & xh
            end = last if w == words - 1 else _TOP
            plus_out, minus_out = (ph >> end) & _ONE, (mh >> end) & _ONE
            ph, mh = (ph << _ONE) | plus, (mh << _ONE) | minus
            up[w], down[w] = mh | ~(xv | ph), ph & xv
            plus, minus = plus_out, minus_out
        score = score + plus.astype(np.int64) - minus.astype(np.int64)
        step += 1
        if step % LOOK == 0:
            # each character that is left lowers the distance by one at most
            keep = score - (length - step) <= most
            if not keep.all():
                result[live[~keep]] = (score - (length - step))[~keep]
                live, length, size, begin, score, last, pattern, most = (x[keep] for x in (live, length, size, begin, score, last, pattern, most))
                up, down = np.ascontiguousarray(up[:, keep]), np.ascontiguousarray(down[:, keep])
    return result
