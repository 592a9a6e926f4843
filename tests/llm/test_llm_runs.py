"""Periodic runs against their definition."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from test_llm_text import corpus, frame, with_extras

from kindred.llm import periodic_runs as P

SPACED = re.compile("[^\x20\x09-\x0d]+")


def plain(words: list[str], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """Every lag, every stretch; the smallest period of a stretch is looked for among all smaller ones."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                part = words[i : j + q]
                if not any(all(part[k] == part[k + g] for k in range(len(part) - g)) for g in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed: int, n: int) -> list[list[str]]:
    rng, out = random.Random(seed), []
    for _ in range(n):
        words: list[str] = []
        for _ in range(rng.randrange(1, 6)):
            block = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 24))]
            words += block * rng.randrange(1, 9) + block[: rng.randrange(len(block))]
        out.append(words[: rng.randrange(len(words) + 1)] if rng.random() < 0.2 else words)
    return out


def test_runs_against_the_definition():
    for words in texts(5, 700):
        numbers = np.array([ord(w) for w in words], np.int64)
        tried = [lag for _, lag in P.lags(numbers, np.array([0, len(words)]))]
        assert P.runs(numbers, tried) == plain(words) if words else not tried, words


def test_lags_of_many_texts_stay_apart():
    """A stretch never goes over from one text to the next; all lags are told as for each text alone."""
    many = texts(6, 200)
    numbers = np.array([ord(w) for words in many for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum([len(w) for w in many])])
    got = P.lags(numbers, first)
    want = [(i, q) for i, words in enumerate(many) if words for _, q in P.lags(np.array([ord(w) for w in words], np.int64), np.array([0, len(words)]))]
    assert got == want


def test_few_lags_of_a_long_text():
    """A million words of stretches of all lengths: about as many lags as the root of the words, and in seconds."""
    rng = np.random.default_rng(1)
    numbers = np.concatenate([[k] * int(rng.integers(1, 3000)) for k in range(700)])
    tried = [q for _, q in P.lags(numbers, np.array([0, len(numbers)]))]
    assert 0 < len(tried) < 8 * len(numbers) ** 0.5
    assert [r for r in P.runs(numbers, tried) if r[2] == 1] == [r for r in P.runs(numbers, [1])]
    same = np.zeros(1 << 20, np.int64)
    assert P.runs(same, [q for _, q in P.lags(same, np.array([0, len(same)]))]) == [(0, 1 << 20, 1)]


def test_stretches_of_every_length():
    numbers = np.array([0, 1, 0, 1, 0, 1, 0, 1, 1, 1, 1, 1, 1, 1, 0])
    bits = P.planes(numbers)
    assert P.stretches(bits, len(numbers), 2, 8) == [(0, 8)]
    assert P.stretches(bits, len(numbers), 1, 6) == [(7, 7)]
    assert P.stretches(bits, len(numbers), 1, 8) == []


def expected(doc_id, text):
    words = SPACED.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.fixture(scope="module")
def rows():
    short = [t for t in corpus()[:70] if t[1] is None or len(t[1]) < 6000]
    odd = [(1000 + i, "   ".join(w) if i % 9 == 0 else "\t".join(w)) for i, w in enumerate(texts(8, 120))]
    return short + odd + [(None, "a b a b a b a b a b c"), (None, None), (7, ""), (7, ""), (7, "x " * 9), (7, "x " * 9), (-3, "é é é é é é ü"), (20, "x")]


def test_op11_against_the_definition(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = P.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == names
    key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
    want = [expected(*r) for r in rows]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5 and sum(r[1] > 1 for r in want) > 20
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_find_runs_keeps_columns(spark):
    df = with_extras(frame(spark, [(1, "a b " * 5), (2, None), (None, "q")]))
    got = {r["doc_id"]: r for r in P.find_runs(df).collect()}
    assert got[1]["runs"] == [(0, 10, 2)] and got[1]["collapsed"] == "a b" and got[1]["n_words"] == 10 and got[1]["_text"] == "y"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == "" and got[None]["collapsed"] == "q"
    assert P.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.find_runs(df, times=3)
