"""Token ids against the library's own, the wavelet matrix against a plain array, shards read back."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_llm_text import corpus, frame, with_extras

from kindred.llm import token_ids, token_output, wavelet

ODD = ["a", "b", "Z", "é", "ß", "ñ", "日", "本", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "'t", "'ll", "'", "''", "1", "23", "²", ".", "!?", "-", " ", "　", " ", "\u0085", "\x1c", "\x00", "😀", "é", "<|endoftext|>", "<|", "|>", " the", " it's", "½", "٠", "_"]


def library(texts):
    return [x.ids for x in token_ids.encoder().library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(4))
def test_ids_equal_the_librarys(seed):
    """Odd characters, runs of one byte, contractions, white space of all kinds, strings of the special token, nulls."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(2500)]
    texts += [c * k for c in "a '\n\t1.é日" for k in (1, 2, 3, 50, 1000)] + [None, "", "<|endoftext|>"] + [t for _, t in corpus(seed)]
    rng.shuffle(texts)
    ids, first = token_ids.encoder().encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == library(texts)


def test_long_texts_are_cut_into_windows(monkeypatch):
    monkeypatch.setattr(token_ids, "SLICE_BYTES", 600)
    monkeypatch.setattr(token_ids, "REMEMBERED", 40)
    rng = random.Random(9)
    texts = ["".join(rng.choice(ODD[:33]) for _ in range(3000)), "x" * 5000, "日" * 900, " ".join(str(rng.random()) for _ in range(400)), "short", ""]
    own = token_ids.Encoder()
    ids, first = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == library(texts)
    assert len(own._windows(np.frombuffer(texts[0].encode(), np.uint8))) > 5


def test_other_vocabularies_are_read_whole():
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    own = token_ids.encoder(path)
    texts = ["A b  c", None, "don't stop", "x" * 50]
    ids, first = own.encode(pa.array(texts))
    assert not own.apart and [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [own.library.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("n", "top", "block"), [(0, 1, 64), (1, 1, 64), (1000, 2, 64), (5000, 50_000, 256), (3000, 100_000, 1 << 16), (513, 1 << 20, 512)])
def test_matrix_against_an_array(monkeypatch, n, top, block):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", block)
    rng = np.random.default_rng(n)
    ids = (rng.random(n) ** 4 * top).astype(np.uint32)
    data = wavelet.encode(ids, [None, 5], np.array([n // 3, n - n // 3]))
    read: list[int] = []

    def part(at, size):
        read.append(size)
        return data[at : at + size]

    m = wavelet.Matrix(part)
    assert m.doc_ids() == [None, 5] and m.lengths().tolist() == [n // 3, n - n // 3] and m.tokens == n
    assert m.decode().tolist() == ids.tolist()
    places = rng.integers(0, n, 50) if n else np.zeros(0, int)
    assert m.access(places).tolist() == ids[places].tolist()
    for token in {0, 1, top - 1, top, top * 2, *ids[:5].tolist()}:
        assert m.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist() and m.count(token) == (ids == token).sum()
        assert m.count(token, n // 4, n // 2) == (ids[n // 4 : n // 2] == token).sum()
        assert m.occurrences(token, n // 4, n // 2).tolist() == (np.flatnonzero(ids[n // 4 : n // 2] == token) + n // 4).tolist()
    for plane in range(m.planes if n else 0):
        for bit in (0, 1):
            total = int(m.rank(plane, bit, np.array([n]))[0])
            assert m.rank(plane, bit, m.select(plane, bit, np.arange(total))).tolist() == list(range(total))
    with pytest.raises(IndexError):
        m.access(np.array([n]))
    with pytest.raises(ValueError):
        wavelet.Matrix(lambda at, size: b"nothing here"[at : at + size])


def test_lookups_read_few_blocks():
    ids = np.random.default_rng(2).integers(0, 50_000, 1 << 20).astype(np.uint32)
    data, read = wavelet.encode(ids, [1], np.array([len(ids)])), []

    def part(at, size):
        read.append(size)
        return data[at : at + size]

    m = wavelet.Matrix(part)
    assert m.count(77) == (ids == 77).sum() and sum(read) < len(data) / 4
    assert len(data) < 1.05 * 2 * len(ids)


def written(rows, end=0):
    """(doc_id, ids) in the order of the files."""
    ids = library([t for _, t in rows])
    return sorted(((i, x + [end]) for (i, _), x in zip(rows, ids)), key=lambda r: (r[0] is None, r[0] or 0))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op13_against_the_library(spark, tmp_path):
    rows = corpus(3, 80)
    random.Random(1).shuffle(rows)
    rows += [(None, "no id"), (900, "<|endoftext|> as a string"), (901, "x" * 30_000), (-5, "first of all")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = token_output.op13_token_output(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want, at = [], 0
    for i, ids in written(rows):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, got.collect()), key=key) == want


def test_shards_of_uneven_ranges(spark, tmp_path):
    """Many rows of one id and one text, texts longer than a shard, repeated and nameless rows: every row is there, in order, and lookups agree."""
    from pyspark.sql import functions as F

    rows = [(7, "the same text here")] * 150 + [(3, "long text " * 400), (8, None), (None, "x"), (None, None), (2, ""), (9, "a b"), (9, "a c"), (9, "a b")]
    folder = str(tmp_path / "out")
    token_output.write_tokens(with_extras(frame(spark, rows)), folder, end=11, shard_tokens=100)
    shards = token_output.manifest(spark, folder).orderBy("start").collect()
    assert len(shards) > 6 and [s["start"] for s in shards] == [0, *np.cumsum([s["n_tokens"] for s in shards])[:-1].tolist()]
    longest = max(len(x) for _, x in written(rows))
    assert max(s["n_tokens"] for s in shards) < 100 + longest and sum(s["n_docs"] for s in shards) == len(rows)
    got = sorted(map(tuple, token_output.read_tokens(spark, folder).collect()), key=lambda r: r[1])
    want = written(rows, 11)
    assert [r[0] for r in got] == [i for i, _ in want] and sorted(bytes(r[3]) for r in got) == sorted(np.array(x, "<u4").tobytes() for _, x in want)
    every = np.concatenate([np.frombuffer(bytes(r[3]), "<u4") for r in got])
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    asked = [11, int(every[0]), int(every[5]), 60_000]
    assert {r["token"]: r["n"] for r in token_output.token_counts(spark, folder, asked).collect()} == {t: int((every == t).sum()) for t in asked}
    found = token_output.occurrences(spark, folder, asked)
    assert sorted((r["place"], r["token"]) for r in found.collect()) == sorted((int(p), t) for t in set(asked) for p in np.flatnonzero(every == t))
    starts = {r[1]: r[0] for r in got}
    assert all(starts[r["place"] - r["at"]] == r["doc_id"] for r in found.where(F.col("token") == 11).collect())
    places = [0, 5, 199, 200, len(every) - 1]
    assert {r["place"]: r["token"] for r in token_output.tokens_at(spark, folder, places).collect()} == {p: int(every[p]) for p in places}
    assert token_output.tokens_at(spark, folder, []).count() == 0


def test_empty_table(spark, tmp_path):
    token_output.write_tokens(frame(spark, [(1, "x")]).limit(0), str(tmp_path / "none"))
    assert token_output.read_tokens(spark, str(tmp_path / "none")).count() == 0
