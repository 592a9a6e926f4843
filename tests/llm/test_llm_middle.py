"""Fill-in-middle against slices of lists of units, and its SQL."""

from __future__ import annotations

import hashlib
import random
import re
import sys

import pytest
from test_llm_text import corpus, frame, with_extras

from kindred.llm import fill_in_middle as M

POINT = re.compile(M.CODE_POINT)


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def expected(doc_id, text):
    units = list(text or "")
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not units or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text or ""), sha(text or ""))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return (doc_id, n, form, a, b - a, sha(out), sha(text))


ODD = [(None, "no id"), (None, None), (5000, None), (5001, ""), (5002, "x"), (5003, "a <P> b"), (5004, "<M>"), (5005, "<<S<P"), (5006, "<<" * 40), (5007, "\n\r\n 𝒳\x00é" * 9), (5007, "\n\r\n 𝒳\x00é" * 9), (5008, "S>" * 30), (-1, "negative")]


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for k in range(4) for i, t in corpus(k, 60)] + [(6000 + i, "<" * (i % 5) + "S><P"[: i % 4] + "M>" * (i % 3) + " ü" * i) for i in range(150)] + ODD


def test_op12_against_lists_and_sql(spark, rows, tmp_path):
    import duckdb

    rows = [(i, t.replace("\x00", "\x01") if t else t) for i, t in rows]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = M.op12_fill_in_middle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    key = lambda r: [(x is None, "" if x is None else x) for x in r]
    found = sorted(map(tuple, got.collect()), key=key)
    assert found == sorted((expected(*r) for r in rows), key=key)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(M.ORACLE).fetchall(), key=key) == found


def test_units_of_any_pattern():
    """Words with what follows them: cuts fall where a word begins, and nothing is lost."""
    word = re.compile(r"\S+")
    rng = random.Random(3)
    for i in range(400):
        text = "".join(rng.choice(["a", "bb", " ", "\n", "ü", ""]) for _ in range(rng.randrange(40)))
        n, form, prefix, middle, output = M.transform(word, text, i, 10, 50)
        starts = [m.start() for m in word.finditer(text)]
        assert n == len(starts) == M.n_units(word, text)
        assert M.restore(output, form) == text
        for low in range(n + 1):
            for high in range(low, n + 1):
                ends = [0, *starts[1:], len(text)] if starts else [0]
                want = (ends[low] if starts else len(text), ends[high] if starts else len(text))
                assert M.cuts(word, text, low, high) == want or not starts and M.cuts(word, text, 0, 0) == (len(text),) * 2


def test_memory_does_not_grow_with_the_units():
    """A text of four million units: neither pass holds as much as a byte a unit."""
    import tracemalloc

    text = "ab" * (2 << 20)
    tracemalloc.start()
    try:
        assert M.n_units(POINT, text) == len(text)
        assert M.cuts(POINT, text, 1 << 20, 3 << 20) == (1 << 20, 3 << 20)
        assert tracemalloc.get_traced_memory()[1] < 200_000
    finally:
        tracemalloc.stop()
    assert sys.getsizeof(text) > 4_000_000


def test_markers_at_the_seams():
    """Parts that end or begin with pieces of markers are told apart from the markers."""
    pieces = ["", "<", "<P", "P>", ">", "<S", "S>", "<M", "M>", "<<", "x"]
    for prefix in pieces:
        for middle in pieces:
            for suffix in pieces:
                text = prefix + middle + suffix
                if any(m in text for m in M.MARKERS):
                    continue
                assert M.restore(f"<P>{prefix}<S>{suffix}<M>{middle}", "psm") == text
                assert M.restore(f"<S>{suffix}<P>{prefix}<M>{middle}", "spm") == text
    with pytest.raises(ValueError):
        M.restore("abc", "psm")


def test_fill_in_middle_edges(spark):
    df = with_extras(frame(spark, [(1, "abc def"), (None, None)])).withColumnRenamed("score", "form")
    got = M.fill_in_middle(df)
    assert got.columns == ["doc_id", "_text", "n_words", "spans", "chunk", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert {r["doc_id"]: (r["restored"], r["_text"]) for r in got.collect()} == {1: ("abc def", "y"), None: ("", "y")}
    assert M.fill_in_middle(df.limit(0)).count() == 0
    words = M.fill_in_middle(frame(spark, [(k, "one two  three\nfour ") for k in range(40)]), unit=r"\S+").collect()
    assert {r["n"] for r in words} == {4} and {r["restored"] for r in words} == {"one two  three\nfour "}
