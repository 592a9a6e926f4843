"""Bit-parallel edit distances against the plain recurrence, and method matching against its definition."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import edits
from kindred.operators import similarity


def plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmn", "aé日😀x", "".join(map(chr, range(97, 400)))])
def test_distances(letters):
    rng = random.Random(letters)
    texts = ["", *("".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 20, 63, 64, 65, 130, 200]))) for _ in range(26))]
    for i in range(1, 12):  # near ones of all lengths
        t = list(texts[i])
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t) + 1) : rng.randrange(len(t) + 1) + 1] = rng.choice(["", rng.choice(letters)])
        texts.append("".join(t))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    want = np.array([plain(texts[i], texts[j]) for i, j in zip(a, b)])
    own = edits.Texts(texts)
    assert edits.distances(own, a, b, np.full(len(a), 1 << 30)).tolist() == want.tolist()
    for most in (0, 3, 70):
        got = edits.distances(own, a, b, np.full(len(a), most))
        assert (got[want <= most] == want[want <= most]).all() and (got[want > most] > most).all()
    assert (own.least(a, b) <= want).all()


def score(x, y):
    ratio = lambda a, b: 1.0 if a == b == 0 else 1.0 - abs(a - b) / max(a, b, 1)
    proto = (0.5 if x[1] == y[1] and x[1] is not None else 0.0) + 0.5 * ratio(x[2], y[2])
    longest = max(len(x[0]), len(y[0]))
    s = 0.7 * (1.0 - plain(x[0], y[0]) / longest if longest else 1.0) + (0.2 * proto + 0.1 * ratio(x[3], y[3]))
    return 1.0 if s >= 1.0 - 1e-9 else s


def expected(a, b):
    pairs = sorted((-score(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if score(x, y) >= 0.4)
    left, right = {}, {}
    for s, i, j in pairs:
        if i not in left and j not in right:
            left[i], right[j] = (j, -s), i
    rows = [(i, *left[i], "matched" if left[i][1] >= 1.0 else "modified") if i in left else (i, None, 0.0, "deleted") for i in range(len(a))]
    return rows + [(None, j, 0.0, "added") for j in range(len(b)) if j not in right]


METHODS = "array<struct<abstract:string,return_type:string,arg_count:int,xref_count:int>>"


def test_method_rows(spark):
    rng = random.Random(5)
    bodies = ["".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for _ in range(12)] + ["", "a" * 90]
    one = lambda: (rng.choice(bodies), rng.choice(["V", "I", None]), rng.randrange(3), rng.randrange(3))
    rows = [(k, [one() for _ in range(rng.randrange(9))], [one() for _ in range(rng.randrange(9))]) for k in range(150)]
    df = spark.createDataFrame(rows, f"k int, a {METHODS}, b {METHODS}")
    got = {r["k"]: [tuple(x) for x in r["m"]] for r in df.select("k", similarity.method_rows(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {k: expected(a, b) for k, a, b in rows}
    none = df.select(similarity.method_rows(F.lit(None).cast(METHODS), F.col("b")).alias("m")).first()["m"]
    assert {x["status"] for x in none} <= {"added"}


def test_large_classes(spark):
    """Three thousand methods a side: nine million pairs in blocks, in one row, in seconds."""
    make = lambda salt: F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.struct(F.translate(F.substring(F.sha2(F.concat((i % 2000 + F.lit(0)).cast("string"), F.lit(salt)), 256), 1, 12 + 30), "0123456789", "abcdefabcd").alias("abstract"), F.lit("V").alias("return_type"), (i % 4).cast("int").alias("arg_count"), F.lit(1).alias("xref_count")))
    began = time.time()
    row = spark.range(1).select(similarity.method_rows(make(""), make("")).alias("m"), similarity.method_rows(make(""), make("x")).alias("n")).first()
    assert sum(x["status"] == "matched" for x in row["m"]) == 3000 and len(row["n"]) >= 3000
    assert time.time() - began < 120
