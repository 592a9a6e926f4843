"""Methods that are alike to the letter are matched before any text is read; what a diff carries."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.operators import diff, lsh, similarity
from kindred.operators.hamming import halves
from kindred.schema import DiffOptions, classes_from_rows


def methods(rows: list[list[str]]) -> pa.Array:
    return pa.array([[{"abstract": t, "return_type": "V", "arg_count": 1, "xref_count": 1} for t in row] for row in rows])


def test_only_what_is_left_is_aligned(monkeypatch):
    """A thousand pairs of classes with four methods that are alike and one that is not: no alike one is aligned."""
    rng, read = random.Random(3), []
    made = similarity.Texts
    monkeypatch.setattr(similarity, "Texts", lambda texts: read.extend(texts) or made(texts))
    text = lambda: "".join(rng.choice("abcdef") for _ in range(24))
    left = [[text() for _ in range(5)] for _ in range(1000)]
    right = [[*reversed(row[1:]), row[0][:-1] + "z"] for row in left]
    got = similarity._rows(methods(left), methods(right)).to_pylist()
    assert len(read) == 2000
    assert all([(x["l"], x["r"], x["status"]) for x in row] == [(0, 4, "modified"), (1, 3, "matched"), (2, 2, "matched"), (3, 1, "matched"), (4, 0, "matched")] for row in got)


def test_repeated_methods_in_order():
    got = similarity._rows(methods([["aa", "aa", "ab"], []]), methods([["ab", "aa", "aa", "aa"], ["aa"]])).to_pylist()
    assert [[(x["l"], x["r"], x["status"]) for x in row] for row in got] == [[(0, 1, "matched"), (1, 2, "matched"), (2, 0, "matched"), (None, 3, "added")], [(None, 0, "added")]]


def test_bags_with_nulls(spark):
    bag = lambda *x: F.array(*[F.lit(v).cast("string") for v in x])
    row = spark.range(1).select(S.bag_jaccard(bag("a", None), bag("a", None)).alias("x"), S.bag_jaccard(bag("a", "a"), bag("a", "a")).alias("y")).first()
    assert row["x"] == 1 / 3 and row["y"] == 1.0


def test_keys_of_columns(spark):
    sig = F.struct(*[F.pmod(F.xxhash64("id", F.lit(p)), F.lit(1 << 32)).alias(p) for p in S.SIGNATURE_PARTS])
    rows = spark.range(300).select(sig.alias("sig")).select(*[h.alias(n) for h, n in zip(halves(), ("hi", "lo"))])
    for bits in (16, 40):
        got = rows.select(F.transform(lsh.bucket_keys(lsh._HALVED, 16, bits), lambda x: x["key"]).alias("a"), lsh._row_keys(16, bits).alias("b"))
        assert got.where("a <> b").isEmpty()


def test_sides_carry_no_bytecode(spark):
    rows = classes_from_rows(spark, [{"descriptor": "La/A;", "methods": [{"bytecode": b"\x0e\x12\x6e"}]}])
    side = diff.prepared(rows, DiffOptions())
    assert "bytecode" not in side.schema["c"].dataType["methods"].dataType.elementType.names
    assert side.select("c.sequence", "c.methods.abstract").first()[0] == "cme" and "sequence" not in diff._slim(side).schema["c"].dataType.names
