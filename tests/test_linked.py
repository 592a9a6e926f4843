"""Classes of equal signatures within a radius."""

from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.operators import hamming


def test_copies_make_no_pairs(spark):
    sig = lambda n: F.struct(*[(F.lit(n) if p == "cls" else F.lit(0)).cast("long").alias(p) for p in S.SIGNATURE_PARTS])
    rows = spark.range(10, 310).select("id", F.when(F.col("id") < 300, sig(0)).when(F.col("id") < 305, sig(7)).otherwise(sig((1 << 30) - 1)).alias("sig"))
    members, pairs = hamming.linked_classes(rows, 4)
    assert [tuple(sorted(r)) for r in pairs.collect()] == [(10, 300)]
    assert {r["first"] for r in members.collect()} == {10, 300, 305} and members.count() == 300
