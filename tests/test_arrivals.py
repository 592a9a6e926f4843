"""Arriving samples, whose classes come in several batches, against the batch score."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_diff import signed

from kindred.operators import family
from kindred.streaming import arrivals


def test_split_samples_score_as_whole_ones(spark, tmp_path):
    seeds = {"a": [1, 2, 3, 9, 11], "b": [2, 4, 6], "later": [1, 5, 7]}
    rows = None
    for digest, some in seeds.items():
        part = signed(spark, digest, some)
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.cache()
    entries, meta = family.curated_pack(signed(spark, "pack", [1, 2, 3, 4, 5, 6]), "odd; name, of a pack")
    folder = str(tmp_path / "in")
    for k in range(3):  # each sample comes in three files, but for one whose last class does not come
        rows.where((F.col("pos") % 3 == k) & ~((F.col("digest") == "later") & (F.col("pos") == 2))).coalesce(1).write.mode("append").parquet(folder)
    sizes = spark.createDataFrame([(d, len(s)) for d, s in seeds.items()], "digest string, n_classes int")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def score():
        arrivals.score_arrivals(stream(), sizes, entries, meta, out, checkpoint).awaitTermination(170)
        return {(r["digest"], r["pack"]): r for r in spark.read.parquet(f"{out}/scores").collect()}

    want = {(r["digest"], r["pack"]): r for r in family.match_family(rows, entries, meta)[0].collect()}
    got = score()
    assert {d for d, _ in got} == {"a", "b"} and any(r["present"] for r in got.values())
    # the last class of a sample that waited comes later: its state was kept
    rows.where("digest = 'later' and pos = 2").coalesce(1).write.mode("append").parquet(folder)
    got = score()
    assert set(got) == set(want)
    for key, r in got.items():
        assert all(r[c] == (pytest.approx(want[key][c]) if c == "score" else want[key][c]) for c in ("family", "score", "present", "total", "weight_present", "weight_total", "tier_1", "tier_2", "tier_3"))
