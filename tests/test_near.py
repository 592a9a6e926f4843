"""What lies near without pairs: sums and links of groups, in tasks and in blocks, and what is shuffled for them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import graph, hamming
from test_hamming import clustered, frame


def crowd(seed: int, n: int) -> list[int]:
    """Copies, near ones, and a crowd that agrees in the first 40 bits, so that it is one group of several bands."""
    rng = random.Random(seed)
    return clustered(rng, n) + [rng.getrandbits(40) | 5 << 90 for _ in range(n)]


@pytest.mark.parametrize(("radius", "hot", "small"), [(4, 1 << 16, 48), (4, 40, 8), (12, 1 << 16, 2), (0, 1 << 16, 48), (12, 30, 48)])
def test_counts_and_links_of_a_scan(spark, monkeypatch, radius, hot, small):
    monkeypatch.setattr(hamming, "HOT", hot)
    monkeypatch.setattr(hamming, "HOT_BLOCK", 16)
    monkeypatch.setattr(hamming, "SMALL", small)
    values = crowd(radius + hot, 150)
    want = [(i, values.index(v), sum((v ^ w).bit_count() <= radius for w in values) - 1) for i, v in enumerate(values)]
    assert sorted(map(tuple, hamming.linked_counts(frame(spark, values), radius).collect())) == want
    members, links = hamming.linked_classes(frame(spark, values), radius)
    found = {r["id"]: r["component"] for r in graph.components(links).collect()}
    root = list(range(len(values)))
    for i in root:  # noqa: B007
        for j, w in enumerate(values):
            if (values[i] ^ w).bit_count() <= radius and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert {r["id"]: found.get(r["first"], r["first"]) for r in members.collect()} == dict(enumerate(root))


def test_near_ones_make_no_pairs(spark):
    """Of a crowd in which all are near each other there are at most as many links as rows in each band, and one row a signature for a wide radius' band."""
    values = [1 << i | 1 << j for i in range(40) for j in range(i)]
    _, links = hamming.linked_classes(frame(spark, values), 4)
    assert len(values) - 1 <= links.count() <= 5 * len(values)
    rows = frame(spark, values).select(*hamming.halves()).distinct().withColumn("w", F.lit(1))
    plan = hamming.near_counts(rows, 12)._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "Join" not in plan and {r["n"] for r in hamming.near_counts(rows, 12).collect()} == {len(values) - 1}


def test_mining_keeps_no_strings(spark, monkeypatch):
    """What is mined is kept and shuffled without strings: those of classes that share a cluster are read where they lie."""
    from kindred.operators import family
    from kindred.plans import lineage, whole

    kept = []
    monkeypatch.setattr(family, "cut", lambda df: kept.append(df.columns) or lineage.cut(df))
    entries = whole.catalogue.QUERIES["family_mined"](spark, "/root/testdata/sf0.001")
    assert entries.count() and kept and not any({"useful", "strings", "methods"} & set(columns) for columns in kept)
    text = entries._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert not [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "useful" in line]
