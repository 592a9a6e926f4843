"""Closures, marks along chains, medoids and weighted prefix filters against plain computations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import anchors, changes, family, graph
from kindred.plans import lineage

SIG = "struct<cls:bigint,fld:bigint,mth:bigint,code:bigint>"


def counted(monkeypatch):
    """How many times graph operators cut lineage."""
    calls = []
    monkeypatch.setattr(graph, "cut", lambda df: calls.append(1) or lineage.cut(df))
    return calls


def plain_closure(edges):
    out = {}
    for start in {a for a, _ in edges}:
        level, depth = {start}, 0
        while level:
            depth += 1
            level = {b for a, b in edges if a in level and (start, b) not in out}
            out |= {(start, b): depth for b in level}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closure_against_a_search(spark, seed):
    """Several parents, joins of paths of unlike length, and cycles: the least depth of each ancestor."""
    rng = random.Random(seed)
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(30)} | {(100 + i, 101 + i) for i in range(21)}
    got = graph.closure(spark.createDataFrame(sorted(edges), "node long, parent long"))
    assert {(r["node"], r["ancestor"]): r["depth"] for r in got.collect()} == plain_closure(edges)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    calls = counted(monkeypatch)
    chain = spark.range(300).select(F.col("id").alias("node"), (F.col("id") + 1).alias("parent"))
    got = graph.closure(chain)
    assert got.count() == 300 * 301 // 2 and got.where("depth <> ancestor - node").isEmpty() and len(calls) <= 11
    with pytest.raises(RuntimeError):
        graph.closure(chain, 20)
    calls.clear()
    chain = spark.range(10_000).select(F.col("id").alias("node"), (F.col("id") + 1).alias("parent"))
    marks = spark.createDataFrame([(10_000, 1), (5_000, 2), (5_000, 4), (77, 8)], "node long, mark long")
    rows = graph.marks_above(chain, marks)
    assert len(calls) < 20
    want = {i: 1 | 6 * (i < 5_000) | 8 * (i < 77) for i in range(10_000)}
    assert {r["node"]: r["mark"] for r in rows.collect()} == want


def test_marks_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (9, 9)], "node long, parent long")
    marks = spark.createDataFrame([(2, 1)], "node long, mark long")
    assert {tuple(r) for r in graph.marks_above(edges, marks).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert graph.marks_above(edges.limit(0), marks).count() == 0


def test_component_labels_of_deep_and_shared_chains(spark):
    rows = [("LA;", "LB;", []), ("LB;", "LC;", ["Landroid/app/Service;"]), ("LC;", "Landroid/app/Application;", []), ("LD;", None, ["Landroid/telephony/SmsMessage;"]), ("LE;", "LE;", []), ("LF;", "Landroid/app/Service;", ["Landroid/app/Service;"])]
    rows += [(f"Lx{i};", f"Lx{i + 1};", []) for i in range(40)] + [("Lx40;", "Landroid/content/ContentProvider;", [])]
    got = {r["descriptor"]: r["codes"] for r in changes.component_labels(spark.createDataFrame(rows, "descriptor string, superclass string, interfaces array<string>")).collect()}
    # an interface counts for its own class alone
    assert got == {"LA;": ["APP"], "LB;": ["APP", "SVC"], "LC;": ["APP"], "LD;": ["SMS"], "LF;": ["SVC"]} | {f"Lx{i};": ["PRV"] for i in range(41)}


@pytest.mark.parametrize("sample", [None, 7])
def test_medoids_against_all_distances(spark, sample):
    rng = random.Random(3)
    members = [(c, rng.choice([5, 9, 0xF0, 1 << 127, rng.getrandbits(128)])) for c in "ab" for _ in range(40)] + [("alone", 1), ("alone", 1), ("two", 3), ("two", 4)]
    want = {}
    for c in {c for c, _ in members}:
        own = sorted(v for k, v in members if k == c)
        first = sorted(set(own), key=lambda v: v)
        tried = [v for v in first if sample is None or own.index(v) < sample]
        total, best = min((sum((v ^ w).bit_count() for w in own), v) for v in tried)
        want[c] = (best, max((best ^ w).bit_count() for w in own))
    sig = lambda v: tuple((v >> s) & 0xFFFFFFFF for s in (96, 64, 32, 0))
    got = family.medoids(spark.createDataFrame([(c, sig(v)) for c, v in members], f"cluster string, sig {SIG}"), sample)
    assert {r["cluster"]: (sum(x << s for x, s in zip(r["sig"], (96, 64, 32, 0))), r["max_dist"]) for r in got.collect()} == want


def test_medoid_of_a_large_cluster(spark):
    """Ten thousand unlike members: no pair of them is made, and the winner is that of all summed distances."""
    import numpy as np

    rows = spark.range(10_000).select(F.lit("c").alias("cluster"), F.struct(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 32)).alias(p) for k, p in enumerate(("cls", "fld", "mth", "code"))]).alias("sig"))
    got = family.medoids(rows, None).first()
    x = np.array([[*r["sig"]] for r in rows.collect()], np.uint64)
    bits = np.concatenate([(x[:, k : k + 1] >> np.arange(32, dtype=np.uint64)) & np.uint64(1) for k in range(4)], 1).astype(np.int64)
    ones = bits.sum(0)
    total = np.where(bits == 1, len(x) - ones, ones).sum(1)
    best = min((int(t), tuple(v)) for t, v in zip(total, x.tolist()))
    assert tuple(got["sig"]) == best[1]


def test_evidence_by_heavy_tokens(spark):
    """With a floor the pairs that reach it are those of the full sums, and a token in every row makes no pairs."""
    rng = random.Random(8)
    rare = [f"rare{i}" for i in range(60)]
    rows = lambda n: [("", i, t) for i in range(n) for t in {"everywhere", "often" if i % 2 else "seldom", *rng.sample(rare, rng.randrange(4))}]
    left, right = (spark.createDataFrame(rows(n), "pool string, id int, token string") for n in (150, 90))
    sizes = spark.createDataFrame([("", 240)], "pool string, n long")
    full = {(r["l"], r["r"]): r["evidence"] for r in anchors.evidence(left, right, sizes).collect()}
    assert len(full) == 150 * 90
    for floor in (0.001, 0.05, 0.2):
        got = {(r["l"], r["r"]): r["evidence"] for r in anchors.evidence(left, right, sizes, floor).collect()}
        assert got == {k: pytest.approx(v) for k, v in full.items() if v >= floor} and 0 < len(got) < 1000
    weigh = lambda df, name: df.join(anchors.token_statistics(left, right), ["pool", "token"]).select("pool", F.col("id").alias(name), "token", (F.log(F.lit(241) / (F.col("ldf") + F.col("rdf"))) / F.log(F.lit(241)) / (F.col("ldf") * F.col("rdf"))).alias("w"))
    few = anchors.candidate_pairs(weigh(left, "l"), weigh(right, "r"), 0.05).count()
    assert few <= 3 * sum(v >= 0.05 for v in full.values()) + 50
