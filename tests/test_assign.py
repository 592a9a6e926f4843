from __future__ import annotations

import itertools
import random

import numpy as np

from kindred.operators import assign


def greedy(edges):
    out, ls, rs = [], set(), set()
    for s, l, r in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if l not in ls and r not in rs:
            out.append((l, r))
            ls.add(l)
            rs.add(r)
    return out


def frame(spark, pools):
    return spark.createDataFrame([(p, l, r, s) for p, edges in pools.items() for s, l, r in edges], "pool string, l long, r long, score double")


def sizes(spark, pools):
    return spark.createDataFrame([(p, len({l for _, l, _ in e})) for p, e in pools.items()], "pool string, n_left long")


def test_greedy_equals_the_sequential_order(spark):
    rng = random.Random(3)
    pools = {f"p{i}": [(rng.choice([0.2, 0.5, 0.9]), l, r) for l in range(5) for r in range(6) if rng.random() < 0.7] for i in range(8)}
    want = {(p, l, r) for p, e in pools.items() for l, r in greedy(e)}
    one = {(r["pool"], r["l"], r["r"]) for r in assign.assign(frame(spark, pools), sizes(spark, pools), "greedy").collect()}
    two = {(r["pool"], r["l"], r["r"]) for r in assign.greedy_rounds(frame(spark, pools)).collect()}
    assert one == want and two == want


def test_hungarian_is_optimal():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (2, 2), (5, 5), (6, 6), (2, 5), (1, 4), (4, 6)):
        for _ in range(5):
            cost = rng.random((n, m)).round(2)
            column = assign.hungarian(cost)
            assert len(set(column)) == n and max(column) < m
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            assert np.isclose(sum(cost[i, column[i]] for i in range(n)), best)


def test_hungarian_serves_more_pairs_than_greedy(spark):
    pools = {"": [(1.0, 0, 0), (0.9, 0, 1), (0.95, 1, 0), (0.8, 2, 1), (0.1, 2, 2)]}
    run = lambda mode: {(r["l"], r["r"]) for r in assign.assign(frame(spark, pools), sizes(spark, pools), mode).collect()}
    assert run("hungarian") == {(0, 1), (1, 0), (2, 2)}
    assert run("auto") == run("hungarian")
    assert {l for l, _ in run("greedy")} == {0, 2}
    pair = {"": [(1.0, 0, 0), (0.4, 0, 1), (0.4, 1, 0)]}
    assert {(r["l"], r["r"]) for r in assign.assign(frame(spark, pair), sizes(spark, pair), "hungarian").collect()} == {(0, 1), (1, 0)}
    free = {"": [(0.5, 0, 0), (0.4, 1, 1)]}
    stats = assign.assignment_stats(frame(spark, free), sizes(spark, free)).first()
    assert stats["solver"] == "greedy" and not stats["contended"]


def test_sparse_matching_is_optimal():
    """Along candidates alone the total is that of the laid-out matrix, with ties and rows that go empty."""
    rng = np.random.default_rng(1)
    for t in range(600):
        n, m = rng.integers(1, 8, 2)
        score = np.where(rng.random((n, m)) < 0.5, rng.choice([0.2, 0.5, 0.9, 1.0], (n, m)) if t % 2 else rng.random((n, m)), -1)
        l, r = np.nonzero(score >= 0)
        if not len(l):
            continue
        weight = 1 + score[l, r]
        got = assign.sparse_matching(np.unique(l, return_inverse=True)[1], np.unique(r, return_inverse=True)[1], weight)
        assert len(set(l[got])) == len(got) == len(set(r[got]))
        cost = np.full((max(n, m),) * 2, 2.0)
        cost[l, r] = 1 - score[l, r]
        column = assign.hungarian(cost)
        assert abs(weight[got].sum() - sum(2 - cost[i, column[i]] for i in range(len(cost)))) < 1e-9


def test_large_part_in_memory_of_its_candidates(spark):
    """One connected part of 20,000 rows and as many columns: no matrix of them is made."""
    import tracemalloc

    rng, n = np.random.default_rng(2), 20_000
    pairs = np.unique(np.concatenate([np.arange(n) * n + rng.integers(0, n, n), np.arange(n) * n + np.arange(n), np.arange(n) * n + (np.arange(n) + 1) % n]))
    l, r, score = (pairs // n).tolist(), (pairs % n).tolist(), rng.random(len(pairs)).tolist()
    tracemalloc.start()
    try:
        got = assign.solve(l, r, score, n, "hungarian")
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()
    assert len({l[k] for k in got}) == len(got) == len({r[k] for k in got}) > 0.99 * n
    greedy = assign.solve(l, r, score, n, "greedy")
    assert sum(1 + score[k] for k in got) >= sum(1 + score[k] for k in greedy)
