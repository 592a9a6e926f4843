"""One-to-one assignment within pools.

Greedy takes pairs by (score descending, l, r). A pool of few candidates is solved in one place,
Hungarian or greedy; a larger one by rounds in which every pair that is the best of both its ends is
taken, which gives the same pairs as the sequential order. Hungarian maximises the sum of (1 + score),
part by part; a part takes memory in proportion to its candidates, not to rows times columns.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.grouped import whole_groups
from kindred.plans.lineage import cut
from kindred.schema import HUNGARIAN_LIMIT
from kindred.session import ship

#: Candidates of a pool that one task solves.
SMALL = 20_000
#: Rows times columns of a connected part up to which all are laid out; a larger part is solved along its candidates alone.
DENSE = 1 << 18


def greedy_rounds(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(pool, l, r, score) kept by greedy matching of candidate rows, by locally dominant pairs."""
    left, out = cut(edges.select("pool", "l", "r", "score")), None
    order = [F.desc("score"), F.asc("l"), F.asc("r")]
    for _ in range(most_rounds):
        best_l = F.row_number().over(Window.partitionBy("pool", "l").orderBy(*order))
        best_r = F.row_number().over(Window.partitionBy("pool", "r").orderBy(*order))
        taken = cut(left.withColumn("_l", best_l).withColumn("_r", best_r).where("_l = 1 and _r = 1").drop("_l", "_r"))
        out = taken if out is None else out.unionByName(taken)
        left = cut(left.join(taken.select("pool", "l"), ["pool", "l"], "left_anti").join(taken.select("pool", "r"), ["pool", "r"], "left_anti"))
        if left.isEmpty():
            return out
    raise RuntimeError("greedy_rounds: no end")


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row at the least total, for no more rows than columns (shortest augmenting paths)."""
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # the last column is where a path starts
    for row in range(n):
        owner[m] = row
        at, reach, back, done = m, np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            r = owner[at]
            free = ~done[:m]
            slack = cost[r] - row_price[r] - col_price[:m]
            closer = free & (slack < reach[:m])
            reach[:m][closer], back[:m][closer] = slack[closer], at
            nxt = int(np.argmin(np.where(free, reach[:m], np.inf)))
            step = reach[nxt]
            row_price[owner[done]] += step
            col_price[done] -= step
            reach[~done] -= step
            at = nxt
        while at != m:
            owner[at] = owner[back[at]]
            at = back[at]
    column = np.empty(n, int)
    taken = np.flatnonzero(owner[:m] >= 0)
    column[owner[taken]] = taken
    return column


def sparse_matching(l: np.ndarray, r: np.ndarray, weight: np.ndarray) -> list[int]:
    """Candidates of the greatest total weight, at most one per row and column; weights above 0, rows and columns numbered from 0.

    Shortest augmenting paths along candidates alone: memory grows with them, not with rows times columns.
    A row may give its column up for a place of its own that weighs nothing.
    """
    n, m = int(l.max()) + 1, int(r.max()) + 1
    top = float(weight.max())
    order = np.lexsort((r, l))
    first = np.searchsorted(l[order], np.arange(n + 1)).tolist()
    columns, cost, edge = r[order].tolist(), (top - weight[order]).tolist(), order.tolist()
    row_price, col_price = [0.0] * n, [0.0] * m
    owner, taken = [-1] * m, [-1] * n  # a column's row; a row's place among the candidates
    for start in range(n):
        reach, back, done, popped, free = {}, {}, set(), [], -1
        heap: list[tuple[float, int]] = []
        row, base, end, last = start, 0.0, 0.0, -1
        least_own = (np.inf, -1)
        while True:
            # the row's own place ends a path
            own = base + top - row_price[row]
            if own < least_own[0]:
                least_own = (own, row)
            for k in range(first[row], first[row + 1]):
                j = columns[k]
                if j not in done:
                    far = base + cost[k] - row_price[row] - col_price[j]
                    if far < reach.get(j, np.inf):
                        reach[j], back[j] = far, k
                        heapq.heappush(heap, (far, j))
            while heap and (heap[0][1] in done or heap[0][0] > reach[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or least_own[0] <= heap[0][0]:
                end, last = least_own
                break
            base, j = heapq.heappop(heap)
            done.add(j)
            if owner[j] < 0:
                end, free = base, j
                break
            popped.append((j, base))
            row = owner[j]
        row_price[start] += end
        for j, at in popped:
            col_price[j] -= end - at
            row_price[owner[j]] += end - at
        if free < 0 and taken[last] >= 0:  # a row gives its column up; else the new row gets none
            free, taken[last] = columns[taken[last]], -1
        while free >= 0:
            k = back[free]
            row = _row_of(first, k)
            before = columns[taken[row]] if taken[row] >= 0 else -1
            owner[free], taken[row] = row, k
            free = before if row != start else -1
    return [edge[k] for k in taken if k >= 0]


def _row_of(first: list[int], k: int) -> int:
    return bisect.bisect_right(first, k) - 1


def _greedy(l: list[int], r: list[int], score: list[float]) -> list[int]:
    out, seen_l, seen_r = [], set(), set()
    for k in sorted(range(len(l)), key=lambda k: (-score[k], l[k], r[k])):
        if l[k] not in seen_l and r[k] not in seen_r:
            out.append(k)
            seen_l.add(l[k])
            seen_r.add(r[k])
    return out


def _best(l: list[int], r: list[int], score: list[float]) -> list[int]:
    """Optimal choice among the candidates of one connected part; one at most per row and column."""
    if len(l) == 1:
        return [0]
    rows, columns = sorted(set(l)), sorted(set(r))
    if len(rows) == 1 or len(columns) == 1:
        return [min(range(len(l)), key=lambda k: (-score[k], l[k], r[k]))]
    if len(rows) > len(columns):
        rows, columns, l, r = columns, rows, r, l
    at_l, at_r = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(columns)}
    if len(rows) * len(columns) > DENSE:
        return sparse_matching(np.array([at_l[x] for x in l]), np.array([at_r[x] for x in r]), 1.0 + np.array(score))
    cost, which = np.full((len(rows), len(columns)), 2.0), np.full((len(rows), len(columns)), -1)
    for k in range(len(l)):
        i, j = at_l[l[k]], at_r[r[k]]
        if 1.0 - score[k] < cost[i, j]:
            cost[i, j], which[i, j] = 1.0 - score[k], k
    column = hungarian(cost)
    return [int(which[i, column[i]]) for i in range(len(rows)) if which[i, column[i]] >= 0]


def solve(l: list[int], r: list[int], score: list[float], n_left: int, mode: str) -> list[int]:
    """Indices of the chosen candidates of one pool, in the order of assignment; n_left counts left rows without any.

    The optimum is found part by part: rows and columns that no chain of candidates connects don't compete.
    """
    n_right = len(set(r))
    if mode == "auto":
        mode = "hungarian" if max(n_left, n_right) <= HUNGARIAN_LIMIT and n_right < len(r) else "greedy"
    if mode == "greedy":
        return _greedy(l, r, score)
    parent: dict[tuple[str, int], tuple[str, int]] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(l, r):
        parent[root(("l", a))] = root(("r", b))
    parts: dict[tuple[str, int], list[int]] = {}
    for k, a in enumerate(l):
        parts.setdefault(root(("l", a)), []).append(k)
    chosen = [own[i] for own in parts.values() for i in _best([l[k] for k in own], [r[k] for k in own], [score[k] for k in own])]
    return sorted(chosen, key=lambda k: l[k])


def assign(candidates: DataFrame, sizes: DataFrame, mode: str = "auto") -> DataFrame:
    """(pool, l, r, score, nth): candidates (pool, l, r, score) chosen, nth in the order of assignment.

    sizes: (pool, n_left), the left rows of each pool that ask for a partner.
    """
    spark = candidates.sparkSession
    ship(spark)
    stats = candidates.groupBy("pool").agg(F.count("*").alias("n"), F.countDistinct("r").alias("n_right")).join(sizes, "pool")
    small = F.col("n") <= SMALL
    if mode == "hungarian":
        small = F.lit(True)
    elif mode == "auto":
        small = small | (F.greatest("n_left", "n_right") <= HUNGARIAN_LIMIT)
    dealt = cut(candidates.select("pool", "l", "r", F.col("score").cast("double").alias("score")).join(stats.select("pool", "n_left", small.alias("small")), "pool"))

    def run(batches):
        for table in whole_groups(batches, "pool"):
            pools, l, r, score, n_left = (table[c].to_pylist() for c in ("pool", "l", "r", "score", "n_left"))
            rows, nth, start = [], [], 0
            for end in range(1, len(pools) + 1):
                if end == len(pools) or pools[end] != pools[start]:
                    order = sorted(range(start, end), key=lambda k: (l[k], r[k]))
                    chosen = [order[i] for i in solve([l[k] for k in order], [r[k] for k in order], [score[k] for k in order], n_left[start], mode)]
                    rows += chosen
                    nth += range(len(chosen))
                    start = end
            got = table.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([got[c].combine_chunks() for c in ("pool", "l", "r", "score")] + [pa.array(nth, pa.int64())], names=["pool", "l", "r", "score", "nth"])

    small_rows = dealt.where("small").drop("small").repartition("pool").sortWithinPartitions("pool")
    solved = small_rows.mapInArrow(run, "pool string, l long, r long, score double, nth long")
    large = dealt.where("not small")
    if large.isEmpty():
        return solved
    rounds = greedy_rounds(large)
    by = Window.partitionBy("pool").orderBy(F.desc("score"), "l", "r")
    return solved.unionByName(rounds.withColumn("nth", (F.row_number().over(by) - 1).cast("long")))


def assignment_stats(candidates: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pool, n_left, n_right, contended, solver): what `auto` decides for each pool."""
    per = candidates.groupBy("pool").agg(F.countDistinct("r").alias("n_right"), F.count("*").alias("n"))
    rows = per.join(sizes, "pool").withColumn("contended", F.col("n") > F.col("n_right"))
    solver = F.when((F.greatest("n_left", "n_right") <= HUNGARIAN_LIMIT) & F.col("contended"), "hungarian").otherwise("greedy")
    return rows.select("pool", "n_left", "n_right", "contended", solver.alias("solver"))
