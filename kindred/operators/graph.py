"""Graphs: connected components, closure of a parent relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.lineage import cut


def _edges(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


#: Edges that one task takes; a round over fewer edges than the session's partitions could hold takes fewer tasks.
TASK_EDGES = 20_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (id, component) per vertex with an edge.

    component is the smallest id reachable. Alternates large-star and small-star rounds (each a
    shuffle with map-side minima, each checkpointed), so the rounds grow with the logarithm of a
    component's size. A vertex with very many edges meets only in a min() that is combined before
    the shuffle and in a join that Spark can split.
    """
    now = cut(_edges(edges, "a", "b"))
    measure = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    state = measure(now)
    for _ in range(most_rounds):
        few = lambda df, n=state[0] // TASK_EDGES + 1: df.coalesce(n)
        now = few(now)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = few(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))).select("v", F.least("v", "m").alias("m"))
        large = few(_edges(few(both.join(low, both.a == low.v)).where("b > a").select("b", "m"), "b", "m"))
        down = large.select(F.col("b").alias("v"), F.col("a").alias("u"))
        least = few(down.groupBy("v").agg(F.min("u").alias("m")))
        small = few(down.join(least, "v")).select(F.explode(F.array("u", "v")).alias("x"), "m")
        now = cut(few(_edges(small, "x", "m")))
        after = measure(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components: no end after {most_rounds} rounds")
    return now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).union(now.select("a", "a").distinct()).distinct()


def closure(parents: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(node, ancestor, depth) of a relation (node, parent): the least depth of each ancestor; cycles end.

    By path doubling: with all ancestors up to depth d known, those up to 2 d are theirs who are exactly d
    up, so there are as many rounds as the depth has binary digits. Raises beyond a depth that was given.
    """
    found, reach = cut(parents.select("node", F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(1))), 1
    while True:
        if most_depth is not None and not found.where(F.col("depth") > most_depth).isEmpty():
            raise RuntimeError(f"closure: deeper than {most_depth}")
        last = found.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("_w"))
        if last.isEmpty():
            return found
        on = last.join(found.select(F.col("node").alias("_w"), "ancestor", "depth"), "_w").select("node", "ancestor", (F.col("depth") + reach).alias("depth"))
        found = cut(found.unionByName(on).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        reach *= 2


def marks_above(parents: DataFrame, marks: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, mark): of a relation (node, parent) with one parent a node, and bits (node, mark), the bits of all
    ancestors together; nodes with none are left out.

    By pointer doubling: a row a node, whose pointer goes twice as far up in each round, so a chain of any
    depth takes as many rounds as its depth has binary digits, and no row for each of its ancestors. Cycles end
    when a round adds no bit.
    """
    bits = marks.groupBy("node").agg(F.bit_or("mark").alias("mark")).select(F.col("node").alias("up"), F.col("mark").alias("_own"))
    state = cut(parents.select("node", F.col("parent").alias("up")).join(bits, "up", "left").select("node", "up", F.coalesce("_own", F.lit(0).cast("long")).alias("mark")))
    for _ in range(most_rounds):
        above = state.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("mark").alias("_mark"))
        both = state.join(above, F.col("up") == F.col("_n"), "left")
        after = both.select("node", F.col("_up").alias("up"), F.col("mark").bitwiseOR(F.coalesce("_mark", F.lit(0).cast("long"))).alias("mark"), (F.col("mark").bitwiseOR(F.coalesce("_mark", F.lit(0).cast("long"))) != F.col("mark")).alias("_new"))
        after = cut(after)
        state = after.drop("_new")
        if after.where("_new").isEmpty():
            return state.where("mark <> 0").select("node", "mark")
    raise RuntimeError(f"marks_above: no end after {most_rounds} rounds")
