"""Pairs spread along references, in rounds that carry places alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.operators import diff
from kindred.plans import whole
from kindred.plans.lineage import cut

PARTS = ("cls", "fld", "mth", "code")


def builds(spark, n: int, links, changed=None):
    ids = spark.range(n).select(F.col("id").alias("n"))
    body = F.substring(F.sha2(F.col("n").cast("string"), 256), 1, 12)
    other = body if changed is None else F.when(changed, F.repeat(F.lit("z"), F.lit(12))).otherwise(body)
    sig = F.struct(*[F.pmod(F.xxhash64("n", F.lit(p)), F.lit(1 << 32)).alias(p) for p in PARTS])
    return tuple(cut(whole.linked_classes(ids, build, b, sig, links)) for build, b in (("one", body), ("two", other)))


def test_rounds_and_gates(spark):
    """A chain: each class refers to the next; a class that changed too much is no pair and stops the spread."""
    one, two = builds(spark, 30, [F.col("n") + 1], F.col("n") == 4)
    got = diff.propagate(whole.seeded(one, two, F.col("l") == 0), one, two, 0.8).collect()
    assert {(r["l"], r["r"], r["ord"]["stage"]) for r in got} == {(k, k, 2 * k + 1) for k in range(1, 4)}
    assert all(r["a"]["descriptor"] == r["lhs"] and r["b"]["descriptor"] == r["rhs"] and r["provenance"] == "propagated" for r in got)
    few = diff.propagate(whole.seeded(one, two, F.col("l") == 0), one, two, 0.8, most_rounds=2)
    assert {r["l"] for r in few.collect()} == {1, 2}


def test_a_limit_that_was_asked_for(spark):
    one, two = builds(spark, 21, [F.col("n") * 4 + i for i in (1, 2, 3, 4)])
    seeds = whole.seeded(one, two, F.col("l") == 0)
    assert diff.propagate(seeds, one, two, 0.8, most_rounds=2).count() == 20
    assert {r["l"] for r in diff.propagate(seeds, one, two, 0.8, most_rounds=2, most_frontier=4).collect()} == {1, 2, 3, 4}


def test_a_frontier_of_many_classes(spark):
    """1,620 pairs refer to 51,840 free classes a side: all are found in one round."""
    seeds, each = 1620, 32
    one, two = builds(spark, seeds * (each + 1), [seeds + F.col("n") * each + i for i in range(each)])
    got = diff.propagate(whole.seeded(one, two, F.col("l") < seeds), one, two, 0.8, most_rounds=1)
    assert got.count() == seeds * each and got.where("l <> r").isEmpty()


def most_broadcast(spark, run) -> int:
    """The most rows that a broadcast held while a function ran, by the metrics of its plans."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    every = lambda: [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]
    bus.waitUntilEmpty()
    before = set(every())
    run()
    bus.waitUntilEmpty()
    found = []
    for n in set(every()) - before:
        nodes, told = store.planGraph(n).allNodes(), store.executionMetrics(n)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name().startswith("BroadcastExchange"):
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                found += [int(told.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and told.contains(m.accumulatorId())]
    assert found
    return max(found)


def test_sides_are_not_broadcast(spark):
    """What a round asks for is sent to the classes, never all classes to what it asks for: 9 classes in 16 tables are the most here."""
    one, two = builds(spark, 4000, [3 * F.col("n") + i for i in (1, 2, 3)])
    seeds = cut(whole.seeded(one, two, F.col("l") == 0))
    assert most_broadcast(spark, lambda: diff.propagate(seeds, one, two, 0.8, most_rounds=2).count()) < 400


def test_a_round_that_asks_for_much_is_shuffled(spark, monkeypatch):
    """Rows beyond MOST_DEALT are not sent; the pairs are those of few rows."""
    one, two = builds(spark, 40, [3 * F.col("n") + i for i in (1, 2, 3)], F.col("n") == 2)
    seeds = cut(whole.seeded(one, two, F.col("l") == 0))
    spread = lambda: {(r["l"], r["r"], r["ord"]["stage"], r["a"]["pos"], r["b"]["pos"]) for r in diff.propagate(seeds, one, two, 0.8, most_rounds=2).collect()}
    sent = spread()
    monkeypatch.setattr(diff, "MOST_DEALT", 0)
    assert spread() == sent == {(k, k, s, k, k) for k, s in ((1, 3), (3, 3), (4, 5), (5, 5), (6, 5), (10, 5), (11, 5), (12, 5))}
