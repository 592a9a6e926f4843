"""Anchors: pairs told by rare tokens that both builds share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.operators.assign import assign
from kindred.operators.similarity import hierarchy_tokens
from kindred.plans.lineage import cut, sent
from kindred.schema import ANCHOR_FLOOR, FRAMEWORK_WEIGHT, HIERARCHY_WEIGHT


def framework_calls(methods: Column) -> Column:
    """The bag of framework calls, as an array."""
    return F.filter(F.flatten(F.transform(methods, lambda m: m["calls"])), S.is_framework)


def anchor_tokens(strings: Column, superclass: Column, interfaces: Column) -> Column:
    """Distinct tokens: useful strings, and framework supertypes behind a NUL."""
    return F.array_distinct(F.concat(S.useful_strings(strings), F.transform(hierarchy_tokens(superclass, interfaces), lambda t: F.concat(F.lit("\0"), t))))


def token_statistics(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pool, token, ldf, rdf): of exploded tokens (pool, id, token), those that both sides hold and how often."""
    both = left.select("pool", "id", "token", F.lit(1).alias("left")).unionByName(right.select("pool", "id", "token", F.lit(0).alias("left")))
    return both.groupBy("pool", "token").agg(F.sum("left").alias("ldf"), F.sum(1 - F.col("left")).alias("rdf")).where("ldf > 0 and rdf > 0")


def _heavy(rows: DataFrame, key: str, floor: float) -> DataFrame:
    """Of weighted tokens (pool, key, token, w), each row's heaviest: those before the lighter ones that stay below the floor together."""
    lighter = Window.partitionBy("pool", key).orderBy("w", "token")
    return rows.withColumn("_rest", F.sum("w").over(lighter)).where(F.col("_rest") >= floor - 1e-9).drop("_rest")


def candidate_pairs(one: DataFrame, two: DataFrame, floor: float) -> DataFrame:
    """(pool, l, r): of weighted tokens (pool, l, token, w) and (pool, r, token, w), the pairs whose shared weight can reach the floor.

    Tokens are ordered by (weight, token), alike on both sides. All that a pair shares is not heavier than its heaviest
    shared token and what either side has below that; so where it reaches the floor, that token is among the heavy
    ones of both. A token that many rows hold weighs little and hardly ever is.
    """
    return _heavy(one, "l", floor).select("pool", "l", "token").join(_heavy(two, "r", floor).select("pool", "r", "token"), ["pool", "token"]).select("pool", "l", "r").distinct()


def evidence(left: DataFrame, right: DataFrame, sizes: DataFrame, floor: float | None = None) -> DataFrame:
    """(pool, l, r, evidence): of tokens (pool, id, token) and pool sizes (pool, n), summed over shared tokens.

    With a floor, the pairs that reach it: only those that can are made, by their heaviest tokens, and then all
    their shared tokens are summed. Without one every pair that shares a token is a row of the answer.
    """
    stats = token_statistics(left, right).join(sizes.select("pool", "n"), "pool")
    n1 = F.col("n") + 1
    norm = F.when(F.log(n1) == 0, 1.0).otherwise(F.log(n1))
    hierarchy = F.when(F.col("token").startswith("\0"), HIERARCHY_WEIGHT).otherwise(1.0)
    share = hierarchy * (F.log(n1 / (F.col("ldf") + F.col("rdf"))) / norm) / (F.col("ldf") * F.col("rdf"))
    # told once for both sides; where few tokens are shared, all others of a side go before anything is shuffled
    weights = sent(stats.select("pool", "token", share.alias("w")))
    one = left.join(weights, ["pool", "token"]).select("pool", "token", F.col("id").alias("l"), "w")
    if floor is None or floor <= 0:
        return one.join(right.select("pool", "token", F.col("id").alias("r")), ["pool", "token"]).groupBy("pool", "l", "r").agg(F.sum("w").alias("evidence"))
    two = right.join(weights, ["pool", "token"]).select("pool", "token", F.col("id").alias("r"), "w")
    one, two = cut(one), cut(two)
    few = candidate_pairs(one, two, floor)
    shared = few.join(one, ["pool", "l"]).join(two.select("pool", "r", "token"), ["pool", "r", "token"])
    return shared.groupBy("pool", "l", "r").agg(F.sum("w").alias("evidence")).where(F.col("evidence") >= floor - 1e-9)


def seed_anchors(lhs: DataFrame, rhs: DataFrame, min_confidence: float = ANCHOR_FLOOR) -> DataFrame:
    """(pool, l, r, confidence, nth): of class frames (pool, pos, c)."""
    tokens = lambda df: df.select("pool", F.col("pos").alias("id"), F.explode(anchor_tokens(F.col("c.strings"), F.col("c.superclass"), F.col("c.interfaces"))).alias("token"))
    sizes = lhs.select("pool").unionByName(rhs.select("pool")).groupBy("pool").agg(F.count("*").alias("n"))
    # calls add at most their weight, so weaker evidence cannot reach the floor
    found = evidence(tokens(lhs), tokens(rhs), sizes, min_confidence - FRAMEWORK_WEIGHT)
    calls = lambda df, name, side: df.select("pool", F.col("pos").alias(name), framework_calls(F.col("c.methods")).alias(side))
    found = found.join(calls(lhs, "l", "_a"), ["pool", "l"]).join(calls(rhs, "r", "_b"), ["pool", "r"])
    # rounded, so that equal evidence ties in whatever order it was added up
    raw = F.round(F.col("evidence") + FRAMEWORK_WEIGHT * S.bag_jaccard(F.col("_a"), F.col("_b"), 0.0), 9)
    # read three times from here on
    scored = cut(found.select("pool", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), raw.alias("score")).where(F.least(F.lit(1.0), "score") >= min_confidence))
    asked = scored.groupBy("pool").agg(F.countDistinct("l").alias("n_left"))
    return assign(scored, asked, "greedy").select("pool", "l", "r", F.least(F.lit(1.0), "score").alias("confidence"), "nth")
