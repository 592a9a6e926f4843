"""Near-duplicate vectors by a forest of random-projection trees.

1. Vectors that are equal component by component are one class, represented by the smallest id.
2. `trees` trees are fitted on a bounded sample of classes (`sample` rows): a node splits at the
   median of a random projection, rows within a margin of the threshold go to both sides (spill).
   Every class is routed to its leaves in every tree, and its vector is sent to each once. While a leaf is
   not meant to be split one tree says it all, and one is built.
3. All that share a leaf are compared, in single precision first, what is near the threshold again in
   double. A leaf beyond what a task takes is dealt into blocks, every two of which meet in a task. The more
   trees and the wider the margin, the fewer pairs are missed (tests measure recall by brute force).
4. A row carries the numbers of all its leaves, so each pair is counted in just one: the least leaf that
   both reach. A task thus emits sums of links and a spanning forest, which grow with its rows, not with
   its pairs. Links are summed with the classes' sizes, and the forests connected.

A tree has at most log2(sample / 8) levels (15 as it is); beyond some 30 million classes leaves grow with the
table, and their blocks with the square of a leaf. A larger `sample` moves that bound.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of unlike lengths do not link. A null id links and is counted, but never names a
component. Equal vectors link with each other. An empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from kindred.llm.minhash_forest import MOST_KEYS, _runs, by_group
from kindred.llm.shared import components, cut, partitions
from kindred.session import ship

#: Rows a leaf is meant to get; rows of a leaf that one task takes; rows compared at once; pairs looked at again at once.
SHARE, MOST, TILE, PAIRS = 1024, 8192, 1024, 1 << 18


def vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, digest, vector, size): vector holds the components as they come, float32 or float64; null where it can't link."""
    single = isinstance(df.schema[embedding].dataType, ArrayType) and isinstance(df.schema[embedding].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64

    def run(batches):
        for batch in batches:
            digests, kept, lengths = [], [], []
            for value in batch.column("embedding"):
                x = value.as_py()
                digest = raw = None
                if x and None not in x:
                    v = np.array(x, kind) + kind(0)
                    if np.isfinite(v).all() and v.any():
                        raw = v.tobytes()
                        digest = hashlib.blake2b(raw, digest_size=16).digest()
                digests.append(digest)
                kept.append(raw)
                lengths.append(len(x) if x else 0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(kept, pa.binary()), pa.array(lengths, pa.int32())], names=["vec_id", "digest", "vector", "size"])

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).mapInArrow(run, "vec_id long, digest binary, vector binary, size int")


def units(column: pa.Array, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of length one in float64, shorter ones filled with zeros."""
    values = column.to_pylist()
    if not values:
        return np.zeros((0, width))
    kind = np.float32 if len(values[0]) == 4 * sizes[0] else np.float64
    most = width * np.dtype(kind).itemsize
    if any(len(v) != most for v in values):
        values = [v.ljust(most, b"\0") for v in values]
    x = np.frombuffer(b"".join(values), kind).reshape(-1, width).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _split(x: np.ndarray, rng: np.random.Generator, spill: float) -> tuple[np.ndarray, float, float]:
    """Direction, threshold and margin of a node: the difference of two random rows, at the median."""
    i, j = rng.integers(0, len(x), 2)
    way = x[i] - x[j]
    if not np.abs(way).max() > 1e-12:
        way = rng.standard_normal(x.shape[1])
    way = way / np.sqrt((way * way).sum())
    at = x @ way
    return way, float(np.median(at)), float(spill * at.std())


def fit_tree(x: np.ndarray, depth: int, seed: int, spill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ways, thresholds and margins of a full tree's inner nodes, breadth first."""
    rng = np.random.default_rng(seed)
    n = (1 << depth) - 1
    ways, at, margin = np.zeros((n, x.shape[1])), np.zeros(n), np.zeros(n)
    rows: dict[int, np.ndarray] = {0: np.arange(len(x))}
    for node in range(n):
        mine = rows.pop(node)
        own = x[mine] if len(mine) > 1 else x
        ways[node], at[node], margin[node] = _split(own, rng, spill)
        side = x[mine] @ ways[node]
        rows[2 * node + 1], rows[2 * node + 2] = mine[side <= at[node]], mine[side > at[node]]
    return ways, at, margin


def route(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves they reach; a row near a threshold reaches leaves on both sides."""
    ways, at, margin = tree
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(depth):
        side = np.einsum("ij,ij->i", x[row], ways[node]) - at[node]
        left, right = side <= margin[node], side > -margin[node]
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node


def _met_before(leaves: np.ndarray, i: np.ndarray, j: np.ndarray, leaf: int) -> np.ndarray:
    """Which pairs of rows share a leaf of a smaller number; leaves: rows x most leaves of a row, filled with -1 - row."""
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), PAIRS):
        a, b = leaves[i[lo : lo + PAIRS]], leaves[j[lo : lo + PAIRS]]
        for k in range(a.shape[1]):
            own = a[:, k : k + 1]
            out[lo : lo + PAIRS] |= ((b == own) & (own >= 0) & (own < leaf)).any(1)
    return out


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Places of pairs that connect what all pairs connect, as a forest: in each round every root takes one pair to a smaller root."""
    label, chosen, left = np.arange(n), [], np.arange(len(i))
    while len(left):
        a, b = label[i[left]], label[j[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        high, first = np.unique(np.maximum(a, b), return_index=True)
        chosen.append(left[first])
        parent = np.arange(n)
        parent[high] = np.minimum(a, b)[first]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def leaf_links(x: np.ndarray, size: np.ndarray, side: np.ndarray, leaves: np.ndarray, leaf: int, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that no smaller leaf counts, and pairs that connect the rows.

    Where there are two sides, pairs of one side meet in a task of their own.
    """
    n = len(x)
    single = x.astype(np.float32)
    near = (x.shape[1] + 4) * 1.2e-7  # what rounding to single precision may change
    links, one, two = np.zeros(n, np.int64), [], []
    apart = bool((side != side[0]).any())
    for lo in range(0, n, TILE):
        a = slice(lo, lo + TILE)
        for up in range(lo, n, TILE):
            b = slice(up, up + TILE)
            i, j = np.nonzero(single[a] @ single[b].T >= threshold - near)
            i, j = i + lo, j + up
            keep = size[i] == size[j]
            if lo == up:
                keep &= i < j
            if apart:
                keep &= side[i] != side[j]
            i, j = i[keep], j[keep]
            for at in range(0, len(i), PAIRS):
                own = slice(at, at + PAIRS)
                same = np.einsum("ij,ij->i", x[i[own]], x[j[own]]) >= threshold
                p, q = i[own][same], j[own][same]
                new = ~_met_before(leaves, p, q, leaf)
                p, q = p[new], q[new]
                links += np.bincount(p, copies[q], n).astype(np.int64) + np.bincount(q, copies[p], n).astype(np.int64)
                forest = spanning(p, q, n)
                one.append(p[forest])
                two.append(q[forest])
    i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (one, two))
    forest = spanning(i, j, n)
    return links, np.stack([i[forest], j[forest]])


def _padded(column: pa.Array) -> np.ndarray:
    values = [np.frombuffer(v, np.int32) for v in column.to_pylist()]
    out = np.repeat(-1 - np.arange(len(values), dtype=np.int32)[:, None], max(map(len, values)), axis=1)
    for row, v in zip(out, values):
        row[: len(v)] = v
    return out


def near_vectors(df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, trees: int = 8, spill: float = 0.15, sample: int = 1 << 18) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    ship(spark)
    rows = cut(vectors(df, vec_id, embedding))
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("vector").alias("vector"), F.min("size").alias("size"))
    classes = cut(classes)
    named = classes.where("rep is not null")
    count, width = named.agg(F.count("*"), F.max("size")).first()
    width = width or 1
    wanted = max(0, int(np.ceil(np.log2(max(count, 1) / SHARE))))
    # eight rows a leaf, and no more rows than the trees need
    most = min(sample, max(1 << 12, 64 << wanted))
    spot = F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(count, 1)))
    fitted, depth = [], wanted
    if wanted:
        got = named.where(spot).select("digest", "vector", "size").toArrow().sort_by("digest").combine_chunks()
        x = units(got["vector"], got["size"].to_numpy(), width)
        depth = min(wanted, max(0, int(np.log2(max(len(x), 1) / 8))))
        fitted = [fit_tree(x, depth, seed, spill) for seed in range(trees)]
    trees = trees if depth else 1
    shared = spark.sparkContext.broadcast((fitted, depth))

    def spread(batches):
        fitted, depth = shared.value
        for batch in batches:
            x = units(batch.column("vector"), batch.column("size").to_numpy(), width)
            if not len(x):
                continue
            row, leaf = [], []
            for tree in range(trees):
                r, node = route(x, fitted[tree], depth) if depth else (np.arange(len(x)), np.zeros(len(x), np.int64))
                row.append(r)
                leaf.append((tree << (depth + 1)) + node)
            row, leaf = np.concatenate(row), np.concatenate(leaf).astype(np.int32)
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            ends = np.searchsorted(row, np.arange(len(x) + 1))
            own = pa.array([leaf[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            picked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *(picked.column(c) for c in ("rep", "copies", "vector", "size")), own.take(pa.array(row))], names=["leaf", "rep", "copies", "vector", "size", "leaves"])

    def dealt(leaves: DataFrame) -> DataFrame:
        """A row of a large leaf meets its own block and every other of its leaf."""
        large = leaves.groupBy("leaf").count().where(F.col("count") > MOST).select("leaf", F.ceil(F.col("count") / (MOST // 2)).cast("long").alias("n"))
        large = cut(large)
        many = large.limit(MOST_KEYS + 1).count()
        if not many:
            return leaves.withColumn("key", F.col("leaf").cast("long")).withColumn("side", F.lit(0).cast("long"))
        out = leaves.join(F.broadcast(large) if many <= MOST_KEYS else large, "leaf", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
        out = out.withColumn("side", F.pmod(F.xxhash64("rep", "leaf"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        key = F.when(F.col("n") > 1, F.xxhash64("leaf", F.least("side", "other"), F.greatest("side", "other"))).otherwise(F.col("leaf"))
        return out.withColumn("key", key.cast("long")).drop("n", "other")

    def compare(batches):
        for table in by_group(batches, ["key", "leaf", "side", "rep", "copies", "vector", "size", "leaves"], "key"):
            for lo, hi in _runs(table["key"].to_numpy()):
                own = table.slice(lo, hi - lo)
                own = own.take(pa.array(np.argsort(own["rep"].to_numpy(), kind="stable"))).combine_chunks()
                rep, copies, size, side = (own[c].to_numpy() for c in ("rep", "copies", "size", "side"))
                links, pairs = leaf_links(units(own["vector"], size, width), size, side, _padded(own["leaves"]), own["leaf"][0].as_py(), copies, threshold)
                some = np.flatnonzero(links)
                if len(some):
                    none = [None] * pairs.shape[1]
                    ids, other = np.concatenate([rep[some], rep[pairs[0]]]), [*[None] * len(some), *rep[pairs[1]].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([*links[some].tolist(), *none], pa.int64()), pa.array(other, pa.int64())], names=["id", "links", "other"])

    leaves = named.select("rep", "copies", "vector", "size").mapInArrow(spread, "leaf int, rep long, copies long, vector binary, size int, leaves binary")
    met = dealt(leaves).repartition(max(partitions(spark), 1), "key").sortWithinPartitions("key").mapInArrow(compare, "id long, links long, other long")
    met = cut(met)
    linked = components(met.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    degree = met.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    answer = classes.join(degree, classes.rep == degree.id, "left").drop("id").join(linked, F.col("rep") == linked.id, "left")
    answer = answer.select("digest", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "digest").join(answer, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_embedding_forest(spark, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.9 or more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
