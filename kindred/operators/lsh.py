"""Approximate nearest neighbours of 128-bit signatures.

A table of the index samples 16 of the 128 bits; rows meet in an equi-join on (pool, table, sample).
Equal signatures are joined once: both sides are grouped by (pool, signature) first, and of equal
right signatures only the `k` first can be among the `k` nearest, so a crowd of alike entities costs
one bucket entry, not its square.
"""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.hamming import halves
from kindred.schema import LSH_BITS, LSH_SEED, LSH_TABLES, TOP_K
from kindred.session import ship


def sampled_bits(tables: int = LSH_TABLES, bits: int = LSH_BITS, seed: int = LSH_SEED) -> list[list[int]]:
    """For each table, the signature bits that make up its key, lowest first."""
    rng, out = random.Random(seed), []
    for _ in range(tables):
        order = list(range(128))
        rng.shuffle(order)
        out.append(order[128 - bits :])
    return out


def bucket_keys(parts: list[str], tables: int = LSH_TABLES, bits: int = LSH_BITS) -> Column:
    """array<struct<perm, key>> of a signature whose four parts have these names: a key per table."""

    def key(sample: list[int]) -> str:
        return " | ".join(f"shiftleft(shiftright({parts[3 - b // 32]}, {b % 32}) & 1L, {j})" for j, b in enumerate(sample))

    return F.expr(f"array({', '.join(f'named_struct({chr(39)}perm{chr(39)}, {p}, {chr(39)}key{chr(39)}, {key(sample)})' for p, sample in enumerate(sampled_bits(tables, bits)))})")


def _row_keys(tables: int, bits: int) -> Column:
    """array<bigint> of a row's hi and lo: the keys of bucket_keys by table, made of whole columns of bits."""
    samples = sampled_bits(tables, bits)

    def run(hi: pa.Array, lo: pa.Array) -> pa.Array:
        half = [np.asarray(x).astype(np.int64) for x in (lo, hi)]
        out = np.zeros((len(hi), tables), np.int64)
        for table, sample in enumerate(samples):
            for j, b in enumerate(sample):
                out[:, table] |= (half[b // 64] >> (b % 64) & 1) << j
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * tables, pa.int32()), pa.array(out.ravel()))

    return F.arrow_udf(run, "array<bigint>")("hi", "lo")


def flips(probe_radius: int, bits: int = LSH_BITS) -> list[int]:
    """By the number of a probe: what it flips of a key. No flip first, then single ones, then pairs."""
    if not 0 <= probe_radius <= 2:
        raise ValueError(f"probe_radius must be 0, 1 or 2 (got {probe_radius})")
    return [0, *(sum(1 << b for b in c) for r in range(1, probe_radius + 1) for c in combinations(range(bits), r))]


def grown_bits(rows: int, least: int = LSH_BITS) -> int:
    """Key bits for so many rows: buckets of evenly spread signatures hold about four, whatever the number of rows."""
    return min(max(least, (max(rows, 4) // 4).bit_length()), 62)


def nearest(lhs: DataFrame, rhs: DataFrame, k: int = TOP_K, tables: int = LSH_TABLES, probe_radius: int = 0, bits: int | None = LSH_BITS, within: int | None = None) -> DataFrame:
    """(pool, l, r, hamming, rank): of frames (pool, id, sig), each left row's k nearest right rows.

    Order: distance, first table that brings the two together, probe, id. A probe radius of 1 or 2 also asks
    buckets whose keys differ in so many bits. Keys of 16 bits give what other readers of the same
    definition find; with None the keys grow with the right side, for pools in which 65,536 buckets would be crowded.

    Within a bucket only the k nearest of a left signature go on: whatever precedes another signature in the
    first bucket that brings it, by distance and id, precedes it in the end. Buckets travel as arrays and are
    compared block against block, so a crowded one makes no row for each of its pairs, only for what goes on.
    With `within` no pair that is further apart goes on. Ids are whole numbers.
    """
    probes = flips(probe_radius, bits or LSH_BITS)  # refuses other radii
    if bits is None:
        bits = grown_bits(rhs.count())
        probes = flips(probe_radius, bits)
    ship(lhs.sparkSession)
    sig_of = lambda p: [h.alias(f"{p}{n}") for h, n in zip(halves(), ("hi", "lo"))]
    left = lhs.select("pool", *sig_of("a"), F.col("id").alias("l"))
    first = Window.partitionBy("pool", "bhi", "blo").orderBy("r")
    right = rhs.select("pool", *sig_of("b"), F.col("id").alias("r")).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    one = left.select("pool", F.col("ahi").alias("hi"), F.col("alo").alias("lo")).distinct().withColumn("mark", F.lit(0).cast("long"))
    two = right.groupBy("pool", F.col("bhi").alias("hi"), F.col("blo").alias("lo")).agg(F.min("r").cast("long").alias("mark"))
    spread = lambda df: df.select("*", _row_keys(tables, bits).alias("_keys")).select("pool", "hi", "lo", "mark", F.posexplode("_keys").alias("perm", "key"))
    one, two = spread(one), spread(two)
    if len(probes) > 1:
        # the mark of an asking signature is the number of its probe
        flipped = F.posexplode(F.array(*[F.lit(x).cast("long") for x in probes])).alias("probe", "flip")
        one = one.drop("mark").select("*", flipped).withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).withColumn("mark", F.col("probe").cast("long"))
    met = _met(_packed(one, ASKING), _packed(two, ASKED), k, within)
    # the first table and probe as one number, which a hash aggregate can keep
    met = met.groupBy("pool", "ahi", "alo", "bhi", "blo", "hamming").agg(F.min("met").alias("met"))
    # every right signature has a row, so those up to the k-th place hold the k nearest rows
    ties = Window.partitionBy("pool", "ahi", "alo").orderBy("hamming", "met", "r")
    expanded = met.withColumn("_d", F.dense_rank().over(Window.partitionBy("pool", "ahi", "alo").orderBy("hamming", "met"))).where(F.col("_d") <= k).join(right, ["pool", "bhi", "blo"])
    ranked = expanded.withColumn("rank", F.row_number().over(ties)).where(F.col("rank") <= k)
    return ranked.join(left, ["pool", "ahi", "alo"]).select("pool", "l", "r", "hamming", "rank")


#: Signatures of a block that asks and of one that is asked; pairs of small blocks that are looked at together.
ASKING, ASKED, TOGETHER = 1024, 1 << 14, 1 << 20
_HALVED = ["shiftrightunsigned(hi, 32)", "(hi & 4294967295L)", "shiftrightunsigned(lo, 32)", "(lo & 4294967295L)"]


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """(pool, perm, key, block): signatures (pool, perm, key, hi, lo, mark) of each bucket in order of mark, at most so many a block, 24 bytes each."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table = pa.Table.from_batches([batch])
            pool, perm, key = (np.asarray(table[c].combine_chunks().dictionary_encode().indices) if c == "pool" else table[c].to_numpy() for c in ("pool", "perm", "key"))
            new = np.ones(n, bool)
            new[1:] = (pool[1:] != pool[:-1]) | (perm[1:] != perm[:-1]) | (key[1:] != key[:-1])
            begin = np.flatnonzero(new)
            place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
            starts = np.flatnonzero(place % most == 0)
            data = np.stack([table[c].to_numpy() for c in ("hi", "lo", "mark")], 1).astype(np.int64).tobytes()
            ends = np.append(starts, n) * 24
            blocks = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])
            got = table.select(["pool", "perm", "key"]).take(pa.array(starts)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(got[c].combine_chunks() for c in ("pool", "perm", "key")), blocks], names=["pool", "perm", "key", "block"])

    dealt = rows.select("pool", "perm", "key", "hi", "lo", "mark").repartition("pool", "perm", "key").sortWithinPartitions("pool", "perm", "key", "mark")
    return dealt.mapInArrow(run, "pool string, perm int, key long, block binary")


def _records(block: memoryview) -> np.ndarray:
    return np.frombuffer(block, np.int64).reshape(-1, 3)


def _closest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, distance): for each record of a the k nearest of b, ties to the first."""
    x, y = a.view(np.uint64), np.ascontiguousarray(b.view(np.uint64).T[:2])
    out = []
    for lo in range(0, len(a), 64):
        far = np.bitwise_count(x[lo : lo + 64, :1] ^ y[0])
        far += np.bitwise_count(x[lo : lo + 64, 1:2] ^ y[1])
        rows = np.arange(len(far))
        for _ in range(min(k, len(b))):
            at = far.argmin(1)
            out.append((rows + lo, at, far[rows, at].astype(np.int64)))
            far[rows, at] = 255
    return tuple(np.concatenate(c) for c in zip(*out))


def _closest_of_many(pairs: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of many small pairs of blocks at once, as places in the blocks one after the other."""
    n, m = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
    a, b = (np.concatenate([p[i] for p in pairs]).view(np.uint64) for i in (0, 1))
    each = np.repeat(m, n)
    left = np.repeat(np.arange(len(a)), each)
    own = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
    base = np.cumsum(m) - m
    right = np.repeat(np.repeat(base, n), each) + own
    far = (np.bitwise_count(a[left, 0] ^ b[right, 0]) + np.bitwise_count(a[left, 1] ^ b[right, 1])).astype(np.int64)
    order = np.sort(left << 34 | far << 24 | own)  # blocks of a small pair have under 2**24 signatures
    left, far, own = order >> 34, (order >> 24) & 1023, order & 0xFFFFFF
    starts = np.flatnonzero(np.diff(left, prepend=-1))
    good = np.arange(len(left)) - np.repeat(starts, np.diff(np.append(starts, len(left)))) < k
    left, far, own = left[good], far[good], own[good]
    return left, np.repeat(base, n)[left] + own, far


def _met(asking: DataFrame, asked: DataFrame, k: int, within: int | None) -> DataFrame:
    """(pool, ahi, alo, bhi, blo, hamming, met): of packed buckets, the k nearest of each block for each asking signature; met tells table and probe."""
    schema = "pool string, ahi long, alo long, bhi long, blo long, hamming int, met long"

    def told(pool: pa.Array, perm: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
        cols = [pool, pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(b[:, 0]), pa.array(b[:, 1]), pa.array(far.astype(np.int32)), pa.array((perm.astype(np.int64) << 32) + a[:, 2])]
        return pa.RecordBatch.from_arrays(cols, names=["pool", "ahi", "alo", "bhi", "blo", "hamming", "met"])

    def run(batches):
        for batch in batches:
            pool, perm = batch.column("pool"), batch.column("perm").to_numpy()
            blocks = [(_records(x.as_buffer()), _records(y.as_buffer())) for x, y in zip(batch.column("block"), batch.column("other"))]
            held, size = [], 0
            for i, (a, b) in enumerate(blocks):
                if len(a) * len(b) >= 1 << 12:
                    left, right, far = _closest(a, b, k)
                    good = slice(None) if within is None else far <= within
                    left, right, far = left[good], right[good], far[good]
                    yield told(pool.take(pa.array(np.full(len(left), i))), np.full(len(left), perm[i]), a[left], b[right], far)
                else:
                    held.append(i)
                    size += len(a) * len(b)
                if held and (size >= TOGETHER or i + 1 == len(blocks)):
                    some = [blocks[j] for j in held]
                    left, right, far = _closest_of_many(some, k)
                    good = slice(None) if within is None else far <= within
                    left, right, far = left[good], right[good], far[good]
                    a, b = (np.concatenate([p[x] for p in some]) for x in (0, 1))
                    of = np.repeat(np.array(held), [len(p[0]) for p in some])[left]
                    yield told(pool.take(pa.array(of)), perm[of], a[left], b[right], far)
                    held, size = [], 0

    other = asked.select("pool", "perm", "key", F.col("block").alias("other"))
    return asking.join(other, ["pool", "perm", "key"]).select("pool", "perm", "block", "other").mapInArrow(run, schema)
