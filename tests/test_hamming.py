"""Multi-index joins of signatures against all pairs, and their cost."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from kindred.operators import family, hamming, lsh

SIG = "struct<cls:bigint,fld:bigint,mth:bigint,code:bigint>"


def sig(v: int) -> tuple:
    return tuple((v >> s) & 0xFFFFFFFF for s in (96, 64, 32, 0))


def frame(spark, values):
    return spark.createDataFrame([(i, sig(v)) for i, v in enumerate(values)], f"id long, sig {SIG}")


def clustered(rng, n, centres=8, most=9, constant=False):
    """Signatures around some centres, with repeats; constant: a part of them is 0 throughout."""
    base = [rng.getrandbits(128) for _ in range(centres)]
    out = [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(most + 1))) for _ in range(n)]
    out += [rng.choice(out) for _ in range(n // 5)] + [0, (1 << 128) - 1]
    return [v & ~(0xFFFFFFFF << 64) for v in out] if constant else out


@pytest.mark.parametrize("radius", [0, 1, 4, 7, 12, 20])
def test_pairs_of_two_sides(spark, radius):
    rng = random.Random(radius)
    left, right = clustered(rng, 60, constant=radius == 4), clustered(random.Random(radius), 25, constant=radius == 4)
    for a, b in ((left, right), (right, left)):
        want = sorted((i, j, (v ^ w).bit_count()) for i, v in enumerate(a) for j, w in enumerate(b) if (v ^ w).bit_count() <= radius)
        assert sorted(map(tuple, hamming.radius_pairs(frame(spark, a), frame(spark, b), radius).collect())) == want and want
    own = sorted((i, j, (left[i] ^ left[j]).bit_count()) for j in range(len(left)) for i in range(j) if (left[i] ^ left[j]).bit_count() <= radius)
    assert sorted(map(tuple, hamming.pairs_within(frame(spark, left), radius).collect())) == own
    near = {i for pair in own for i in pair[:2]}
    assert {r["id"] for r in hamming.accompanied(frame(spark, left), radius).collect() if r["near"]} == near


@pytest.mark.parametrize("m", [1, 2, 3, 5, 13])
def test_any_number_of_bands_finds_each_pair_once(spark, m):
    """The distance is split over the bands: whatever their number, no pair is lost or told twice."""
    rng = random.Random(m)
    values = list(dict.fromkeys(clustered(rng, 40, most=6)))
    radius = {1: 1, 2: 3}.get(m, 12)
    bands = hamming.bands_of(radius, m)
    rows = hamming.distinct_signatures(frame(spark, values))
    got = [((r["hi"] % (1 << 64)) << 64 | r["lo"] % (1 << 64), (r["hi2"] % (1 << 64)) << 64 | r["lo2"] % (1 << 64)) for r in hamming.signature_pairs(rows, rows, radius, bands).collect()]
    want = [(v, w) for v in values for w in values if (v ^ w).bit_count() <= radius]
    assert sorted(got) == sorted(want)


def test_refused_radii():
    for radius in (-1, 128):
        with pytest.raises(ValueError):
            hamming.plan(radius, 10)


def test_candidates_grow_slowly(spark):
    """What meets in the bands for twelve bits: near the answer, and growing below n ** 1.3 for spread signatures."""
    met = []
    for n in (1000, 8000):
        rng = random.Random(n)
        rows = hamming.distinct_signatures(frame(spark, [rng.getrandbits(128) for _ in range(n)]))
        bands, _ = hamming.plan(12, n)
        met.append(max(hamming.candidates(rows, rows, bands).count() - n * len(bands.radii), n))
        assert bands.flips <= hamming.MOST_FLIPS
    assert met[1] < met[0] * 8**1.3


def test_small_packs_never_meet_class_pairs(spark):
    """Many classes against few entries: what meets is at most twice the answer, and no class meets a class."""
    rng = random.Random(2)
    entries = [rng.getrandbits(128) for _ in range(40)]
    classes = [rng.choice(entries) ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(5))) for _ in range(4000)]
    one, two = (hamming.distinct_signatures(frame(spark, v)) for v in (entries, classes))
    bands, _ = hamming.plan(4, 4000)
    answer = hamming.signature_pairs(one, two, 4, bands).count()
    pairs = hamming.candidates(one, two, bands).select("hi", "lo", "hi2", "lo2").distinct().count()
    assert answer <= pairs <= 2 * answer


@pytest.mark.parametrize(("radius", "n"), [(3, 300), (12, 300), (50, 150), (40, 4000)])
def test_nearest_within(spark, radius, n, monkeypatch):
    rng = random.Random(radius)
    known = clustered(rng, n, centres=30, most=14)
    asking = [rng.choice(known) ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(45))) for _ in range(40)] + [0, 5]
    if radius == 40:
        monkeypatch.setattr(hamming, "ROW_WORTH", 1 / 4)  # bands, although few are asked
    rows = spark.createDataFrame([("ab"[j % 2], j, sig(w)) for j, w in enumerate(known)], f"grp string, id long, sig {SIG}")
    want = set()
    for i, v in enumerate(asking):
        for g in (0, 1):
            best = min((((v ^ w).bit_count(), j) for j, w in enumerate(known) if j % 2 == g), default=None)
            if best[0] <= radius:
                want.add((i, "ab"[g], best[1], best[0]))
    assert {tuple(r) for r in hamming.nearest_within(frame(spark, asking), rows, radius).collect()} == want
    assert hamming.nearest_within(frame(spark, asking), rows.limit(0), radius).count() == 0


def test_multi_probe_against_a_scan(spark):
    """Radius 0, 1 and 2 find what a scan of the flipped buckets finds, in seconds; wider ones are refused."""
    rng, k = random.Random(7), 4
    base = [rng.getrandbits(128) for _ in range(6)]
    near = lambda: rng.choice(base) ^ sum(1 << rng.randrange(128) for _ in range(rng.randrange(20)))
    lhs, rhs = [near() for _ in range(30)], [near() for _ in range(60)]
    rhs += rhs[:5] * 3
    samples = lsh.sampled_bits()
    keys = lambda v: [sum(((v >> b) & 1) << j for j, b in enumerate(s)) for s in samples]
    pooled = lambda values: frame(spark, values).withColumn("pool", F.lit(""))
    began = time.time()
    for radius in (0, 1, 2):
        number = {flip: i for i, flip in enumerate(lsh.flips(radius))}
        want = set()
        for i, v in enumerate(lhs):
            met = []
            for j, w in enumerate(rhs):
                how = [(p, number[a ^ b]) for p, (a, b) in enumerate(zip(keys(v), keys(w))) if a ^ b in number]
                if how:
                    met.append(((v ^ w).bit_count(), min(how), j))
            want |= {(i, j, d, n + 1) for n, (d, _, j) in enumerate(sorted(met)[:k])}
        got = {(r["l"], r["r"], r["hamming"], r["rank"]) for r in lsh.nearest(pooled(lhs), pooled(rhs), k, probe_radius=radius).collect()}
        assert got == want
    assert time.time() - began < 60
    with pytest.raises(ValueError):
        lsh.nearest(pooled(lhs), pooled(rhs), k, probe_radius=3)


def test_keys_grow_with_the_pool(spark):
    assert lsh.grown_bits(10) == 16 and lsh.grown_bits(1 << 22) == 21 and lsh.grown_bits(1 << 40) == 39
    rng = random.Random(1)
    values = [rng.getrandbits(128) for _ in range(50)]
    rows = frame(spark, values).withColumn("pool", F.lit(""))
    assert {(r["l"], r["r"]) for r in lsh.nearest(rows, rows, 1, bits=None).collect()} == {(i, i) for i in range(50)}


def test_string_tier_by_heavy_tokens(spark):
    """A string in everything brings no entry together with all classes; the best entry is that of a full comparison."""
    rng = random.Random(4)
    words = [f"word number {i}" for i in range(60)]
    everywhere = "in every class and entry"
    pick = lambda: [everywhere, *rng.sample(words, rng.randrange(4))]
    known, told = [pick() for _ in range(50)], [pick() for _ in range(300)]
    entries = spark.createDataFrame([("p", i, sig(rng.getrandbits(128)), s) for i, s in enumerate(known)], f"pack string, entry_id int, sig {SIG}, strings array<string>")
    classes = spark.createDataFrame([("d", i, sig(rng.getrandbits(128)), s) for i, s in enumerate(told)], f"digest string, pos int, sig {SIG}, strings array<string>")
    from math import log

    df = {w: sum(w in s for s in known) for w in {*words, everywhere}}
    want = {}
    for i, s in enumerate(told):
        scores = [(-round(sum(sorted(log(1 + 50 / df[w]) for w in {*s} & {*e})), 9), j) for j, e in enumerate(known) if {*s} & {*e}]
        score, j = min(scores)
        want[i] = (j, -score)
    got = {r["pos"]: (r["entry_id"], r["score"]) for r in family.detect(classes, entries, 4).collect()}
    assert {i: (j, pytest.approx(s, abs=1e-8)) for i, (j, s) in want.items()} == got
    flat = classes.select("digest", "pos", F.lit("p").alias("pack"), F.explode("strings").alias("s"))
    weights = spark.createDataFrame([(w, log(1 + 50 / n)) for w, n in df.items() if n], "s string, idf double")
    few = family.string_candidates(flat.join(weights, "s"), entries.select("pack", "entry_id", F.explode("strings").alias("s")), 0.5)
    rare = sum(1 for s in told if len({*s} & {w for w in words if df[w]}) > 0)
    assert few.count() < 50 * (300 - rare) + 12 * rare
