"""Pairs of 128-bit signatures within a Hamming distance, exactly: multi-index hashing.

The bits are dealt into m bands, bit i to band i mod m, so that a constant part of the signatures makes no
band constant. If two signatures differ in at most r = a * m + b bits (b < m), they differ in at most a
bits of one of the first b + 1 bands or in at most a - 1 of one of the others. The asking side looks a
band up with up to so many of its bits flipped, the asked side as it is: one equi-join on (band, its
bits). How many bands there are follows from the radius and both sides' sizes, by the rows that the
join makes. A pair that would meet in several bands is kept in the first of them, which is told from the pair
alone, so no distinct follows. Equal signatures meet once and are expanded at the end.

Where a radius is so wide that flips outnumber the signatures, a stated set of asking signatures is
compared with all others block by block (`nearest_within`).

Where it is asked how many lie near, or what holds together, no pair is made: signatures that agree in one of
radius + 1 bands are compared where they meet (`linked_counts`, `linked_classes`).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.plans.lineage import cut
from kindred.session import ship

BITS = 128
#: Flips of all bands together, at most: they are broadcast, some 30 bytes each.
MOST_FLIPS = 1 << 13
#: Distances that are tried before a wider one, where the nearest is asked.
STEPS = (3, 7, 15, 23)
#: Signatures of a block; comparisons of two blocks that cost about as much as one row of a join.
BLOCK, ROW_WORTH = 2048, 32


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@dataclass(frozen=True)
class Bands:
    """For each band, which bits of the two halves it has and how many of them may differ."""

    masks: tuple[tuple[int, int], ...]
    radii: tuple[int, ...]

    @property
    def flips(self) -> int:
        return sum(comb(_ones(m), k) for m, r in zip(self.masks, self.radii) for k in range(r + 1))

    def met(self, asked: int) -> float:
        """Of so many evenly spread signatures, those that an asking one meets."""
        return sum(comb(_ones(m), k) * asked / 2.0 ** _ones(m) for m, r in zip(self.masks, self.radii) for k in range(r + 1))

    def table(self) -> list[tuple[int, int, int]]:
        """(band, hi, lo): every flip."""
        out = []
        for band, ((hi, lo), radius) in enumerate(zip(self.masks, self.radii)):
            bits = [b for b in range(BITS) if (hi << 64 | lo) >> b & 1]
            for k in range(radius + 1):
                for some in combinations(bits, k):
                    flip = sum(1 << b for b in some)
                    out.append((band, signed(flip >> 64), signed(flip & (1 << 64) - 1)))
        return out


def _ones(mask: tuple[int, int]) -> int:
    return mask[0].bit_count() + mask[1].bit_count()


def bands_of(radius: int, m: int) -> Bands:
    """m bands; those that no pair needs are left out."""
    most, rest = divmod(radius, m)
    masks = [sum(1 << b for b in range(j, BITS, m)) for j in range(m)]
    radii = [most if j <= rest else most - 1 for j in range(m)]
    used = [(mask, r) for mask, r in zip(masks, radii) if r >= 0]
    return Bands(tuple((mask >> 64, mask & (1 << 64) - 1) for mask, _ in used), tuple(r for _, r in used))


def plan(radius: int, asked: int) -> tuple[Bands, float]:
    """The bands with the fewest rows per asking signature, and those rows."""
    if not 0 <= radius < BITS:
        raise ValueError("a radius has 0 to 127 bits")
    found = [bands_of(radius, m) for m in range(1, min(radius + 1, 64) + 1)]
    cost = lambda b: b.flips + b.met(asked)
    fit = [b for b in found if b.flips <= MOST_FLIPS] or [min(found, key=lambda b: b.flips)]
    best = min(fit, key=cost)
    return best, cost(best)


def halves(sig: str = "sig") -> list[Column]:
    """The signature as two longs, hi and lo."""
    word = lambda a, b: F.shiftleft(F.col(f"{sig}.{a}"), 32).bitwiseOR(F.col(f"{sig}.{b}"))
    a, b, c, d = S.SIGNATURE_PARTS
    return [word(a, b).alias("hi"), word(c, d).alias("lo")]


def _banded(sigs: DataFrame, bands: Bands) -> DataFrame:
    """(hi, lo, band, khi, klo): a row for each band."""
    each = [F.struct(F.lit(j).alias("band"), F.col("hi").bitwiseAND(F.lit(signed(hi))).alias("khi"), F.col("lo").bitwiseAND(F.lit(signed(lo))).alias("klo")) for j, (hi, lo) in enumerate(bands.masks)]
    return sigs.select("hi", "lo", F.explode(F.array(*each)).alias("x")).select("hi", "lo", "x.*")


def _far(bits: str = "") -> str:
    return f"(bit_count((hi ^ hi2){bits and ' & ' + bits.split()[0] + 'L'}) + bit_count((lo ^ lo2){bits and ' & ' + bits.split()[1] + 'L'}))"


def candidates(asking: DataFrame, asked: DataFrame, bands: Bands) -> DataFrame:
    """(hi, lo, hi2, lo2, band) of frames of distinct (hi, lo): signatures that meet in a band, once for each such band."""
    flips = asking.sparkSession.createDataFrame(bands.table(), "band int, fhi long, flo long")  # at most MOST_FLIPS rows
    probes = _banded(asking, bands).join(F.broadcast(flips), "band").select("hi", "lo", "band", F.col("khi").bitwiseXOR(F.col("fhi")).alias("khi"), F.col("klo").bitwiseXOR(F.col("flo")).alias("klo"))
    keys = _banded(asked.select("hi", "lo"), bands).select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "band", "khi", "klo")
    return probes.join(keys, ["band", "khi", "klo"]).select("hi", "lo", "hi2", "lo2", "band")


def signature_pairs(asking: DataFrame, asked: DataFrame, radius: int, bands: Bands | None = None) -> DataFrame:
    """(hi, lo, hi2, lo2, hamming) of frames of distinct (hi, lo): all pairs within the radius, each once."""
    bands = plan(radius, asked.count())[0] if bands is None else bands
    met = candidates(asking, asked, bands)
    near = met.where(f"{_far()} <= {radius}")
    first = " ".join(f"when {_far(f'{signed(hi)} {signed(lo)}')} <= {r} then {j}" for j, ((hi, lo), r) in enumerate(zip(bands.masks, bands.radii)))
    return near.where(f"band = case {first} end").select("hi", "lo", "hi2", "lo2", F.expr(_far()).alias("hamming"))


def distinct_signatures(rows: DataFrame) -> DataFrame:
    return rows.select(*halves()).distinct()


def radius_pairs(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(l, r, hamming): all pairs of a left and a right row (id, sig) within the radius; equal signatures are 0 apart.

    Left rows meet right rows alone. The side with fewer signatures asks.
    """
    one, two = cut(distinct_signatures(left)), cut(distinct_signatures(right))
    n, m = one.count(), two.count()
    if n <= m:
        met = signature_pairs(one, two, radius, plan(radius, m)[0])
    else:
        met = signature_pairs(two, one, radius, plan(radius, n)[0]).select(F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "hamming")
    ids = left.select(F.col("id").alias("l"), *halves())
    others = right.select(F.col("id").alias("r"), *[h.alias(f"{n}2") for h, n in zip(halves(), ("hi", "lo"))])
    return met.join(ids, ["hi", "lo"]).join(others, ["hi2", "lo2"]).select("l", "r", "hamming")


def _own_pairs(alone: DataFrame, radius: int) -> DataFrame:
    return signature_pairs(alone, alone, radius).where("hi < hi2 or hi = hi2 and lo < lo2")


def pairs_within(rows: DataFrame, radius: int) -> DataFrame:
    """(l, r, hamming), l < r: all pairs of rows (id, sig) of one table within the radius."""
    ids = rows.select("id", *halves())
    met = _own_pairs(cut(distinct_signatures(rows)), radius)
    unlike = met.join(ids.select(F.col("id").alias("a"), "hi", "lo"), ["hi", "lo"]).join(ids.select(F.col("id").alias("b"), F.col("hi").alias("hi2"), F.col("lo").alias("lo2")), ["hi2", "lo2"])
    alike = ids.select(F.col("id").alias("l"), "hi", "lo").join(ids.select(F.col("id").alias("r"), "hi", "lo"), ["hi", "lo"]).where("l < r")
    return unlike.select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"), "hamming").unionByName(alike.select("l", "r", F.lit(0).alias("hamming")))


# ---- what lies near, without pairs

#: Rows of a group that are compared in one task, and of a block of a larger one; the parts that a larger one's comparisons are dealt to.
HOT, HOT_BLOCK, HOT_PARTS = 1 << 16, 1 << 13, 4
#: Groups up to this size are compared together, so many pairs at a time.
SMALL, SMALL_PAIRS = 48, 1 << 20
_KEY = ("band", "khi", "klo")
_FOUND = "band int, khi long, klo long, number int, a long, b long, n long, x binary, y binary, w binary"


class _Group:
    """Signatures in order of their groups, and what is found of them: sums of weights of near ones, or trees that hold together what is near."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, w: np.ndarray, band: np.ndarray, bands: Bands, radius: int, trees: bool, small: int):
        self.hi, self.lo, self.w, self.band, self.radius, self.trees, self.small = hi.view(np.uint64), lo.view(np.uint64), w, band, radius, trees, small
        self.masks = [(np.uint64(a), np.uint64(b)) for a, b in bands.masks]
        self.sums, self.root = np.zeros(len(w), np.int64), np.arange(len(w))

    def near(self, x: np.ndarray, y: np.ndarray) -> None:
        """Takes up the pairs of places that lie within the radius; x and y are of one group."""
        dh, dl = self.hi[x] ^ self.hi[y], self.lo[x] ^ self.lo[y]
        at = np.flatnonzero(np.bitwise_count(dh).astype(np.int16) + np.bitwise_count(dl) <= self.radius)
        if not len(at):
            return
        x, y, dh, dl = x[at], y[at], dh[at], dl[at]
        band, again = self.band[x], np.zeros(len(x), bool)
        for j, (a, b) in enumerate(self.masks):  # a pair counts in the first band that it meets in
            again |= (j < band) & (((dh & a) | (dl & b)) == 0)
        x, y = x[~again], y[~again]
        if not self.trees:
            np.add.at(self.sums, x, self.w[y])
            np.add.at(self.sums, y, self.w[x])
            return
        while True:  # roots hook to lesser roots until each pair has one root
            a, b = self.root[x], self.root[y]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up

    def block(self, one: slice, two: slice) -> None:
        """Compares two slices of a group: the same, or apart."""
        for i in range(one.start, one.stop, 16):
            rows = slice(i, min(i + 16, one.stop))
            for j in range(i if one == two else two.start, two.stop, 8192):
                some = slice(j, min(j + 8192, two.stop))
                far = np.bitwise_count(self.hi[rows, None] ^ self.hi[some])
                far += np.bitwise_count(self.lo[rows, None] ^ self.lo[some])
                x, y = np.divmod(np.flatnonzero(far <= self.radius), far.shape[1])
                x, y = x + i, y + j
                if one == two:
                    x, y = x[x < y], y[x < y]
                self.near(x, y)

    def groups(self, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Compares each group's rows with each other."""
        for start, size in zip(starts[sizes > self.small].tolist(), sizes[sizes > self.small].tolist()):
            self.block(slice(start, start + size), slice(start, start + size))
        few = (sizes > 1) & (sizes <= self.small)
        starts, sizes = starts[few], sizes[few]
        row = np.repeat(starts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        after = np.repeat(starts + sizes, sizes) - row - 1  # the rows behind, in its group
        ends, lo = np.cumsum(after), 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SMALL_PAIRS, "right")))
            many = after[lo:hi]
            x = np.repeat(row[lo:hi], many)
            self.near(x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many))
            lo = hi

    def found(self) -> pa.RecordBatch:
        """(a, b, n): the halves of what has near ones and the sum of those; or two weights that hold together."""
        if self.trees:
            at = np.flatnonzero(self.root != np.arange(len(self.root)))
            return _found(len(at), a=self.w[self.root[at]], b=self.w[at])
        at = np.flatnonzero(self.sums)
        return _found(len(at), a=self.hi[at].view(np.int64), b=self.lo[at].view(np.int64), n=self.sums[at])


def _found(size: int, **columns) -> pa.RecordBatch:
    """Rows of _FOUND; columns that are not given are null."""
    kind = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(name, kind[t]) for name, t in (c.split() for c in _FOUND.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in fields], schema=pa.schema(fields))


def _near(sigs: DataFrame, radius: int, trees: bool) -> DataFrame:
    """(a, b, n) of distinct signatures (hi, lo) with a weight w, as _Group finds them, group by group.

    A signature is sent once to each of radius + 1 bands, in one of which two near ones agree: neither flips nor pairs are
    rows. Those that agree are compared where they meet, in order of their groups; a group of HOT rows or more goes on in blocks, and
    block meets block.
    """
    ship(sigs.sparkSession)
    bands = bands_of(radius, radius + 1)
    each = [F.struct(F.lit(j).alias("band"), F.col("hi").bitwiseAND(F.lit(signed(hi))).alias("khi"), F.col("lo").bitwiseAND(F.lit(signed(lo))).alias("klo")) for j, (hi, lo) in enumerate(bands.masks)]
    rows = sigs.select("hi", "lo", F.col("w").cast("long").alias("w"), F.explode(F.array(*each)).alias("k")).select("k.*", "hi", "lo", "w")
    names, most, size, small = (*_KEY, "hi", "lo", "w"), HOT, HOT_BLOCK, SMALL

    def group(part):
        return _Group(*(part[c] for c in ("hi", "lo", "w", "band")), bands, radius, trees, small)

    def whole(part, firsts):
        own = group(part)
        own.groups(firsts, np.diff(np.append(firsts, len(part["w"]))))
        return own.found()

    def blocks(part, number):
        for i, lo in enumerate(range(0, len(part["w"]), size)):
            own = {c: v[lo : lo + size] for c, v in part.items()}
            yield _found(1, **{c: own[c][:1] for c in _KEY}, number=[number + i], x=[own["hi"].tobytes()], y=[own["lo"].tobytes()], w=[own["w"].tobytes()])

    def meet(batches):
        held, hot, number = {c: np.zeros(0, np.int64) for c in names}, None, 0
        for batch in batches:
            part = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names}
            if hot is not None:  # more of a group that went on in blocks
                other = np.flatnonzero(np.logical_or.reduce([part[c] != k for c, k in zip(_KEY, hot)]))
                end = int(other[0]) if len(other) else len(part["w"])
                yield from blocks({c: v[:end] for c, v in part.items()}, number)
                number += end // size + 1
                part = {c: v[end:] for c, v in part.items()}
            if not len(part["w"]):
                continue
            held, hot = {c: np.concatenate([held[c], part[c]]) for c in names}, None
            new = np.logical_or.reduce([held[c][1:] != held[c][:-1] for c in _KEY])
            firsts = np.concatenate([[0], np.flatnonzero(new) + 1])
            last = int(firsts[-1])
            yield whole({c: v[:last] for c, v in held.items()}, firsts[:-1])
            held = {c: v[last:] for c, v in held.items()}
            if len(held["w"]) >= most:
                yield from blocks(held, 0)
                hot, number = tuple(held[c][0] for c in _KEY), len(held["w"]) // size + 1
                held = {c: v[:0] for c, v in held.items()}
        if len(held["w"]):
            yield whole(held, np.zeros(1, np.int64))

    def block_pairs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                same = row["number"] == row["number2"]
                one, two = ([np.frombuffer(row[c + side], np.int64) for c in "xyw"] for side in ("", "2"))
                hi, lo, w = one if same else map(np.concatenate, zip(one, two))
                own, n = group({"hi": hi, "lo": lo, "w": w, "band": np.full(len(w), row["band"])}), len(one[0])
                own.block(slice(0, n), slice(0, n) if same else slice(n, len(w)))
                yield own.found()

    # read twice, by what is found and by blocks: narrow but for the blocks
    met = cut(rows.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(meet, _FOUND))
    found = met.where("number is null").select("a", "b", "n")
    crowded = met.where("number is not null")
    if crowded.isEmpty():
        return found
    one = crowded.select(*_KEY, "number", "x", "y", "w", F.pmod("number", F.lit(HOT_PARTS)).alias("part"))
    two = crowded.select(*_KEY, *[F.col(c).alias(f"{c}2") for c in ("number", "x", "y", "w")], F.explode(F.array(*map(F.lit, range(HOT_PARTS)))).alias("part"))
    pairs = one.join(two.hint("shuffle_merge"), [*_KEY, "part"]).where("number <= number2").select("band", "number", "x", "y", "w", "number2", "x2", "y2", "w2")
    return found.unionByName(pairs.mapInArrow(block_pairs, _FOUND).select("a", "b", "n"))


def near_counts(sigs: DataFrame, radius: int) -> DataFrame:
    """(hi, lo, n) of distinct signatures (hi, lo) and how many rows each has, w: the rows of other signatures within the radius, where there are any."""
    return _near(sigs, radius, False).groupBy(F.col("a").alias("hi"), F.col("b").alias("lo")).agg(F.sum("n").alias("n"))


def linked_classes(rows: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(id, first) of rows (id, sig), ids being longs, and links (a, b) of firsts: rows of equal signatures are one class, named by its least id.

    What lies within the radius holds together by the links, of which a group of a band has fewer than rows: copies make no
    pairs, and neither do near ones.
    """
    ids = rows.select("id", *halves())
    classes = cut(ids.groupBy("hi", "lo").agg(F.min("id").alias("first")))
    links = _near(classes.select("hi", "lo", F.col("first").alias("w")), radius, True).select("a", "b")
    return ids.join(classes, ["hi", "lo"]).select("id", "first"), links


def linked_counts(rows: DataFrame, radius: int) -> DataFrame:
    """(id, first, n): of rows (id, sig) the least id of equal signature, and how many other rows lie within the radius. No pair is made."""
    ids = rows.select("id", *halves())
    alone = cut(ids.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.count("*").alias("w")))
    told = alone.join(near_counts(alone, radius), ["hi", "lo"], "left").select("hi", "lo", "first", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"))
    return ids.join(told, ["hi", "lo"]).select("id", "first", "n")


def accompanied(rows: DataFrame, radius: int) -> DataFrame:
    """(id, near): whether another row (id, sig) of the table lies within the radius. No pair is made."""
    return linked_counts(rows, radius).select("id", (F.col("n") > 0).alias("near"))


# ---- the nearest within a wide radius

_PACKED = "grp string, number long, n int, halves binary, ids binary"


def _blocks(rows: DataFrame) -> DataFrame:
    """(grp, number, n, halves, ids): rows (grp, id, hi, lo) in blocks of at most BLOCK, as arrays."""

    def run(batches):
        from pyspark.taskcontext import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("grp")
            names = table["grp"].to_pylist()
            ends = [i for i in range(1, len(names) + 1) if i == len(names) or names[i] != names[i - 1]]
            begin, out = 0, []
            for end in ends:
                for lo in range(begin, end, BLOCK):
                    part = table.slice(lo, min(BLOCK, end - lo))
                    both = np.stack([part["hi"].to_numpy(), part["lo"].to_numpy()])
                    out.append({"grp": names[lo], "number": number, "n": len(part), "halves": both.tobytes(), "ids": part["id"].to_numpy().astype(np.int64).tobytes()})
                    number += 1
                begin = end
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("grp", pa.string()), ("number", pa.int64()), ("n", pa.int32()), ("halves", pa.binary()), ("ids", pa.binary())]))

    return rows.select("grp", F.col("id").cast("long").alias("id"), "hi", "lo").mapInArrow(run, _PACKED)


def _scanned(asking: DataFrame, asked: DataFrame, radius: int) -> DataFrame:
    """(grp, l, hamming, r): for rows (grp, id, hi, lo) the nearest asked row of their group within the radius, block against block."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[c], np.uint64).reshape(2, -1) for c in ("halves", "halves2"))
                ids, other = (np.frombuffer(row[c], np.int64) for c in ("ids", "ids2"))
                order = np.argsort(other, kind="stable")
                b, other = b[:, order], other[order]
                best, at = np.full(len(ids), BITS + 1), np.zeros(len(ids), np.int64)
                for lo in range(0, len(ids), 128):
                    far = np.bitwise_count(a[0, lo : lo + 128, None] ^ b[0]) + np.bitwise_count(a[1, lo : lo + 128, None] ^ b[1])
                    place = far.argmin(1)  # the first of equals: the least id
                    best[lo : lo + 128], at[lo : lo + 128] = far[np.arange(len(place)), place], other[place]
                mine = best <= radius
                cols = [pa.array([row["grp"]] * int(mine.sum()), pa.string()), pa.array(ids[mine]), pa.array(best[mine].astype(np.int32)), pa.array(at[mine])]
                yield pa.RecordBatch.from_arrays(cols, names=["grp", "l", "hamming", "r"])

    one = _blocks(asking)
    two = _blocks(asked).select("grp", F.col("halves").alias("halves2"), F.col("ids").alias("ids2"))
    rows = one.join(two, "grp").select("grp", "halves", "ids", "halves2", "ids2").mapInArrow(run, "grp string, l long, hamming int, r long")
    return rows.groupBy("grp", "l").agg(F.min(F.struct("hamming", "r")).alias("x")).select("grp", "l", "x.hamming", "x.r")


def nearest_within(asking: DataFrame, asked: DataFrame, radius: int) -> DataFrame:
    """(l, grp, r, hamming): for rows (id, sig) and each group of the asked rows (grp, id, sig), the nearest asked
    row within the radius, ties to the least id; ids are longs; nothing where there is none.

    Near ones are looked for first; signatures that found theirs ask no wider radius. A radius that is dearer by
    bands than by comparing blocks (a stated set of asking rows against all asked ones) is scanned.
    """
    ship(asking.sparkSession)
    ids = asking.select(F.col("id").cast("long").alias("l"), *halves())
    known = cut(asked.select("grp", "id", *halves()).groupBy("grp", "hi", "lo").agg(F.min("id").cast("long").alias("id")))
    groups = known.select("grp").distinct()
    rest = cut(ids.groupBy("hi", "lo").agg(F.min("l").alias("id")).crossJoin(groups))  # a row for each row of the answer
    sigs = cut(known.select("hi", "lo").distinct())
    n, found = sigs.count(), None
    for step in [*(s for s in STEPS if s < radius), radius]:
        if rest.isEmpty():
            break
        bands, rows = plan(step, n)
        scan = n / ROW_WORTH
        if rows >= scan and step < radius:
            continue
        if rows >= scan:
            best = _scanned(rest, known, radius).join(rest.select("grp", F.col("id").alias("l"), "hi", "lo"), ["grp", "l"]).select("grp", "hi", "lo", "hamming", "r")
        else:
            met = signature_pairs(rest.select("hi", "lo").distinct(), sigs, step, bands)
            other = known.select("grp", F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("id").alias("r"))
            best = met.join(other, ["hi2", "lo2"]).groupBy("grp", "hi", "lo").agg(F.min(F.struct("hamming", "r")).alias("x")).select("grp", "hi", "lo", "x.hamming", "x.r")
        best = cut(best)
        found = best if found is None else found.unionByName(best)
        if step < radius:
            rest = cut(rest.join(best, ["grp", "hi", "lo"], "left_anti"))
    if found is None:
        return ids.select("l", F.lit("").alias("grp"), F.col("l").alias("r"), F.lit(0).alias("hamming")).limit(0)
    return ids.join(found, ["hi", "lo"]).select("l", "grp", "r", "hamming")
