"""Near-duplicate documents by an LSH forest of minhash signatures.

1. A document's distinct word shingles give its set, a digest of it and `trees * depth` minhashes; the
   set and the minhashes come from two independent hashes of the words. Documents with equal digests
   (of set and signature) are one class from here on, represented by the smallest doc_id.
2. A tree is the sorted order of its `depth` minhashes, and a region of it is what shares a prefix of that
   order. Regions begin `shallow` values deep. One of more than `HOT` classes goes deeper, one value at a time
   up to two: in several orders, which turn the values after the shared prefix about, so that a pair that
   differs in one of them still shares a longer prefix of another order. What is alone in its region goes.
   The orders are range-sorted, each region whole in one task. Neighbours in the order, which have the longest
   common prefixes, are compared first, then all of the region that these have not linked; those that may
   reach the threshold are joined loosely. A region that is over-full at its deepest is compared whole all the
   same: dealt into blocks, every two of which meet in a task of their own.
3. Loose groups are connected, their members' full sets fetched, and all pairs within that may reach
   the threshold are confirmed on the sets, unless already linked. A group beyond a block (of `BLOCK`
   shingles or `BLOCK_ROWS` classes) is compared in random blocks twice. What that leaves outside the
   group's largest part is compared with everything, block against block, so that no pair is left out.
4. Confirmed links are connected; every document gets the smallest doc_id it reaches.

Between a signature's estimate and the true similarity 4.1 standard deviations are allowed for. A pair at the
threshold is met in some tree with a probability of 0.9999 at 80 percent and more, though all its regions be
over-full; the first depth is less for lower thresholds, so that it stays at 0.95 or more (`first_depth`).

Defined results: words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text with fewer words than a
shingle has one shingle, its whole sequence; null and word-less texts have an empty set, link with
nothing and are kept. Rows that share a doc_id are one
node: what one of them links, all do. A null doc_id links, but never
names a component; where a class has null ids only, it is linked with nothing outside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import textkit as K
from kindred.llm.shared import components, cut, partitions, thinned
from kindred.session import ship

_U = K.U
TREES, DEPTH, SHALLOW = 16, 6, 3
SIZE = TREES * DEPTH
#: Rows beyond which a region goes deeper, and at its deepest, times WIDE, is dealt into blocks; rows compared at once;
#: shingles and classes of a block.
HOT, REGION, BLOCK, BLOCK_ROWS = 4096, 1024, 4 << 20, 512
WIDE = 4
#: Levels that an over-full region goes below its first depth.
DEEPER = 2
#: Up to so many keys of over-full regions are broadcast; more are joined, their rows salted.
MOST_KEYS = 100_000
_random = np.random.default_rng(20240501)
_XOR = _random.integers(0, 1 << 32, SIZE, dtype=np.uint32)
_ODD = _random.integers(0, 1 << 32, SIZE, dtype=np.uint32) | np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int, salts: tuple[int, ...] = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """All shingles' hashes by each salt, text by text, and where each text's begin."""
    words = K.Words(data, offsets, K.PLAIN)
    n = np.diff(words.first)
    full = words.room()[: max(words.count - size + 1, 0)] >= size
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((n > 0) & (n < size))
    is_long = np.ones(at[-1], bool)
    is_long[at[short]] = False
    out = []
    for salt in salts:
        hashes, got = words.hashes(True, salt), np.zeros(at[-1], _U)
        got[is_long] = K.mix(K.windows(hashes, size))[full]
        for i in short:
            own = hashes[words.first[i] : words.first[i + 1]]
            got[at[i]] = K.mix(K.windows(own, len(own)) ^ _U(len(own)))[0]
        out.append(got)
    return out, at


def _digest(items: np.ndarray, signature: bytes) -> bytes:
    """128 bits of a set (of one hash) and its signature (of the other)."""
    return hashlib.blake2b(items.tobytes() + signature, digest_size=16).digest()


def minhashes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts x SIZE minhashes of non-empty texts."""
    out = np.empty((len(at) - 1, SIZE), np.uint32)
    low = (values >> _U(32)).astype(np.uint32)
    for k in range(SIZE):
        out[:, k] = np.minimum.reduceat((low ^ _XOR[k]) * _ODD[k], at[:-1])
    return out


def sketches(df: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, signature); digest and signature are null for an empty set."""

    def run(batches):
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            n_all, digests, signatures = [], [], []
            for lo, hi in K.slices(offsets):
                (values, second), at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size, (0, 1))
                full = np.flatnonzero(np.diff(at))
                signed = minhashes(second, np.append(at[full], at[-1])) if len(full) else None
                n = np.zeros(hi - lo, np.int64)
                own_digest: list = [None] * (hi - lo)
                own_signature: list = [None] * (hi - lo)
                for j, i in enumerate(full):
                    own = np.unique(values[at[i] : at[i + 1]])
                    n[i] = len(own)
                    own_signature[i] = signed[j].tobytes()
                    own_digest[i] = _digest(own, own_signature[i])
                n_all.append(n)
                digests += own_digest
                signatures += own_signature
            n = np.concatenate(n_all) if n_all else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def first_depth(threshold: float) -> int:
    """The depth, SHALLOW at most, at which a pair at the threshold shares a region with a probability of 0.95 or more."""
    return max([d for d in range(1, SHALLOW + 1) if (1 - threshold**d) ** TREES <= 0.05], default=1)


def _matrix(column, kind: str, width: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(-1, width)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of equal width as binaries."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def labels(classes: DataFrame) -> DataFrame:
    """(rep, sig, tree, label): each class in each tree's order; a label's bytes sort as its minhashes do. sig tells classes of one rep apart."""

    def run(batches):
        for batch in batches:
            own = _matrix(batch.column("signature"), "<u4", SIZE).astype(">u4").reshape(-1, DEPTH)
            rows = [np.repeat(batch.column(c).to_numpy(), TREES) for c in ("rep", "sig")]
            tree = np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(tree), _fixed(own)], names=["rep", "sig", "tree", "label"])

    return classes.select("rep", F.xxhash64("signature").alias("sig"), "signature").mapInArrow(run, "rep long, sig long, tree int, label binary")


def _prefix(depth) -> Column:
    return F.substring("label", F.lit(1), F.lit(4) * depth)


def _turned(rows: DataFrame, depth: int) -> DataFrame:
    """Each row in the orders whose first `depth` values are the tree's and whose others are turned about."""
    start, turn = F.lit(4 * depth + 1), F.lit(4) * F.col("turn")
    label = F.concat(_prefix(F.lit(depth)), F.substring("label", start + turn, F.lit(4 * (DEPTH - depth))), F.substring("label", start, turn))
    return rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - depth - 1)))).withColumn("label", label)


def _over_full(rows: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of the large regions (key, n); no task gets all of a region."""
    if large.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        return rows.join(F.broadcast(large), "key")
    salts = min(partitions(rows.sparkSession), 256)
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def leaves(classes: DataFrame, first: int) -> DataFrame:
    """(rep, sig, tree, turn, label, depth, n): the regions of two or more rows at the depths that their sizes ask for.

    n is a region's number of blocks.
    """
    rows, found = labels(classes).withColumn("turn", F.lit(0)), []
    for depth in range(first, min(first + DEEPER, DEPTH) + 1):
        rows = rows.withColumn("key", F.xxhash64("tree", "turn", _prefix(F.lit(depth))))
        met = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        small, large = met.where(F.col("n") <= HOT).select("key"), met.where(F.col("n") > HOT)
        at = lambda df, n: df.select("rep", "sig", "tree", "turn", "label", F.lit(depth).alias("depth"), n.cast("long").alias("n"))  # noqa: E731, B023
        found.append(at(thinned(rows, small, "key").join(small, "key", "left_semi"), F.lit(1)))
        if large.isEmpty():
            break
        rows = cut(_over_full(rows, large))
        if depth == min(first + DEEPER, DEPTH):
            found.append(at(rows, F.ceil(F.col("n") / (WIDE * HOT))))
        elif depth == first:
            rows = _turned(rows, first)
        rows = rows.drop("n", "key")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


class Links:
    """Union-find over 0..n-1; remembers the pairs that joined two sets."""

    def __init__(self, n: int):
        self.parent, self.pairs = list(range(n)), []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.pairs.append((i, j))
        return True


def _region(marks: np.ndarray, side: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows, in their order, whose marks agree in `least` places or more.

    Where there are two sides, pairs of one side may be left out: they meet in a task of their own.
    """
    # no row has a longer common prefix with another than with a neighbour of its own
    near = (marks[1:] == marks[:-1]).sum(1) >= least
    label = np.concatenate([[0], np.cumsum(~near)])
    pairs = [(int(i), int(i) + 1) for i in np.flatnonzero(near)]

    def meet(i: int, rows: np.ndarray, columns: np.ndarray) -> None:
        for lo in range(0, len(rows), REGION):
            own = rows[lo : lo + REGION]
            agree = (columns[:, lo : lo + len(own)] == marks[i][:, None]).view(np.uint8).sum(0, dtype=np.uint8)
            near = own[agree >= least]
            near = near[label[near] != label[i]]
            if len(near):
                joined, first = np.unique(label[near], return_index=True)
                pairs.extend((int(j), i) for j in near[first])
                label[np.isin(label, joined)] = label[i]

    rows = np.arange(len(marks))
    columns = np.ascontiguousarray(marks.T)
    # near copies become one group by their likeness to a few rows
    for i in range(min(64, len(marks))):
        meet(i, rows[i + 1 :], columns[:, i + 1 :])
    names, sizes = np.unique(label, return_counts=True)
    # what is in the largest group is linked already: only pairs with a row outside it are left
    out = label != names[np.argmax(sizes)]
    left = side == side[0]
    if left.all():
        order = np.concatenate([rows[~out], rows[out]])
        tasks = [(rows[out], order, np.count_nonzero(~out))]
    else:
        tasks = [(rows[out & ~left], rows[left], None), (rows[out & left], rows[~left & ~out], None)]
    for asking, order, first in tasks:
        columns = np.ascontiguousarray(marks[order].T)
        for k, i in enumerate(asking):
            if len(pairs) == len(marks) - 1:
                return pairs
            end = len(order) if first is None else first + k
            meet(int(i), order[:end], columns[:, :end])
    return pairs


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    yield from zip(np.append(0, cuts), np.append(cuts, len(keys)))


def by_group(batches, columns: list[str], key: str):
    """Whole groups of a stream sorted by key: batches that end where a group ends."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held[key].to_numpy()
        if not len(keys):
            continue
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if last:
            yield held.slice(0, last).combine_chunks().select(columns)
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks().select(columns)


def whole_groups(rows: DataFrame) -> DataFrame:
    """rows, sorted by key, all of a key in one partition: for by_group.

    Spark leaves out a shuffle by a column that a join below has dealt the rows by already, and may then change
    that join, so that a key's rows lie in many partitions. It keeps a shuffle by an expression of the column.
    """
    return rows.repartition(partitions(rows.sparkSession), F.xxhash64("key")).sortWithinPartitions("key")


def loose_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): classes whose signatures agree nearly enough, as a spanning forest of each region."""
    least = int(np.ceil(SIZE * (threshold - 4.1 * np.sqrt(threshold * (1 - threshold) / SIZE))))

    def marked(batches):
        for batch in batches:
            marks = _matrix(batch.column("signature"), "<u4", SIZE).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("sig"), _fixed(marks)], names=["rep", "sig", "marks"])

    def compare(batches):
        for table in by_group(batches, ["key", "rep", "side", "marks"], "key"):
            keys, reps, side = table["key"].to_numpy(), table["rep"].to_numpy(), table["side"].to_numpy()
            rows = _matrix(table["marks"], np.uint8, SIZE)
            runs = np.array(list(_runs(keys)), np.int64).reshape(-1, 2)
            size = runs[:, 1] - runs[:, 0]
            two = runs[size == 2, 0]
            same = (rows[two] == rows[two + 1]).sum(1) >= least
            a, b = [reps[two[same]]], [reps[two[same] + 1]]
            for lo, hi in runs[size > 2]:
                pairs = _region(rows[lo:hi], side[lo:hi], least)
                if pairs:
                    pairs = np.array(pairs) + lo
                    a.append(reps[pairs[:, 0]])
                    b.append(reps[pairs[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    places = cut(leaves(classes, first_depth(threshold)))
    wanted = thinned(classes.select("rep", "signature"), places.select("rep"), "rep").select("rep", F.xxhash64("signature").alias("sig"), "signature").distinct()
    rows = places.join(wanted.mapInArrow(marked, "rep long, sig long, marks binary"), ["rep", "sig"])
    # a row of a region of several blocks meets its own block and every other
    rows = rows.withColumn("side", F.pmod(F.xxhash64("rep", "tree", "turn"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.select("tree", "turn", _prefix(F.col("depth")).alias("prefix"), F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "label", "rep", "side", "marks")
    region = ["tree", "turn", "prefix", "low", "high"]
    # no region's prefix begins another's of its order, so this sorts whole orders and never parts a region
    rows = rows.repartitionByRange(partitions(rows.sparkSession), *region).sortWithinPartitions(*region, "label")
    rows = rows.select(F.xxhash64(*region).alias("key"), "rep", "side", "marks")
    return rows.mapInArrow(compare, "a long, b long").distinct()


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Adds the sorted set to (doc_id, text, digest, signature, component, shingles); keeps the rows that have the digest."""

    def run(batches):
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            digests, signatures = batch.column("digest").to_pylist(), batch.column("signature").to_pylist()
            keep, sets = [], []
            for lo, hi in K.slices(offsets):
                (values,), at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                full = np.flatnonzero(np.diff(at))
                for i in full:
                    own = np.unique(values[at[i] : at[i + 1]])
                    if _digest(own, signatures[lo + i]) == digests[lo + i]:
                        keep.append(lo + i)
                        sets.append(own.tobytes())
            picked = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column("doc_id"), picked.column("component"), picked.column("shingles"), picked.column("signature"), pa.array(sets, pa.binary())], names=["rep", "component", "shingles", "signature", "items"])

    return docs.mapInArrow(run, "rep long, component long, shingles long, signature binary, items binary")


def _confirm(sets: list[np.ndarray], marks: np.ndarray, side: np.ndarray | None, percent: int, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union; side: only pairs of unlike sides."""
    links = Links(len(sets))
    lengths = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    at = np.concatenate([[0], np.cumsum(lengths)])
    flag = np.zeros(int(ids.max()) + 1, np.int32)
    for i in range(1, len(sets)):
        near = (marks[:i] == marks[i]).sum(1) >= least
        near &= (100 * np.minimum(lengths[:i], lengths[i]) >= percent * np.maximum(lengths[:i], lengths[i]))
        if side is not None:
            near &= side[:i] != side[i]
        near = np.flatnonzero(near)
        if not len(near):
            continue
        own = ids[at[i] : at[i + 1]]
        flag[own] = 1
        while len(near):
            roots = np.array([links.root(int(j)) for j in near])
            near = near[roots != links.root(i)]
            tried, near = near[:32], near[32:]
            if not len(tried):
                break
            common = [int(flag[ids[at[j] : at[j + 1]]].sum()) for j in tried]
            for j, c in zip(tried, common):
                if 100 * c >= percent * (lengths[i] + lengths[j] - c):
                    links.link(int(j), i)
        flag[own] = 0
    return links.pairs


def _links_within(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links that connect what is linked among the rows of each key.

    rows: (key, rep, signature, items, side); rows of one side are not compared where a key has two.
    """
    threshold = percent / 100
    least = int(np.ceil(SIZE * (threshold - 4.1 * np.sqrt(threshold * (1 - threshold) / SIZE))))

    def compare(batches):
        for table in by_group(batches, ["key", "rep", "signature", "items", "side"], "key"):
            a, b = [], []
            for lo, hi in _runs(table["key"].to_numpy()):
                own = table.slice(lo, hi - lo)
                distinct = {x: i for i, x in enumerate(zip(own["rep"].to_pylist(), own["items"].to_pylist()))}
                if len(distinct) < 2:
                    continue
                own = own.take(pa.array(sorted(distinct.values())))
                reps, side = own["rep"].to_numpy(), own["side"].to_numpy()
                sets = [np.frombuffer(x, _U) for x in own["items"].to_pylist()]
                marks = _matrix(own["signature"], "<u4", SIZE).astype(np.uint8)
                for i, j in _confirm(sets, marks, side if (side != side[0]).any() else None, percent, least):
                    a.append(min(reps[i], reps[j]))
                    b.append(max(reps[i], reps[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return whole_groups(rows).mapInArrow(compare, "a long, b long")


def _blocks(rows: Column, shingles_: Column) -> Column:
    """Blocks that rows of so many shingles need; two of them meet in a task."""
    return F.greatest(F.ceil(rows / F.lit(BLOCK_ROWS / 2)), F.ceil(shingles_ / F.lit(BLOCK / 2))).cast("int")


def confirmed_edges(df: DataFrame, classes: DataFrame, groups: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """(a, b): confirmed links that connect what is linked within each loose group.

    A group beyond a block is dealt into blocks at random, twice. The parts that these links make of it are
    final but for links between them: what lies outside the largest part is compared with all of the group.
    """
    members = classes.join(groups, classes.rep == groups.id).select(F.col("rep").alias("doc_id"), "digest", "signature", "component", F.col("n_shingles").alias("shingles"))
    members = cut(members)
    sums = [F.sum("shingles").alias("total"), F.count("*").alias("size")]
    large = cut(members.groupBy("component").agg(*sums).where((F.col("total") > BLOCK) | (F.col("size") > BLOCK_ROWS)))
    texts = thinned(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), members.select("doc_id"), "doc_id")
    sets = _sets(texts.join(members, "doc_id"), size)
    row = lambda key, side: [key.alias("key"), F.col("rep"), F.col("signature"), F.col("items"), side.cast("int").alias("side")]
    if large.isEmpty():
        return _links_within(sets.select(*row(F.col("component"), F.lit(0))), percent)
    sets = cut(sets)
    few = sets.join(large.select("component"), "component", "left_anti")
    found = cut(_links_within(few.select(*row(F.col("component"), F.lit(0))), percent))
    many = cut(sets.join(large, "component").withColumn("n", _blocks(F.col("size"), F.col("total"))))
    block = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), n)
    for salt in (1, 2):
        found = found.union(_links_within(many.select(*row(F.xxhash64("component", block(salt, F.col("n")), F.lit(salt)), F.lit(0))), percent))
    found = cut(found)
    parts = many.join(components(found).select(F.col("id").alias("rep"), F.col("component").alias("part")), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    sizes = parts.groupBy("component", "part").agg(F.count("*").alias("rows"), F.sum("shingles").alias("shingles_"))
    greatest = F.max(F.struct("rows", "shingles_", "part")).alias("main")
    left = sizes.groupBy("component").agg(greatest, F.sum("rows").alias("rows"), F.sum("shingles_").alias("shingles_"))
    left = left.where("main.rows < rows").select("component", F.col("main.part").alias("main"), _blocks(F.col("main.rows"), F.col("main.shingles_")).alias("n_main"), _blocks(F.col("rows") - F.col("main.rows"), F.col("shingles_") - F.col("main.shingles_")).alias("n_rest"))
    left = cut(left)
    if left.isEmpty():
        return found
    rest = parts.join(left, "component")
    inside, outside = rest.where("part = main"), rest.where("part <> main")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # in a task of two sides only rows of unlike sides are compared
    # an int and a long of one value hash apart
    key = lambda kind, a, b: F.xxhash64("component", F.lit(kind), a.cast("long"), b.cast("long"))
    main_rows = inside.withColumn("other", to("n_rest")).select(*row(key("main", F.col("other"), block(3, F.col("n_main"))), F.lit(-1)))
    own = block(3, F.col("n_rest"))
    meets_main = outside.withColumn("other", to("n_main")).select(*row(key("main", own, F.col("other")), F.lit(0)))
    meets_rest = outside.withColumn("own", own).withColumn("other", to("n_rest")).select(*row(key("rest", F.least("own", "other"), F.greatest("own", "other")), F.col("own")))
    return found.union(_links_within(main_rows.union(meets_main).union(meets_rest), percent))


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id
    is the smallest doc_id reachable, kept says whether that is the document itself.
    """
    ship(df.sparkSession)
    sketched = cut(sketches(df, doc_id, text, shingle))
    classes = sketched.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"))
    classes = cut(classes.where("rep is not null"))
    groups = components(loose_edges(classes, percent / 100))
    linked = components(confirmed_edges(df, classes, groups, doc_id, text, shingle, percent))
    named = classes.join(linked, classes.rep == linked.id, "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op9_minhash_forest(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: five-word shingles, similarity of 0.85 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, percent=85)
