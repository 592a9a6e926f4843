"""Scores of class pairs: blob similarity, method matching, and the comparison that combines them.

All of it is row-local: a pair row that carries both classes is scored by built-in expressions, its methods
in batches of rows by one Arrow kernel, so no shuffle follows the join that made the pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.functions.edits import Texts, distances
from kindred.schema import METHOD_FLOOR, OBJECT
from kindred.schema import SCORE_WEIGHTS as W
from kindred.session import ship


def hierarchy_tokens(superclass: Column, interfaces: Column) -> Column:
    own = superclass.isNotNull() & (superclass != OBJECT) & S.is_framework(superclass)
    one = F.when(own, F.array(F.concat(F.lit("S:"), superclass))).otherwise(F.array().cast("array<string>"))
    return F.concat(one, F.transform(F.filter(interfaces, S.is_framework), lambda i: F.concat(F.lit("I:"), i)))


def structural_features(a: Column, b: Column) -> Column:
    """struct of nmethods, nfields, access, field_types, method_protos, hierarchy (null if neither has any), average."""
    types = lambda c: F.transform(c["fields"], lambda f: f["type_desc"])
    protos = lambda c: F.transform(c["methods"], lambda m: F.concat_ws("|", m["return_type"], m["arg_count"].cast("string")))
    parts = {
        "nmethods": S.ratio(F.size(a["methods"]), F.size(b["methods"])),
        "nfields": S.ratio(F.size(a["fields"]), F.size(b["fields"])),
        "access": S.flag_jaccard(a["access"], b["access"]),
        "field_types": S.bag_jaccard(types(a), types(b)),
        "method_protos": S.bag_jaccard(protos(a), protos(b)),
    }
    both = F.struct(hierarchy_tokens(a["superclass"], a["interfaces"]).alias("a"), hierarchy_tokens(b["superclass"], b["interfaces"]).alias("b"))
    hierarchy = S.let(both, lambda h: F.when(F.size(h["a"]) + F.size(h["b"]) > 0, S.bag_jaccard(h["a"], h["b"])))
    made = F.struct(*[v.alias(k) for k, v in parts.items()], hierarchy.alias("hierarchy"))

    def averaged(f: Column) -> Column:
        base = sum((f[k] for k in parts), F.lit(0.0))
        average = F.when(f["hierarchy"].isNull(), base / 5).otherwise((base + f["hierarchy"]) / 6)
        return F.struct(*[f[k].alias(k) for k in (*parts, "hierarchy")], average.alias("average"))

    return S.let(made, averaged)


def class_similarity(a: Column, b: Column) -> Column:
    """The score that ranks candidates: edit similarity of the whole abstract sequences, and the features."""
    edit = S.edit_similarity(a["sequence"], b["sequence"])
    return W["bytecode"] * edit + W["features"] * structural_features(a, b)["average"]


#: Method pairs that are looked at together, whatever class pairs they are of.
BLOCK_PAIRS = 1 << 20
METHOD_ROWS = "array<struct<l:int,r:int,score:double,status:string>>"


def _numbered(values: pa.Array) -> np.ndarray:
    """Equal values have equal numbers; nulls -1."""
    return pc.fill_null(values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


class _Methods:
    """The methods of many classes on both sides, one after the other."""

    def __init__(self, left: pa.ListArray, right: pa.ListArray):
        self.sides = []
        parts = {f: [] for f in ("abstract", "return_type", "arg_count", "xref_count")}
        base = 0
        for side in (left, right):
            size = pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = side.flatten()
            for f, got in parts.items():
                got.append(flat.field(f))
            self.sides.append((base + np.cumsum(size) - size, size))
            base += len(flat)
        whole = {f: pa.chunked_array(got).combine_chunks() for f, got in parts.items()}
        coded = whole["abstract"].dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.body = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.bodies = coded.dictionary
        self.returns = _numbered(whole["return_type"])
        number = lambda f: pc.fill_null(whole[f], -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.args, self.xrefs = number("arg_count"), number("xref_count")
        #: Methods that can be matched and that nothing has taken yet.
        self.free = (self.body >= 0) & (self.args >= 0) & (self.xrefs >= 0)
        self.texts, self.text = None, None

    def read(self) -> None:
        """Makes texts of the bodies of free methods; text tells a method's place among them."""
        used = np.unique(self.body[self.free])
        self.texts = Texts([t or "" for t in self.bodies.take(pa.array(used)).to_pylist()])
        place = np.zeros(len(self.bodies) + 1, np.int64)  # the last for methods without a body
        place[used] = np.arange(len(used))
        self.text = place[self.body]

    def scored(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these pairs of methods reach the floor, and their scores; before texts are read, which of equal bodies have score 1."""

        def ratio(of: np.ndarray) -> np.ndarray:
            a, b = of[x], of[y]
            return np.where((a == 0) & (b == 0), 1.0, 1.0 - np.abs(a - b) / np.maximum(np.maximum(a, b), 1))

        proto = np.where((self.returns[x] == self.returns[y]) & (self.returns[x] >= 0), 0.5, 0.0) + 0.5 * ratio(self.args)
        rest = W["method_proto"] * proto + W["method_xref"] * ratio(self.xrefs)
        if self.texts is None:
            # pairs of equal bodies
            score = W["method_bytecode"] + rest
            at = np.flatnonzero(score >= 1.0 - 1e-9)
            return at, np.ones(len(at))
        la, lb = (self.texts.length[self.text[k]] if len(self.texts.length) else np.zeros(len(k), np.int64) for k in (x, y))
        longest = np.maximum(la, lb)
        # the lengths alone bound the score from above: only pairs that can reach the floor are aligned
        bound = W["method_bytecode"] * np.where(longest == 0, 1.0, np.minimum(la, lb) / np.maximum(longest, 1)) + rest
        at = np.flatnonzero(bound >= METHOD_FLOOR - 1e-9)
        rest, longest = rest[at], longest[at]
        pair, back = np.unique(self.text[x[at]] * len(self.texts.length) + self.text[y[at]], return_inverse=True)
        # the greatest distance with which any pair of these bodies reaches the floor
        most = np.zeros(len(pair), np.int64)
        np.maximum.at(most, back, np.floor(longest * (1.0 - (METHOD_FLOOR - rest) / W["method_bytecode"]) + 1e-6).astype(np.int64))
        far = distances(self.texts, pair // max(len(self.texts.length), 1), pair % max(len(self.texts.length), 1), most)[back]
        score = W["method_bytecode"] * np.where(longest == 0, 1.0, 1.0 - far / np.maximum(longest, 1)) + rest
        score = np.where(score >= 1.0 - 1e-9, 1.0, score)
        good = (score >= METHOD_FLOOR) & (far <= most[back])
        return at[good], score[good]

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class pair, left, right, score) of the pairs of free methods that scored tells; pairs are made a block at a time."""
        (l0, ln), (r0, rn) = self.sides
        row = np.repeat(np.arange(len(ln)), ln)  # a row for each left method
        i = np.arange(len(row)) - np.repeat(np.cumsum(ln) - ln, ln)
        open_ = self.free[l0[row] + i]
        row, i = row[open_], i[open_]
        many = rn[row]
        ends = np.cumsum(many)
        out, lo = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0)]], 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_PAIRS, "right")))
            each = many[lo:hi]
            own = np.repeat(np.arange(lo, hi), each)
            j = np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)
            x, y = l0[row[own]] + i[own], r0[row[own]] + j
            met = self.free[y] if self.texts is not None else self.free[y] & (self.body[x] == self.body[y])
            own, j, x, y = own[met], j[met], x[met], y[met]
            at, score = self.scored(x, y)
            out.append([row[own[at]], i[own[at]], j[at], score])
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*out))

    def matched(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class pair, left, right, score) of the method pairs that greedy matching takes.

        Score 1 comes before all others, and only equal bodies have it. So pairs of score 1 are taken before any text is
        read, and the texts that are aligned are those of the methods that are left.
        """
        (l0, _), (r0, _) = self.sides
        out = []
        for aligned in (False, True):
            if aligned:
                self.read()
            found = self.candidates()
            got = greedy_places(*found)
            row, i, j, score = (x[got] for x in found)
            self.free[l0[row] + i] = False
            self.free[r0[row] + j] = False
            out.append([row, i, j, score])
        return tuple(np.concatenate(x) for x in zip(*out))


def greedy_places(row: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the pairs that greedy matching by (score descending, i, j) takes in each row: rounds of those that are the first of both their ends."""
    left = np.lexsort((j, i, -score, row))
    taken = []
    while len(left):
        first = np.ones(len(left), bool)
        for end in (i, j):
            own = np.zeros(len(left), bool)
            own[np.unique(row[left] << 32 | end[left], return_index=True)[1]] = True
            first &= own
        got = left[first]
        taken.append(got)
        keep = ~first
        for end in (i, j):
            keep &= ~np.isin(row[left] << 32 | end[left], row[got] << 32 | end[got])
        left = left[keep]
    return np.concatenate([np.zeros(0, np.int64), *taken])


def _rows(left: pa.Array, right: pa.Array) -> pa.Array:
    methods = _Methods(left, right)
    row, i, j, score = methods.matched()
    (l0, ln), (r0, rn) = methods.sides
    base = r0 - (r0[0] if len(r0) else 0)
    to, back = np.full(int(ln.sum()), -1), np.zeros(int(rn.sum()), bool)
    worth = np.zeros(len(to))
    place = l0[row] + i
    to[place], worth[place] = j, score
    back[base[row] + j] = True
    # left methods in order, then the right ones that nothing took
    of_left = np.repeat(np.arange(len(ln)), ln)
    of_right = np.repeat(np.arange(len(rn)), rn)[~back]
    own = np.arange(len(to)) - np.repeat(np.cumsum(ln) - ln, ln)
    new = (np.arange(len(back)) - np.repeat(np.cumsum(rn) - rn, rn))[~back]
    order = np.argsort(np.concatenate([of_left, of_right]), kind="stable")
    none = lambda x, gone: pa.array(x[order].astype(np.int32), mask=gone[order])
    k, m = len(to), len(new)
    both = lambda a, b: np.concatenate([a, b])
    lefts = none(both(own, np.zeros(m, np.int64)), both(np.zeros(k, bool), np.ones(m, bool)))
    rights = none(both(np.maximum(to, 0), new), both(to < 0, np.zeros(m, bool)))
    scores = both(worth, np.zeros(m))[order]
    kinds = both(np.where(to < 0, 2, np.where(worth >= 1.0, 0, 1)), np.full(m, 3))[order]
    status = pa.DictionaryArray.from_arrays(pa.array(kinds.astype(np.int8)), pa.array(["matched", "modified", "deleted", "added"])).cast(pa.string())
    items = pa.StructArray.from_arrays([lefts, rights, pa.array(scores), status], names=["l", "r", "score", "status"])
    sizes = np.bincount(np.concatenate([of_left, of_right]), minlength=len(ln)) if len(ln) else np.zeros(0, int)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), items)


def method_rows(a: Column, b: Column) -> Column:
    """array<struct<l, r, score, status>> of two method arrays: left methods in order, then added ones; l and r are places or null.

    Pairs are taken greedily by (score descending, l, r) at or above the floor. A batch of rows is matched together:
    the method pairs of all its class pairs are scored a block at a time, whichever classes they are of. Methods
    of which a needed value is null match nothing.
    """

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return _rows(left, right)

    slim = lambda c: F.transform(c, lambda m: F.struct(m["abstract"].alias("abstract"), m["return_type"].alias("return_type"), m["arg_count"].alias("arg_count"), m["xref_count"].alias("xref_count")))
    return F.arrow_udf(run, METHOD_ROWS)(slim(a), slim(b))


def method_rollup(a: Column, b: Column, rows: Column) -> Column:
    """Mean method score, each weighted by the longer side's instructions plus one; 1 without methods."""
    weight = lambda x: F.greatest(F.coalesce(F.get(a, x["l"])["instr_count"], F.lit(0)), F.coalesce(F.get(b, x["r"])["instr_count"], F.lit(0)), F.lit(0)) + 1.0
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"))
    total = F.aggregate(rows, zero, lambda got, x: F.struct((got["w"] + weight(x)).alias("w"), (got["s"] + weight(x) * x["score"]).alias("s")))
    return F.when(F.size(rows) == 0, 1.0).otherwise(total["s"] / total["w"])


def _expressions(a: str, b: str) -> tuple[Column, ...]:
    x, y = F.col(a), F.col(b)
    rollup = method_rollup(x["methods"], y["methods"], F.col("method_rows"))
    overall = W["bytecode"] * F.col("_rollup") + W["features"] * F.col("features.average")
    count = lambda status: F.size(F.filter("method_rows", lambda r: r["status"] == status)).cast("double")
    parts = [F.lit("bytecode"), F.col("_rollup"), F.lit("overall"), F.col("similarity")]
    for f in ("nmethods", "nfields", "access", "field_types", "method_protos"):
        parts += [F.lit(f), F.col(f"features.{f}")]
    for status in ("matched", "modified", "added", "deleted"):
        parts += [F.lit(f"methods_{status}"), count(status)]
    breakdown = F.create_map(*parts)
    more = F.when(F.col("features.hierarchy").isNotNull(), F.map_concat(breakdown, F.create_map(F.lit("hierarchy"), F.col("features.hierarchy")))).otherwise(breakdown)
    return method_rows(x["methods"], y["methods"]), structural_features(x, y), rollup, overall, more


def compared(df, a: str = "a", b: str = "b"):
    """Adds method_rows, features and similarity to rows that carry two classes."""
    context = df.sparkSession.sparkContext
    ship(df.sparkSession)
    # rounds compare again and again: the expressions, some thousand calls to build, are kept with their context
    kept = context.__dict__.setdefault("_kindred_compared", {})
    if (a, b) not in kept:
        kept[a, b] = _expressions(a, b)
    rows, features, rollup, overall, breakdown = kept[a, b]
    df = df.withColumn("method_rows", rows).withColumn("features", features).withColumn("_rollup", rollup)
    return df.withColumn("similarity", overall).withColumn("breakdown", breakdown).drop("_rollup", "features")
