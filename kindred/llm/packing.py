"""Best-fit packing of tokenized documents by linear grouping.

1. Every document is tokenized whole and cut only where it exceeds a sequence; the pieces' lengths
   are counted exactly, by length (at most `capacity` counts, whatever the corpus' size).
2. The plan is made from those counts alone. Large lengths are split into groups of equal
   cardinality and rounded up to their group's greatest. Configurations of the few rounded sizes are
   optimised by column generation (a linear program over knapsack patterns); whole multiples are
   used, the rest of the large pieces goes best-fit. Actual lengths are then substituted for the
   rounded ones, in the last slot the one that fits best, and the small pieces go best-fit into what
   is left, longest first.
   The plan is a list of runs: so many sequences with the same lengths. Its size follows from the
   number of lengths and configurations, not from that of the documents.
3. A piece's rank among those of its length (counted per task, then summed) leads to its run,
   sequence and offset.

Defined results: a null or empty text is the end token alone. Repeated documents are packed each. An
empty table gives no row. No piece is dropped or overlaps another.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from kindred.llm.shared import cut
from kindred.session import ship

END = 2


class Tokenizer:
    """Ids of a byte-level BPE file by `tokenizers`; its .tiktoken twin, where there is one, is the
    faster reader of the same vocabulary and is used for texts without a special token's string."""

    def __init__(self, path: str):
        import json
        import os

        from tokenizers import Tokenizer as Slow

        self.slow = Slow.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.fast = None
        twin = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(twin):
            import base64

            import public_tokenizers
            import tiktoken

            with open(twin, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(x in text for x in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all full but the first."""
    first = total % capacity
    return ([first] if first else []) + [capacity] * (total // capacity)


def pieces(df: DataFrame, path: str | None, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): nth counts a task's pieces of a length."""
    ship(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        if path is None:
            import public_tokenizers

            own = tokenizer(str(public_tokenizers.path("byte_bpe_50k.json")))
        else:
            own = tokenizer(path)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*own.ids(value.as_py() or ""), END], "<u4")
                start = 0
                for i, length in enumerate(cut_lengths(len(ids), capacity)):
                    for col, x in zip(out, (doc, i, start, length, zlib.crc32(ids[start : start + length].tobytes()), seen[length])):
                        col.append(x)
                    seen[length] += 1
                    start += length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(x, k) for x, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(out[0]), task), pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task int")


# ---- the plan


def _pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = np.flatnonzero(sizes <= c)
        if len(fits):
            with_it = best[c - sizes[fits]] + values[fits]
            k = int(np.argmax(with_it))
            if with_it[k] > best[c] + 1e-12:
                best[c], take[c] = with_it[k], fits[k]
    out, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            out[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, steps: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Whole multiples of configurations, from the linear program min sum x, A x = counts, by columns."""
    m = len(sizes)
    basis = np.diag(np.maximum(capacity // sizes, 1)).astype(float)
    x = counts / np.diag(basis)
    for _ in range(steps):
        prices = np.linalg.solve(basis.T, np.ones(m))
        value, column = _pattern(sizes, prices, capacity)
        if value <= 1 + 1e-9:
            break
        move = np.linalg.solve(basis, column.astype(float))
        good = move > 1e-12
        if not good.any():
            break
        ratio = np.full(m, np.inf)
        ratio[good] = x[good] / move[good]
        out = int(np.argmin(ratio))
        step = ratio[out]
        x = np.maximum(x - step * move, 0)
        x[out] = step
        basis[:, out] = column
    return [(basis[:, j].astype(int), int(np.floor(x[j] + 1e-9))) for j in range(m) if x[j] >= 1 - 1e-9]


def _longest(left: np.ndarray, low: int, high: int, need: int) -> list[list[int]]:
    """Takes the longest `need` pieces with low < length <= high (or all there are): [length, count]."""
    got = []
    for v in np.flatnonzero(left[low + 1 : high + 1])[::-1] + low + 1:
        if not need:
            break
        part = min(int(left[v]), need)
        left[v] -= part
        need -= part
        got.append([int(v), part])
    return got


def plan(counts: np.ndarray, capacity: int, *, large: float = 0.125, groups: int = 96) -> list[tuple[list[int], int]]:
    """Runs (lengths, how many sequences) that use counts[length] pieces of every length exactly.

    Lengths above large * capacity count as large. A configuration's slots but the last take the longest
    pieces of their groups; the last takes the piece, of any group, that best fits what these leave.
    """
    left = counts.astype(np.int64).copy()
    runs: list[tuple[list[int], int]] = []
    if left[capacity]:
        runs.append(([capacity], int(left[capacity])))
        left[capacity] = 0
    floor = int(capacity * large)
    big = np.flatnonzero(left[floor + 1 :]) + floor + 1
    open_runs: list[tuple[list[int], int]] = []
    if len(big):
        # groups of (nearly) equal cardinality; all pieces of a length are in one
        passed = np.cumsum(left[big])
        n_groups = min(groups, len(big))
        exact = n_groups == len(big)  # every length is a group of its own: nothing is rounded
        group = np.arange(len(big)) if exact else np.minimum((passed - 1) * n_groups // passed[-1], n_groups - 1)
        last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
        tops = big[last].astype(int)
        bottoms = np.concatenate([[floor], tops[:-1]])
        have = np.diff(np.concatenate([[0], passed[last]]))
        made = configurations(tops, have.astype(float), capacity)
        # fullest first
        for pattern, times in sorted(made, key=lambda x: -int(x[0] @ tops)):
            slots = [int(k) for k in np.flatnonzero(pattern)[::-1] for _ in range(pattern[k])]
            firsts, end = slots[:-1], slots[-1]
            for k in set(firsts):
                times = min(times, int(left[bottoms[k] + 1 : tops[k] + 1].sum()) // firsts.count(k))
            if times <= 0:
                continue
            parts: list[tuple[list[int], int]] = [([], times)]
            for k in firsts:
                taken, split = _longest(left, bottoms[k], tops[k], times), []
                for lengths, n in parts:
                    while n:
                        part = min(n, taken[0][1])
                        split.append((lengths + [taken[0][0]], part))
                        n -= part
                        taken[0][1] -= part
                        if not taken[0][1]:
                            taken.pop(0)
                parts = split
            for lengths, n in parts:
                room = capacity - sum(lengths)
                while n:
                    low = bottoms[end] if exact else floor
                    fit = np.flatnonzero(left[low + 1 : (room if lengths and not exact else tops[end]) + 1])
                    if not len(fit):
                        open_runs.append((lengths, n))
                        break
                    v = int(fit[-1]) + int(low) + 1
                    part = min(n, int(left[v]))
                    left[v] -= part
                    n -= part
                    open_runs.append((lengths + [v], part))
    # best-fit of all that is left, longest first: by room, the runs that have it
    rooms: dict[int, list[tuple[list[int], int]]] = {}

    def put(lengths: list[int], times: int) -> None:
        if times:
            rooms.setdefault(capacity - sum(lengths), []).append((lengths, times))

    for lengths, times in open_runs:
        if lengths:
            put(lengths, times)
    for v in range(capacity, 0, -1):
        n = int(left[v])
        while n:
            fitting = [r for r in rooms if r >= v]
            if not fitting:
                each = capacity // v
                put([v] * each, n // each)
                put([v] * (n % each), 1 if n % each else 0)
                break
            room = min(fitting)
            lengths, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = room // v
            full = min(times, n // each)
            put(lengths + [v] * each, full)
            n, times = n - full * each, times - full
            if n and times:
                put(lengths + [v] * n, 1)
                n, times = 0, times - 1
            put(lengths, times)
    for got in rooms.values():
        runs += got
    return runs


def placement(runs: list[tuple[list[int], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by rank: first rank of each stretch, its first sequence, slots, offset."""
    stretches: dict[int, list[tuple[int, int, int, int]]] = {}
    used = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for lengths, times in runs:
        ordered = sorted(lengths, reverse=True)
        offset = i = 0
        while i < len(ordered):
            v = ordered[i]
            m = ordered.count(v)
            stretches.setdefault(v, []).append((int(used[v]), sequence, m, offset))
            used[v] += m * times
            offset, i = offset + m * v, i + m
        sequence += times
    return {v: tuple(np.array(x, np.int64) for x in zip(*rows)) for v, rows in stretches.items()}


def pack(df: DataFrame, *, path: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = cut(pieces(df, path, doc_id=doc_id, text=text, capacity=capacity))
    per_task = parts.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in parts.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(placement(plan(counts, capacity), capacity))
    ranked = parts.join(starts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank"))

    def place(batches):
        where = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                mine = np.flatnonzero(length == v)
                first, base, slots, at = where[int(v)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                own = rank[mine] - first[k]
                sequence[mine] = base[k] + own // slots[k]
                offset[mine] = at[k] + own % slots[k] * v
            kept = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
