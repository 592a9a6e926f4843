"""Runs: stretches of words that repeat with a period, found with bit-parallel lags.

A run is a maximal stretch of consecutive words with smallest period q (words q apart are identical)
and at least max(`least`, `times` * q) words.

1. The words of a text are numbered; bit b of all numbers makes one big integer, a bit plane. For a
   lag q each plane is XORed with itself shifted by q and the results are ORed: a zero bit says that
   the words q apart are equal. ANDing the inverse with itself, shifted by 1, 2, 4, ... isolates
   the places where a long enough zero stretch begins. A stretch whose words have a divisor of q as a
   period belongs to that period and is no run of q.
2. Which lags are worth a try is told exactly: a run with `times` >= 4 and a period from P to 2 P - 1
   (P a power of two) holds two whole blocks of P words that start at a multiple of P, and the window
   of 2 P words there comes again q words later. Where a window comes again at several such
   distances, all but the greatest have a smaller period (their difference and they add up to less than
   2 P), so a block asks for one lag at most: of n words only about sqrt(n) lags are tried, not n / 4. Windows
   are numbered exactly, by doubling, and only those that a text holds twice are carried on.

Row-local, no shuffle: texts are handled in slices of about 2 MB, a longer one alone.

Defined results: null, empty and word-less texts have no words, no runs and an empty collapsed text.
Repeated rows are each judged alike; null ids are kept. A column named like an output is replaced.
An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import textkit as K
from kindred.llm.shared import columns, fresh, others, widened
from kindred.session import ship

LEAST, TIMES = 6, 4


def word_numbers(words: K.Words) -> np.ndarray:
    """Equal words have equal numbers."""
    if not words.count:
        return np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    wide = len(words.data) >= 1 << 31
    column = (pa.LargeBinaryArray if wide else pa.BinaryArray).from_buffers(
        pa.large_binary() if wide else pa.binary(), words.count, [None, pa.py_buffer(ends.astype(np.int64 if wide else np.int32)), pa.py_buffer(words.data[words.table[words.data]])]
    )
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct key, and which keys are there more than once."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, np.bincount(rank, minlength=1)[rank] > 1


def lags(numbers: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """(text, lag) for all lags that a run of at least four periods can have, sorted; first: where the texts' words start."""
    n = len(numbers)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rank, twice = _ranks(text * (int(numbers.max(initial=0)) + 1) + numbers)  # windows of one word
    places = np.flatnonzero(twice)
    rank = rank[places]
    found: set[tuple[int, int]] = set()
    half, size = 1, np.diff(first)
    while len(places) and 4 * half <= size.max():
        # windows of 2 * half words: of two neighbouring ones that are both there twice
        next_ = np.full(n, -1, np.int64)
        next_[places] = rank
        at = places[places + half < n]
        second = next_[at + half]
        good = (second >= 0) & (text[at] == text[np.minimum(at + half, n - 1)])
        at = at[good]
        if not len(at):
            break
        rank, twice = _ranks(next_[at] * (int(rank.max()) + 1) + second[good])
        places, rank = at[twice], rank[twice]
        # a block's window and the last place, half to 2 * half - 1 words later, where it comes again
        keys = rank * n + places
        keys.sort()
        block = (places - first[text[places]]) % half == 0
        own, wanted = places[block], rank[block] * n
        last = np.searchsorted(keys, wanted + np.minimum(own + 2 * half - 1, n - 1), "right") - 1
        distance = keys[last] - wanted - own
        hit = (distance >= half) & (4 * distance <= size[text[own]])
        found.update(zip(text[own[hit]].tolist(), distance[hit].tolist()))
        half *= 2
    return sorted(found)


def planes(numbers: np.ndarray) -> list[int]:
    """The bit planes of a text's word numbers: bit i of plane b is bit b of word i's number."""
    dense = np.unique(numbers, return_inverse=True)[1]
    return [int.from_bytes(np.packbits((dense >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(max(int(dense.max()).bit_length(), 1))]


def stretches(bits: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, words) of the maximal stretches of at least `least` words in which words `lag` apart are equal."""
    unlike = 0
    for plane in bits:
        unlike |= plane ^ (plane >> lag)
    alike = ~unlike & ((1 << (n - lag)) - 1)
    need, have = least - lag, 1
    while alike and have < need:
        step = min(have, need - have)
        alike &= alike >> step
        have += step
    if not alike:
        return []
    flags = np.unpackbits(np.frombuffer(alike.to_bytes(n // 8 + 2, "little"), np.uint8), bitorder="little").view(np.int8)
    edges = np.flatnonzero(np.diff(flags, prepend=np.int8(0)))
    return [(int(s), int(e - s) + have - 1 + lag) for s, e in zip(edges[::2], edges[1::2])]


def _factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def runs(numbers: np.ndarray, tried: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs with one of the tried lags as their period, in that order."""
    n, bits, out = len(numbers), planes(numbers), []
    for q in tried:
        smaller = [q // p for p in _factors(q)]
        for start, length in stretches(bits, n, q, max(least, times * q)):
            once = numbers[start : start + q]
            if not any((once[g:] == once[:-g]).all() for g in smaller):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: K.Words, dropped: np.ndarray) -> pa.Array:
    """The texts' words that are not dropped, joined by one space."""
    kept = np.flatnonzero(~dropped)
    first = np.searchsorted(kept, words.first)
    length = (words.ends - words.starts)[kept] + 1
    lasts = first[1:][np.diff(first) > 0] - 1
    length[lasts] -= 1  # no space follows a text's last word
    ends = np.concatenate([[0], np.cumsum(length)])
    shift = words.starts[kept] - ends[:-1]
    data = np.concatenate([words.data, [np.uint8(32)]])[np.repeat(shift, length) + np.arange(ends[-1])]
    spaced = np.ones(len(kept), bool)
    spaced[lasts] = False
    data[ends[1:][spaced] - 1] = 32
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(ends[first].astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _found(data: np.ndarray, offsets: np.ndarray, least: int, times: int) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], pa.Array]:
    words = K.Words(data, offsets, K.PLAIN)
    numbers = word_numbers(words)
    n = np.diff(words.first)
    out: list[list[tuple[int, int, int]]] = [[] for _ in n]
    change = np.zeros(words.count + 1, np.int64)
    asked: dict[int, list[int]] = {}
    for text, lag in lags(numbers, words.first):
        asked.setdefault(text, []).append(lag)
    for text, tried in asked.items():
        begin = int(words.first[text])
        out[text] = runs(numbers[begin : int(words.first[text + 1])], tried, least, times)
        for start, length, period in out[text]:
            change[begin + start + period] += 1
            change[begin + start + length] -= 1
    return n, out, collapsed(words, np.cumsum(change)[:-1] > 0)


SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(df: DataFrame, *, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """df's columns without `text`, with n_words, runs (by start, then period; start is a word's number) and
    collapsed: the words that are in no run or among the first `period` ones of each run that holds them."""
    if times < 4:
        raise ValueError("a run has at least four periods")
    ship(df.sparkSession)
    kept = others(df, text, "n_words", "runs", "collapsed")
    body = fresh(df, "_text")

    def find(batches):
        for batch in batches:
            data, offsets = K.utf8(batch.column(body))
            for lo, hi in K.slices(offsets):
                n, found, left = _found(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], least, times)
                flat = np.array([x for one in found for x in one], np.int64).reshape(-1, 3)
                at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                cols = [batch.column(c).slice(lo, hi - lo) for c in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), items).cast(_RUNS), left], names=[*kept, "n_words", "runs", "collapsed"])

    return df.select(*columns(df, kept), F.col(f"`{text.replace('`', '``')}`").alias(body)).mapInArrow(find, widened(df, kept, SCHEMA))


WORD = r"([^\x20\x09-\x0D]+)"


def periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which a tenth (by the crc32 of the id) repeats itself from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(1)))
    rows = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    a = F.expr("cast(g % n as int)")
    p = F.expr("cast(1 + (n - g % n) div (3 + g % 8) as int)")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((F.col("n") - a) / p).cast("int"))), F.lit(1), F.col("n") - a)
    return rows.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", F.slice("words", F.lit(1), a), tail)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of all documents, a tenth of which get a periodic tail first."""
    docs = periodic_tails(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = find_runs(docs)
    # exact: a / b > c / d as a * d > c * b
    best = F.expr(
        "array_sort(runs, (l, r) -> case when l.length * r.period > r.length * l.period then -1 when l.length * r.period < r.length * l.period then 1"
        " when l.start <> r.start then if(l.start < r.start, -1, 1) when l.period < r.period then -1 when l.period > r.period then 1 else 0 end)[0]"
    )
    told = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("").alias("told"), "collapsed")
    return rows.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("told", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
