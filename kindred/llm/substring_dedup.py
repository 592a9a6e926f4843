"""Removal of repeated word windows by level-wise doubling.

A window of `window` words can only repeat if its sub-windows do. The first level takes sub-windows of
the seed length (5 words), and of each window only the one with the least hash, which equal windows
share. What is found in more than one place is extended to twice its length: the windows around it are
candidates, whose least sub-windows of 10 words are tried next, and so on until the full length decides
or no candidate survives; a chunk without candidates asks nothing more. At each level a chunk of
documents asks the buckets about its distinct candidates alone (kindred.llm.packed). False alarms of
the short fingerprints of the lower levels are undone by the last, which compares 128 bits: two
independent hashes of all words of a window.

The first occurrence of a window is the one with the smallest doc_id, or the earliest start there.
All words that a later occurrence covers are removed; windows are judged on the input.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a text without any, and null, has none and keeps ''.
Rows that share a doc_id count as consecutive parts of a document in the order of a hash of their
texts; no window spans two rows. A null doc_id counts as the greatest. Rows and columns stay whole. An
empty table gives no row. Rows that are equal in id and text are held by one chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import packed
from kindred.llm import textkit as K
from kindred.llm.shared import columns, widened
from kindred.session import ship

_U = K.U
_OTHER = _U(0xD6E8FEB86659FD93)


def levels(window: int, seed: int) -> list[int]:
    """The lengths below `window`, each twice the one before."""
    out = []
    length = window
    while length >= 2 * seed:
        length //= 2
        out.append(length)
    return out[::-1]


class Candidates:
    """The windows of a chunk that may repeat."""

    def __init__(self, chunk: packed.Chunk, window: int, answers: pa.Table, lengths: list[int], n_buckets: int):
        self.chunk, self.words, self.window, self.n_buckets = chunk, chunk.words, window, n_buckets
        n = max(len(self.words) - window + 1, 0)
        self.valid = chunk.room()[:n] >= window
        #: May repeat outside the chunk, or within it.
        self.outside, self.inside = self.valid.copy(), self.valid.copy()
        for i, length in enumerate(lengths):
            least = self.least(length)
            self.inside &= self.twice(least, length)
            mine = answers.filter(pc.equal(answers["level"], i))
            told = np.zeros(n, bool)
            key, bucket = self.print(least)
            full = (bucket.astype(np.uint64) << _U(32)) | key
            known = [(np.uint64(b) << _U(32)) | np.cumsum(packed.unpack(p, "u4")[0], dtype=np.uint32).astype(np.uint64) for b, p in zip(mine["bucket"].to_pylist(), mine["payload"].to_pylist())]
            if known:
                told = K.member(np.sort(np.concatenate(known)), full)
            self.outside &= told

    def least(self, length: int) -> np.ndarray:
        """The least hash of the sub-windows of `length` words, for each window."""
        hashes = K.mix(K.windows(self.words, length))
        return K.sliding_min(hashes, self.window - length + 1)[: len(self.valid)] if len(self.valid) else np.zeros(0, _U)

    def print(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = K.mix(least ^ _OTHER)
        return x & _U(0xFFFFFFFF), ((x >> _U(32)) % _U(self.n_buckets)).astype(np.int64)

    def twice(self, least: np.ndarray, length: int) -> np.ndarray:
        """Whether a window's least sub-window is found at two places of the chunk."""
        n = len(least)
        hashes = K.mix(K.windows(self.words, length))
        place = np.zeros(len(hashes), bool)
        for j in range(self.window - length + 1):
            place[j : j + n] |= (hashes[j : j + n] == least) & self.valid
        value, count = np.unique(hashes[place], return_counts=True)
        return K.member(value[count > 1], least)

    def whole(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows at the places."""
        if not len(places):
            return np.zeros(0, _U), np.zeros(0, _U)
        second = self.chunk.second(places)
        return K.mix(K.windows(self.words, self.window)[places]), K.mix(K.windows(second, self.window)[places])


def _ordered(one: np.ndarray, two: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the pair of keys (then `more`), and which of the ordered have the key of the one before."""
    order = np.lexsort((*more[::-1], two, one))
    one, two = one[order], two[order]
    again = np.zeros(len(order), bool)
    again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    return order, again


def _shared_prints(questions: list[tuple[int, bytes]]) -> list[bytes]:
    """For each chunk its fingerprints that another chunk has too, as differences."""
    mine = [np.cumsum(packed.unpack(p, "u4")[0], dtype=np.uint32) for _, p in questions]
    value, count = np.unique(np.concatenate(mine), return_counts=True)
    both = value[count > 1]
    out = []
    for x in mine:
        x = x[K.member(both, x)]
        out.append(packed.pack(np.diff(x, prepend=x.dtype.type(0))) if len(x) else b"")
    return out


def _earlier_elsewhere(questions: list[tuple[int, bytes]]) -> list[bytes]:
    """For each chunk the places whose window another chunk has in an earlier document."""
    got = [packed.unpack(p, "u8", "u8", "i8", "i8", "i4") for _, p in questions]
    one, two, ids, hashes = (np.concatenate([g[i] for g in got]) for i in range(4))
    places = np.concatenate([np.cumsum(g[4], dtype=np.int32) for g in got])
    owner = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    order, again = _ordered(one, two, ids, hashes)
    later = np.zeros(len(order), bool)
    later[order] = again
    out = []
    for i in range(len(questions)):
        x = places[later & (owner == i)]
        out.append(packed.pack(np.diff(x, prepend=x.dtype.type(0))) if len(x) else b"")
    return out


def _covered(found: Candidates, answers: pa.Table, last: int) -> np.ndarray:
    """Which words a later occurrence of a window covers.

    Of a window that the chunk has more than once the first is told by the answers, the others are later.
    """
    edge = np.zeros(len(found.words) + 1, np.int64)
    mine = answers.filter(pc.equal(answers["level"], last))
    told = [np.cumsum(packed.unpack(p, "i4")[0], dtype=np.int32) for p in mine["payload"].to_pylist()]
    own = np.flatnonzero(found.inside)
    order, again = _ordered(*found.whole(own))
    at = np.unique(np.concatenate([own[order[again]], *told])).astype(np.int64)
    edge[at] += 1
    edge[at + found.window] -= 1
    return np.cumsum(edge[:-1]) > 0


def _ask(docs: DataFrame, answers: DataFrame | None, lengths: list[int], window: int, n_buckets: int, final: bool) -> DataFrame:
    def work(chunk_no: int, table: pa.Table, told: pa.Table) -> pa.Table:
        chunk = packed.Chunk(table, K.PLAIN, False)
        if final:
            found = Candidates(chunk, window, told, lengths, n_buckets)
            at = np.flatnonzero(found.outside)
            one, two = found.whole(at)
            order, again = _ordered(one, two)
            first = np.sort(order[~again])
            at, one, two = at[first], one[first], two[first]
            row, bucket = chunk.row_of(at), (K.mix(two ^ _OTHER) % _U(n_buckets)).astype(np.int64)
            dealt = packed.deal(bucket, one, two, chunk.ids[row], chunk.hash[row], at.astype(np.int32))
            return packed.asked(((b, packed.pack(*x, np.diff(p, prepend=p.dtype.type(0)))) for b, (*x, p) in dealt), chunk_no)
        found = Candidates(chunk, window, told, lengths[:-1], n_buckets)
        least = np.unique(found.least(lengths[-1])[found.outside]) if len(found.valid) else np.zeros(0, _U)
        key, bucket = found.print(least)
        full = np.unique((bucket.astype(np.uint64) << _U(32)) | key)
        bucket, key = (full >> _U(32)).astype(np.int64), full.astype(np.uint32)
        return packed.asked(((b, packed.pack(np.diff(k, prepend=k.dtype.type(0)))) for b, (k,) in packed.deal(bucket, key)), chunk_no)

    grouped = docs.groupBy("chunk")
    if answers is None:
        empty = pa.table({"level": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        return grouped.applyInArrow(lambda key, t: work(key[0].as_py(), t, empty), packed.ASKED)
    return grouped.cogroup(answers.groupBy("chunk")).applyInArrow(lambda key, a, b: work(key[0].as_py(), a, b), packed.ASKED)


def remove_repeats(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 20, seed: int = 5, keep_columns: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed, kept (the kept words joined by one space).

    keep_columns: further columns to carry along, none of these names; keep_text: `text` as well.
    """
    spark = df.sparkSession
    ship(spark)
    more = [*(keep_columns or []), *(["text"] if keep_text else [])]
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *columns(df, keep_columns or []))
    total = packed.sizes(docs)
    schema = widened(docs, more, "doc_id long, n_words long, n_removed long, kept string")
    docs = packed.chunked(docs, total).withColumn("hash", F.xxhash64("text"))
    n_buckets = packed.buckets(total // 6, 4)
    lengths = levels(window, seed)
    answers = None
    for i in range(len(lengths)):
        reply = packed.answer(_ask(docs, answers, lengths[: i + 1], window, n_buckets, False), _shared_prints, i)
        answers = reply if answers is None else answers.union(reply)
    last = len(lengths)
    final = packed.answer(_ask(docs, answers, lengths, window, n_buckets, True), _earlier_elsewhere, last)

    def finish(key, table, told):
        chunk = packed.Chunk(table, K.PLAIN, False)
        # only what repeats within the chunk is looked for here; the rest has been told
        found = Candidates(chunk, window, told, [], n_buckets)
        for length in lengths:
            found.inside &= found.twice(found.least(length), length)
        gone = _covered(found, told, last)
        n_words = np.diff(chunk.first)
        removed = np.concatenate([[0], np.cumsum(gone)])[chunk.first]
        removed = removed[1:] - removed[:-1]
        kept = []
        for i, value in enumerate(chunk.table["text"]):
            words = (value.as_py() or "").encode().split()
            if removed[i]:
                lost = gone[chunk.first[i] : chunk.first[i + 1]].tolist()
                words = [w for w, x in zip(words, lost) if not x]
            kept.append(b" ".join(words).decode())
        out = {c: chunk.table[c] for c in [*more, "doc_id"]}
        return pa.table(out | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return docs.groupBy("chunk").cogroup(final.groupBy("chunk")).applyInArrow(finish, schema)


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 20 words of whole documents that repeat an earlier one, removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
v as (select doc_id, i, list_aggregate(w[i : i + 19], 'string_agg', ' ') k from (select doc_id, w, unnest(range(1, len(w) - 18)) i from d where len(w) >= 20)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) n from v) where n > 1),
g as (select distinct doc_id, unnest(range(i, i + 20)) j from r),
x as (select doc_id, list(j) gone from g group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed,
  sha256(coalesce(array_to_string(case when gone is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: not list_contains(gone, p[2])), lambda p: p[1]) end, ' '), '')) kept_sha256
from d left join x on d.doc_id = x.doc_id
"""
