"""Benchmark decontamination by winnowing.

A window is `window` (10) consecutive words of a benchmark item, or a whole shorter item. For every
place of a text the least hash of the k-grams in the window that starts there is its fingerprint;
neighbouring windows mostly share one, so few are looked up. A window that occurs in both has the
same fingerprint in both, so every shared span of `window` words is met.

The benchmark's fingerprints are joined with those of the documents. Before the join a bitmap of the
benchmark's fingerprints (at most `most_bits` bits, 16 MB, whatever the benchmark's size) thins the
documents' ones where they are made; it lets everything through that may meet. A fingerprint that
passes is extended: the windows around it are sent as 128-bit keys, joined with the benchmark's
windows of that fingerprint, and the words they cover are marked. The documents' texts are never
shuffled: only thinned windows are. What was found is joined to the documents by the text's MD5: by
broadcast up to a checked size, beyond it by salted keys.

Defined results: null texts have no words and no hits. Repeated documents are answered each. Items
without words match nothing. Items with equal ids count once; items with null ids hit but are not
counted or listed. An empty benchmark leaves every document clean; no documents, no rows. Columns named
like the outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm import textkit as K
from kindred.llm.shared import columns, cut, fresh, others, widened
from kindred.session import ship

_U = K.U
#: Bits of the bitmap for each fingerprint of the benchmark, as long as `most_bits` allows.
SPARSE = 64
#: Word ranges and items that are broadcast at most; copies of what is found beyond that.
BROADCAST, SALTS = 1 << 19, 16
WINDOW = "length int, print long, one long, two long"


def _fingerprints(hashes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The least k-gram hash within the window of each place."""
    return K.sliding_min(K.mix(K.windows(hashes, gram)), length - gram + 1)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def item_windows(items: DataFrame, window: int, gram: int) -> DataFrame:
    """(item, length, print, one, two) of items (item, text): all windows with their fingerprints and keys."""

    def run(batches):
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for lo, hi in K.slices(offsets):
                words = K.Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], K.ALNUM)
                one, two, counts = words.hashes(True), words.hashes(True, salt=1), np.diff(words.first)
                room = words.room()
                for length in np.unique(np.minimum(counts[counts > 0], window)).tolist():
                    whole = np.minimum(counts, window) == length  # the items whose windows are that long
                    row = np.repeat(np.arange(hi - lo), counts)[: max(words.count - length + 1, 0)]
                    places = np.flatnonzero(whole[row] & (room[: len(row)] >= length))
                    prints = _fingerprints(one, length, min(gram, length))
                    columns_ = [batch.column("item").take(pa.array(lo + row[places])), pa.array(np.full(len(places), length, np.int32)), _long(prints[places])]
                    keys = [_long(K.mix(K.windows(x, length)[places])) for x in (one, two)]
                    yield pa.RecordBatch.from_arrays([*columns_, *keys], names=["item", "length", "print", "one", "two"])

    return items.mapInArrow(run, f"item string, {WINDOW}")


class Bitmap:
    """Which fingerprints the benchmark may have, and its windows' lengths."""

    def __init__(self, words: np.ndarray, size: int, lengths: list[int], gram: int):
        self.words, self.size, self.lengths, self.gram = words, size, lengths, gram

    def may_hold(self, prints: np.ndarray) -> np.ndarray:
        bit = prints & _U(self.size - 1)
        return (self.words[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1


def bitmap(windows: DataFrame, gram: int, most_bits: int) -> Bitmap:
    """Collects at most `most_bits` bits; fewer where the benchmark has few fingerprints."""
    lengths = windows.groupBy("length").agg(F.approx_count_distinct("print").alias("n")).collect()  # at most `window` rows
    total = sum(r["n"] for r in lengths)
    size = 64
    while size < min(most_bits, SPARSE * total):
        size *= 2
    bit = F.col("print").bitwiseAND(size - 1)
    word = windows.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(print & 63 as int))").alias("bits"))
    got = word.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, _U)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(_U)
    return Bitmap(words, size, sorted(r["length"] for r in lengths), gram)


def candidates(bits: Bitmap, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place in the text, length, print, one, two) of the windows whose fingerprint may be the benchmark's."""
    words = K.Words(data, offsets, K.ALNUM)
    one, room = words.hashes(True), words.room()
    out = []
    second = None
    for length in bits.lengths:
        n = words.count - length + 1
        if n <= 0:
            continue
        prints = _fingerprints(one, length, min(bits.gram, length))
        turn = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        met = np.flatnonzero(bits.may_hold(prints[turn]))
        if not len(met):
            continue
        # a fingerprint is extended to all windows that have it
        ends = np.append(turn, n)
        many = ends[met + 1] - turn[met]
        places = np.repeat(turn[met] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        places = places[room[places] >= length]
        if not len(places):
            continue
        second = words.hashes(True, salt=1) if second is None else second
        row = np.searchsorted(words.first, places, "right") - 1
        keys = [K.mix(K.windows(x, length)[places]) for x in (one, second)]
        out.append((row, places - words.first[row], np.full(len(places), length), prints[places], *keys))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 6


def document_windows(docs: DataFrame, bits: Bitmap) -> DataFrame:
    """(digest, place, length, print, one, two) of docs (digest, text): windows that may be the benchmark's."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            for lo, hi in K.slices(offsets):
                row, place, length, *keys = candidates(shared.value, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if len(row):
                    digest = batch.column("digest").take(pa.array(lo + row))
                    yield pa.RecordBatch.from_arrays([digest, pa.array(place.astype(np.int32)), pa.array(length.astype(np.int32)), *map(_long, keys)], names=["digest", "place", "length", "print", "one", "two"])

    return docs.select("digest", "text").mapInArrow(run, f"digest string, place int, {WINDOW}")


def _merged(hits: DataFrame) -> DataFrame:
    """(digest, spans): the word ranges that hits (digest, place, length) cover, touching ones joined."""
    by = Window.partitionBy("digest").orderBy("place", "end")
    rows = hits.select("digest", "place", (F.col("place") + F.col("length")).alias("end")).distinct()
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("place") > before).cast("int"), F.lit(1)))
    rows = rows.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy("digest", "span").agg(F.struct(F.min("place").alias("start"), F.max("end").alias("end")).alias("x"))
    return spans.groupBy("digest").agg(F.array_sort(F.collect_list("x")).alias("spans"))


def _answered(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """docs with what was found for their texts: broadcast up to BROADCAST ranges and items, else joined by salted
    keys, so that copies of one text are spread."""
    entries = found.agg(F.coalesce(F.sum(F.size("spans") + F.size("items")), F.lit(0))).first()[0]
    if entries <= BROADCAST:
        return docs.join(F.broadcast(found), key, "left")
    salt = fresh(docs, "_salt")
    spread = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(spread, [key, salt], "left")


def find_benchmark(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 6, most_bits: int = 1 << 27) -> DataFrame:
    """df's columns with n_words, spans (word ranges that occur in the benchmark) and items (their ids,
    as sorted strings); columns of these names are replaced."""
    ship(df.sparkSession)
    kept = others(df, "n_words", "spans", "items")
    body, key = fresh(df, "_text"), fresh(df, "_digest")
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    wanted = item_windows(items, window, gram).distinct()
    bits = bitmap(wanted, gram, most_bits)
    asked = document_windows(df.select(digest.alias("digest"), F.col(text).alias("text")).where("text is not null"), bits)
    met = asked.join(wanted, ["length", "print", "one", "two"]).select("digest", "place", "length", "item")
    listed = met.where("item is not null").groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = _merged(met).join(listed, "digest", "left").select(F.col("digest").alias(key), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))

    def count(batches):
        for batch in batches:
            data, offsets = K.utf8(batch.column(body))
            n = [np.diff(K.Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], K.ALNUM).first) for lo, hi in K.slices(offsets)]
            cols = [batch.column(c) for c in [*kept, key]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], names=[*kept, key, "n_words"])

    rows = df.select(*columns(df, kept), digest.alias(key), F.col(text).alias(body))
    counted = rows.mapInArrow(count, widened(rows, [*kept, key], "n_words bigint"))
    out = _answered(counted, cut(found), key)
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return out.select(*columns(df, kept), "n_words", none("spans"), none("items"))


def hit_count(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]).cast("long"))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Which words of every document occur in windows of the benchmark, and of which items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = find_benchmark(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        hit_count().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
b as (select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from benchmark),
bw as (select distinct item_id, m, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') k from (select item_id, w, least(len(w), 10) m, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
dw as (select doc_id, m, i, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') k from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from d, (select distinct m from bw) where len(w) >= m)),
h as (select doc_id, item_id, dw.i, dw.m from dw join bw on dw.m = bw.m and dw.k = bw.k),
n as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + m)) j from h) group by doc_id),
t as (select doc_id, count(*) n_items, sha256(string_agg(id, ',' order by id)) items_sha256 from (select distinct doc_id, item_id::varchar id from h) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join n on d.doc_id = n.doc_id left join t on d.doc_id = t.doc_id
"""
