"""Language identification with language-bitmask n-gram filters.

Every slot of a bit-sliced Bloom filter is a mask of one bit a language, in as many 64-bit words as the
languages need. A gram's k slots are AND-ed: the result names all languages whose filter may hold the gram. A text's votes are the
per-language popcounts over its grams, corrected for each filter's own false-positive rate.

The filters are fitted on a bounded sample (`per_language` rows of each language and about `most_rows` in
all, chosen by a hash of the id) of the `most_languages` languages with most labelled rows, and hold each
language's `top` most frequent grams of the sample; every text is scored whole, by the same broadcast filter of fixed size.

Defined results: null text or text without a letter -> `und`, score 0. A text whose grams are in no
filter gets the language with most sampled rows, score 0. Ties go to the language first by name.
Rows with null language are not learned from. Repeated rows are scored each. No labelled row at all ->
every text is `und`. Columns named like the outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import textkit as K
from kindred.llm.shared import columns, fresh, others, widened
from kindred.session import ship

_U = K.U
#: Lower-cases A-Z; ASCII bytes that are no letters become a space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


@dataclass(frozen=True)
class LanguageFilters:
    languages: tuple[str, ...]
    slots: np.ndarray
    rates: np.ndarray
    default: int
    gram: int
    hashes: int


def grams(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all byte grams of folded texts, runs of spaces being one, and where each text's begin."""
    folded = _FOLD[data]
    space = folded == 0x20
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[heads] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    packed = folded[keep].astype(_U)
    n = max(len(packed) - gram + 1, 0)
    out = np.zeros(n, _U)
    for i in range(gram):
        out = (out << _U(8)) | packed[i : i + n]
    room = np.repeat(at[1:], np.diff(at))[:n] - np.arange(n)
    inside = room >= gram
    return K.mix(out[inside]), np.concatenate([[0], np.cumsum(inside)])[np.minimum(at, n)]


def _slots(keys: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    return [((keys + _U(i) * ((keys >> _U(32)) | _U(1))) % _U(size)).astype(np.int64) for i in range(hashes)]


def fit(sample: pa.Table, *, gram: int = 3, top: int = 1000, bits: int = 16, hashes: int = 3) -> LanguageFilters | None:
    """Filters from a table (text, lang): each language's `top` most frequent grams."""
    names = sorted({x for x in sample["lang"].to_pylist() if x is not None})
    if not names:
        return None
    size = 1 << bits
    slots, rates, rows = np.zeros((-(-len(names) // 64), size), _U), np.zeros(len(names)), []
    langs = np.array(sample["lang"].to_pylist(), object)
    data, offsets = K.utf8(sample["text"])
    for bit, name in enumerate(names):
        mine = np.flatnonzero(langs == name)
        rows.append(len(mine))
        counts: dict[str, np.ndarray] = {"key": np.zeros(0, _U), "n": np.zeros(0, np.int64)}
        for part in np.array_split(mine, max(1, len(mine) // 500)):
            if not len(part):
                continue
            texts = [data[offsets[i] : offsets[i + 1]] for i in part]
            at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
            found, n = np.unique(grams(np.concatenate(texts), at, gram)[0], return_counts=True)
            key, inverse = np.unique(np.concatenate([counts["key"], found]), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, inverse, np.concatenate([counts["n"], n]))
            counts = {"key": key, "n": total}
        order = np.lexsort((counts["key"], -counts["n"]))[:top]
        word = slots[bit // 64]
        for at in _slots(counts["key"][order], size, hashes):
            word[at] |= _U(1) << _U(bit % 64)
        rates[bit] = (((word >> _U(bit % 64)) & _U(1)).mean()) ** hashes
    return LanguageFilters(tuple(names), slots, rates, int(np.argmax(rows)), gram, hashes)


def votes(model: LanguageFilters, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x languages: popcounts corrected for false positives, never below 0."""
    keys, at = grams(data, offsets, model.gram)
    n = np.diff(at)
    out = np.zeros((len(n), len(model.languages)))
    places = _slots(keys, model.slots.shape[1], model.hashes)
    for bit, rate in enumerate(model.rates):
        if bit % 64 == 0:
            mask = np.full(len(keys), ~_U(0), _U)
            for slot in places:
                mask &= model.slots[bit // 64][slot]
        total = np.concatenate([[0], np.cumsum((mask >> _U(bit % 64)) & _U(1), dtype=np.int64)])
        out[:, bit] = np.maximum((total[at[1:]] - total[at[:-1]] - n * rate) / (1 - rate), 0)
    return out


def sample_rows(df: DataFrame, group: str, per_group: float | Column, key: str = "doc_id", most_groups: int = 4096) -> DataFrame:
    """About `per_group` rows (a number, or a column of `group`) of each value of `group`: those with the least hash of `key`.

    A threshold per group from the groups' counts; no sort and no window over a group. Of more than
    `most_groups` groups those with most rows are sampled, so the broadcast thresholds have a bound.
    """
    most = per_group if isinstance(per_group, Column) else F.lit(float(per_group))
    counts = df.groupBy(group).count().orderBy(F.desc("count"), group).limit(most_groups)
    share = counts.select(group, (most / F.col("count")).alias("_share"))
    spot = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return df.join(F.broadcast(share), group).where(spot < F.col("_share")).drop("_share")


def fit_filters(df: DataFrame, learn: Column, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 2000, most_rows: int = 40_000, most_languages: int = 4096, **knobs) -> LanguageFilters | None:
    """Fits on at most about `per_language` rows a language, and `most_rows` in all, among those where `learn` holds."""
    rows = df.where(learn).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    languages = rows.agg(F.approx_count_distinct("lang")).first()[0]
    rows = sample_rows(rows, "lang", min(per_language, most_rows / max(min(languages, most_languages), 1)), most_groups=most_languages)
    return fit(rows.select("doc_id", "text", "lang").toArrow().sort_by("doc_id"), **knobs)


def identify(df: DataFrame, model: LanguageFilters | None, *, text: str = "text") -> DataFrame:
    """df's columns without `text`, with lang_pred and score (columns of these names are replaced). No shuffle."""
    kept = others(df, text, "lang_pred", "score")
    body, letter = fresh(df, "_text"), fresh(df, "_letter")
    rows = df.select(*columns(df, kept), F.col(text).alias(body), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letter))
    schema = widened(df, kept, "lang_pred string, score double")
    if model is None:
        return rows.select(*columns(df, kept), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        names = np.array(model.languages, object)
        for batch in batches:
            data, offsets = K.utf8(batch.column(body))
            parts = [votes(model, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in K.slices(offsets)]
            got = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            total, best = got.sum(1), got.argmax(1)
            best[total == 0] = model.default
            share = np.where(total > 0, got[np.arange(len(got)), best] / np.maximum(total, 1e-12), 0.0)
            has = np.asarray(batch.column(letter).to_pylist(), bool)
            predicted = np.where(has, names[best], "und")
            cols = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(predicted, pa.string()), pa.array(np.where(has, share, 0.0))], names=[*kept, "lang_pred", "score"])

    return rows.mapInArrow(score, schema)


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents, learned from rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.expr(HELD_OUT), F.lit(False))
    model = fit_filters(docs, ~held)
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
