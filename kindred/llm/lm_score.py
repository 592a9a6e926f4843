"""Scoring by cross-entropy difference of two matched character n-gram models.

The target model and the background model have the same order, smoothing and vocabulary (the
characters of both corpora). Tokens are the characters of the text with A-Z lower-cased, each
predicted from the `order - 1` before it in its text:

    p(c | h) = (n(h c) + weight * p1(c)) / (n(h) + weight),   p1(c) = (n(c) + 1) / (N + V)

A document's loss under a model is the mean of -log2 p over its tokens; its score is the target loss
less the background loss, so lower means nearer to the target.

All counts are exact and cover every document. Each chunk of documents counts its own n-grams and
asks the buckets for the corpus' counts of just these (kindred.llm.packed), so no model is collected
or broadcast; only the character counts (at most one per Unicode character) go to the tasks whole.
An n-gram is a 64-bit number of four 16-bit characters, so `order` is at most 4. Where the corpora have more
than 65,536 characters, a context is a number of three 21-bit characters, and an n-gram is told by 64 bits
mixed of its context and its last character.

Defined results: a text of fewer than `order` characters, and null, has no tokens, losses and score 0.
Repeated rows count and are scored each. An empty target gives p1 = 1 / V for the target. An empty
table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import packed
from kindred.llm import textkit as K
from kindred.session import ship

_U = K.U
_SIDE, _LAST = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, A-Z lower-cased, and where each text starts."""
    points = np.frombuffer("".join(x or "" for x in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.concatenate([[0], np.cumsum([len(x or "") for x in texts])]).astype(np.int64)
    return np.where((points >= 65) & (points <= 90), points + 32, points), at


def ngrams(ids: np.ndarray, at: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The context of each token, `bits` bits a character, and its own character; and tokens per text."""
    n = len(ids) - order + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(len(at) - 1, np.int64)
    contexts = np.zeros(n, _U)
    for i in range(order - 1):
        contexts = (contexts << _U(bits)) | ids[i : i + n]
    inside = np.ones(n, bool)
    for i in range(1, order):  # an n-gram that begins so near a text's end is none
        last = at[1:] - i
        inside[last[(last >= 0) & (last < n) & (last >= at[:-1])]] = False
    return contexts[inside], ids[order - 1 :][inside].astype(_U), np.maximum(np.diff(at) - order + 1, 0)


class Alphabet:
    """Ids of the characters of both corpora, and the numbers of their n-grams."""

    def __init__(self, points: np.ndarray, counts: np.ndarray):
        n = len(points)
        #: Bits of an id: 16, or 21 where there are more characters than that tells apart.
        self.bits = 16 if n <= 1 << 16 else 21
        self.table = np.zeros(int(points.max(initial=0)) + 1, np.uint16 if self.bits == 16 else np.uint32)
        self.table[points] = np.arange(n)
        #: p1 of each id, in the background and in the target.
        self.p1 = (counts + 1) / (counts.sum(1, keepdims=True) + max(n, 1))

    def ids(self, points: np.ndarray) -> np.ndarray:
        return self.table[points]

    def numbers(self, contexts: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A number for each n-gram; with 16 bits an id its context is that number's upper part."""
        if self.bits == 16:
            return (contexts << _U(16)) | last
        return K.mix(contexts) ^ K.mix(last ^ _LAST)


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("target", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]).combine_chunks() if table.num_rows else table


def _slices(table: pa.Table) -> list[tuple[int, list]]:
    """Texts in slices of bounded size."""
    _, offsets = K.utf8(table["text"])
    return [(lo, table["text"].slice(lo, hi - lo).to_pylist()) for lo, hi in K.slices(offsets)]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their columns of counts, and where each was first."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[:, order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, axis=1) if len(first) else counts, order[first]


def _distinct(table: pa.Table, alphabet: Alphabet, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a chunk, their counts in the background and in the target, their contexts and characters."""
    target = np.asarray(table["target"].to_pylist(), bool)
    keys, counts, parts = [np.zeros(0, _U)], [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), _U)]
    for lo, texts in _slices(table):
        points, at = characters(texts)
        contexts, last, n = ngrams(alphabet.ids(points), at, order, alphabet.bits)
        grams, own = alphabet.numbers(contexts, last), np.repeat(target[lo : lo + len(texts)], n)
        for i in (0, 1) if own.any() else (0,):
            mine = own == bool(i)
            if alphabet.bits == 16:
                found, times = np.unique(grams[mine], return_counts=True)
            else:
                found, first, times = np.unique(grams[mine], return_index=True, return_counts=True)
                parts.append(np.stack([contexts[mine][first], last[mine][first]]))
            keys.append(found)
            counts.append(np.stack([times, 0 * times] if i == 0 else [0 * times, times]))
    keys, sums, first = _summed(np.concatenate(keys), np.concatenate(counts, axis=1))
    contexts, last = (keys >> _U(16), keys & _U(0xFFFF)) if alphabet.bits == 16 else np.concatenate(parts, axis=1)[:, first]
    return keys, sums, contexts, last.astype(np.int64)


def _contexts(own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts of n-grams, their counts, and each n-gram's context."""
    value, sums, _ = _summed(own, counts)
    return value, sums, np.searchsorted(value, own)


def _totals(questions: list[tuple[int, bytes]]) -> list[bytes]:
    """For each chunk, the corpus' counts of its keys, in its order."""
    got = [packed.unpack(p, "u8", "i8", "i8") for _, p in questions]
    value, inverse = np.unique(np.concatenate([k for k, _, _ in got]), return_inverse=True)
    sums = []
    for i in (1, 2):
        total = np.zeros(len(value), np.int64)
        np.add.at(total, inverse, np.concatenate([g[i] for g in got]))
        sums.append(total[inverse])
    out, at = [], 0
    for k, _, _ in got:
        out.append(packed.pack(sums[0][at : at + len(k)], sums[1][at : at + len(k)]))
        at += len(k)
    return out


def character_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Code points of both corpora and their counts, as 2 rows (background, target)."""

    def count(batches):
        for batch in batches:
            target = np.asarray(batch.column("target").to_pylist(), bool)
            out: dict[tuple[int, bool], int] = {}
            _, offsets = K.utf8(batch.column("text"))
            for lo, hi in K.slices(offsets):
                points, at = characters(batch.column("text").slice(lo, hi - lo).to_pylist())
                side = np.repeat(target[lo:hi], np.diff(at))
                for flag in (False, True):
                    counts = np.bincount(points[side == flag])
                    for c in np.flatnonzero(counts):
                        out[int(c), flag] = out.get((int(c), flag), 0) + int(counts[c])
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([f for _, f in out], pa.bool_()), pa.array(list(out.values()), pa.int64())], names=["c", "target", "n"])

    got = docs.select("target", "text").mapInArrow(count, "c long, target boolean, n long").groupBy("c", "target").agg(F.sum("n").alias("n")).collect()
    points = np.array(sorted({r["c"] for r in got}), np.int64)
    counts = np.zeros((2, len(points)), np.int64)
    for r in got:
        counts[int(r["target"]), np.searchsorted(points, r["c"])] = r["n"]
    return points, counts


def score_difference(df: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", order: int = 4, weight: float = 10.0) -> DataFrame:
    """One row per row of df: doc_id, n_tokens, loss_target, loss_background, score."""
    if not 2 <= order <= 4:
        raise ValueError("order: 2 to 4")
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(False).alias("target"))
    docs = docs.union(target.select(F.lit(None).cast("long"), F.col(target_text), F.lit(True)))
    total = packed.sizes(docs)
    points, counts = character_counts(docs)
    shared = spark.sparkContext.broadcast(Alphabet(points, counts))
    docs = packed.chunked(docs, total)
    n_buckets = packed.buckets(total // 16, 24)

    def asks(table):
        """The chunk's n-grams, then its contexts (told apart by the hash), with buckets."""
        keys, counts, own, last = _distinct(table, shared.value, order)
        contexts, sums, context_of = _contexts(own, counts)
        both = np.concatenate([K.mix(keys), K.mix(contexts ^ _SIDE)])
        return keys, last, context_of, both, np.concatenate([counts, sums], axis=1), (K.mix(both ^ _SIDE) % _U(n_buckets)).astype(np.int64)

    def ask(key, table):
        _, _, _, both, counts, bucket = asks(_sorted(table))
        return packed.asked(((b, packed.pack(*x)) for b, x in packed.deal(bucket, both, counts[0], counts[1])), key[0].as_py())

    answers = packed.answer(docs.groupBy("chunk").applyInArrow(ask, packed.ASKED), _totals)

    def finish(key, table, told):
        alphabet, table = shared.value, _sorted(table)
        keys, last, context_of, both, _, bucket = asks(table)
        replies = dict(zip(told["bucket"].to_pylist(), told["payload"].to_pylist()))
        sums = np.zeros((2, len(both)), np.int64)
        for b, (where,) in packed.deal(bucket, np.arange(len(both))):
            sums[0, where], sums[1, where] = packed.unpack(replies[b], "i8", "i8")
        loss = [-np.log2((sums[i, : len(keys)] + weight * alphabet.p1[i, last]) / (sums[i, len(keys) + context_of] + weight)) for i in (0, 1)]
        lookup = K.Lookup(keys) if len(keys) else None
        target = np.asarray(table["target"].to_pylist(), bool)
        losses, tokens = np.zeros((2, len(target))), np.zeros(len(target), np.int64)
        for lo, texts in _slices(table):
            points, starts = characters(texts)
            contexts, own, n = ngrams(alphabet.ids(points), starts, order, alphabet.bits)
            grams = alphabet.numbers(contexts, own)
            at = np.concatenate([[0], np.cumsum(n)])
            tokens[lo : lo + len(texts)] = n
            where = lookup.find(grams) if len(grams) else np.zeros(0, np.int64)
            for i in (0, 1):
                total = np.concatenate([[0.0], np.cumsum(loss[i][where])])
                losses[i, lo : lo + len(texts)] = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
        out = pa.table({"doc_id": table["doc_id"], "n_tokens": pa.array(tokens), "loss_target": pa.array(losses[1]), "loss_background": pa.array(losses[0]), "score": pa.array(losses[1] - losses[0])})
        return out.filter(pa.array(~target))

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    """Loss of every document under models of the benchmark's texts and of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    rounded = [F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")]
    return score_difference(docs, benchmark).select("doc_id", "n_tokens", *rounded)


ORACLE = r"""
with a as (
  select doc_id, false target, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') s from documents
  union all select null, true, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
ch as (select target, unnest(regexp_extract_all(s, '(?s).')) c from a),
n1 as (select target, c, count(*) n from ch group by all),
voc as (select count(distinct c) v from n1),
sides as (select unnest([false, true]) target),
p1 as (select s.target, x.c, (coalesce(n, 0) + 1) / (coalesce((select sum(n) from n1 z where z.target = s.target), 0) + v) p
       from sides s, (select distinct c from n1) x, voc left join n1 on n1.target = s.target and n1.c = x.c),
g as (select doc_id, target, substr(s, i, 3) h, substr(s, i + 3, 1) c from (select doc_id, target, s, unnest(range(1, length(s) - 2)) i from a where length(s) >= 4)),
n4 as (select target, h, c, count(*) n from g group by all),
n3 as (select target, h, count(*) n from g group by all),
k as (select doc_id, h, c, count(*) m from g where not target group by all),
l as (select doc_id, s.target, sum(m) t, sum(m * -log2((coalesce(n4.n, 0) + 10.0 * p) / (coalesce(n3.n, 0) + 10.0))) loss
      from k cross join sides s join p1 on p1.target = s.target and p1.c = k.c
      left join n4 on n4.target = s.target and n4.h = k.h and n4.c = k.c left join n3 on n3.target = s.target and n3.h = k.h group by all)
select d.doc_id, coalesce(x.t, 0)::bigint n_tokens, round(coalesce(y.loss / y.t, 0.0), 6) loss_target, round(coalesce(x.loss / x.t, 0.0), 6) loss_background,
  round(coalesce(y.loss / y.t - x.loss / x.t, 0.0), 6) score
from documents d left join l x on x.doc_id = d.doc_id and not x.target left join l y on y.doc_id = d.doc_id and y.target
"""
