"""Toxic passages by maximum-scoring segment search.

Token scores are log-odds of labelled toxic against labelled clean texts (in how many distinct texts
a token occurs) under a Dirichlet prior, one plus a share of the pooled counts; only tokens whose
log-odds exceed `z` standard errors carry a score, their log-odds less `shrink` standard errors; all
others, and a token that repeats the one before it, cost `drift`. A linear-time scan finds every maximal scoring segment of
a text. Segment scores are put on the scale of extreme values: lambda solves sum p exp(lambda s) = 1
over the clean tokens, K follows from the clean texts' best segments. A text's evidence (its best
segment's surprise, the number of significant segments) is turned into a probability by a logistic
fit.

The model is fitted on a bounded sample of labelled rows (`most_toxic`, `most_clean`); every text is scanned whole.

Defined results: null, empty and word-less texts have no segment and get the score of no evidence.
No labelled rows, or rows of one label only -> every score is 0. Labels above 0 count as 1; several
labels of a document count as their maximum; null labels are not learned from. Repeated rows are
scored each.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm import textkit as K
from kindred.llm.language_id import HELD_OUT, sample_rows
from kindred.llm.shared import columns, fresh, others, widened
from kindred.session import ship

_EULER = 0.5772156649015329


@dataclass(frozen=True)
class SegmentModel:
    keys: np.ndarray
    scores: np.ndarray
    drift: float
    rate: float
    log_k: float
    weights: np.ndarray


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time."""
    out: list[tuple[int, int, float]] = []
    # open segments: start, end, totals before and after, and the last open one that begins lower
    starts, ends, lows, highs, lower = [], [], [], [], []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low = i, before
        while True:
            j = len(starts) - 1
            while j >= 0 and lows[j] >= low:
                j = lower[j]
            if j < 0:
                # it begins lower than all open ones, so none of them can grow any more
                out += [(a, b, hi - lo) for a, b, lo, hi in zip(starts, ends, lows, highs)]
                starts, ends, lows, highs, lower = [start], [i + 1], [low], [total], [-1]
                break
            if highs[j] >= total:
                starts.append(start)
                ends.append(i + 1)
                lows.append(low)
                highs.append(total)
                lower.append(j)
                break
            start, low = starts[j], lows[j]
            del starts[j:], ends[j:], lows[j:], highs[j:], lower[j:]
    return out + [(a, b, hi - lo) for a, b, lo, hi in zip(starts, ends, lows, highs)]


def segments(model: SegmentModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Words per text, and each text's maximal segments as (first word, word after, score).

    Equal-signed neighbours are one step of the scan: no maximal segment begins or ends inside them.
    """
    words = K.Words(data, offsets, K.ALNUM)
    hashes = words.hashes(True)
    at = np.searchsorted(model.keys, hashes)
    at[at == len(model.keys)] = 0
    own = np.full(words.count, -model.drift)
    if len(model.keys):
        hit = model.keys[at] == hashes
        own[hit] = model.scores[at[hit]]
        again = np.concatenate([[False], hashes[1:] == hashes[:-1]])[: words.count]
        first = words.first[:-1]
        again[first[first < words.count]] = False  # a text's first word repeats no word of the text before
        own[again] = -model.drift
    up = np.flatnonzero(own > 0)
    total = np.concatenate([[0.0], np.cumsum(own)])
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(offsets) - 1)]
    of = np.searchsorted(words.first, up, "right") - 1
    for doc in np.unique(of):
        mine = up[of == doc] if len(up) < 64 else up[np.searchsorted(of, doc) : np.searchsorted(of, doc, "right")]
        cuts = np.flatnonzero(np.diff(mine) > 1) + 1
        starts, ends = mine[np.concatenate([[0], cuts])], mine[np.concatenate([cuts - 1, [len(mine) - 1]])] + 1
        steps = np.empty(2 * len(starts) - 1)
        steps[::2] = total[ends] - total[starts]
        steps[1::2] = total[starts[1:]] - total[ends[:-1]]
        base = words.first[doc]
        out[doc] = [(int(starts[a // 2] - base), int(ends[(b - 1) // 2] - base), s) for a, b, s in maximal_segments(steps.tolist())]
    return np.diff(words.first), out


def evidence(model: SegmentModel, n_words: np.ndarray, found: list[list[tuple[int, int, float]]], level: float = 0.05) -> np.ndarray:
    """Texts x 3: one, surprise of the best segment, log of the number of significant segments."""
    out = np.zeros((len(found), 3))
    out[:, 0], out[:, 1] = 1, -5
    bar = -math.log(level)
    for i, segs in enumerate(found):
        if segs:
            space = model.log_k + math.log(max(int(n_words[i]), 1))
            surprise = [model.rate * s - space for _, _, s in segs]
            out[i, 1] = min(max(-5.0, max(surprise)), 30.0)
            out[i, 2] = math.log1p(sum(x > bar for x in surprise))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - ridge * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def fit(sample: pa.Table, *, z: float = 3.0, drift: float = 0.5, prior: float = 0.001, shrink: float = 2.0, vocabulary: int = 1 << 16, log_prior: float | None = None) -> SegmentModel | None:
    """A model from a table (text, toxic); at most `vocabulary` tokens, those of greatest |z|.

    log_prior: log odds of label 1 where the texts come from, if other than in the table.
    """
    label = np.asarray(sample["toxic"].to_pylist(), int) > 0
    if not len(label) or label.all() or not label.any():
        return None
    data, offsets = K.utf8(sample["text"])
    once = np.zeros(len(label), bool)  # of equal texts the first counts
    seen: set[bytes] = set()
    for i in range(len(label)):
        digest = hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest()
        once[i] = digest not in seen
        seen.add(digest)
    # per slice: distinct (token, text) pairs as token and label; all tokens of clean texts with counts
    pairs, clean, lengths = [], [], []
    for lo, hi in K.slices(offsets):
        words = K.Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], K.ALNUM)
        hashes, n = words.hashes(True), np.diff(words.first)
        doc = np.repeat(np.arange(lo, hi), n)
        clean.append(np.unique(hashes[~label[doc]], return_counts=True))
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])[: len(hashes)] & once[doc]
        pairs.append((hashes[new], label[doc[new]]))
        lengths.append(n)
    keys, inverse = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
    toxic = np.concatenate([t for _, t in pairs])
    bad = np.bincount(inverse[toxic], minlength=len(keys)).astype(float)
    good = np.bincount(inverse[~toxic], minlength=len(keys)).astype(float)
    del pairs, inverse, toxic
    n_bad, n_good = float((label & once).sum()), float((~label & once).sum())
    share = 1 + prior * (bad + good)
    odds = lambda n, texts: np.log((n + share) / (texts + 2 * share - n))
    delta = odds(bad, n_bad) - odds(good, n_good)
    score_z = delta / np.sqrt(1 / (bad + share) + 1 / (good + share))
    chosen = np.argsort(-np.abs(score_z), kind="stable")[:vocabulary]
    chosen = np.sort(chosen[np.abs(score_z[chosen]) >= z])
    scores = np.sign(delta[chosen]) * (np.abs(delta[chosen]) * (1 - shrink / np.abs(score_z[chosen])))
    # lambda over what a clean token scores, tokens never seen there counting as seen once
    clean_tokens = np.zeros(len(keys))
    for found, n in clean:
        known = K.member(keys, found)
        clean_tokens[np.searchsorted(keys, found[known])] += n[known]
    del clean
    p = np.concatenate([clean_tokens[chosen] + 1, [max(clean_tokens.sum() - clean_tokens[chosen].sum(), 1.0)]])
    p, s = p / p.sum(), np.concatenate([scores, [-drift]])
    if (p * s).sum() >= 0 or not (s > 0).any():
        rate = 1.0
    else:
        lo, hi = 1e-6, 1.0
        while (p * np.exp(hi * s)).sum() < 1 and hi < 64:
            hi *= 2
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
        rate = (lo + hi) / 2
    model = SegmentModel(keys[chosen], scores, drift, rate, 0.0, np.zeros(3))
    n_words, found = np.concatenate(lengths), []
    for lo, hi in K.slices(offsets):
        found += segments(model, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[1]
    best = np.array([max((x[2] for x in segs), default=0.0) for segs in found])
    clean = ~label & (best > 0)
    log_k = float(np.mean(rate * best[clean] - np.log(np.maximum(n_words[clean], 1))) - _EULER) if clean.any() else -2.0
    model = SegmentModel(model.keys, scores, drift, rate, log_k, np.zeros(3))
    weights = _logistic(evidence(model, n_words, found), label.astype(float))
    if log_prior is not None:
        weights[0] += log_prior - np.log(label.sum() / (~label).sum())
    return SegmentModel(model.keys, scores, drift, rate, log_k, weights)


def fit_labels(docs: DataFrame, labels: DataFrame, learn: Column, *, most_toxic: int = 2000, most_clean: int = 6000, **knobs) -> SegmentModel | None:
    """Fits on at most about so many labelled rows of each label for which `learn` holds.

    Only the sampled ids, whose number these bounds fix, are broadcast to the scan of the texts. The
    probability's offset follows the labels' shares among all labelled rows, not in the sample.
    """
    known = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = sample_rows(known, "toxic", F.when(F.col("toxic") == 1, float(most_toxic)).otherwise(float(most_clean)))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    log_prior = np.log(share[1] / share[0]) if len(share) == 2 else None
    return fit(rows.select("doc_id", "text", "toxic").toArrow().sort_by("doc_id"), log_prior=log_prior, **knobs)


def score_toxicity(df: DataFrame, model: SegmentModel | None, *, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df's columns (`text` only if keep_text) with score, predicted and passages; columns of
    these names are replaced.

    passages: array of (first_word, end_word, score, e_value), words being `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`
    of the lower-cased text; every maximal segment with an e-value of at most 0.05.
    """
    kept = others(df, "score", "predicted", "passages", *([] if keep_text else [text]))
    body = fresh(df, "_text")
    rows = df.select(*columns(df, kept), F.col(text).alias(body))
    passage = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
    ddl = "array<struct<first_word:int,end_word:int,score:double,e_value:double>>"
    if model is None:
        return rows.select(*columns(df, kept), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(ddl).alias("passages"))
    schema = widened(df, kept, f"score double, predicted int, passages {ddl}")
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model = shared.value
        for batch in batches:
            data, offsets = K.utf8(batch.column(body))
            scores, spans = [], []
            for lo, hi in K.slices(offsets):
                n_words, found = segments(model, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                logit = evidence(model, n_words, found) @ model.weights
                scores.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
                bar = -math.log(0.05)
                for n, segs in zip(n_words.tolist(), found):
                    space = model.log_k + math.log(max(n, 1))
                    spans.append([{"first_word": a, "end_word": b, "score": s, "e_value": math.exp(space - model.rate * s)} for a, b, s in segs if model.rate * s - space >= bar])
            score = np.concatenate(scores) if scores else np.zeros(0)
            cols = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, passage)], names=[*kept, "score", "predicted", "passages"])

    return rows.mapInArrow(scan, schema)


def trained(spark, docs: DataFrame, sf_dir: str) -> SegmentModel | None:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return fit_labels(docs, labels, ~F.coalesce(F.expr(HELD_OUT), F.lit(True)))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents, learned from labelled rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out")
    return score_toxicity(docs.select("doc_id", held, "text"), trained(spark, docs, sf_dir)).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))
