"""Questions of chunks of documents to hash buckets, and their answers, in packed arrays.

Documents are dealt into chunks of about `CHUNK_BYTES` of text. A chunk asks each bucket about its
keys in one row: the keys are distinct within the chunk (counted or thinned before the shuffle), so
a key that is in every document costs one entry per chunk, and no bucket holds more of it than there
are chunks. A bucket answers each chunk in one row. Arrays travel as byte planes, which compress well.
Chunks and buckets are groups of bounded size; their numbers follow from the input's size alone. There
are never more rows than entries, however many chunks and buckets there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import textkit as K

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
LEAST = 16
#: Where a null id sorts.
LAST_ID = (1 << 63) - 1


def sizes(df: DataFrame, text: str = "text") -> int:
    """Bytes of text."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def chunked(df: DataFrame, total: int) -> DataFrame:
    """(chunk, doc_id, text, ...) of a frame with doc_id and text: rows dealt by a hash of id and text.

    The number of chunks follows from the bytes of all texts; nothing is collected. Rows of one id but
    unlike texts are spread; only rows that are equal in both share a chunk.
    """
    n = max(LEAST, -(-total // CHUNK_BYTES))
    return df.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def buckets(entries: int, width: int) -> int:
    return max(LEAST, -(-entries * width // BUCKET_BYTES))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes."""
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    planes = np.frombuffer(data, np.uint8).reshape(width, len(data) // width)
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(planes[at : at + size].T).view(k).ravel())
        at += size
    return out


def deal(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' entries bucket by bucket, in their order; the work does not grow with buckets that get nothing."""
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for start, end in zip(starts, [*starts[1:], len(bucket)]):
        yield int(bucket[start]), [a[start:end] for a in arrays]


class Chunk:
    """The documents of a chunk in the order of (doc_id, hash of the text, text), null ids last, and their words' hashes."""

    def __init__(self, table: pa.Table, keep: np.ndarray, lower: bool):
        ids = pc.fill_null(table["doc_id"], LAST_ID)
        if table.num_rows:
            order = pc.sort_indices(pa.table({"id": ids, "hash": table["hash"], "text": table["text"]}), [("id", "ascending"), ("hash", "ascending"), ("text", "ascending")])
            table, ids = table.take(order), ids.take(order)
        self.table, self.ids, self.hash = table.combine_chunks(), ids.to_numpy(), table["hash"].to_numpy()
        self.keep, self.lower = keep, lower
        data, self.offsets = K.utf8(self.table["text"])
        self.words, self.first = K.hashed_words(data, self.offsets, keep, lower)

    def room(self) -> np.ndarray:
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.words))

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def second(self, places: np.ndarray) -> np.ndarray:
        """Independent hashes of all words of the rows that hold the places; 0 elsewhere."""
        out = np.zeros(len(self.words), np.uint64)
        rows = np.unique(self.row_of(places))
        if len(rows):
            data, offsets = K.utf8(self.table["text"].take(pa.array(rows)))
            hashes, first = K.hashed_words(data, offsets, self.keep, self.lower, salt=1)
            for i, row in enumerate(rows):
                out[self.first[row] : self.first[row + 1]] = hashes[first[i] : first[i + 1]]
        return out


ASKED = "bucket int, chunk int, payload binary"
ANSWERED = "chunk int, bucket int, level int, payload binary"


def rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def asked(questions: Iterator[tuple[int, bytes]], chunk: int) -> pa.Table:
    got = list(questions)
    return rows({"bucket": ([b for b, _ in got], pa.int32()), "chunk": ([chunk] * len(got), pa.int32()), "payload": ([p for _, p in got], pa.binary())})


def answer(questions: DataFrame, reply: Callable[[list[tuple[int, bytes]]], list[bytes]], level: int = 0) -> DataFrame:
    """One answer per question; reply gets a bucket's (chunk, payload) in the order of chunks. Empty answers stay out."""

    def run(key, table):
        table = table.sort_by("chunk")
        chunks = table["chunk"].to_pylist()
        payloads = reply(list(zip(chunks, table["payload"].to_pylist())))
        kept = [i for i, p in enumerate(payloads) if p]
        n = len(kept)
        return rows({"chunk": ([chunks[i] for i in kept], pa.int32()), "bucket": ([key[0].as_py()] * n, pa.int32()), "level": ([level] * n, pa.int32()), "payload": ([payloads[i] for i in kept], pa.binary())})

    return questions.groupBy("bucket").applyInArrow(run, ANSWERED)
