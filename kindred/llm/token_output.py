"""Token ids of a corpus in shards, each a wavelet matrix in one compressed file.

Rows are sorted by id over ranges (one shuffle, of the texts; many rows with one id are spread over ranges by
the texts' hashes and the rows' numbers). A task encodes its range's texts in their order and writes a shard
whenever `shard_tokens` ids are there, so no task holds more than a shard and a batch of rows, however
uneven the ranges are. Files go through the folder's own file system under a name that no other attempt of the
task has; the manifest, a small Parquet table that Spark commits, says which of them count and in which order. An
executor lost while writing leaves a file that nothing names.

Reading goes by the manifest: a shard is decoded whole (`read_tokens`), or asked in parts by rank and
select (`token_counts`, `occurrences`, `tokens_at`).

Defined results: a null or empty text is the end id alone. Documents follow each other by ascending id,
null ids last; rows with one id by their texts' hashes. Repeated rows are each written. An empty table makes
an empty manifest, and no row is read. Columns other than id and text are not written.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from kindred.llm import packed, token_ids, wavelet
from kindred.llm.shared import partitions, shared_dir
from kindred.session import ship

END = 0
SHARD_TOKENS = 4 << 20
#: Text of a range, about.
RANGE_BYTES = 128 << 20
MANIFEST = "part int, seq int, name string, n_docs long, n_tokens long, n_bytes long"
#: Ids in a batch of rows that are read, about.
BATCH_TOKENS = 1 << 20


class Files:
    """A folder of any file system that pyarrow knows by its address."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)

    def write(self, name: str, data: bytes) -> None:
        self.fs.create_dir(self.path, recursive=True)
        with self.fs.open_output_stream(f"{self.path}/{name}") as out:
            out.write(data)

    def matrix(self, name: str) -> wavelet.Matrix:
        file = self.fs.open_input_file(f"{self.path}/{name}")
        return wavelet.Matrix(lambda at, size: bytes(file.read_at(size, at)))


def _sorted(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    spark = df.sparkSession
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    rows = df.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("nth")]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    ranges = max(partitions(spark), -(-packed.sizes(rows) // RANGE_BYTES))
    return rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)


def write_tokens(df: DataFrame, folder: str, *, path: str | None = None, doc_id: str = "doc_id", text: str = "text", end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the shards and the manifest of all rows into a new folder."""
    ship(df.sparkSession)

    def write(batches):
        own, files = token_ids.encoder(path), Files(f"{folder}/shards")
        part, attempt, seq = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        ids, docs, lengths, have = [], [], [], 0

        def shard():
            data = wavelet.encode(np.concatenate(ids), docs, np.array(lengths))
            name = f"{part:06d}-{seq:06d}-{attempt}.kwm"
            files.write(name, data)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "name": name, "n_docs": len(docs), "n_tokens": have, "n_bytes": len(data)}], schema=_ARROW)

        for batch in batches:
            got, first = token_ids.ended(*own.encode(batch.column("text")), end)
            names = batch.column("doc_id").to_pylist()
            begin = 0
            while begin < len(names):
                # as many documents as fill the shard; the one that does is its last
                stop = min(len(names), int(np.searchsorted(first, first[begin] + shard_tokens - have, "left")))
                ids.append(got[first[begin] : first[stop]].copy())
                docs += names[begin:stop]
                lengths += np.diff(first[begin : stop + 1]).tolist()
                have += int(first[stop] - first[begin])
                begin = stop
                if have >= shard_tokens:
                    yield shard()
                    ids, docs, lengths, have, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    _sorted(df, doc_id, text).select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with `start`: the ids of all shards before. Sums per range (their number follows from the
    cluster's settings and the bytes of text) come to the driver, nothing per shard or document."""
    rows = spark.read.parquet(f"{folder}/manifest")
    base, at = [], 0
    for part, n in sorted(tuple(r) for r in rows.groupBy("part").agg(F.sum("n_tokens")).collect()):
        base.append((part, at))
        at += n
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    return rows.join(F.broadcast(spark.createDataFrame(base, "part int, _base long")), "part").withColumn("start", F.col("_own") + F.col("_base")).drop("_own", "_base")


def _each(spark: SparkSession, folder: str, make, schema: str, rows: DataFrame | None = None, per_task: int = 2) -> DataFrame:
    """make(matrix, start) gives the record batches of a shard; for all shards, or those of `rows`."""
    ship(spark)
    rows = manifest(spark, folder) if rows is None else rows
    tasks = max(1, -(-rows.count() // per_task))

    def run(batches):
        files = Files(f"{folder}/shards")
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                yield from make(files.matrix(name), start)

    return rows.select("name", "start").repartition(tasks, "name").mapInArrow(run, schema)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (unsigned, four bytes each, little-endian) of every document."""

    def make(matrix, start):
        ids, docs = matrix.decode(), matrix.doc_ids()
        first = np.concatenate([[0], np.cumsum(matrix.lengths())])
        begin = 0
        while begin < len(docs):
            stop = max(begin + 1, int(np.searchsorted(first, first[begin] + BATCH_TOKENS, "right")) - 1)
            raw = ids[first[begin] : first[stop]].astype("<u4")
            at = ((first[begin : stop + 1] - first[begin]) * 4).astype(np.int32)
            blob = pa.BinaryArray.from_buffers(pa.binary(), stop - begin, [None, pa.py_buffer(at), pa.py_buffer(raw)])
            cols = [pa.array(docs[begin:stop], pa.int64()), pa.array(first[begin:stop] + start), pa.array(np.diff(first[begin : stop + 1])), blob]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids"])
            begin = stop

    return _each(spark, folder, make, "doc_id long, start long, n_tokens long, ids binary")


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of some ids is there."""
    tokens = sorted(set(tokens))

    def make(matrix, start):
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return _each(spark, folder, make, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """token, doc_id, at (its place in the document), place (in all documents): every occurrence of some ids."""
    tokens = sorted(set(tokens))

    def make(matrix, start):
        docs, first = np.array(matrix.doc_ids(), object), np.concatenate([[0], np.cumsum(matrix.lengths())])
        for token in tokens:
            places = matrix.occurrences(token)
            for lo in range(0, len(places), BATCH_TOKENS):
                some = places[lo : lo + BATCH_TOKENS]
                row = np.searchsorted(first, some, "right") - 1
                cols = [pa.array(np.full(len(some), token)), pa.array(docs[row], pa.int64()), pa.array(some - first[row]), pa.array(some + start)]
                yield pa.RecordBatch.from_arrays(cols, names=["token", "doc_id", "at", "place"])

    return _each(spark, folder, make, "token long, doc_id long, at long, place long")


def tokens_at(spark: SparkSession, folder: str, places: list[int]) -> DataFrame:
    """place, token: the ids at some places of the whole sequence. Only shards that hold one are opened."""
    asked = np.unique(np.array(places, np.int64))
    if not len(asked):
        return spark.createDataFrame([], "place long, token long")

    def make(matrix, start):
        mine = asked[(asked >= start) & (asked < start + matrix.tokens)] - start
        yield pa.RecordBatch.from_arrays([pa.array(mine + start), pa.array(matrix.access(mine).astype(np.int64))], names=["place", "token"])

    held = F.exists(F.lit(asked.tolist()), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens")))
    return _each(spark, folder, make, "place long, token long", manifest(spark, folder).where(held))


def op13_token_output(spark, sf_dir: str) -> DataFrame:
    """All documents as shards of token ids in the shared folder, read back from there."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
