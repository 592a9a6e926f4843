"""The fingerprint store: prepared classes by sample, with a stamp for each layer; and packs.

A store is a Parquet folder partitioned by digest. Three stamps say which parameters made each layer:
what was extracted, the abstract opcodes, the signatures. A stale layer is refused, or, where only the
signatures are stale, made anew from the stored columns.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.simhash import signatures, with_abstract
from kindred.schema import LSH_SEED, LSH_TABLES, OPCODE_CATEGORIES

EXTRACTION_VERSION = 2


def _stamp(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


EXTRACTION_STAMP = _stamp("extraction", EXTRACTION_VERSION)
ABSTRACT_STAMP = _stamp("abstract", OPCODE_CATEGORIES)
SIGNATURE_STAMP = _stamp("signature", ABSTRACT_STAMP, "murmur3-0", (1, 4, 3, 1, 3), LSH_SEED, LSH_TABLES)
STAMPS = {"extraction_stamp": EXTRACTION_STAMP, "abstract_stamp": ABSTRACT_STAMP, "signature_stamp": SIGNATURE_STAMP}


class StaleStore(ValueError):
    """A stored layer was made with other parameters."""


def prepare(classes: DataFrame) -> DataFrame:
    """Class rows with abstract opcodes, signatures and stamps; the opcode bytes are dropped."""
    rows = signatures(with_abstract(classes))
    rows = rows.withColumn("methods", F.transform("methods", lambda m: m.withField("bytecode", F.lit(b""))))
    for name, stamp in STAMPS.items():
        rows = rows.withColumn(name, F.lit(stamp))
    return rows


def save(prepared: DataFrame, path: str, mode: str = "append") -> None:
    """Writes samples; each digest is a folder. With mode 'overwrite' only the digests written are replaced."""
    if mode == "overwrite":
        prepared.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("digest").parquet(path)
    else:
        prepared.write.mode(mode).partitionBy("digest").parquet(path)


def stale_layers(rows: DataFrame) -> list[str]:
    """Which layers of stored rows do not have today's stamps."""
    flags = rows.agg(*[F.max((F.col(n) != s).cast("int")).alias(n) for n, s in STAMPS.items()]).first()
    return [n.removesuffix("_stamp") for n in STAMPS if flags[n]]


def load(spark: SparkSession, path: str, digests: list[str] | None = None, check: bool = True) -> DataFrame:
    """Stored class rows; the digest filter prunes folders. Raises StaleStore for a stale layer unless check is off."""
    rows = spark.read.parquet(path)
    if digests is not None:
        rows = rows.where(F.col("digest").isin(digests))
    rows = rows.withColumn("digest", F.col("digest").cast("string"))
    if check and (stale := stale_layers(rows)):
        hint = "migrate it" if stale == ["signature"] else "prepare its samples again"
        raise StaleStore(f"{path}: stale layers {', '.join(stale)}; {hint}")
    return rows


#: Samples that are broadcast, some 50 bytes each.
MOST_SAMPLES = 100_000


def by_sample(samples: DataFrame) -> DataFrame:
    """A row a sample, to be joined by digest with classes: a sample's classes are not shuffled to one task, unless samples are very many."""
    return F.broadcast(samples) if samples.limit(MOST_SAMPLES + 1).count() <= MOST_SAMPLES else samples


def migrate(spark: SparkSession, path: str) -> DataFrame:
    """Makes the signatures of stale samples anew; (digest, outcome) tells what became of each: ok, migrated or stale."""
    rows = load(spark, path, check=False)
    old = (F.col("extraction_stamp") != EXTRACTION_STAMP) | (F.col("abstract_stamp") != ABSTRACT_STAMP)
    per = rows.groupBy("digest").agg(F.max(old.cast("int")).alias("old"), F.max((F.col("signature_stamp") != SIGNATURE_STAMP).cast("int")).alias("sig"))
    outcome = F.when(F.col("old") == 1, "stale").when(F.col("sig") == 1, "migrated").otherwise("ok")
    from kindred.plans.lineage import cut

    result = cut(per.select("digest", outcome.alias("outcome")))
    old_ones = result.where("outcome = 'migrated'").select("digest")
    if not old_ones.isEmpty():
        todo = cut(rows.join(by_sample(old_ones), "digest"))
        save(signatures(todo.drop("sig")).withColumn("signature_stamp", F.lit(SIGNATURE_STAMP)), path, "overwrite")
    return result


def missing(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Of wanted digests those the store lacks: what has yet to be parsed."""
    try:
        have = spark.read.parquet(path).select(F.col("digest").cast("string").alias("digest")).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return wanted
    return wanted.join(have, "digest", "left_anti")


def digests(files: DataFrame) -> DataFrame:
    """(path, digest) of binary files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("digest"))


def folder_digest(files: DataFrame) -> str:
    """One digest of a folder: of its files' digests in the order of their paths."""
    rows = digests(files).orderBy("path").collect()  # one row a file
    return hashlib.sha256("".join(r["digest"] for r in rows).encode()).hexdigest()


def kinds(files: DataFrame) -> DataFrame:
    """(path, kind) by the first bytes of (path, content), by the extension where they tell nothing."""
    head = F.col("content")
    starts = lambda magic: F.substring(head, 1, len(magic)) == F.lit(magic)
    lower = F.lower("path")
    kind = (
        F.when(starts(b"dex\n"), "dex").when(starts(b"PK\x03\x04"), "apk").when(starts(b"PAR1"), "store").when(starts(b"{"), "json")
        .when(lower.endswith(".dex"), "dex").when(lower.endswith(".apk"), "apk").when(lower.endswith(".parquet"), "store").when(lower.endswith(".json"), "json").otherwise("unknown")
    )
    return files.select("path", kind.alias("kind"))


def files(spark: SparkSession, paths: list[str], glob: str | None = None) -> DataFrame:
    """(path, content, nth) of files and of folders' files below, each path once, in the order given.

    A file below two of the paths is read for the first: later ones leave out what lies at or below an earlier one, by
    the file's name, so no content is shuffled.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    whole = lambda p: _qualified(spark, p)
    out, earlier = None, []
    for i, p in enumerate(paths):
        rows = (read.option("pathGlobFilter", glob) if glob else read).load(p).select("path", "content", F.lit(i).alias("nth"))
        for root in earlier:
            rows = rows.where((F.col("path") != root) & ~F.col("path").startswith(f"{root}/"))
        earlier.append(whole(p))
        out = rows if out is None else out.unionByName(rows)
    return out


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark names its files: with its file system, without a slash at its end."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


# ---- packs


def save_pack(entries: DataFrame, meta: DataFrame, path: str, extra: DataFrame | None = None) -> None:
    """Two tables below the path. extra: (entry_id, ...) adds payload columns, never replaces any."""
    if extra is not None:
        own = [c for c in extra.columns if c != "entry_id" and c not in entries.columns]
        unknown = extra.join(entries, "entry_id", "left_anti")
        if not unknown.isEmpty():
            raise ValueError("the extra payload refers to entries that the pack lacks")
        entries = entries.join(extra.select("entry_id", *own), "entry_id", "left")
    entries.write.mode("overwrite").parquet(f"{path}/entries")
    meta.write.mode("overwrite").json(f"{path}/meta")


def load_pack(spark: SparkSession, path: str, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entries, meta); refuses a pack of other signatures."""
    schema = "pack string, family string, kind string, n_samples int, k int, radius_build int, min_instr int, samples array<string>, stamp string"
    meta = spark.read.schema(schema).json(f"{path}/meta")
    if check and not meta.where(F.col("stamp") != SIGNATURE_STAMP).isEmpty():
        raise StaleStore(f"{path}: the pack's signatures are stale; build it again")
    return spark.read.parquet(f"{path}/entries"), meta


def list_packs(spark: SparkSession, folder: str) -> DataFrame:
    """The packs of a folder by their meta rows alone."""
    schema = "pack string, family string, kind string, n_samples int, k int, radius_build int, min_instr int, samples array<string>, stamp string"
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    return rows.where("pack is not null").withColumn("stale", F.col("stamp") != SIGNATURE_STAMP)


def find_pack(explicit: str | None, env: str = "KINDRED_PACK", default: str | None = None) -> str | None:
    """The first that is set: an explicit path, the environment's, the default."""
    import os

    return next((p for p in (explicit, os.environ.get(env), default) if p), None)
