"""The corpus pipeline: five stages over documents, each calling one operator of kindred.llm.

A stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a frame; all
but the last return the columns of documents. run() writes each stage's rows to the shared folder as
Parquet and reads them again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontaminate, minhash_forest, packing, substring_dedup, toxicity
from kindred.llm.shared import cut, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the segment search calls toxic.

    Null, empty and word-less texts have no toxic passage and stay; repeated rows are judged alike. Without a
    toxic label to learn from nothing is dropped. Null ids are scored, not learned from.
    """
    model = toxicity.trained(spark, docs.select("doc_id", "text"), sf_dir)
    return toxicity.score_toxicity(docs, model, keep_text=True).where("predicted = 0").select(*COLUMNS)


#: Above every id: where rows without one are numbered by their texts.
_NAMELESS = 1 << 62


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8): the least id.

    Null and word-less texts are like nothing and stay. Rows that share an id are one document, of which the
    least row by its columns stays; rows without an id are one document where their texts are equal, and
    give way to documents with an id.
    """
    number = F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(_NAMELESS - 1) + F.lit(_NAMELESS))
    rows = docs.select(*COLUMNS, number.alias("_number"))
    found = minhash_forest.near_duplicates(rows, doc_id="_number", percent=80)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("_number")).distinct()
    kept = rows.join(dropped, "_number", "left_anti")
    again = cut(rows.groupBy("_number").count().where("count > 1").select("_number"))
    if again.isEmpty():
        return kept.select(*COLUMNS)
    least = kept.join(again, "_number", "left_semi").groupBy("_number").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.join(again, "_number", "left_anti").select(*COLUMNS).unionByName(least)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out windows of 20 words that repeat earlier ones; documents of which no word is left go.

    A text that loses nothing stays as it is, null and empty ones too; the kept words of others are joined by
    one space and counted anew. Of rows that are equal in id and text the first keeps its words.
    """
    kept = substring_dedup.remove_repeats(docs, keep_columns=[c for c in COLUMNS if c not in ("doc_id", "text")], keep_text=True)
    changed = F.col("n_removed") > 0
    rows = kept.where("n_removed = 0 or n_removed < n_words")
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    chars = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item.

    Null and word-less texts hold none and stay; an empty benchmark drops nothing; items without words, and
    null ones, match nothing. Repeated rows are judged alike.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.find_benchmark(docs, benchmark).where(F.size("spans") == 0).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens.

    A null or empty text is a document of one token, its end. Every row is packed, repeated ones too.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained models and tokenizers are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
