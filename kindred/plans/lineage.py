"""Cutting lineage between the rounds of iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a local session (tests) gets a temporary one; a cluster is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir names no shared folder; a cluster needs one")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kindred-"))
    return context.getCheckpointDir()


#: Decimal digits of a size estimate beyond which it is forgotten.
MOST_SIZE_DIGITS = 300


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that it survives lost executors.

    A checkpoint keeps its plan's size estimate, and joins multiply estimates: over the rounds of an iteration they
    grow to numbers of millions of digits, which the planner multiplies again. Such an estimate is dropped.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)
    told = re.search(r"E\+(\d+) B", kept._jdf.queryExecution().optimizedPlan().stats().simpleString())
    if told and int(told[1]) > MOST_SIZE_DIGITS:
        kept = DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), spark)
    return kept


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder as compressed columns: for wide rows that are read in parts.

    A checkpoint holds whole rows as they lie in memory, and every reader reads them whole. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


#: Weighted strings that are sent to every task, some 50 bytes each.
MOST_SENT = 400_000


def sent(rows: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """rows, computed once, and broadcast where they are few: the other side of their join is then not shuffled. More are joined as they are."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
