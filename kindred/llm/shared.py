"""What the operators share: whole column names, names that clash, and the core's checkpoints and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.operators.graph import components
from kindred.plans.lineage import cut, shared_dir

__all__ = ["columns", "components", "cut", "fresh", "others", "partitions", "shared_dir", "thinned", "widened"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(df: DataFrame, names: list[str]) -> list:
    """The named columns, whatever characters the names hold."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def widened(df: DataFrame, names: list[str], ddl: str) -> StructType:
    """The schema of the named columns of df and of the columns of a DDL string."""
    return StructType([df.schema[n] for n in names] + StructType.fromDDL(ddl).fields)


def fresh(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but these; a column named like an output is replaced by it."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def thinned(rows: DataFrame, wanted: DataFrame, key: str, most_bits: int = 1 << 27) -> DataFrame:
    """The rows whose key may be among the wanted ones, and all that are: a filter before a shuffle.

    What is broadcast is a bitmap of the keys' hashes, of at most most_bits bits whatever their number.
    """
    count, size = wanted.count(), 64
    while size < min(most_bits, 8 * count):
        size *= 2
    place = F.pmod(F.xxhash64(key), F.lit(size))
    bits = wanted.select(F.shiftright(place, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {size}) & 63 as int))").alias("_bit"))
    bits = bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = F.expr(f"(shiftrightunsigned(_bits, cast(pmod(xxhash64(`{key}`), {size}) & 63 as int)) & 1) = 1")
    return rows.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(bits), "_word").where(held).drop("_word", "_bits")
