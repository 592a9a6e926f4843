"""Groups of a sorted stream of Arrow batches, and row numbers of a whole table."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.plans.lineage import cut


def whole_groups(batches, key: str):
    """Tables that end where a group of the sorted key ends; no group is cut."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not held.num_rows:
            continue
        keys = held[key].combine_chunks()
        own = pc.sum(pc.equal(keys, keys[len(keys) - 1])).as_py()  # sorted: the last group's rows
        if own < len(keys):
            yield held.slice(0, len(keys) - own)
            held = held.slice(len(keys) - own)
    if held is not None and held.num_rows:
        yield held


def numbered(df: DataFrame, order: list, name: str, keep=cut) -> DataFrame:
    """df with row numbers from 1 in a total order, without a task that holds all rows.

    Rows are sorted by ranges; a row's number is its place in its range and the rows of the ranges before,
    of which there is one count a partition. The sorted rows are computed once, by `keep`: lineage.kept for wide ones.
    """
    rows = keep(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_id") - F.shiftleft("_part", 33) + F.col("_before") + 1).drop("_id", "_part", "_before")
