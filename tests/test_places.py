"""Places of assembled classes."""

import re

from pyspark.sql import functions as F

from kindred.sources import dex


def test_places_are_counted_without_a_window_of_a_whole_build(spark):
    none = F.array().cast("array<string>")
    kind = "array<struct<name:string,descriptor:string,access:int,bytecode:binary,instr_count:int,opcode_xor:int,calls:array<string>,instantiates:array<string>>>"
    raw = spark.range(40).select(
        F.when(F.col("id") % 2 == 0, "d").otherwise("e").alias("digest"), F.lit(0).alias("nth"), F.lit(0).alias("blob"), F.col("id").cast("int").alias("cls"), F.lit(True).alias("ok"), F.concat(F.lit("La/C"), F.col("id"), F.lit(";")).alias("descriptor"),
        F.lit(None).cast("string").alias("source_file"), F.lit(1).alias("access"), F.lit("Ljava/lang/Object;").alias("superclass"), none.alias("interfaces"), none.alias("strings"),
        F.array().cast("array<struct<name:string,type_desc:string,access:int>>").alias("fields"), F.array().cast(kind).alias("methods"),
    )
    out = dex.assemble(raw)
    assert {(r["descriptor"], r["pos"]) for r in out.collect()} == {(f"La/C{i};", i // 2 + 1) for i in range(40)}
    assert not re.search(r"windowspecdefinition\(digest#\d+, nth", out._jdf.queryExecution().optimizedPlan().toString())
