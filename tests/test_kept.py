"""Wide rows, kept as columns."""

from pyspark.sql import functions as F

from kindred.plans.lineage import kept


def test_kept_rows_are_read_by_column(spark):
    df = spark.range(100).select("id", F.array(F.struct(F.col("id").alias("x"), F.lit(b"ab").alias("y"))).alias("wide"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    got = kept(df)
    assert got.schema.simpleString() == df.schema.simpleString() and got.selectExpr("id", "wide", "m['k'] k").exceptAll(df.selectExpr("id", "wide", "m['k'] k")).isEmpty()
    assert "wide" not in got.select("id")._jdf.queryExecution().executedPlan().toString()
