"""Clear names for obfuscated classes and members, told from a matched build."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import scalars as S

TRUSTED = 0.95


def build_mapping(matches: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """(original, obfuscated, confidence, anchored, methods, fields) of paired rows whose right name is obfuscated.

    Of classes that would get one name the best (anchored, then most similar, then in order of the pair)
    keeps it; the others get their own leaf appended, and a number where even that is taken.
    """
    outer = lambda name: F.regexp_extract(name, "^[^$]*", 0)
    rows = matches.where("lhs is not null and rhs is not null").withColumn("anchored", F.col("provenance") == "anchored")
    rows = rows.withColumn("head", S.recovered_head(F.col("a.source_file"), F.col("a.name")))
    rows = rows.where(S.looks_obfuscated(outer(F.col("b.name"))) & (F.col("anchored") | (F.col("similarity") >= min_confidence)) & F.col("head").isNotNull())
    plain = S.with_head(F.col("b.package"), F.col("b.name"), F.col("head"))
    suffixed = S.with_head(F.col("b.package"), F.col("b.name"), F.concat_ws("_", "head", outer(F.col("b.name"))))
    best = lambda c: Window.partitionBy(c).orderBy(F.desc("anchored"), F.desc("similarity"), "ord")
    rows = rows.withColumn("_plain", plain).withColumn("_n", F.row_number().over(best("_plain"))).withColumn("original", F.when(F.col("_n") == 1, F.col("_plain")).otherwise(suffixed))
    again = F.row_number().over(Window.partitionBy("original").orderBy("_n", F.desc("anchored"), F.desc("similarity"), "ord"))
    rows = rows.withColumn("_m", again).withColumn("original", F.when(F.col("_m") == 1, F.col("original")).otherwise(F.concat_ws("_", "original", F.col("_m").cast("string"))))
    member = "array<struct<signature:string,original:string,obfuscated:string,confidence:double,trusted:boolean>>"
    fit = F.filter("method_rows", lambda x: (x["status"] == "matched") | ((x["status"] == "modified") & (x["score"] >= min_confidence)))

    def method(x):
        left, right = F.get(F.col("a.methods"), x["l"]), F.get(F.col("b.methods"), x["r"])
        return F.struct(S.java_method(left["name"], left["descriptor"]).alias("signature"), left["name"].alias("original"), right["name"].alias("obfuscated"), x["score"].alias("confidence"), (x["score"] >= TRUSTED).alias("trusted"))

    zipped = F.arrays_zip(F.col("a.fields").alias("x"), F.col("b.fields").alias("y"))
    same = F.filter(zipped, lambda z: z["x"].isNotNull() & z["y"].isNotNull() & (z["x"]["type_desc"] == z["y"]["type_desc"]))
    fields = F.transform(same, lambda z: F.struct(S.java_field(z["x"]["name"], z["x"]["type_desc"]).alias("signature"), z["x"]["name"].alias("original"), z["y"]["name"].alias("obfuscated"), F.lit(1.0).alias("confidence"), F.lit(True).alias("trusted")))
    return rows.select("original", S.fqcn(F.col("b.package"), F.col("b.name")).alias("obfuscated"), F.col("similarity").alias("confidence"), "anchored", F.transform(fit, method).cast(member).alias("methods"), fields.cast(member).alias("fields"))


def mapping_lines(entries: DataFrame) -> DataFrame:
    """(obfuscated, lines): each class' lines in rename-mapping format, with its members."""
    low = lambda c: F.concat(F.lit("# low-confidence ("), F.format_string("%.2f", c), F.lit(")"))
    by_name = lambda members: F.transform(F.array_sort(F.transform(members, lambda m, i: F.struct(m["obfuscated"].alias("k"), i.alias("i"), m.alias("m")))), lambda x: x["m"])

    def shown(m):
        line = F.concat(F.lit("    "), m["signature"], F.lit(" -> "), m["obfuscated"])
        return F.when(m["trusted"], line).otherwise(F.concat(F.lit("    "), low(m["confidence"]), F.lit("\n"), line))

    head = F.concat("original", F.lit(" -> "), "obfuscated", F.lit(":"))
    head = F.when(~F.col("anchored") & (F.col("confidence") < TRUSTED), F.concat(low(F.col("confidence")), F.lit("\n"), head)).otherwise(head)
    return entries.select("obfuscated", F.array_join(F.concat(F.array(head), F.transform(by_name(F.col("fields")), shown), F.transform(by_name(F.col("methods")), shown)), "\n").alias("lines"))
