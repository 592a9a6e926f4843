"""Grading matches against known truth, and truth told from rename mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks in the names of compiler-made classes, of generated comparators, and the placeholder of removed classes.
SYNTHETIC_MARKS = ("$$ExternalSynthetic", "$$Lambda$")
COMPARATOR_MARKS = (
    "$$inlined$sortedBy", "$$inlined$sortByDescending", "$$inlined$sortBy", "$$inlined$compareBy", "$$inlined$thenBy", "$$inlined$thenComparator",
    "$$inlined$sortedByDescending",
)
REMOVED_MARK = "R8$$REMOVED"


def simple_name(name: Column) -> Column:
    return F.regexp_extract(name, "[^.]*$", 0)


def _holds_any(name: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(name, F.lit(mark))
    return out


def is_generated_boilerplate(name: Column) -> Column:
    """Resource classes, view bindings and generated comparators."""
    return simple_name(name).rlike("^R$|^R\\$|Binding$|BindingImpl$") | _holds_any(name, COMPARATOR_MARKS)


def is_synthetic_like(name: Column) -> Column:
    return _holds_any(name, SYNTHETIC_MARKS) | is_generated_boilerplate(name)


def is_removed_target(name: Column) -> Column:
    return F.contains(name, F.lit(REMOVED_MARK))


def parse_mapping(lines: DataFrame, value: str = "value") -> DataFrame:
    """(original, obfuscated) class lines of a rename mapping; members, comments and malformed lines are skipped.

    lines: (value, n) with n the line's number; the last line of an original wins.
    """
    from pyspark.sql import Window

    found = lines.where(~F.col(value).rlike("^[\\s#]")).select("n", F.regexp_extract(value, "^(\\S.*?) -> (.*):\\s*$", 1).alias("original"), F.regexp_extract(value, "^(\\S.*?) -> (.*):\\s*$", 2).alias("obfuscated"))
    last = Window.partitionBy("original").orderBy(F.desc("n"))
    return found.where("original <> ''").withColumn("_k", F.row_number().over(last)).where("_k = 1").select(F.trim("original").alias("original"), F.trim("obfuscated").alias("obfuscated"))


def cross_version_truth(left: DataFrame, right: DataFrame, package: str | None = None, skip_synthetic: bool = True) -> DataFrame:
    """(original, lhs, rhs): names of one class in two builds, by their mappings (original, obfuscated)."""
    from kindred.functions.scalars import in_package

    keep = ~is_removed_target(F.col("lhs")) & ~is_removed_target(F.col("rhs"))
    if package:
        keep = keep & in_package(F.regexp_replace("original", "\\.[^.]*$", ""), package)
    if skip_synthetic:
        keep = keep & ~is_synthetic_like(F.col("original"))
    one = left.select("original", F.col("obfuscated").alias("lhs"))
    return one.join(right.select("original", F.col("obfuscated").alias("rhs")), "original").where(keep)


def score_matches(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of (lhs, rhs) pairs against truth (lhs, rhs).

    Only left names that the truth knows are graded; a wrong partner is a false positive and a miss.
    """
    known = truth.select("lhs", F.col("rhs").alias("true_rhs"))
    graded = known.join(matches.where("lhs is not null and rhs is not null").select("lhs", "rhs"), "lhs", "left")
    hit = F.col("rhs") == F.col("true_rhs")
    per = graded.groupBy("lhs", "true_rhs").agg(F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("tp"), F.coalesce(F.sum((~hit).cast("int")), F.lit(0)).alias("fp"))
    out = per.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"), F.coalesce(F.sum(1 - F.col("tp")), F.lit(0)).alias("fn"))
    return with_scores(out)


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp and fn; 0 where there is nothing to divide by."""
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumn("precision", safe(tp, tp + fp)).withColumn("recall", safe(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", safe(2 * p * r, p + r))
