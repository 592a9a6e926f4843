"""Sinks: change reports as JSON, CSV, XML and text, raw matches, components, name mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.operators import changes as C
from kindred.operators.naming import mapping_lines
from kindred.schema import REPORT_SCHEMA

CSV_COLUMNS = ("kind", "origin", "library", "confidence", "lhs", "rhs", "magnitude", "match_distance", "anchored", "lhs_super", "rhs_super", "interfaces", "components", "summary")
KINDS = ("modified", "added", "removed", "cosmetic", "unchanged")


def json_rows(changes: DataFrame) -> DataFrame:
    """One JSON object a change, keys sorted, similarity to four places; null delta and methods are left out."""
    names = ["anchored", "components", "confidence", "delta", "kind", "lhs", "lhs_interfaces", "lhs_super", "library", "magnitude", "match_distance", "methods", "origin", "rhs", "rhs_interfaces", "rhs_super", "source_file"]
    shown = changes.withColumn("match_distance", F.round("match_distance", 4)).withColumn("methods", F.when(F.size("methods") > 0, F.col("methods")))
    return shown.select(F.to_json(F.struct(*names)).alias("value"))


def json_document(changes: DataFrame) -> str:
    """The whole report as one document; for reports that fit the driver, else write json_rows."""
    import json

    rows = [json.loads(r["value"]) for r in json_rows(changes.orderBy(*C.report_order())).collect()]
    for r in rows:
        for k in ("lhs", "rhs", "source_file", "library", "lhs_super", "rhs_super"):
            r.setdefault(k, None)
    summary = {r["kind"]: r["count"] for r in C.counts(changes).collect()}
    return json.dumps({"schema_version": REPORT_SCHEMA, "summary": summary, "changes": rows}, indent=2, sort_keys=True)


def flat_rows(changes: DataFrame) -> DataFrame:
    """The fourteen text columns of CSV and XML; what is absent is empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    cols = {
        "magnitude": F.col("magnitude").cast("string"), "match_distance": F.format_string("%.4f", "match_distance"), "anchored": F.col("anchored").cast("string"),
        "interfaces": F.array_join(F.array_sort(F.array_union("lhs_interfaces", "rhs_interfaces")), " "), "components": F.array_join("components", ";"),
    }
    return changes.select(*[cols.get(c, text(c) if c not in cols else None).alias(c) for c in CSV_COLUMNS])


def write_csv(changes: DataFrame, path: str) -> None:
    flat_rows(changes.orderBy(*C.report_order())).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_json(changes: DataFrame, path: str) -> None:
    json_rows(changes).write.mode("overwrite").text(path)


def write_xml(changes: DataFrame, path: str) -> None:
    """Rows of <change>; empty values are left out."""
    rows = flat_rows(changes).select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in CSV_COLUMNS])
    rows.write.mode("overwrite").format("xml").option("rowTag", "change").option("rootTag", f'changes schema_version="{REPORT_SCHEMA}"').save(path)


def _top(changes: DataFrame, most: int) -> DataFrame:
    """The first rows of each kind in the order of the report."""
    by = Window.partitionBy("kind").orderBy(*C.report_order())
    return changes.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= most)


MARKS = {"app": "app", "library": "lib"}


def text_report(changes: DataFrame, top: int = 30) -> str:
    """A digest for a terminal: a line of counts, facts worth knowing, then a table of the greatest changes of each kind."""
    cells = {tuple(r)[:3]: r["count"] for r in changes.groupBy("kind", "origin", "confidence").count().collect()}  # a few rows
    tally = lambda test: {k: sum(n for (kind, *rest), n in cells.items() if kind == k and test(*rest)) for k in KINDS}
    shown = lambda counts: "  ".join(f"{k}={n}" for k, n in counts.items())
    lines = ["change summary: " + shown(tally(lambda origin, confidence: True))]
    own = tally(lambda origin, confidence: origin == "app")
    if any(own.values()):
        lines.append("in the app itself: " + shown(own))
    weak = tally(lambda origin, confidence: confidence == "low")["modified"]
    if weak:
        lines.append(f"of the modified, {weak} outside the app differ in calls alone (low confidence)")
    shared = C.sensitive_shared(changes).select(F.explode("components").alias("code")).groupBy("code").count().orderBy("code").collect()  # one row a code
    if shared:
        lines.append("sensitive in both builds: " + ", ".join(f"{r['code']} x{r['count']}" for r in shared))
    facts = F.concat_ws(", ", F.col("summary"), F.when(F.col("anchored"), "anchored"), F.when(F.col("confidence") == "low", "low confidence"))
    inner = F.transform(F.slice("methods", 1, 3), lambda m: F.concat(m["name"], m["descriptor"], F.lit(" | "), C.method_summary(m)))
    mark = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), F.col("origin")), F.lit("-"))
    rows = _top(changes.where(F.col("kind").isin("modified", "added", "removed")), top)
    rows = rows.select("kind", "_k", "magnitude", mark.alias("mark"), F.coalesce("source_file", "lhs", "rhs", F.lit("?")).alias("who"), facts.alias("facts"), F.coalesce(inner, F.array().cast("array<string>")).alias("inner"))
    kind = None
    for r in sorted(rows.collect(), key=lambda r: (KINDS.index(r["kind"]), r["_k"])):  # at most `top` a kind
        if r["kind"] != kind:
            kind = r["kind"]
            lines += ["", f"{kind}, greatest first (magnitude, origin, class, what)"]
        lines.append(f"{r['magnitude']:>6}  {r['mark']:<4} {r['who']}  {r['facts']}")
        lines += [f"{'':>12} {x}" for x in r["inner"]]
    return "\n".join(lines)


def components_report(changes: DataFrame) -> str:
    """Paired classes with sensitive components, one line each."""
    codes = F.filter("components", lambda c: c.isin(*C.SENSITIVE_CODES))
    named = F.array_join(F.transform(codes, lambda c: F.concat_ws("=", c, S.component_name(c))), ",")
    shared = C.sensitive_shared(changes)
    base = F.coalesce("lhs_super", "rhs_super", F.lit("?"))
    rows = shared.orderBy("components", "lhs").select(F.concat(F.lit("  ["), named, F.lit("] "), "lhs", F.lit("  <->  "), "rhs", F.lit("   (extends "), base, F.lit(")")).alias("line")).collect()
    if not rows:
        return "sensitive components: none shared across both builds"
    return "\n".join([f"sensitive components shared by both builds ({len(rows)} classes):", *(r["line"] for r in rows)])


def match_lines(matches: DataFrame, only_changed: bool = False, methods: bool = False) -> DataFrame:
    """(line) of raw matches: similarity, both sides, and the changed methods if asked for."""
    info = lambda c: F.concat(c["package"], F.lit(": "), c["name"], F.lit(" - "), F.coalesce(F.nullif(c["source_file"], F.lit("")), F.lit("<unknown>")))
    rows = matches.where((F.col("similarity") < 1.0) | F.col("lhs").isNull() | F.col("rhs").isNull()) if only_changed else matches
    head = F.when(F.col("lhs").isNull(), F.concat(F.lit("+ "), info(F.col("b")))).when(F.col("rhs").isNull(), F.concat(F.lit("- "), info(F.col("a")))).otherwise(
        F.concat(F.format_string("%.4f ", "similarity"), info(F.col("a")), F.lit(" -> "), info(F.col("b")))
    )
    if not methods:
        return rows.select(head.alias("line"))
    changed = F.filter("method_rows", lambda x: x["status"] != "matched")
    name: Column = F.transform(changed, lambda x: F.concat(F.lit("    "), x["status"], F.lit(" "), F.coalesce(F.get(F.col("a.methods"), x["l"])["name"], F.get(F.col("b.methods"), x["r"])["name"]), F.format_string(" %.4f", x["score"])))
    return rows.select(F.array_join(F.concat(F.array(head), F.coalesce(name, F.array().cast("array<string>"))), "\n").alias("line"))


def match_json(matches: DataFrame) -> DataFrame:
    return matches.select(F.to_json(F.struct("lhs", "rhs", F.col("similarity").alias("distance"), "breakdown", "method_rows")).alias("value"))


MAPPING_HEAD = "# rename map: <recovered name> -> <obfuscated name>:\n# indented lines name members; packages stay as they are\n# lines marked low-confidence were not anchored and are less alike than 0.95"


def write_mapping(entries: DataFrame, path: str) -> None:
    """A folder of text in the order of the obfuscated names; the head is a file of its own in the order."""
    spark = entries.sparkSession
    head = spark.createDataFrame([("", MAPPING_HEAD)], "obfuscated string, lines string")
    head.unionByName(mapping_lines(entries)).orderBy("obfuscated").select("lines").write.mode("overwrite").text(path)


def default_output(lhs: str, rhs: str, extension: str) -> str:
    from pathlib import PurePath

    return f"{PurePath(lhs).stem}__vs__{PurePath(rhs).stem}.diff.{extension}"
