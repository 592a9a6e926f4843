"""From matches to typed, ranked changes, and the filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.operators.anchors import framework_calls
from kindred.operators.graph import marks_above
from kindred.plans.lineage import kept, sent
from kindred.schema import SENSITIVE_COMPONENTS, GENERIC_COMPONENTS

KIND_RANK = {"modified": 0, "added": 1, "removed": 2, "cosmetic": 3, "unchanged": 4}
ORIGIN_RANK = {"app": 0, "unknown": 1, "library": 2}
SENSITIVE_CODES = tuple(code for code, _ in SENSITIVE_COMPONENTS.values())
SELECT = {"changed": ("modified", "added", "removed"), "unchanged": ("unchanged", "cosmetic")}
_STRINGS = "array<string>"


def rank(column: Column, order: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, n in order.items():
        out = F.when(column == name, n).otherwise(out)
    return out


def type_refs(c: Column) -> Column:
    """Distinct types a class refers to, itself not among them."""
    one = F.when(F.coalesce(c["superclass"], F.lit("")) != "", F.array(c["superclass"])).otherwise(F.array().cast(_STRINGS))
    typed = F.flatten(F.transform(c["fields"], lambda f: S.object_types(f["type_desc"])))
    proto = F.flatten(F.transform(c["methods"], lambda m: S.object_types(m["descriptor"])))
    return F.array_except(F.array_distinct(F.concat(one, c["interfaces"], typed, proto)), F.array(c["descriptor"]))


def features(c: Column) -> Column:
    """struct<calls, strings, types, app_types>: the sets that a change is judged by."""
    return S.let(type_refs(c), lambda refs: F.struct(
        F.array_distinct(framework_calls(c["methods"])).alias("calls"),
        F.filter(F.array_distinct(c["strings"]), S.informative).alias("strings"),
        F.filter(refs, S.is_framework).alias("types"),
        F.filter(refs, lambda t: ~S.is_framework(t)).alias("app_types"),
    ))


def _two_way(a: Column, b: Column) -> tuple[Column, Column]:
    less = lambda x, y: F.when(x == y, F.array().cast(_STRINGS)).otherwise(F.array_sort(F.array_except(x, y)))
    return less(b, a), less(a, b)


def method_deltas(rows: Column, a: Column, b: Column) -> Column:
    """Added and deleted methods, and modified ones whose framework calls moved; the weightiest first."""
    kind = "struct<status:string,name:string,descriptor:string,instr_count:int,calls_added:array<string>,calls_removed:array<string>>"
    calls = lambda m: F.array_sort(F.array_distinct(F.filter(m["calls"], S.is_framework)))
    none = F.array().cast(_STRINGS)

    def entry(x: Column) -> Column:
        left, right = F.get(a, x["l"]), F.get(b, x["r"])
        shown = F.when(x["status"] == "deleted", left).otherwise(right)
        sides = F.struct(F.when(left.isNull(), none).otherwise(calls(left)).alias("a"), F.when(right.isNull(), none).otherwise(calls(right)).alias("b"))

        def told(p: Column) -> Column:
            more, less = _two_way(p["a"], p["b"])
            return F.struct(x["status"].alias("status"), shown["name"].alias("name"), shown["descriptor"].alias("descriptor"), shown["instr_count"].alias("instr_count"), more.alias("calls_added"), less.alias("calls_removed")).cast(kind)

        return S.let(sides, told)

    moved = F.filter(F.transform(F.filter(rows, lambda x: x["status"] != "matched"), entry), lambda d: (d["status"] != "modified") | (F.size(d["calls_added"]) + F.size(d["calls_removed"]) > 0))
    status = lambda d: rank(d["status"], {"modified": 0, "added": 1, "deleted": 2}, 9)
    keyed = F.transform(moved, lambda d, i: F.struct(status(d).alias("k"), (-F.size(d["calls_added"]) - F.size(d["calls_removed"])).alias("c"), (-d["instr_count"]).alias("n"), d["name"].alias("name"), i.alias("i"), d.alias("d")))
    return F.transform(F.array_sort(keyed), lambda x: x["d"])


def class_map(matches: DataFrame) -> DataFrame:
    return matches.where("lhs is not null and rhs is not null").select(F.col("lhs").alias("from"), F.col("rhs").alias("to"))


#: Pairs with references among the matched classes that are sent to every task, some 500 bytes each.
MOST_REFERRING = 50_000


def _app_types(pairs: DataFrame) -> DataFrame:
    """(lhs, rhs, app_added, app_removed): of pairs (lhs, rhs, was, now) with their app types those that changed, the left ones renamed by the matches; what has no match is left out.

    The names that are referred to are told first: where they are few, no pair is shuffled to find its own.
    """
    names = class_map(pairs)
    refs = lambda side, name: pairs.select("lhs", "rhs", F.explode(side).alias(name))
    asked = lambda side, name: refs(side, name).select(name).distinct()
    left = refs("was", "from").join(sent(names.join(asked("was", "from"), "from", "left_semi")), "from").groupBy("lhs", "rhs").agg(F.collect_set("to").alias("was"))
    right = refs("now", "to").join(sent(names.select("to").join(asked("now", "to"), "to", "left_semi").distinct()), "to").groupBy("lhs", "rhs").agg(F.collect_set("to").alias("now"))
    both = left.join(right, ["lhs", "rhs"], "full")
    more, less = _two_way(F.coalesce("was", F.array().cast(_STRINGS)), F.coalesce("now", F.array().cast(_STRINGS)))
    return sent(both.select("lhs", "rhs", more.alias("app_types_added"), less.alias("app_types_removed")), MOST_REFERRING)


DELTA = ("calls_added", "calls_removed", "strings_added", "strings_removed", "types_added", "types_removed", "app_types_added", "app_types_removed")


def change_set(matches: DataFrame, dev_package=None, components: DataFrame | None = None, libraries: DataFrame | None = None) -> DataFrame:
    """One ranked change per match.

    components: (side 'lhs'/'rhs' or null for both, descriptor, codes); libraries: (side, descriptor, label).
    """
    prefixes = S.dev_prefixes(dev_package)
    m = matches.withColumn("paired", F.col("lhs").isNotNull() & F.col("rhs").isNotNull())
    none, shown = F.array().cast(_STRINGS), F.when(F.col("lhs").isNotNull(), F.col("a")).otherwise(F.col("b"))
    where = S.origin(shown["descriptor"], shown["source_file"], prefixes)
    source = F.coalesce(F.nullif(F.col("a.source_file"), F.lit("")), F.col("b.source_file"))
    # what the classes tell is taken before the joins, so that no class is shuffled
    m = m.withColumn("fa", F.when(F.col("paired"), features(F.col("a")))).withColumn("fb", F.when(F.col("paired"), features(F.col("b"))))
    cols = []
    for name in ("calls", "strings", "types"):
        more, less = _two_way(F.col(f"fa.{name}"), F.col(f"fb.{name}"))
        cols += [more.alias(f"{name}_added"), less.alias(f"{name}_removed")]
    m = m.select(
        "lhs", "rhs", "paired", "similarity", "provenance", F.struct(*cols).alias("_own"), where.alias("_where"), source.alias("source_file"), S.total_instructions(shown["methods"]).alias("_instructions"),
        F.when(F.col("paired"), method_deltas(F.col("method_rows"), F.col("a.methods"), F.col("b.methods"))).alias("methods"),
        F.col("a.superclass").alias("lhs_super"), F.col("b.superclass").alias("rhs_super"), F.coalesce(F.col("a.interfaces"), none).alias("lhs_interfaces"), F.coalesce(F.col("b.interfaces"), none).alias("rhs_interfaces"),
        F.col("fa.app_types").alias("_was"), F.col("fb.app_types").alias("_now"),
    )
    # the classes are looked at once; references are told of what is kept
    m = kept(m)
    m = m.drop("_was", "_now").join(_app_types(m.where("paired").select("lhs", "rhs", F.col("_was").alias("was"), F.col("_now").alias("now"))), ["lhs", "rhs"], "left")
    whole = F.struct(*[F.col(f"_own.{c}").alias(c) for c in DELTA[:6]], *[F.coalesce(c, none).alias(c) for c in DELTA[6:]])
    m = m.withColumn("delta", F.when(F.col("paired"), whole)).drop("_own", *DELTA[6:])
    for side in ("lhs", "rhs"):
        if components is not None:
            own = components.where(F.col("side").isNull() | (F.col("side") == side)).select(F.col("descriptor").alias(side), F.col("codes").alias(f"{side}_components"))
            m = m.join(own, side, "left")
        else:
            m = m.withColumn(f"{side}_components", F.lit(None).cast(_STRINGS))
        if libraries is not None:
            own = libraries.where(F.col("side").isNull() | (F.col("side") == side)).select(F.col("descriptor").alias(side), F.col("label").alias(f"_{side}_label"))
            m = m.join(own, side, "left")
        else:
            m = m.withColumn(f"_{side}_label", F.lit(None).cast("string"))
        m = m.withColumn(f"{side}_components", F.coalesce(f"{side}_components", none))
    library, where = F.coalesce("_lhs_label", "_rhs_label"), F.col("_where")
    m = m.withColumn("library", library).withColumn("origin", F.when(library.isNotNull() & (where != "app"), "library").otherwise(where))
    structural = F.coalesce(F.size(F.filter("methods", lambda d: d["status"].isin("added", "deleted"))), F.lit(0))
    sizes = {c: F.coalesce(F.size(F.col(f"delta.{c}")), F.lit(0)) for c in DELTA}
    total = sum(sizes.values(), F.lit(0))
    content = sum((v for k, v in sizes.items() if not k.startswith("calls")), F.lit(0))
    m = m.withColumn("_total", total).withColumn("_content", content).withColumn("_structural", structural)
    changed = F.col("_total") + F.col("_structural") > 0
    kind = F.when(F.col("lhs").isNull(), "added").when(F.col("rhs").isNull(), "removed").when(changed, "modified").when(F.col("similarity") >= 1.0 - 1e-9, "unchanged").otherwise("cosmetic")
    m = m.withColumn("kind", kind)
    modified = F.col("kind") == "modified"
    low = modified & (F.col("_content") == 0) & (F.col("_structural") == 0) & (F.col("origin") != "app")
    magnitude = F.when(F.col("paired"), F.when(modified, F.col("_total") + F.col("_structural")).otherwise(0)).otherwise(F.col("_instructions"))
    out = m.select(
        "kind", "lhs", "rhs", "source_file", magnitude.cast("int").alias("magnitude"), F.col("similarity").alias("match_distance"),
        (F.col("provenance") == "anchored").alias("anchored"), "origin", "library", F.when(low, "low").otherwise("high").alias("confidence"),
        "lhs_super", "rhs_super", "lhs_interfaces", "rhs_interfaces",
        F.array_sort(F.array_union("lhs_components", "rhs_components")).alias("components"), "lhs_components", "rhs_components",
        F.when(modified, F.col("delta")).alias("delta"), F.when(modified, F.col("methods")).alias("methods"),
    )
    return out.withColumn("summary", change_summary())


def method_summary(d: Column) -> Column:
    parts = F.concat_ws(", ", F.when(F.size(d["calls_added"]) > 0, F.concat(F.lit("+"), F.size(d["calls_added"]).cast("string"), F.lit(" calls"))), F.when(F.size(d["calls_removed"]) > 0, F.concat(F.lit("-"), F.size(d["calls_removed"]).cast("string"), F.lit(" calls"))))
    whole = lambda verb: F.concat(F.lit(f"{verb} method ("), d["instr_count"].cast("string"), F.lit(" instr)"))
    return F.when(d["status"] == "added", whole("added")).when(d["status"] == "deleted", whole("removed")).otherwise(F.concat(F.lit("method "), F.when(parts == "", "body changed").otherwise(parts)))


def delta_summary(delta: Column) -> Column:
    parts = []
    for name, label in (("calls", "calls"), ("strings", "strings"), ("types", "types"), ("app_types", "app-types")):
        for sign, way in (("+", "added"), ("-", "removed")):
            n = F.size(delta[f"{name}_{way}"])
            parts.append(F.when(n > 0, F.concat(F.lit(sign), n.cast("string"), F.lit(f" {label}"))))
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", "no semantic change").otherwise(text)


def change_summary() -> Column:
    """A few words on a change row."""
    count = lambda status: F.size(F.filter("methods", lambda d: d["status"] == status))
    semantic = sum((F.size(F.col(f"delta.{c}")) for c in DELTA), F.lit(0)) > 0
    parts = F.concat_ws(
        ", ",
        F.when(semantic, delta_summary(F.col("delta"))),
        F.when(count("added") > 0, F.concat(F.lit("+"), count("added").cast("string"), F.lit(" methods"))),
        F.when(count("deleted") > 0, F.concat(F.lit("-"), count("deleted").cast("string"), F.lit(" methods"))),
    )
    return (
        F.when(F.col("kind") == "modified", F.when(parts == "", "structure changed").otherwise(parts))
        .when(F.col("kind").isin("added", "removed"), F.concat(F.col("magnitude").cast("string"), F.lit(" instructions")))
        .when(F.col("kind") == "cosmetic", "body changed")
        .otherwise("")
    )


def report_order() -> list[Column]:
    return [
        rank(F.col("kind"), KIND_RANK, 9), rank(F.col("origin"), ORIGIN_RANK, 1), F.when(F.col("confidence") == "high", 0).otherwise(1),
        F.desc("magnitude"), F.coalesce("source_file", F.lit("")), F.coalesce("lhs", "rhs", F.lit("")),
    ]


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind").count()


def select_changes(changes: DataFrame, mode: str) -> DataFrame:
    return changes.where(F.col("kind").isin(*SELECT[mode])) if mode in SELECT else changes


def filter_class(changes: DataFrame, needle: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("lhs", "rhs", "source_file")]))
    return changes.where(F.contains(hay, F.lit(needle.lower())))


def filter_min_confidence(changes: DataFrame, floor: str) -> DataFrame:
    return changes.where("confidence = 'high'") if floor == "high" else changes


def sensitive_shared(changes: DataFrame) -> DataFrame:
    """Paired classes with a sensitive component on either side."""
    return changes.where(F.col("lhs").isNotNull() & F.col("rhs").isNotNull() & F.arrays_overlap("components", F.array(*map(F.lit, SENSITIVE_CODES))))


def split_matches(matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paired, deleted and added rows."""
    return matches.where("lhs is not null and rhs is not null"), matches.where("rhs is null"), matches.where("lhs is null")


def component_labels(classes: DataFrame, side: str | None = None) -> DataFrame:
    """(side, descriptor, codes): component codes by the superclass chain and the direct interfaces.

    The chain is followed to any depth by pointers that double; cycles end.
    """
    spark = classes.sparkSession
    table = {**SENSITIVE_COMPONENTS, **GENERIC_COMPONENTS}
    names = sorted({c for c, _ in table.values()})
    codes = spark.createDataFrame([(d, 1 << names.index(c)) for d, (c, _) in table.items()], "node string, mark long")
    # of classes that bear one name the first superclass by name counts for those below
    above = classes.where("superclass is not null and superclass <> ''")
    parents = above.groupBy("descriptor").agg(F.min("superclass").alias("parent")).withColumnRenamed("descriptor", "node")
    higher = marks_above(parents, codes)
    own = above.select("descriptor", F.col("superclass").alias("node")).unionByName(classes.select("descriptor", F.explode("interfaces").alias("node")))
    found = own.join(F.broadcast(codes), "node").select("descriptor", "mark").unionByName(above.select("descriptor", F.col("superclass").alias("node")).join(higher, "node").select("descriptor", "mark"))
    found = found.groupBy("descriptor").agg(F.bit_or("mark").alias("mark"))
    told = F.filter(F.array(*[F.when(F.col("mark").bitwiseAND(1 << i) != 0, F.lit(c)) for i, c in enumerate(names)]), lambda c: c.isNotNull())
    return found.select(F.lit(side).cast("string").alias("side"), "descriptor", told.alias("codes"))


def merge_labels(*labels: DataFrame) -> DataFrame:
    """Label tables as one, by descriptor alone."""
    out = labels[0]
    for x in labels[1:]:
        out = out.unionByName(x)
    return out.select("descriptor", F.explode("codes").alias("code")).groupBy("descriptor").agg(F.array_sort(F.collect_set("code")).alias("codes")).select(F.lit(None).cast("string").alias("side"), "descriptor", "codes")
