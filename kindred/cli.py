"""Command line: diff (or compare), prepare, score, migrate, family build, family match, grade, serve.

    python -m kindred diff A B [options]
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from kindred.operators import changes as C
from kindred.operators import family, grade, naming
from kindred.operators.diff import diff, in_scope
from kindred.schema import BUILD_RADIUS, MATCH_RADIUS, MIN_MINED_INSTRUCTIONS, DiffOptions
from kindred.session import local_session, ship
from kindred.sources import dex, inputs, manifest, normalize, reports, store
from kindred.streaming import serve


DEFAULTS = DiffOptions()

#: Options in groups that commands share: flags, a help text, and what else argparse needs to know.
GROUPS = {
    "what is compared": (
        ("-p --package", "only this package and what is below it", {}),
        ("-A --auto-package", "take the package from a manifest: of the file given, else of the left input", {"nargs": "?", "const": "", "metavar": "FILE"}),
        ("--min-instr", "least instructions of a class", {"type": int, "default": DEFAULTS.min_inst_size_threshold}),
        ("--keep-boilerplate", "compare generated comparators too", {"dest": "skip_boilerplate", "action": "store_false"}),
        ("--no-skip-synthetic", "compare synthetic classes too", {"dest": "skip_synthetic", "action": "store_false"}),
        ("--skip-synthetic", "leave synthetic classes out (as it is)", {"action": "store_true", "default": True}),
        ("--skip-inner", "leave inner classes out", {"action": "store_true"}),
        ("--skip-external", "leave classes without code out", {"action": "store_true"}),
    ),
    "how it is matched": (
        ("--assignment", "solver of a pool", {"choices": ("auto", "greedy", "hungarian"), "default": DEFAULTS.assignment}),
        ("-k --neighbors", "candidates of a class", {"type": int, "default": DEFAULTS.top_match_threshold}),
        ("-n --buckets", "tables of the index", {"type": int, "default": DEFAULTS.buckets}),
        ("-t --threshold", "least similarity of a pair", {"type": float, "default": 0.8}),
        ("--no-anchors", "do not pair by rare tokens first", {"dest": "anchoring", "action": "store_false"}),
        ("--no-cluster", "one pool for all packages", {"action": "store_true"}),
        ("--no-propagation", "do not spread pairs along references", {"dest": "propagation", "action": "store_false"}),
        ("--find-obfuscated", "one pool for packages with obfuscated names", {"action": "store_true"}),
    ),
    "what is told": (
        ("--app-package", "a package of the app's own; may be given again", {"action": "append"}),
        ("-c --class", "only classes whose name or file holds this", {"dest": "klass"}),
        ("--min-confidence", "least confidence of a change", {"choices": ("low", "high"), "default": "low"}),
        ("-s --select", "which kinds", {"choices": ("all", "changed", "unchanged"), "default": "all"}),
        ("-m --matches", "raw matches instead of changes", {"action": "store_true"}),
    ),
    "where it goes": (
        ("-f --format", "of the report", {"choices": ("csv", "json", "xml"), "default": "json"}),
        ("-o --output", "the report's folder", {}),
        ("--no-file", "write no report", {"action": "store_true"}),
        ("--components-file", "a file for the components' list", {}),
        ("--deobfuscation-map", "a folder for the rename map", {}),
        ("--map-min-confidence", "least similarity of a name in the map", {"type": float, "default": 0.8}),
    ),
    "libraries": (
        ("--libsigs", "a pack that names libraries' classes (else $KINDRED_PACK)", {"metavar": "PACK"}),
        ("--no-libsigs", "label no libraries", {"action": "store_true"}),
    ),
    "archives": (("--normalize", "run the external normaliser on archives first", {"action": "store_true"}),),
    "accepted, without effect here": (("-j --jobs", "Spark decides", {"type": int}), ("--progress", "see Spark's own", {"action": "store_true"})),
    "store": (("-o --output", "the store's folder", {"required": True}), ("--digest", "a name for the sample", {})),
    "containment": (
        ("-R --radius", "bits that signatures may differ in", {"type": int, "default": MATCH_RADIUS}),
        ("--keep-library", "count classes of libraries too", {"dest": "drop_library", "action": "store_false"}),
        ("--min-shared-calls", "framework calls that a pair must share", {"type": int, "default": 0}),
    ),
    "mining": (
        ("-o --output", "the pack's folder", {"required": True}),
        ("--name", "of the pack", {}),
        ("-k", "samples that must share a class; all by default", {"type": int}),
        ("--radius", "bits within a cluster", {"type": int, "default": BUILD_RADIUS}),
        ("--min-instr", "least instructions of a class", {"type": int, "default": MIN_MINED_INSTRUCTIONS}),
    ),
    "matching a pack": (
        ("-R --radius", "bits; the pack's own by default", {"type": int}),
        ("--min-instr", "least instructions of a class", {"type": int, "default": MIN_MINED_INSTRUCTIONS}),
        ("--no-strings", "no matching by strings", {"action": "store_true"}),
        ("--threshold", "exit code 1 if no pack scores as much", {"type": float}),
    ),
    "evidence": (("--evidence", "rows of evidence to show", {"type": int, "default": 0}), ("--json", "one JSON line", {"action": "store_true"})),
    "as json": (("--json", "one JSON line", {"action": "store_true"}),),
    "truth": (
        ("--mapping", "rename map of the right build, or of both with --mapping-lhs", {"required": True}),
        ("--mapping-lhs", "rename map of the left build", {}),
        ("-p --package", "only this package", {}),
    ),
    "cache": (("--cache", "a store that keeps parsed inputs", {}),),
}
#: Of each command: what it is for, its arguments, and its groups of options.
COMMANDS = {
    "diff": ("ranked changes from one build to another", ("lhs", "rhs"), ("what is compared", "how it is matched", "what is told", "where it goes", "libraries", "archives", "accepted, without effect here")),
    "prepare": ("store the fingerprints of a sample", ("sample",), ("store", "archives", "accepted, without effect here")),
    "score": ("how much of a family's classes a candidate has (experimental)", ("family", "candidate"), ("containment", "libraries", "evidence")),
    "migrate": ("make stale signatures of stores anew", ("paths+",), ()),
    "family build": ("mine a pack of what samples share", ("samples+",), ("mining", "libraries", "archives", "as json", "accepted, without effect here")),
    "family match": ("which entries of packs a candidate has", ("packs+", "candidate"), ("matching a pack", "evidence")),
    "grade": ("precision and recall of a diff against rename maps", ("lhs", "rhs"), ("truth",)),
    "serve": ("answer JSON lines from standard input", (), ("cache",)),
}


def _parser() -> argparse.ArgumentParser:
    """The parser that COMMANDS and GROUPS declare."""
    top = argparse.ArgumentParser(prog="kindred", description="Compares builds of applications, class by class.")
    top.add_argument("--master", default=None, help="Spark master; a local session by default")
    levels = {"": top.add_subparsers(dest="command", required=True)}
    for command, (purpose, arguments, groups) in COMMANDS.items():
        above, _, name = command.rpartition(" ")
        if above not in levels:
            levels[above] = levels[""].add_parser(above, help="packs of families").add_subparsers(dest="action", required=True)
        own = levels[above].add_parser(name, help=purpose, aliases=["compare"] if name == "diff" else [])
        for argument in arguments:
            own.add_argument(argument.rstrip("+"), **({"nargs": "+"} if argument.endswith("+") else {}))
        for title in groups:
            group = own.add_argument_group(title)
            for flags, text, more in GROUPS[title]:
                group.add_argument(*flags.split(), help=text, **more)
    return top


def _labels(spark, a, classes):
    """Library labels (descriptor, label) of classes by the pack that is named, null without one."""
    path = None if a.no_libsigs else store.find_pack(a.libsigs)
    if path is None:
        return None
    entries, _ = store.load_pack(spark, path)
    if not {"coord", "ranges"} <= set(entries.columns):
        raise dex.LoadError(f"{path} names no libraries: its entries have no coord and ranges")
    return family.label_libraries(classes, entries, entries.select("pack", "entry_id", "coord", "ranges"))


def _suggested(spark, a) -> str | None:
    """The package that a manifest suggests: of the file given, or of the left input."""
    found = manifest.with_manifest(store.files(spark, [a.auto_package or a.lhs]).select("path", "content")).where("prefix is not null and prefix <> ''").first()
    if found is None:
        print("no package is suggested; everything is compared", file=sys.stderr)
    return found["prefix"] if found else None


def _source(spark, path: str, normalized: bool) -> str:
    """The path; or where its normalised archive is: the tool writes on the driver, executors read it from the shared folder."""
    if not normalized:
        return path
    import tempfile
    import uuid

    from pyarrow import fs

    from kindred.plans.lineage import shared_dir

    made = normalize.normalize(path, tempfile.mkdtemp(prefix="kindred-normalized-"))
    where = f"{shared_dir(spark)}/normalized-{uuid.uuid4().hex}"
    files, folder = fs.FileSystem.from_uri(where)
    files.create_dir(folder, recursive=True)
    fs.copy_files(str(made), f"{folder}/{made.name}", destination_filesystem=files)
    return f"{where}/{made.name}"


def _diff(spark, a) -> int:
    one, facts = inputs.load(spark, _source(spark, a.lhs, a.normalize))
    two, _ = inputs.load(spark, _source(spark, a.rhs, a.normalize))
    package = a.package or (_suggested(spark, a) if a.auto_package is not None else None)
    opts = DiffOptions(
        inner_skipping=a.skip_inner, external_skipping=a.skip_external, synthetic_skipping=a.skip_synthetic, skip_boilerplate=a.skip_boilerplate, find_obfuscated_packages=a.find_obfuscated,
        min_inst_size_threshold=a.min_instr, top_match_threshold=a.neighbors, buckets=a.buckets, cluster=not a.no_cluster, anchoring=a.anchoring, propagation=a.propagation, assignment=a.assignment,
    )
    matches = diff(in_scope(one, package), in_scope(two, package), a.threshold, opts)
    if a.matches:
        for r in reports.match_lines(matches, a.select == "changed", True).toLocalIterator():
            print(r["line"])
        return 0
    labels = C.component_labels(one, "lhs").unionByName(C.component_labels(two, "rhs"))
    sided = [x.select(F.lit(side).alias("side"), "descriptor", "label") for side, x in (("lhs", _labels(spark, a, one)), ("rhs", _labels(spark, a, two))) if x is not None]
    found = C.change_set(matches, a.app_package or package, labels, sided[0].unionByName(sided[1]) if sided else None)
    found = C.filter_min_confidence(found, a.min_confidence)
    found = C.select_changes(C.filter_class(found, a.klass) if a.klass else found, a.select).cache()
    print(reports.text_report(found))
    if not a.no_file:
        out = a.output or reports.default_output(a.lhs, a.rhs, a.format)
        {"json": reports.write_json, "csv": reports.write_csv, "xml": reports.write_xml}[a.format](found, out)
        print(f"written: {out}")
    text = reports.components_report(found)
    print(text)
    if a.components_file:
        Path(a.components_file).write_text(text + "\n")
    if a.deobfuscation_map:
        reports.write_mapping(naming.build_mapping(matches, a.map_min_confidence), a.deobfuscation_map)
    return 0


def _prepare(spark, a) -> int:
    rows, facts = inputs.load(spark, _source(spark, a.sample, a.normalize), a.digest)
    store.save(rows, a.output, "overwrite")
    print(json.dumps({"store": a.output, **facts, "classes": rows.count()}))
    return 0


def _score(spark, a) -> int:
    one, _ = inputs.load(spark, a.family)
    two, _ = inputs.load(spark, a.candidate)
    score, evidence = family.containment(one, two, a.radius, a.drop_library, a.min_shared_calls, _labels(spark, a, one))
    row = score.first().asDict()
    rows = [r.asDict() for r in evidence.orderBy("distance", "descriptor").limit(a.evidence).collect()]
    print("score is experimental", file=sys.stderr)
    print(json.dumps(row | {"evidence": rows}) if a.json else f"{row['score']:.4f}  ({row['present']} of {row['total']} classes)" + "".join(f"\n  {r['distance']:3d}  {r['descriptor']}  {r['candidate']}" for r in rows))
    return 0


def _migrate(spark, a) -> int:
    failed = 0
    for path in a.paths:
        try:
            rows = store.migrate(spark, path).groupBy("outcome").count().collect()
        except Exception as e:  # noqa: BLE001  the other stores go on
            print(f"{path}: {str(e).splitlines()[0]}")
            failed += 1
            continue
        print(f"{path}: " + ", ".join(f"{r['outcome']} {r['count']}" for r in rows))
        failed += any(r["outcome"] == "stale" for r in rows)
    return int(failed > 0)


def _family_build(spark, a) -> int:
    rows, seen = None, {}
    for path in a.samples:
        one, facts = inputs.load(spark, _source(spark, path, a.normalize))
        if facts["digest"] in seen:
            print(f"{path} is the same sample as {seen[facts['digest']]}; left out", file=sys.stderr)
            continue
        seen[facts["digest"]] = path
        own = one.select("digest", "pos", "descriptor", "package", "name", "source_file", "interfaces", "strings", "methods", "sig")
        rows = own if rows is None else rows.unionByName(own)
    if a.k is not None and 2 * a.k <= len(seen):
        print(f"k = {a.k} is no majority of {len(seen)} samples", file=sys.stderr)
    entries, meta = family.mine_family(rows, a.name or Path(a.output).name, a.k, a.radius, a.min_instr, _labels(spark, a, rows))
    store.save_pack(entries, meta, a.output)
    n = store.load_pack(spark, a.output)[0].count()
    print(json.dumps({"pack": a.output, "samples": len(seen), "entries": n}) if a.json else f"{a.output}: {n} entries of {len(seen)} samples")
    return 0


def _family_match(spark, a) -> int:
    classes, _ = inputs.load(spark, a.candidate)
    out = []
    for folder in a.packs:
        paths = [folder] if (Path(folder) / "meta").exists() else sorted(str(p.parent) for p in Path(folder).glob("*/meta"))
        for path in paths:
            try:
                entries, meta = store.load_pack(spark, path)
            except store.StaleStore as e:
                print(e, file=sys.stderr)
                continue
            scores, hits = family.match_family(classes, entries, meta, a.radius, not a.no_strings, a.min_instr)
            evidence = [r.asDict() for r in hits.orderBy("tier", "distance", "fqcn", "entry_id").limit(a.evidence).collect()]
            out.append((scores.first() or {"score": 0.0}).asDict() | {"path": path, "evidence": evidence})
    out.sort(key=lambda r: -r["score"])
    for r in out:
        print(json.dumps(r) if a.json else f"{r['score']:.4f}  {r['family']}  {r['present']} of {r['total']}  tiers {r['tier_1']}/{r['tier_2']}/{r['tier_3']}")
    return int(a.threshold is not None and not any(r["score"] >= a.threshold for r in out))


def _grade(spark, a) -> int:
    one, _ = inputs.load(spark, a.lhs)
    two, _ = inputs.load(spark, a.rhs)
    lines = lambda p: spark.createDataFrame(list(enumerate(Path(p).read_text().splitlines())), "n int, value string")  # noqa: E731  one mapping file
    right = grade.parse_mapping(lines(a.mapping))
    left = grade.parse_mapping(lines(a.mapping_lhs)) if a.mapping_lhs else right.select("original", F.col("original").alias("obfuscated"))
    truth = grade.cross_version_truth(left, right, a.package)
    dotted = lambda c: F.regexp_replace(F.regexp_replace(c, "^L|;$", ""), "/", ".")
    found = diff(one, two).where("lhs is not null and rhs is not null").select(dotted("lhs").alias("lhs"), dotted("rhs").alias("rhs"))
    print(json.dumps(grade.score_matches(found, truth).first().asDict()))
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    a = _parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master(a.master).getOrCreate() if a.master else local_session()
    ship(spark)
    commands = {"diff": _diff, "compare": _diff, "prepare": _prepare, "score": _score, "migrate": _migrate, "grade": _grade}
    try:
        if a.command == "family":
            return (_family_build if a.action == "build" else _family_match)(spark, a)
        if a.command == "serve":
            return serve.run(serve.Session(spark, a.cache))
        return commands[a.command](spark, a)
    except (dex.LoadError, normalize.NormalizerUnavailable, normalize.NormalizerFailed) as e:
        print(f"kindred: {e}", file=sys.stderr)
        return 2
