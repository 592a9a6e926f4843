from __future__ import annotations

import random

import fixtures
import pytest
from pyspark.sql import functions as F

from kindred.operators import changes as C
from kindred.operators import family, naming
from kindred.operators.diff import diff
from kindred.schema import classes_from_rows
from kindred.sources import reports, store

PUB = {"descriptor": "(I)V", "arg_count": 1}


@pytest.fixture(scope="module")
def mutated(spark):
    lhs, rhs, kinds = fixtures.mutation()
    left, right = classes_from_rows(spark, lhs), classes_from_rows(spark, rhs)
    matches = diff(left, right).cache()
    return left, right, matches, C.change_set(matches, "com.acme.app").cache(), kinds


def test_labelled_mutation(mutated):
    _, _, _, changes, kinds = mutated
    rows = {(r["lhs"] or r["rhs"]).split("/")[-1][:-1]: r for r in changes.collect()}
    assert {k: r["kind"] for k, r in rows.items()} == kinds
    assert fixtures.TOAST in rows["C0"]["delta"]["calls_added"]
    assert fixtures.URI in rows["C1"]["delta"]["calls_removed"]
    assert rows["C2"]["delta"]["strings_added"] == ["brand_new_feature_flag"]
    assert fixtures.URI in rows["C3"]["delta"]["calls_added"]
    assert [(d["status"], d["name"]) for d in rows["C3"]["methods"]] == [("added", "added")]
    assert [(d["status"], d["name"]) for d in rows["C4"]["methods"]] == [("deleted", "helper")]
    assert rows["C4"]["summary"] == "-1 methods"
    assert rows["C5"]["match_distance"] < 1 and rows["C6"]["match_distance"] == 1.0
    assert all(r["origin"] == "app" for r in rows.values())


def test_self_diff_is_identical(spark, mutated):
    left = mutated[0]
    rows = diff(left, left, options={"propagation": False}).collect()
    assert {(r["lhs"], r["rhs"], r["similarity"]) for r in rows} == {(r["descriptor"], r["descriptor"], 1.0) for r in left.collect()}


def test_filters_and_reports(mutated, tmp_path):
    _, _, matches, changes, _ = mutated
    assert {r["kind"] for r in C.select_changes(changes, "changed").collect()} == {"modified", "added", "removed"}
    assert C.select_changes(changes, "no such mode").count() == changes.count()
    assert C.filter_class(changes, "/c3;").count() == 1
    assert C.filter_min_confidence(changes, "high").count() == changes.count()
    text = reports.text_report(changes)
    assert text.startswith("change summary: modified=5  added=1  removed=1  cosmetic=1  unchanged=1")
    import json

    doc = json.loads(reports.json_document(changes))
    assert doc["schema_version"] == 3 and len(doc["changes"]) == 9 and doc["summary"]["modified"] == 5
    assert doc["changes"][0]["kind"] == "modified" and doc["changes"][-1]["kind"] == "unchanged"
    reports.write_csv(changes, str(tmp_path / "csv"))
    reports.write_xml(changes, str(tmp_path / "xml"))
    reports.write_json(changes, str(tmp_path / "json"))
    spark = changes.sparkSession
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert back.columns == list(reports.CSV_COLUMNS) and back.count() == 9
    assert spark.read.format("xml").option("rowTag", "change").load(str(tmp_path / "xml")).count() == 9
    assert spark.read.json(str(tmp_path / "json")).count() == 9
    assert reports.match_lines(matches, True, True).count() == 5
    assert reports.match_json(matches).count() == 9


def twins(prefix: str, order: list[int]) -> list[dict]:
    body = [fixtures.method("<init>", 2), fixtures.method("get", 4)]
    return [{"descriptor": f"Lp/{prefix}{i};", "methods": body, "strings": [f"anchor-token-{i}-qwerty"], "superclass": "Ljava/lang/Object;"} for i in order]


def test_anchors_recover_a_permutation(spark):
    rows = diff(classes_from_rows(spark, twins("A", [0, 1, 2, 3])), classes_from_rows(spark, twins("B", [3, 1, 0, 2]))).collect()
    assert {(r["lhs"], r["rhs"]) for r in rows} == {(f"Lp/A{i};", f"Lp/B{i};") for i in range(4)}
    assert all(r["provenance"] == "anchored" for r in rows)


def test_common_string_anchors_nothing(spark):
    same = lambda p: [t | {"strings": ["the same everywhere"]} for t in twins(p, [0, 1, 2])]
    rows = diff(classes_from_rows(spark, same("A")), classes_from_rows(spark, same("B"))).collect()
    assert not any(r["provenance"] == "anchored" for r in rows)


def test_propagation_follows_references_and_call_sites(spark):
    base = [fixtures.method(n, 6 + i, **PUB) for i, n in enumerate(("alpha", "beta", "gamma"))]
    helper = [fixtures.method("help", 9), fixtures.method("more", 5, **PUB)]

    def build(package: str, made: str) -> list[dict]:
        child = [fixtures.method("run", 12, instantiates=[made])]
        return [
            {"descriptor": "Lapp/Child;", "methods": child, "strings": ["child-unique-string"], "superclass": f"L{package}/Base;"},
            {"descriptor": f"L{package}/Base;", "methods": base, "superclass": "Ljava/lang/Object;", "fields": [{"name": "k", "type_desc": "J"}]},
            {"descriptor": made, "methods": helper, "superclass": "Ljava/lang/Object;"},
            {"descriptor": "Lapp/Other;", "methods": [fixtures.method("other", 30, **PUB)], "strings": ["other-unique-string"], "superclass": "Ljava/lang/Object;"},
        ]

    left, right = classes_from_rows(spark, build("old", "Lone/HelperL;")), classes_from_rows(spark, build("moved", "Ltwo/HelperR;"))
    on = {(r["lhs"], r["rhs"]): r for r in diff(left, right).collect()}
    assert on["Lold/Base;", "Lmoved/Base;"]["provenance"] == "propagated"
    assert on["Lone/HelperL;", "Ltwo/HelperR;"]["breakdown"]["call_site_anchored"] == 1.0
    off = {(r["lhs"], r["rhs"]) for r in diff(left, right, options={"propagation": False}).collect()}
    assert ("Lold/Base;", None) in off and (None, "Lmoved/Base;") in off


def test_record_equals_fresh(spark, mutated, tmp_path):
    left, right, matches, _, _ = mutated
    path = str(tmp_path / "store")
    store.save(store.prepare(left.withColumn("digest", F.lit("l"))), path)
    store.save(store.prepare(right.withColumn("digest", F.lit("r"))), path)
    again = diff(store.load(spark, path, ["l"]), store.load(spark, path, ["r"]))
    key = lambda r: (r["lhs"], r["rhs"], round(r["similarity"], 12), r["provenance"])
    assert {key(r) for r in again.collect()} == {key(r) for r in matches.collect()}
    wanted = spark.createDataFrame([("l",), ("new",)], "digest string")
    assert [r["digest"] for r in store.missing(spark, path, wanted).collect()] == ["new"]
    assert store.missing(spark, str(tmp_path / "none"), wanted).count() == 2


def test_stale_layers(spark, mutated, tmp_path):
    path = str(tmp_path / "stale")
    rows = store.prepare(mutated[0].limit(3))
    store.save(rows.withColumn("digest", F.lit("old")).withColumn("signature_stamp", F.lit("x")), path)
    store.save(rows.withColumn("digest", F.lit("dead")).withColumn("extraction_stamp", F.lit("x")), path)
    with pytest.raises(store.StaleStore):
        store.load(spark, path)
    assert {r["digest"]: r["outcome"] for r in store.migrate(spark, path).collect()} == {"old": "migrated", "dead": "stale"}
    assert store.load(spark, path, ["old"]).count() == 3


def signed(spark, digest: str, seeds: list[int]):
    rows = []
    for n, s in enumerate(seeds):
        rng = random.Random(s)
        code = lambda: bytes(rng.choice([0x12, 0x32, 0x6E, 0x90, 0x1A, 0x52, 0x44, 0x01, 0x60]) for _ in range(rng.randrange(8, 30)))  # noqa: B023, E731
        methods = [{"name": f"m{i}", "bytecode": code(), "arg_count": rng.randrange(6), "return_type": rng.choice("VIJZ"), "xref_count": rng.randrange(9), "calls": [f"Landroid/x/C{s};->m{i}()V"]} for i in range(rng.randrange(2, 6))]
        fields = [{"name": f"f{i}", "type_desc": rng.choice(["I", "J", "Ljava/lang/String;", "[B", "Z"]), "access": rng.choice([1, 9])} for i in range(rng.randrange(1, 5))]
        rows.append({"digest": digest, "pos": n, "descriptor": f"Lf/K{s};", "methods": methods, "fields": fields, "strings": [f"string of class {s}", f"only in {digest} {s}"], "superclass": "Ljava/lang/Object;"})
    return store.prepare(classes_from_rows(spark, rows))


def test_family_and_containment(spark, tmp_path):
    samples = signed(spark, "a", [1, 2, 3]).unionByName(signed(spark, "b", [1, 2, 4])).unionByName(signed(spark, "c", [1, 5]))
    count = lambda k: {(r["fqcn"], r["coverage"]) for r in family.mine_family(samples, "fam", k, min_instructions=2)[0].collect()}
    assert count(None) == {("f.K1", 3)}
    assert count(2) == {("f.K1", 3), ("f.K2", 2)}
    assert {n for n, _ in count(1)} == {f"f.K{i}" for i in range(1, 6)}
    entries, meta = family.mine_family(samples, "fam", 2, min_instructions=2)
    strings = {r["fqcn"]: r["strings"] for r in entries.collect()}
    assert strings["f.K1"] == ["string of class 1"]
    with pytest.raises(ValueError):
        family.mine_family(samples, "fam", 9)
    store.save_pack(entries, meta, str(tmp_path / "packs/fam"))
    entries, meta = store.load_pack(spark, str(tmp_path / "packs/fam"))
    assert [r["family"] for r in store.list_packs(spark, str(tmp_path / "packs")).collect()] == ["fam"]
    scores, hits = family.match_family(signed(spark, "cand", [2, 9]), entries, meta, min_instructions=2)
    row = scores.first()
    assert row["present"] == 1 and row["total"] == 2 and 0 < row["score"] < 1 and row["tier_1"] == 1
    assert {(r["fqcn"], r["tier"], r["distance"]) for r in hits.collect()} == {("f.K2", 1, 0)}
    near = family.nearest_entries(signed(spark, "cand", [2, 9]), entries, 0).collect()
    assert {(r["descriptor"], r["distance"]) for r in near} == {("Lf/K2;", 0), ("Lf/K9;", None)}
    fam = signed(spark, "a", [1, 2, 3])
    assert family.containment(fam, fam)[0].first()["score"] == 1.0
    part = family.containment(fam, signed(spark, "z", [1, 2]))[0].first()
    assert part["present"] == 2 and 0 < part["score"] < 1
    assert family.containment(fam.limit(0), fam)[0].first()["score"] == 0.0
    holders = {r["descriptor"]: r["inputs"] for r in family.holders(samples).collect()}
    assert holders["Lf/K2;"] == ["a", "b"]


def test_labels_need_five_classes(spark):
    hits = spark.createDataFrame([(f"L{i};", "g:a", "g:a@1") for i in range(6)] + [("Lx;", "g:b", "g:b@1"), ("Ly;", "g:b", "g:b@1")], "descriptor string, coord string, label string")
    labels = family.labels_having(hits)
    assert {r["label"] for r in labels.collect()} == {"g:a@1"} and labels.count() == 6
    assert tuple(family.label_summary(labels).first()) == (6, 1)


def test_components(spark):
    rows = [{"descriptor": "La/S;", "superclass": "Lb/B;"}, {"descriptor": "Lb/B;", "superclass": "Landroid/app/Service;"}, {"descriptor": "La/C;", "superclass": "La/C;"}, {"descriptor": "La/N;", "interfaces": ["Landroid/app/Application;"]}]
    labels = C.component_labels(classes_from_rows(spark, rows))
    assert {r["descriptor"]: r["codes"] for r in labels.collect()} == {"La/S;": ["SVC"], "Lb/B;": ["SVC"], "La/N;": ["APP"]}
    assert C.merge_labels(labels, labels).count() == 3


def test_mapping(spark, tmp_path):
    body = [fixtures.method("onCreate", 6), fixtures.method("build", 9, **PUB)]
    clear = [{"descriptor": "Lcom/acme/Holder;", "source_file": "Holder.java", "methods": body, "strings": ["unique-holder-string"], "fields": [{"name": "count", "type_desc": "I"}]}]
    dark = [{"descriptor": "Lcom/acme/q;", "methods": [m | {"name": n} for m, n in zip(body, "ab")], "strings": ["unique-holder-string"], "fields": [{"name": "a", "type_desc": "I"}]}]
    filler = lambda: [{"descriptor": f"Lcom/acme/Filler{i};", "methods": [fixtures.method("x" * (i + 1), 20 + 3 * i)], "strings": [f"filler string {i}"]} for i in range(2)]
    entries = naming.build_mapping(diff(classes_from_rows(spark, clear + filler()), classes_from_rows(spark, dark + filler())))
    row = entries.first()
    assert entries.count() == 1 and (row["original"], row["obfuscated"]) == ("com.acme.Holder", "com.acme.q")
    reports.write_mapping(entries, str(tmp_path / "map"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "map")).collect())
    assert "com.acme.Holder -> com.acme.q:" in text and "    int count -> a" in text and "    void build(int) -> b" in text
