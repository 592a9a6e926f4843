"""Reports and filters on small tables of changes and matches."""

from __future__ import annotations

import json

from kindred.operators import changes as C
from kindred.operators.diff import quality_filter
from kindred.schema import DiffOptions, classes_from_rows
from kindred.sources import reports

PAIRS = "lhs string, rhs string, lhs_super string, rhs_super string, components array<string>"


def pairs(spark):
    rows = [("La;", "Lx;", "Landroid/app/Service;", None, ["BNL", "SVC"]), ("Lb;", "Ly;", None, None, ["SMS"]), ("Lc;", None, None, None, ["BNL"]), ("Ld;", "Lz;", None, None, ["SVC"]), ("Le;", "Lw;", None, None, [])]
    return spark.createDataFrame(rows, PAIRS)


def test_sensitive_components(spark):
    """Only paired classes with a sensitive code; generic codes and one-sided classes stay out."""
    assert {r["lhs"] for r in C.sensitive_shared(pairs(spark)).collect()} == {"La;", "Lb;"}
    text = reports.components_report(pairs(spark)).split("\n")
    assert text[0].endswith("(2 classes):") and len(text) == 3
    assert text[1] == "  [BNL=BindNotificationListener] La;  <->  Lx;   (extends Landroid/app/Service;)"
    assert text[2] == "  [SMS=SmsHandling] Lb;  <->  Ly;   (extends ?)"
    assert reports.components_report(pairs(spark).where("size(components) = 0")).endswith("none shared across both builds")


def test_split_and_json(spark):
    kind = "lhs string, rhs string, similarity double, breakdown map<string,double>, method_rows array<struct<l:int,r:int,score:double,status:string>>"
    rows = [("La;", "Lx;", 0.75, {"overall": 0.75}, [(0, 1, 0.5, "modified"), (1, None, 0.0, "deleted")]), ("Lb;", None, 0.0, None, None), (None, "Ly;", 0.0, None, None)]
    matches = spark.createDataFrame(rows, kind)
    assert [[(r["lhs"], r["rhs"]) for r in part.collect()] for part in C.split_matches(matches)] == [[("La;", "Lx;")], [("Lb;", None)], [(None, "Ly;")]]
    told = [json.loads(r["value"]) for r in reports.match_json(matches).collect()]
    assert told[0] == {"lhs": "La;", "rhs": "Lx;", "distance": 0.75, "breakdown": {"overall": 0.75}, "method_rows": [{"l": 0, "r": 1, "score": 0.5, "status": "modified"}, {"l": 1, "score": 0.0, "status": "deleted"}]}
    assert told[1] == {"lhs": "Lb;", "distance": 0.0} and told[2] == {"rhs": "Ly;", "distance": 0.0}


def test_quality_filter_by_option(spark):
    """Each option drops its own classes; a row stands on either side of every gate."""
    method = lambda n: [{"instr_count": n, "bytecode": b"\x0e" * n}]
    rows = [
        {"descriptor": "Lp/Plain;", "methods": method(5)},
        {"descriptor": "Lp/Synthetic;", "methods": method(5), "is_synthetic": True},
        {"descriptor": "Lp/Inner$1;", "methods": method(5), "is_inner": True},
        {"descriptor": "Lp/External;", "methods": method(5), "is_external": True},
        {"descriptor": "Lp/Compares;", "methods": method(5), "interfaces": ["Ljava/util/Comparator;"]},
        {"descriptor": "Lp/ComparesMore;", "methods": method(5) * 3, "interfaces": ["Ljava/util/Comparator;"]},
        {"descriptor": "Lp/Short;", "methods": method(1)},
    ]
    classes = classes_from_rows(spark, rows)
    every = {r["descriptor"][3:-1] for r in rows}
    kept = lambda **o: {r["descriptor"][3:-1] for r in quality_filter(classes, DiffOptions(**({"synthetic_skipping": False, "skip_boilerplate": False, "min_inst_size_threshold": 0} | o))).collect()}
    assert kept() == every
    for option, gone in (("synthetic_skipping", "Synthetic"), ("inner_skipping", "Inner$1"), ("external_skipping", "External"), ("skip_boilerplate", "Compares")):
        assert every - kept(**{option: True}) == {gone}
    assert every - kept(min_inst_size_threshold=2) == {"Short"}
