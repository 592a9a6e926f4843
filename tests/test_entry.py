from __future__ import annotations

import datetime

import __spark_entry__ as entry
import pytest

from kindred.operators import grade
from kindred.plans import catalogue, whole  # noqa: F401  whole adds its queries
from kindred.streaming import arrivals

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["l", "r", "hamming", "rank"] and df.count() > 0


def test_every_document_asks(spark):
    """Documents of either parity ask and answer, and a copy of the same parity is found."""
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    rows = entry.entry(spark).collect()
    assert {(r["l"] % 2, r["r"] % 2) for r in rows} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert {r["l"] for r in rows} <= ids and all(r["l"] != r["r"] for r in rows)
    exact = {r["doc_id"] for r in catalogue.near_dup_exact_radius(spark, SF).collect() if r["n_links"]}
    near = {r["doc_id"]: r["near"] for r in catalogue.radius_presence(spark, SF).collect()}
    assert set(near) == ids and exact and all(near[i] for i in exact)


def test_names_of_any_size(spark):
    """Alike names of one brand are found whether or not the sizes are equal."""
    size = {r["p_partkey"]: r["p_size"] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size").collect()}
    pairs = {(r["l"], r["r"]) for r in catalogue.levenshtein_names(spark, SF).collect()}
    assert any(size[a] != size[b] for a, b in pairs)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(rows):
    return sorted(tuple(repr(float(x) if hasattr(x, "as_integer_ratio") and not isinstance(x, bool) else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert plain(tuple(r[n] for n in names) for r in got.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_rename_maps(spark):
    text = ["# a comment", "com.acme.A -> x.a:", "    void m() -> b", "", "broken line", "com.acme.B -> x.b:", "com.acme.A -> x.c:", "com.acme.R$id -> x.d:"]
    lines = spark.createDataFrame(list(enumerate(text)), "n int, value string")
    mapping = grade.parse_mapping(lines)
    assert {(r["original"], r["obfuscated"]) for r in mapping.collect()} == {("com.acme.A", "x.c"), ("com.acme.B", "x.b"), ("com.acme.R$id", "x.d")}
    truth = grade.cross_version_truth(mapping, mapping, "com.acme")
    assert {r["original"] for r in truth.collect()} == {"com.acme.A", "com.acme.B"}
    matches = spark.createDataFrame([("x.c", "x.c"), ("x.b", "wrong"), ("unknown", "x.b")], "lhs string, rhs string")
    assert tuple(grade.score_matches(matches, truth).first())[:3] == (1, 1, 1)
    assert tuple(grade.score_matches(matches.limit(0), truth.limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    late = events.limit(1).select("event_id", (events.ts + datetime.timedelta(days=365)).alias("ts"), "user_id", "event_type", "value", "props")
    late.write.mode("append").parquet(str(tmp_path / "in"))
    rows = arrivals.hourly(arrivals.stream_table(spark, str(tmp_path / "in"), events))
    stream = rows.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.table("hours").collect()}
    want = {(r["window_start"], r["event_type"]): r["n"] for r in arrivals.hourly(events).collect()}
    assert want.items() <= got.items() and len(got) == len(want) + 1
