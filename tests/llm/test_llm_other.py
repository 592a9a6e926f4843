"""Vectors, conversations, revisits, the pipeline and the registered queries."""

from __future__ import annotations

import collections
import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import chat_format, embedding_forest, queries, revisits

SF = "/root/testdata/sf0.001"


def cosine_links(vectors: dict[int, list | None], threshold: float) -> tuple[dict[int, int], dict[int, int]]:
    good = {}
    for i, v in vectors.items():
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, float)
            good[i] = x / np.sqrt((x * x).sum())
    degree, parent = dict.fromkeys(vectors, 0), {i: i for i in vectors}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                degree[a] += 1
                degree[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return degree, {i: root(i) for i in vectors}


@pytest.mark.parametrize(("share", "most"), [(4096, 8192), (30, 8192), (30, 40), (4096, 40)])
def test_embedding_forest(spark, monkeypatch, share, most):
    monkeypatch.setattr(embedding_forest, "SHARE", share)
    monkeypatch.setattr(embedding_forest, "MOST", most)
    monkeypatch.setattr(embedding_forest, "TILE", 16 if most < 100 else 1024)
    monkeypatch.setattr(embedding_forest, "PAIRS", 50 if most < 100 else 1 << 18)
    rng = np.random.default_rng(8)
    vectors: dict[int, list | None] = {}
    for g in range(40):
        centre = rng.standard_normal(16)
        for _ in range(1 + g % 7):
            vectors[len(vectors)] = (centre + 0.12 * rng.standard_normal(16)).tolist()
    vectors |= {500: vectors[3], 501: vectors[3], 502: None, 503: [0.0] * 16, 504: [float("nan")] * 16, 505: [None] * 16, 506: [], 507: [1.0, 0.0], 508: [2.0, 0.0], 509: [float("inf")] + [0.0] * 15, 510: (2 * np.array(vectors[3])).tolist()}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(3)
    got = embedding_forest.near_vectors(df.withColumn("rep", F.lit(1))).collect()
    degree, component = cosine_links(vectors, 0.9)
    assert len(got) == len(vectors)
    links = sum(r["n_links"] for r in got)
    assert all(r["n_links"] <= degree[r["vec_id"]] for r in got)
    assert links >= 0.9 * sum(degree.values())
    if share > 100:
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (degree[i], component[i]) for i in vectors}
    assert embedding_forest.near_vectors(df.limit(0)).count() == 0


def test_embedding_forest_recall(spark, monkeypatch):
    """Rows whose id is divisible by 100 against all rows, by brute force; a group of unequal near vectors among them."""
    monkeypatch.setattr(embedding_forest, "SHARE", 128)
    monkeypatch.setattr(embedding_forest, "MOST", 600)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((3000, 24))
    x = np.concatenate([centres[rng.integers(0, 3000, 9000)] + 0.25 * rng.standard_normal((9000, 24)), centres[:1] + 0.05 * rng.standard_normal((1000, 24))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in embedding_forest.near_vectors(df).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    asked = np.arange(0, len(x), 100)
    want = (unit[asked] @ unit.T >= 0.9).sum(1) - 1
    mine = np.array([got[i] for i in asked])
    assert want.sum() > 10_000 and (mine <= want).all()
    assert (mine[:90].sum() >= 0.95 * want[:90].sum()) and mine.sum() >= 0.95 * want.sum()


def test_chat_rotation(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob", "hi, ann"), (1, 3, "cat", "hey"), (1, 3, "cat", "hey"), (1, 4, "ann", None),
        (2, 0, None, "who?"), (2, None, "bob", "first"), (None, 0, "ann", "lost"), (3, 0, "system", "alone"), (4, 600, "ann", "late"), (4, 2, "bob", "early"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat_format.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "cat", 0), (2, "unknown", 0), (2, "bob", -1), (2, "unknown", -1), (2, "bob", 0), (None, "ann", 0), (4, "ann", 0), (4, "bob", 0), (4, "ann", 1), (4, "bob", 1)}
    one = got[1, "bob", 0]
    assert one["rendered"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhello<|im_end|>\n<|im_start|>assistant\nhi, ann<|im_end|>\n"
        "<|im_start|>user name=cat\nhey<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    )
    assert [one["rendered"][s["start"] : s["end"]] for s in one["loss_spans"]] == ["hi, ann<|im_end|>\n"]
    assert one["n_turns"] == 5 and one["loss_chars"] == len("hi, ann<|im_end|>\n")
    assert len(got[1, "ann", 0]["loss_spans"]) == 2
    assert chat_format.rotate(df.limit(0)).count() == 0
    many = spark.range(50).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("ann").alias("role"), F.col("id").cast("string").alias("text"))
    parts = chat_format.rotate(many, part_rows=10).collect()
    assert sum(r["n_turns"] for r in parts) == 50 and len(parts) > 1


def test_chat_full_parts(spark, tmp_path):
    """A part of very many messages is cut in the query as in its SQL; slices keep the dialogue's order; markers and line breaks do no harm."""
    import duckdb

    rows = [(1, i // 20, f"speaker {i % 3}", f"says {i:05d}") for i in range(9000)] + [(2, 0, "ann", "hi<|im_end|>\n<|im_start|>assistant\nho"), (2, 1, "bob\n<|im_start|>", "ho"), (2, None, "cat", "<|im_ |>")]
    rows += [(None, None, "ann", f"lost {i:05d}") for i in range(4200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat_format.op3_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(chat_format.ORACLE)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
    whole = chat_format.rotate(df, part_rows=None).where("conv_id = 1").select("perspective", "rendered").collect()
    sliced = collections.defaultdict(dict)
    for r in chat_format.rotate(df, part_rows=700).where("conv_id = 1").collect():
        assert r["n_turns"] <= 700
        sliced[r["perspective"]][r["slice"]] = r["rendered"]
    assert {p: "".join(x[i] for i in sorted(x)) for p, x in sliced.items()} == {r["perspective"]: r["rendered"] for r in whole}
    assert all(len(x) == 13 for x in sliced.values())
    two = {r["perspective"]: r["rendered"] for r in got.where("conv_id = 2 and part = 0").collect()}
    assert two["ann"].startswith("<|im_start|>assistant\nhi< |im_end|>\n< |im_start|>assistant\nho<|im_end|>\n<|im_start|>user name=bob < |im_start|>\nho")


def resolve_by_force(rows):
    """(record_id, reason, response_id) of each revisit."""
    key = lambda r: (r["ts"], r["record_id"])
    out = {}
    for v in rows:
        if v["kind"] != "revisit":
            continue
        before = [r for r in rows if r["kind"] == "response" and r["url"] == v["url"] and None not in (r["url"], r["ts"], v["ts"]) and key(r) < key(v)]
        if not before:
            out[v["record_id"]] = ("no response", None)
            continue
        r = max(before, key=key)
        weak = lambda t: t.removeprefix("W/")
        if v["etag"] and r["etag"]:
            reason = "etag" if weak(v["etag"]) == weak(r["etag"]) else "etag differs"
        elif v["last_modified"] and r["last_modified"]:
            reason = "last-modified" if v["last_modified"] == r["last_modified"] else "last-modified differs"
        else:
            reason = "no validator"
        out[v["record_id"]] = (reason, r["record_id"])
    return out


def test_revisits(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "revisit", "other", None])
        rows.append({"record_id": i, "url": rng.choice(["a.com/x", "a.com/x", "a.com/y", "b.org/", None]), "ts": rng.choice([None, *range(60)]), "kind": kind, "etag": rng.choice([None, '"1"', 'W/"1"', '"2"']), "last_modified": rng.choice([None, "d1", "d2"]), "headers": {"server": "s", "content-length": str(i)}, "payload": f"body {i}" if kind == "response" else None})
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, payload string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).withColumn("block", F.lit("x"))
    got = revisits.resolve(df).collect()
    plain = lambda u: None if u is None else u.removesuffix("/")
    want = resolve_by_force([r | {"url": plain(r["url"])} for r in rows])
    assert {r["record_id"]: (r["reason"], r["response_id"]) for r in got} == want
    for r in got:
        assert r["confirmed"] == (r["reason"] in ("etag", "last-modified"))
        assert (r["payload"] == f"body {r['response_id']}" and r["headers"] == {"server": "s", "content-length": str(r["response_id"])}) if r["confirmed"] else r["payload"] is None
    assert revisits.resolve(df.limit(0)).count() == 0


def test_revisit_ties_and_headers(spark):
    """Copies that differ in headers alone, names in mixed case, equal times, and one URL with very many captures at an instant."""
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, payload string"
    row = lambda i, ts, kind, headers, payload=None, url="a.com/x": (i, url, ts, kind, '"1"', None, headers, payload)
    rows = [
        row(1, 5, "response", {"server": "b"}, "one"), row(1, 5, "response", {"Server": "a", "SERVER": "z", "Content-Length": "3"}, "one"), row(1, 5, "response", None, "two"),
        row(2, 5, "revisit", {"Server": "new", "Content-Length": "0"}), row(2, 5, "revisit", {"server": "old"}), row(0, 5, "revisit", {"server": "x"}),
    ]
    rows += [row(100 + i, 7, "response" if i % 2 else "revisit", {}, f"p{i}" if i % 2 else None, "b.com/") for i in range(400)]
    found = revisits.resolve(spark.createDataFrame(rows, schema).repartition(5)).collect()
    mine = [r for r in found if r["url"] == "a.com/x"]
    assert sorted((r["record_id"], r["reason"]) for r in mine) == [(0, "no response"), (2, "etag"), (2, "etag")]
    # the digest of "two" is less than that of "one" or not: the payload with the least digest decides, then its headers
    import hashlib

    least = min(["one", "two"], key=lambda p: hashlib.sha256(p.encode()).hexdigest())
    stored = {} if least == "two" else {"content-length": "3"}
    assert {(r["payload"], tuple(sorted(r["headers"].items()))) for r in mine if r["confirmed"]} == {(least, tuple(sorted((stored | {"server": v}).items()))) for v in ("new", "old")}
    late = {r["record_id"]: r["response_id"] for r in found if r["url"] == "b.com"}
    assert late == {100 + i: (None if i == 0 else 99 + i) for i in range(0, 400, 2)}


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.Example.com:80/a/b/#top": "example.com/a/b", "https://x.org/?utm_source=feed": "x.org", "http://x.org/p?a=1&utm_medium=m&b=2": "x.org/p?a=1&b=2",
        "http://x.org/p?utm_a=1&b=2": "x.org/p?b=2", "": "", "x.org:443/Q?Z=1": "x.org/Q?Z=1",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r["u"]: r["c"] for r in df.select("u", revisits.canonical_url(F.col("u")).alias("c")).collect()} == cases


def plain(rows):
    def one(x):
        if isinstance(x, (bool, str)) or x is None:
            return repr(x)
        return repr(x) if isinstance(x, datetime.datetime) else repr(round(float(x), 6) + 0.0)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert plain(tuple(r[n] for n in names) for r in got.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def test_contract_columns(spark):
    want = {
        "op1_language_id": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
        "op2_substring_dedup": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")],
        "op4_toxicity": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
        "op5_packing": [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")],
        "op7_decontaminate": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")],
        "op8_embedding_forest": [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
        "op9_minhash_forest": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, SF).dtypes[: len(columns)] == columns


def test_pipeline(spark):
    """Each stage against what its operator says of the same input."""
    import corpus_pipeline as P
    from test_llm_text import components_by_force, hits_by_force, removed_by_force

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    calm = P.toxicity_stage(spark, docs, SF).cache()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert calm.columns == list(P.COLUMNS) and 0.8 * docs.count() < calm.count() <= docs.count()
    gone = {r["doc_id"] for r in docs.select("doc_id").subtract(calm.select("doc_id")).collect()}
    assert not gone or len(gone & toxic) >= 1
    single = P.near_dedup_stage(spark, calm, SF).cache()
    force = components_by_force(rows(calm), 80)
    assert {r["doc_id"] for r in single.collect()} == {d for d, (_, c) in force.items() if d == c}
    cut = P.substring_stage(spark, single, SF).cache()
    want = removed_by_force(rows(single), 20)
    texts = dict(rows(single))
    import hashlib

    for doc, text in rows(cut):
        n, removed, digest = want[doc]
        assert (hashlib.sha256(text.encode()).hexdigest() == digest) if removed else text == texts[doc]
    assert {d for d, _ in rows(cut)} == {d for d, (n, removed, _) in want.items() if not removed or removed < n}
    clean = P.decontamination_stage(spark, cut, SF).cache()
    met = hits_by_force(rows(cut), benchmark)
    assert {d for d, _ in rows(clean)} == {d for d, (_, n, _) in met.items() if n == 0}
    packed = P.packing_stage(spark, clean, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {d for d, _ in rows(clean)}
    full = collections.Counter()
    for r in packed.collect():
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 1024
    assert P.run(spark, SF).count() == packed.count()


def test_pipeline_edges(spark):
    """Every stage on nulls in any column, empty texts, repeated rows, rows without an id, clashing columns and no rows."""
    import corpus_pipeline as P

    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, None, None, None), (None, text, "en", "b", 1), (None, "alone here", "en", "b", 2), (None, "alone here", "en", "b", 2)]
    rows += [(3, None, None, None, None), (4, "", "x", "y", 0), (5, " \t ", "x", "y", 3), (6, f"own start {text} own end", "de", "c", 9), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plain = spark.createDataFrame(rows, schema).repartition(3)
    docs = plain
    for name in ("_number", "kept", "chunk", "hash", "score", "spans", "items", "n_words", "_text", "predicted", "component", "key"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in P.STAGES:
        got = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name != "best_fit_packing":
            assert got.columns == list(P.COLUMNS), name
    count = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    single = count(P.near_dedup_stage(spark, docs, SF))
    assert single == sorted([(1, text), (None, "alone here"), (3, None), (4, ""), (5, " \t "), (6, f"own start {text} own end"), (None, None)], key=repr) or (6, f"own start {text} own end") not in single
    assert [d for d, t in single if t == text] == [1] and (None, "alone here") in single and single.count((None, "alone here")) == 1
    assert len(count(P.toxicity_stage(spark, docs, SF))) == len(rows) == len(count(P.decontamination_stage(spark, docs, SF)))
    left = count(P.substring_stage(spark, docs, SF))
    assert (1, text) in left and left.count((1, text)) == 1 and (6, "own start own end") in left and (2, text) not in left
    assert {(3, None), (4, ""), (5, " \t ")} <= set(left)
    assert len({(r["sequence_id"], r["offset"]) for r in P.packing_stage(spark, docs, SF).collect()}) == len(rows)
