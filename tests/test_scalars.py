from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.functions.hashing import murmur3
from kindred.operators import lsh
from kindred.schema import DiffOptions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_murmur3_vectors():
    assert [murmur3(s.encode()) for s in ("", "a", "abc", "Hello, world!")] == [0, 0x3C2569B2, 0xB3DD93FA, 0xC0363E43]


def test_entropy_and_packages(spark):
    assert one(spark, S.entropy(F.lit("aaaa"))) == 0.0
    assert one(spark, S.entropy(F.lit(""))) == 0.0
    assert math.isclose(one(spark, S.entropy(F.lit("abcd"))), 2.0)
    for name, obfuscated in (("a.b.c", True), ("a", True), ("a.b.cd", True), ("", True), ("com.acme.app", False), ("com.acme.a", False)):
        assert one(spark, S.is_obfuscated_package(F.lit(name))) is obfuscated
    assert one(spark, S.pool_key(F.lit(""))) == "__obfuscated__"
    assert one(spark, S.pool_key(F.lit("x"), cluster=False)) == "__global__"
    assert one(spark, S.in_package(F.lit("com.acmeother"), "com.acme")) is False


def test_categories(spark):
    assert one(spark, S.categorize(F.lit(bytes([0x00, 0x01, 0x0E, 0x12, 0x1A, 0x32, 0x6E, 0x90, 0xFA, 0xFF])))) == "".join(chr(97 + k) for k in (0, 11, 2, 12, 10, 1, 4, 5, 4, 0))


def test_descriptors(spark):
    assert one(spark, S.package_of(F.lit("Lp/q/N;"))) == "p.q"
    assert one(spark, S.name_of(F.lit("Lp/q/N$a;"))) == "N$a"
    assert one(spark, S.name_of(F.lit("LN;"))) == "N"
    assert one(spark, S.parameters(F.lit("(I [J Lp/A; [[Lq/B;)V"))) == ["I", "[J", "Lp/A;", "[[Lq/B;"]
    assert one(spark, S.java_method(F.lit("m"), F.lit("([ILjava/lang/String;)[Lp/A;"))) == "p.A[] m(int[],java.lang.String)"
    assert one(spark, S.object_types(F.lit("(Lp/A;I[Lq/B;)V"))) == ["Lp/A;", "Lq/B;"]


def test_similarity(spark):
    bag = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, S.bag_jaccard(bag("a", "a", "b"), bag("a", "b", "b"))) == 0.5
    assert one(spark, S.bag_jaccard(bag(), bag())) == 1.0
    assert one(spark, S.bag_jaccard(bag(), bag(), 0.0)) == 0.0
    assert one(spark, S.ratio(F.lit(0), F.lit(0))) == 1.0
    assert one(spark, S.ratio(F.lit(2), F.lit(4))) == 0.5
    assert one(spark, S.edit_similarity(F.lit(""), F.lit(""))) == 1.0
    assert math.isclose(one(spark, S.edit_similarity(F.lit("kitten"), F.lit("sitting"))), 1 - 3 / 7)


def test_strings_and_names(spark):
    text = F.array(*map(F.lit, ("abc", "abcd", "12345", "longer one", "abcd")))
    assert one(spark, S.useful_strings(text)) == ["abcd", "longer one"]
    assert one(spark, S.top_strings(S.useful_strings(text), 1)) == ["longer one"]
    assert one(spark, S.recovered_head(F.lit("ContextCompat.java"), F.lit("q"))) == "ContextCompat"
    assert one(spark, S.recovered_head(F.lit("SourceFile"), F.lit("q"))) is None
    assert one(spark, S.recovered_head(F.lit(None).cast("string"), F.lit("Holder$a"))) == "Holder"
    assert one(spark, S.with_head(F.lit("x6"), F.lit("q$a"), F.lit("Holder"))) == "x6.Holder$a"
    prefix = lambda *c: one(spark, S.suggested_prefix(F.lit("com.x"), F.array(*map(F.lit, c)) if c else F.array().cast("array<string>")))
    assert prefix("com.acme.a.Main", "com.acme.b.Other") == "com.acme"
    assert prefix(".ui.Main", "com.x.Other") == "com.x"
    assert prefix() == "com.x"
    assert prefix("org.a.B", "net.c.D") == "com.x"
    assert prefix("com.x.Main") == "com.x"
    assert S.dev_prefixes(["com.acme", "Lcom/acme;", None]) == ("Lcom/acme/",)


def test_signature_text(spark):
    sig = F.struct(F.lit(1).cast("long").alias("cls"), F.lit(0xFFFFFFFF).alias("fld"), F.lit(0).cast("long").alias("mth"), F.lit(171).cast("long").alias("code"))
    text = one(spark, F.format_string("%08x%08x%08x%08x", sig["cls"], sig["fld"], sig["mth"], sig["code"]))
    assert text == "00000001ffffffff00000000000000ab"
    back = one(spark, S.signature_from_hex(F.lit(text)))
    assert (back["cls"], back["fld"], back["mth"], back["code"]) == (1, 0xFFFFFFFF, 0, 171)


def test_options_ignore_unknown_keys():
    assert DiffOptions.from_dict({"buckets": 8, "no_such": 1}).buckets == 8
    assert DiffOptions.from_dict(None) == DiffOptions()


def test_nearest_equals_a_scan_of_buckets(spark):
    rng, k = random.Random(7), 3
    base = [rng.getrandbits(128) for _ in range(6)]
    near = lambda: rng.choice(base) ^ sum(1 << rng.randrange(128) for _ in range(rng.randrange(6)))
    lhs, rhs = [near() for _ in range(30)], [near() for _ in range(60)]
    samples = lsh.sampled_bits()
    keys = lambda v: [sum(((v >> b) & 1) << j for j, b in enumerate(s)) for s in samples]
    rkeys = [keys(v) for v in rhs]
    want = set()
    for i, v in enumerate(lhs):
        mine = keys(v)
        met = [((v ^ w).bit_count(), next(p for p in range(16) if mine[p] == rkeys[j][p]), j) for j, w in enumerate(rhs) if any(mine[p] == rkeys[j][p] for p in range(16))]
        want |= {(i, j, d, n + 1) for n, (d, _, j) in enumerate(sorted(met)[:k])}
    frame = lambda values: spark.createDataFrame([("", i, ((v >> 96) & 0xFFFFFFFF, (v >> 64) & 0xFFFFFFFF, (v >> 32) & 0xFFFFFFFF, v & 0xFFFFFFFF)) for i, v in enumerate(values)], "pool string, id long, sig struct<cls:bigint,fld:bigint,mth:bigint,code:bigint>")
    got = {(r["l"], r["r"], r["hamming"], r["rank"]) for r in lsh.nearest(frame(lhs), frame(rhs), k).collect()}
    assert got == want
    wider = {(r["l"], r["r"]) for r in lsh.nearest(frame(lhs), frame(rhs), 60, probe_radius=1).collect()}
    assert wider >= {(r["l"], r["r"]) for r in lsh.nearest(frame(lhs), frame(rhs), 60).collect()}
