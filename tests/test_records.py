"""Packed and JSON records read as class tables."""

from __future__ import annotations

import base64
import json
import random
import zlib

import pytest

from kindred.sources import records
from kindred.sources.store import StaleStore

HEAD = {"extraction_stamp": "00" * 7 + "01", "abstract_stamp": "ab" * 8, "signature_stamp": "ff" * 8}


def samples(seed: int, n: int):
    rng = random.Random(seed)
    word = lambda: rng.choice(["", "é", "La/B;", "x" * 300, *(f"s{i}" for i in range(200))])
    some = lambda k: [word() for _ in range(rng.randrange(k))]
    method = lambda: {"name": word(), "descriptor": "()V", "access": rng.randrange(1 << 18), "arg_count": rng.randrange(300), "return_type": word(), "xref_count": 0, "instr_count": rng.randrange(1 << 20), "opcode_xor": rng.randrange(256), "calls": some(4), "instantiates": some(3), "abstract": bytes(rng.randrange(13) for _ in range(rng.randrange(200)))}
    one = lambda: {"descriptor": word(), "package": word(), "name": word(), "source_file": rng.choice([None, "", "A.java"]), "superclass": rng.choice([None, "La/B;"]), "access": rng.randrange(1 << 18), "is_inner": rng.random() < 0.5, "is_synthetic": rng.random() < 0.5, "is_external": rng.random() < 0.5, "signature": [rng.getrandbits(32) for _ in range(4)], "interfaces": some(3), "strings": some(9), "fields": [{"name": word(), "type_desc": word(), "access": rng.randrange(9)} for _ in range(rng.randrange(4))], "methods": [method() for _ in range(rng.randrange(5))]}
    return [one() for _ in range(n)]


def varint(v: int) -> bytes:
    out = b""
    while v >= 128:
        out += bytes([v % 128 + 128])
        v //= 128
    return out + bytes([v])


def packed(classes, digest="d1", kind=1, normalized=True, manifest=True) -> bytes:
    table: dict[str, int] = {}
    s = lambda x: varint(table.setdefault(x, len(table)))
    seq = lambda xs: varint(len(xs)) + b"".join(map(s, xs))
    opt = lambda x: varint(0) if x is None else varint(table.setdefault(x, len(table)) + 1)
    body = s("com.acme") + seq(["A"]) + seq([]) + seq(["B", "A"]) + seq([]) if manifest else b""
    body += varint(len(classes))
    for c in classes:
        body += s(c["descriptor"]) + s(c["package"]) + s(c["name"]) + opt(c["source_file"]) + opt(c["superclass"]) + varint(c["access"])
        body += bytes([c["is_inner"] + 2 * c["is_synthetic"] + 4 * c["is_external"]]) + b"".join(p.to_bytes(4, "big") for p in c["signature"])
        body += seq(c["interfaces"]) + seq(c["strings"]) + varint(len(c["fields"]))
        body += b"".join(s(f["name"]) + s(f["type_desc"]) + varint(f["access"]) for f in c["fields"]) + varint(len(c["methods"]))
        for m in c["methods"]:
            body += s(m["name"]) + s(m["descriptor"]) + varint(m["access"]) + varint(m["arg_count"]) + s(m["return_type"]) + varint(m["xref_count"]) + varint(m["instr_count"]) + varint(m["opcode_xor"]) + seq(m["calls"]) + seq(m["instantiates"]) + varint(len(m["abstract"])) + m["abstract"]
    strings = b"".join(varint(len(x.encode())) + x.encode() for x in table)
    head = b"".join(bytes.fromhex(HEAD[n]) for n in records.STAMPS) + varint(len(digest)) + digest.encode() + bytes([kind, normalized + 2 * manifest])
    return records.MAGIC + bytes([records.LAYOUT]) + zlib.compress(head + varint(len(table)) + strings + body)


def as_json(classes, digest="d1", layered=True) -> bytes:
    coded = [c | {"methods": [m | {"abstract": base64.b64encode(m["abstract"]).decode()} for m in c["methods"]]} for c in classes]
    stamps = {n.removesuffix("_stamp") + "_version": v for n, v in HEAD.items()} if layered else {}
    return json.dumps({"record_version": 1, "algo_version": "old"} | stamps | {"digest": digest, "input_kind": "dex", "normalized": True, "manifest": None, "classes": coded}).encode()


def plain(row) -> dict:
    c = row.asDict(recursive=True)
    c["signature"] = [c["sig"][p] for p in ("cls", "fld", "mth", "code")]
    for m in c["methods"]:
        m["abstract"] = bytes(ord(x) - 97 for x in m["abstract"])
        assert m.pop("bytecode") == b""
    return c


def test_records_round_trip(spark, tmp_path):
    """Both forms give the same rows, class by class in their order, from many files at once."""
    want = {}
    for k in range(4):
        classes = samples(k, [0, 1, 7, 30][k])
        want |= {(f"p{k}", i): c for i, c in enumerate(classes)} | {(f"j{k}", i): c for i, c in enumerate(classes)}
        (tmp_path / f"p{k}.rec").write_bytes(packed(classes, f"p{k}", manifest=k % 2 == 0))
        (tmp_path / f"j{k}.json").write_bytes(as_json(classes, f"j{k}"))
    rows = records.read_records(spark, str(tmp_path), HEAD).collect()
    got = {(r["digest"], r["pos"]): plain(r) for r in rows}
    assert got.keys() == want.keys()
    for key, c in want.items():
        assert {k: got[key][k] for k in c} == c
    assert {(r["input_kind"], r["normalized"], *(r[s] for s in records.STAMPS)) for r in rows} == {("dex", True, *HEAD.values())}


def test_stale_and_broken_records(spark, tmp_path):
    one = samples(1, 3)
    (tmp_path / "a.rec").write_bytes(packed(one))
    with pytest.raises(StaleStore, match="signature; sign"):
        records.read_records(spark, str(tmp_path / "a.rec"), HEAD | {"signature_stamp": "0" * 16})
    with pytest.raises(StaleStore, match="extraction; prepare"):
        records.read_records(spark, str(tmp_path / "a.rec"), HEAD | {"extraction_stamp": "0" * 16})
    (tmp_path / "old.json").write_bytes(as_json(one, layered=False))
    assert {r["abstract_stamp"] for r in records.read_records(spark, str(tmp_path / "old.json")).collect()} == {"legacy:old"}
    for name, data in (("junk", b"nothing"), ("version", records.MAGIC + b"\x07" + b"x"), ("short", records.MAGIC + bytes([2]) + zlib.compress(zlib.decompress(packed(one)[4:])[:-3]))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=name):
            records.read_records(spark, str(tmp_path / name)).collect()
