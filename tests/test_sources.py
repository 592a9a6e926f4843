"""DEX and archive scans by a small writer of DEX files, manifests, the request loop, the command line."""

from __future__ import annotations

import io
import json
import struct
import zipfile

import fixtures
import pytest
from pyspark.sql import functions as F

from kindred import cli
from kindred.schema import classes_from_rows
from kindred.sources import dex, inputs, manifest, normalize, reports, store
from kindred.streaming import serve


def uleb(n: int) -> bytes:
    out = b""
    while True:
        n, b = n >> 7, n & 0x7F
        out += bytes([b | (0x80 if n else 0)])
        if not n:
            return out


def write_dex(classes: list[dict]) -> bytes:
    """A DEX blob of classes: descriptor, superclass, fields (name, type), methods (name, params, ret, code builder)."""
    strings, protos, fields, methods = set(), set(), set(), set()
    for c in classes:
        strings |= {c["descriptor"], c["superclass"], *c.get("interfaces", [])} | ({c["source"]} if c.get("source") else set()) | set(c.get("strings", []))
        for name, kind in c.get("fields", []):
            strings |= {name, kind}
            fields.add((c["descriptor"], name, kind))
        for m in [*c["methods"], *c.get("foreign", [])]:
            owner = m.get("owner", c["descriptor"])
            strings |= {m["name"], m["ret"], owner, *m["params"]}
            protos.add((m["ret"], tuple(m["params"])))
            methods.add((owner, m["name"], m["ret"], tuple(m["params"])))
    strings |= {"V"}
    text = sorted(strings)
    types = sorted(t for t in strings if t[0] in "L[" or t in "VIJZ")
    sid, tid = {s: i for i, s in enumerate(text)}, {t: i for i, t in enumerate(types)}
    protos, fields, methods = sorted(protos), sorted(fields), sorted(methods)
    pid, fid, mid = ({x: i for i, x in enumerate(v)} for v in (protos, fields, methods))
    at = {"strings": 0x70}
    for name, width, n in (("types", 4, len(text)), ("protos", 4, len(types)), ("fields", 12, len(protos)), ("methods", 8, len(fields)), ("classes", 8, len(methods)), ("data", 32, len(classes))):
        at[name] = list(at.values())[-1] + width * n
    data = bytearray()
    here = lambda: at["data"] + len(data)

    def pad():
        while here() % 4:
            data.append(0)

    text_at = []
    for s in text:
        text_at.append(here())
        data.extend(uleb(len(s.encode("utf-16-le", "surrogatepass")) // 2) + s.encode("utf-8", "surrogatepass").replace(b"\0", b"\xc0\x80") + b"\0")

    def listed(names) -> int:
        if not names:
            return 0
        pad()
        where = here()
        data.extend(struct.pack("<I", len(names)) + b"".join(struct.pack("<H", tid[t]) for t in names))
        return where

    proto_rows = b"".join(struct.pack("<III", sid[r], tid[r], listed(p)) for r, p in protos)
    class_rows = b""
    for c in classes:
        faces = listed(c.get("interfaces", []))
        bodies = {}
        for m in c["methods"]:
            if m.get("code") is not None:
                pad()
                units = m["code"](sid, tid, lambda o, n, r, p: mid[o, n, r, tuple(p)])
                bodies[m["name"]] = here()
                data.extend(struct.pack("<HHHHII", 4, 1, 2, 0, 0, len(units)) + struct.pack(f"<{len(units)}H", *units))
        body = here()
        own_f = sorted(fid[c["descriptor"], n, k] for n, k in c.get("fields", []))
        own_m = sorted((mid[c["descriptor"], m["name"], m["ret"], tuple(m["params"])], m["name"]) for m in c["methods"])
        data.extend(uleb(0) + uleb(len(own_f)) + uleb(0) + uleb(len(own_m)))
        last = 0
        for f in own_f:
            data.extend(uleb(f - last) + uleb(1))
            last = f
        last = 0
        for i, name in own_m:
            data.extend(uleb(i - last) + uleb(1) + uleb(bodies.get(name, 0)))
            last = i
        class_rows += struct.pack("<8I", tid[c["descriptor"]], c.get("access", 1), tid[c["superclass"]], faces, sid[c["source"]] if c.get("source") else 0xFFFFFFFF, 0, body, 0)
    tables = struct.pack(f"<{len(text)}I", *text_at) + struct.pack(f"<{len(types)}I", *(sid[t] for t in types)) + proto_rows
    tables += b"".join(struct.pack("<HHI", tid[c], tid[k], sid[n]) for c, n, k in fields) + b"".join(struct.pack("<HHI", tid[c], pid[r, p], sid[n]) for c, n, r, p in methods) + class_rows
    head = [at["data"] + len(data), 0x70, 0x12345678, 0, 0, 0, len(text), at["strings"], len(types), at["types"], len(protos), at["protos"], len(fields), at["fields"], len(methods), at["methods"], len(classes), at["classes"], len(data), at["data"]]
    return b"dex\n035\0" + b"\0" * 24 + struct.pack("<20I", *head) + tables + bytes(data)


def sample(extra: bool = False) -> bytes:
    def code(sid, tid, ref):
        log = ref("Landroid/util/Log;", "d", "I", ["Ljava/lang/String;"])
        out = [0x001A, sid["hello anchor"], 0x1071, log, 0, 0x0022, tid["Lp/q/B$C;"], 0x0012]
        out += [0x0026, 3, 0, 0x000E, 0x0300, 2, 2, 0, 0x1111, 0x2222]  # a table in the code
        return out

    def tail(sid, tid, ref):
        return [0x106E, ref("Lp/q/A;", "run", "V", ["I", "[Lp/q/B$C;"]), 0, 0x000E]

    log = {"owner": "Landroid/util/Log;", "name": "d", "ret": "I", "params": ["Ljava/lang/String;"]}
    a = {"descriptor": "Lp/q/A;", "superclass": "Ljava/lang/Object;", "interfaces": ["Ljava/lang/Runnable;"], "source": "A.java", "strings": ["hello anchor", "unused", "café \ud83d"], "fields": [("size", "I"), ("next", "Lp/q/A;")], "methods": [{"name": "run", "ret": "V", "params": ["I", "[Lp/q/B$C;"], "code": code}], "foreign": [log]}
    b = {"descriptor": "Lp/q/B$C;", "superclass": "Ljava/lang/Object;", "access": 0x1001, "methods": [{"name": "go", "ret": "V", "params": [], "code": tail}, {"name": "none", "ret": "J", "params": [], "code": None}]}
    c = {"descriptor": "Lp/q/D;", "superclass": "Lp/q/A;", "methods": [{"name": "absent", "ret": "V", "params": [], "code": None}]}
    return write_dex([a, b, c] if extra else [a, b])


def test_dex_scan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.dex").write_bytes(sample())
    (tmp_path / "in/two.dex").write_bytes(sample(True))
    (tmp_path / "in/bad.dex").write_bytes(b"dex\n035\0 broken")
    (tmp_path / "in/other.txt").write_text("no")
    classes, failures = dex.scan_dex(spark, [str(tmp_path / "in")], "d1")
    rows = {r["descriptor"]: r for r in classes.collect()}
    assert set(rows) == {"Lp/q/A;", "Lp/q/B$C;", "Lp/q/D;"} and failures.count() == 1
    a, b = rows["Lp/q/A;"], rows["Lp/q/B$C;"]
    assert (a["package"], a["name"], a["source_file"], a["superclass"], a["interfaces"], a["strings"]) == ("p.q", "A", "A.java", "Ljava/lang/Object;", ["Ljava/lang/Runnable;"], ["hello anchor"])
    run = a["methods"][0]
    assert bytes(run["bytecode"]) == bytes([0x1A, 0x71, 0x22, 0x12, 0x26, 0x0E]) and run["instr_count"] == 6
    assert run["calls"] == ["Landroid/util/Log;->d(Ljava/lang/String;)I"] and run["instantiates"] == ["Lp/q/B$C;"]
    assert (run["arg_count"], run["return_type"], run["xref_count"]) == (2, "V", 1)
    assert b["is_inner"] and b["is_synthetic"] and not b["is_external"] and rows["Lp/q/D;"]["is_external"]
    assert {(f["name"], f["type_desc"]) for f in a["fields"]} == {("size", "I"), ("next", "Lp/q/A;")}
    with pytest.raises(dex.LoadError):
        dex.scan_dex(spark, [str(tmp_path / "in/bad.dex")], "d2")
    with pytest.raises(dex.LoadError):
        dex.scan_dex(spark, [str(tmp_path / "nowhere.dex")], "d3")


def apk(path, blobs: list[bytes]) -> None:
    with zipfile.ZipFile(path, "w") as z:
        for i, b in enumerate(blobs):
            z.writestr(f"classes{i + 1 if i else ''}.dex", b)
        z.writestr("res/raw.bin", b"x")


def test_inputs_and_cache(spark, tmp_path):
    apk(tmp_path / "a.apk", [sample(), sample(True)])
    cache = str(tmp_path / "cache")
    one, facts = inputs.load(spark, str(tmp_path / "a.apk"), cache=cache)
    assert one.count() == 3 and facts["kind"] == "apk" and not facts["from_cache"]
    two, again = inputs.load(spark, str(tmp_path / "a.apk"), cache=cache)
    assert again["from_cache"] and again["digest"] == facts["digest"] and two.count() == 3
    (tmp_path / "x.txt").write_text("plain")
    with pytest.raises(dex.LoadError):
        inputs.load(spark, str(tmp_path / "x.txt"))
    files = store.files(spark, [str(tmp_path / "a.apk"), str(tmp_path / "x.txt"), str(tmp_path / "x.txt")])
    assert {r["kind"] for r in store.kinds(files.select("path", "content")).collect()} == {"apk", "unknown"} and files.count() == 2


def binary_manifest() -> bytes:
    words = ["manifest", "package", "com.acme", "activity", "name", ".Main", "service", "com.acme.bg.Sync"]
    pool, offsets = b"", []
    for w in words:
        offsets.append(len(pool))
        pool += struct.pack("<H", len(w)) + w.encode("utf-16-le") + b"\0\0"
    pool += b"\0" * (-len(pool) % 4)
    strings = struct.pack("<HHIIIIII", 1, 28, 28 + 4 * len(words) + len(pool), len(words), 0, 0, 28 + 4 * len(words), 0) + struct.pack(f"<{len(words)}I", *offsets) + pool

    def tag(name, key, value):
        attribute = struct.pack("<IIIHBBI", 0xFFFFFFFF, key, value, 8, 0, 3, value)
        body = struct.pack("<IIIIHHHHHH", 1, 0xFFFFFFFF, 0xFFFFFFFF, name, 20, 20, 1, 0, 0, 0) + attribute
        return struct.pack("<HHI", 0x102, 16, 8 + len(body)) + body

    rest = strings + tag(0, 1, 2) + tag(3, 4, 5) + tag(6, 4, 7)
    return struct.pack("<HHI", 3, 8, 8 + len(rest)) + rest


def test_manifests(spark, tmp_path):
    (tmp_path / "b.xml").write_bytes(binary_manifest())
    (tmp_path / "t.xml").write_text('<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="org.x"><application><receiver android:name="org.x.a.R"/><provider android:name="org.x.b.P"/></application></manifest>')
    (tmp_path / "z.xml").write_text("<broken")
    rows = {r["path"].rpartition("/")[2]: r for r in manifest.with_manifest(store.files(spark, [str(tmp_path)]).select("path", "content")).collect()}
    assert rows["b.xml"]["manifest"]["activities"] == [".Main"] and rows["b.xml"]["manifest"]["services"] == ["com.acme.bg.Sync"]
    assert rows["b.xml"]["prefix"] == "com.acme" and rows["t.xml"]["prefix"] == "org.x"
    assert rows["z.xml"]["manifest"]["package"] == "" and manifest.parse(None) is None
    if not normalize.is_available():
        with pytest.raises(normalize.NormalizerUnavailable):
            normalize.normalize("a.apk", str(tmp_path))


def test_serve(spark, tmp_path):
    lhs, rhs, _ = fixtures.mutation()
    path = str(tmp_path / "store")
    store.save(store.prepare(classes_from_rows(spark, lhs).withColumn("digest", F.lit("l"))), path)
    store.save(store.prepare(classes_from_rows(spark, rhs).withColumn("digest", F.lit("r"))), path)
    packs = str(tmp_path / "packs")
    entry = lambda d: {"input_index": 0, "descriptor": d}
    requests = [
        {"id": 1, "op": "hello"}, {"id": 2, "op": "load", "params": {"inputs": [{"index": 0, "path": path, "digest": "l"}, {"index": 1, "path": path, "digest": "r"}, {"index": 2, "path": str(tmp_path / "none")}]}},
        {"id": 3, "op": "where", "params": {"descriptors": ["Lcom/acme/app/C7;", "Lcom/acme/app/C0;"]}}, {"id": 4, "op": "describe", "params": entry("Lcom/acme/app/C0;")},
        {"id": 5, "op": "pack.build", "params": {"name": "p", "out_dir": packs, "entries": [entry("Lcom/acme/app/C0;"), entry("Lcom/acme/app/C7;")]}},
        {"id": 6, "op": "pack.match", "params": {"packs": [{"path": f"{packs}/p", "min_instructions": 2, "extra_entries": [{"signature": "zz"}]}, {"path": f"{packs}/absent"}]}},
        {"id": 7, "op": "pack.nearest", "params": {"pack": {"path": f"{packs}/p"}, "classes": [entry("Lcom/acme/app/C7;"), entry("Lno/Such;")], "radius": 0}},
        {"id": 8, "op": "pack.list", "params": {"dir": packs}}, {"id": 9, "op": "nope"}, {"id": 10, "op": "where", "params": []}, {"id": 11, "v": 9, "op": "hello"}, [], {"id": 12, "op": "status"}, {"id": 13, "op": "describe", "params": {"input_index": 5}}, {"id": 14, "op": "shutdown"}, {"id": 15, "op": "hello"},
    ]
    out = io.StringIO()
    serve.run(serve.Session(spark), io.StringIO("not json\n\n" + "\n".join(map(json.dumps, requests))), out)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    got = {x["id"]: x for x in lines if "ok" in x}
    assert lines[0]["error"]["code"] == "bad-json" and 15 not in got and got[14]["ok"]
    assert [r.get("classes") for r in got[2]["result"]["inputs"]] == [8, 8, None]
    assert got[3]["result"]["where"] == {"Lcom/acme/app/C7;": [0], "Lcom/acme/app/C0;": [0, 1]}
    assert got[4]["result"]["duplicates"] == [1] and len(got[4]["result"]["signature"]) == 32
    match = {r["input_index"]: r for r in got[6]["result"]["results"]}
    # C0 and C7 sign alike, so one entry stands for both
    assert match[0]["present"] == 1 and match[0]["tier_1"] == 1 and 0 < match[1]["score"] <= match[0]["score"] < 1
    assert {s["reason"] for s in got[6]["result"]["skipped"]} == {"bad-extra-entry", "bad-pack"}
    assert [(r["entry_id"], r.get("missing", False)) for r in got[7]["result"]["nearest"]] == [(0, False), (None, True)]
    assert got[8]["result"]["packs"][0]["family"] == "p"
    assert [got[i]["error"]["code"] for i in (9, 11, 13)] == ["unknown-op", "bad-version", "unknown-input"]
    assert sum(x.get("event") == "progress" for x in lines) == 4


def test_command_line(spark, tmp_path, capsys):
    lhs, rhs, _ = fixtures.mutation()
    for name, rows in (("l", lhs), ("r", rhs)):
        store.save(store.prepare(classes_from_rows(spark, rows).withColumn("digest", F.lit(name))), str(tmp_path / name))
    l, r = str(tmp_path / "l"), str(tmp_path / "r")
    assert cli.main(["diff", l, r, "-f", "csv", "-o", str(tmp_path / "out"), "-s", "changed", "--app-package", "com.acme.app", "--components-file", str(tmp_path / "c.txt")], spark) == 0
    assert "modified=5" in capsys.readouterr().out
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 7
    assert cli.main(["score", l, r, "--json", "--evidence", "2"], spark) == 0
    assert 0 < json.loads(capsys.readouterr().out)["score"] <= 1
    assert cli.main(["family", "build", l, r, "-o", str(tmp_path / "pack"), "--min-instr", "2", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["entries"] > 0
    assert cli.main(["family", "match", str(tmp_path / "pack"), r, "--min-instr", "2", "--threshold", "0.5"], spark) == 0
    (tmp_path / "m.txt").write_text("com.acme.app.C0 -> com.acme.app.C0:\ncom.acme.app.C7 -> com.acme.app.gone:\n")
    capsys.readouterr()
    assert cli.main(["grade", l, r, "--mapping", str(tmp_path / "m.txt")], spark) == 0
    assert json.loads(capsys.readouterr().out)["tp"] == 1
    assert cli.main(["migrate", l], spark) == 0
    apk(tmp_path / "a.apk", [sample()])
    assert cli.main(["prepare", str(tmp_path / "a.apk"), "-o", str(tmp_path / "s")], spark) == 0
    assert cli.main(["diff", str(tmp_path / "nothing"), r], spark) == 2
    assert reports.default_output("x/a.apk", "b.apk", "json") == "a__vs__b.diff.json"
