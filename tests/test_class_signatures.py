"""Signatures of classes by their definition, token by token."""

from math import log2

from kindred.functions.hashing import murmur3
from kindred.operators.simhash import signatures
from kindred.schema import ACCESS_FLAGS, CLASSES, FRAMEWORK_PREFIXES


def plain(c: dict) -> list[int]:
    framework = lambda x: x is not None and x.startswith(FRAMEWORK_PREFIXES)
    tokens = [(0, f"nmethods={len(c['methods'])}", 1.0), (0, f"nfields={len(c['fields'])}", 1.0)]
    tokens += [(0, f"access={n}", 1.0) for bit, n in ACCESS_FLAGS.items() if c["access"] & bit]
    tokens += [(0, f"super={c['superclass']}", 4.0)] if framework(c["superclass"]) else []
    tokens += [(0, f"iface={i}", 3.0) for i in c["interfaces"] if framework(i)]
    for f in c["fields"]:
        tokens += [(1, f"ftype={f[1]}", 1.0), (1, f"fstatic={bool(f[2] & 8)}", 1.0)]
    for m in c["methods"]:
        heavy = log2(2 + m["instr_count"])
        tokens += [(2, f"margs={m['arg_count']}", heavy), (2, f"mret={m['return_type']}", heavy), (2, f"mxref={m['xref_count']}", heavy)]
        tokens += [(3, f"op={ord(x) - 97}", heavy) for x in m["abstract"]] + [(3, f"call={x}", 3 * heavy) for x in m["calls"] if framework(x)]
    out = [0] * 4
    for part in range(4):
        for b in range(32):
            votes = sum(w if murmur3(t.encode()) >> b & 1 else -w for p, t, w in tokens if p == part)
            out[part] |= (votes > 1e-9) << b
    return out


def test_signatures_of_odd_classes(spark):
    method = lambda i, body, calls: {"name": f"m{i}", "descriptor": "()V", "access": 1, "arg_count": i % 3, "return_type": "VIJ"[i % 3], "xref_count": i, "bytecode": b"", "instr_count": i * 7, "opcode_xor": i, "abstract": body, "calls": calls, "instantiates": []}
    kinds = [
        ("Ljava/lang/Object;", ["Ljava/lang/Runnable;", "Lown/Face;"], [("f", "I", 8), ("g", "Lown/A;", 1)], [method(1, "abcb", ["Landroid/a;->b()V", "Lown/x;->y()V"]), method(2, "", []), method(4, "zz", ["Landroid/a;->b()V"] * 3)], 0x4011),
        (None, [], [], [], 0), ("Lown/Base;", ["Lown/Face;"], [("f", "I", 0)] * 3, [method(i, "ab" * i, ["Ljava/x;->y()V"]) for i in range(9)], 1),
    ]
    made = [{"digest": "d", "pos": i, "descriptor": f"L{i};", "package": "", "name": str(i), "source_file": None, "access": a, "is_inner": False, "is_synthetic": False, "is_external": False, "superclass": s, "interfaces": f, "strings": [], "fields": fs, "methods": ms} for i, (s, f, fs, ms, a) in enumerate(kinds * 40)]
    classes = spark.createDataFrame([tuple(c.values()) for c in made], CLASSES)
    signed = signatures(classes)
    assert {r["pos"]: list(r["sig"]) for r in signed.collect()} == {c["pos"]: plain(c) for c in made}
    # tokens are no rows of structs: only the fields that are signed go to Python
    assert "transform(" not in signed._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
