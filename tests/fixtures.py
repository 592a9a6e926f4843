"""Class tables for tests: the labelled mutation and small builds."""

from __future__ import annotations

LOG = "Landroid/util/Log;->d(Ljava/lang/String;Ljava/lang/String;)I"
URI = "Landroid/net/Uri;->parse(Ljava/lang/String;)Landroid/net/Uri;"
BUNDLE = "Landroid/os/Bundle;-><init>()V"
TOAST = "Landroid/widget/Toast;->show()V"


def method(name: str, instr: int, calls: tuple = (), **more) -> dict:
    code = bytes([0x12 + sum(map(ord, name)) % 6]) * (instr - 1) + b"\x0e"
    return {"name": name, "bytecode": code, "instr_count": instr, "calls": list(calls)} | more


def cls(name: str, methods: list, strings: tuple = (), **more) -> dict:
    return {"descriptor": f"Lcom/acme/app/{name};", "methods": methods, "strings": list(strings), "superclass": "Ljava/lang/Object;"} | more


def mutation() -> tuple[list[dict], list[dict], dict[str, str]]:
    """Both builds of the labelled mutation, and the kind of change expected of each class."""
    init = method("<init>", 4)
    lhs = {
        "C0": ([init, method("run", 8, (LOG,))], "anchor_c0_qwerty"),
        "C1": ([init, method("run", 9, (LOG, URI))], "anchor_c1_asdfgh"),
        "C2": ([init, method("load", 7, (BUNDLE,))], "anchor_c2_zxcvbn"),
        "C3": ([init, method("op", 7, (LOG,))], "anchor_c3_poiuyt"),
        "C4": ([init, method("compute", 6), method("helper", 5)], "anchor_c4_lkjhgf"),
        "C5": ([init, method("work", 8, (TOAST,))], "anchor_c5_mnbvcx"),
        "C6": ([init, method("noop", 5)], "anchor_c6_rtyuio"),
        "C7": ([init, method("gone", 7, (LOG,))], "anchor_c7_wertyu"),
    }
    rhs = dict(lhs)
    rhs["C0"] = ([init, method("run", 8, (LOG, TOAST))], lhs["C0"][1])
    rhs["C1"] = ([init, method("run", 9, (LOG,))], lhs["C1"][1])
    rhs["C3"] = ([*lhs["C3"][0], method("added", 6, (URI,))], lhs["C3"][1])
    rhs["C4"] = (lhs["C4"][0][:2], lhs["C4"][1])
    work = lhs["C5"][0][1]
    rhs["C5"] = ([init, work | {"bytecode": b"\x6e\x90" + work["bytecode"][2:], "opcode_xor": None}], lhs["C5"][1])
    del rhs["C7"]
    left = [cls(n, m, (s,)) for n, (m, s) in lhs.items()]
    right = [cls(n, m, (s, "brand_new_feature_flag") if n == "C2" else (s,)) for n, (m, s) in rhs.items()]
    body = [method(f"n{i}", 10 + i, descriptor=f"({'I' * i})V", arg_count=i) for i in range(5)]
    right.append(cls("C8", body, ("brand_new_class_c8",), fields=[{"name": "x", "type_desc": "J"}, {"name": "y", "type_desc": "[I"}]))
    kinds = {"C0": "modified", "C1": "modified", "C2": "modified", "C3": "modified", "C4": "modified", "C5": "cosmetic", "C6": "unchanged", "C7": "removed", "C8": "added"}
    return left, right, kinds
