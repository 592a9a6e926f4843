"""Scalar functions on columns. All are built-in expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.schema import ACCESS_MASK, COMPARATOR, FRAMEWORK_PREFIXES, GLOBAL_POOL, LIBRARY_PREFIXES, OBFUSCATED_POOL, OPCODE_CATEGORIES, SENSITIVE_COMPONENTS, GENERIC_COMPONENTS, USEFUL_LENGTH

ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """use(value) with the value computed once a row, also inside lambdas, where nothing is shared otherwise."""
    return F.element_at(F.transform(F.array(value), use), 1)


def starts_with_any(x: ColumnOrName, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | col(x).startswith(p)
    return out


# ---- opcodes and methods


def categorize(bytecode: ColumnOrName) -> Column:
    """Opcode bytes as a string of categories, chr(97 + category)."""
    kind = [0] * 256
    for first, last, category in OPCODE_CATEGORIES:
        for b in range(first, last + 1):
            kind[b] = category
    letters = "".join(chr(97 + k) for k in kind)
    return F.translate(F.decode(F.coalesce(col(bytecode), F.lit(b"")), "ISO-8859-1"), "".join(map(chr, range(256))), letters)


def order_key(instr_count: Column, opcode_xor: Column) -> Column:
    return F.shiftleft(instr_count.bitwiseAND(255), 8).bitwiseOR(opcode_xor.bitwiseAND(255))


def total_instructions(methods: ColumnOrName = "methods") -> Column:
    return F.aggregate(col(methods), F.lit(0).cast("long"), lambda n, m: n + m["instr_count"])


def class_info() -> Column:
    return F.concat(F.col("package"), F.lit(": "), F.col("name"), F.lit(" - "), F.coalesce(F.nullif(F.col("source_file"), F.lit("")), F.lit("<unknown>")))


def abstract_sequence(methods: ColumnOrName = "methods") -> Column:
    """Methods' category strings, joined in the stable order of their keys."""
    keyed = F.transform(col(methods), lambda m, i: F.struct(order_key(m["instr_count"], m["opcode_xor"]).alias("key"), i.alias("i"), m["abstract"].alias("abstract")))
    return F.array_join(F.sort_array(keyed)["abstract"], "")


# ---- packages


def entropy(s: ColumnOrName) -> Column:
    """Shannon entropy of a string in bits per character; 0 when empty."""
    letters = F.filter(F.split(col(s), ""), lambda x: x != "")
    n = F.size(letters).cast("double")

    def term(total: Column, letter: Column) -> Column:
        p = F.size(F.filter(letters, lambda x: x == letter)) / n
        return total - p * F.log2(p)

    return F.when(F.length(col(s)) == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_sort(F.array_distinct(letters)), F.lit(0.0), term))


def is_obfuscated_package(package: ColumnOrName, max_segment: int = 3, max_entropy: float = 3.2) -> Column:
    """Empty, or every segment is short and of low entropy."""
    segments = F.filter(F.split(F.coalesce(col(package), F.lit("")), "\\."), lambda x: x != "")
    return F.forall(segments, lambda x: (F.length(x) <= max_segment) & (entropy(x) < max_entropy))


def pool_key(package: ColumnOrName, cluster: bool = True, find_obfuscated: bool = False) -> Column:
    if not cluster:
        return F.lit(GLOBAL_POOL)
    named = F.when(F.coalesce(col(package), F.lit("")) == "", F.lit(OBFUSCATED_POOL)).otherwise(col(package))
    return F.when(is_obfuscated_package(package), F.lit(OBFUSCATED_POOL)).otherwise(named) if find_obfuscated else named


def in_package(package: ColumnOrName, prefix: str) -> Column:
    return (col(package) == prefix) | col(package).startswith(prefix + ".")


# ---- descriptors


def package_of(descriptor: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_extract(col(descriptor), "^L(.*)/[^/]*;$", 1), "/", ".")


def name_of(descriptor: ColumnOrName) -> Column:
    return F.regexp_extract(col(descriptor), "^L(?:.*/)?([^/]*);$", 1)


def parameters(descriptor: ColumnOrName) -> Column:
    """The parameter types of a method descriptor."""
    inner = F.regexp_replace(F.regexp_extract(col(descriptor), "^\\(([^)]*)\\)", 1), " ", "")
    return F.regexp_extract_all(inner, F.lit("\\[*(?:L[^;]*;|[ZBSCIJFDV])"), 0)


def return_type(descriptor: ColumnOrName) -> Column:
    return F.trim(F.regexp_extract(col(descriptor), "\\)(.*)$", 1))


def object_types(descriptor: ColumnOrName) -> Column:
    return F.regexp_extract_all(col(descriptor), F.lit("L[^;]*;"), 0)


def is_framework(descriptor: ColumnOrName) -> Column:
    return starts_with_any(descriptor, FRAMEWORK_PREFIXES)


# The one-letter types and their Java names.
JAVA_TYPES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}


def java_type(descriptor: ColumnOrName) -> Column:
    d = col(descriptor)
    body = F.regexp_replace(d, "^\\[+", "")
    names = F.create_map(*[F.lit(x) for kv in JAVA_TYPES.items() for x in kv])
    base = F.when(body.rlike("^L.*;$"), F.regexp_replace(F.regexp_replace(body, "^L|;$", ""), "/", ".")).otherwise(F.coalesce(F.element_at(names, body), body))
    return F.concat(base, F.repeat(F.lit("[]"), F.length(d) - F.length(body)))


def java_method(name: Column, descriptor: Column) -> Column:
    return F.concat(java_type(return_type(descriptor)), F.lit(" "), name, F.lit("("), F.array_join(F.transform(parameters(descriptor), java_type), ","), F.lit(")"))


def java_field(name: Column, type_desc: Column) -> Column:
    return F.concat(java_type(type_desc), F.lit(" "), name)


def fqcn(package: ColumnOrName = "package", name: ColumnOrName = "name") -> Column:
    return F.concat_ws(".", F.nullif(col(package), F.lit("")), col(name))


# ---- strings


def useful_strings(strings: ColumnOrName = "strings") -> Column:
    """Distinct strings of four characters or more that are not all digits."""
    return F.array_distinct(F.filter(col(strings), lambda s: (F.length(s) >= USEFUL_LENGTH) & ~s.rlike("^\\p{Nd}+$")))


def informative(s: ColumnOrName) -> Column:
    return F.length(F.regexp_replace(col(s), "[^\\p{L}\\p{N}]", "")) >= 2


def top_strings(strings: ColumnOrName, most: int) -> Column:
    """Longest first, then by content."""
    keyed = F.transform(col(strings), lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda x: x["s"])


def shared_strings(a: Column, b: Column) -> Column:
    return top_strings(F.array_intersect(useful_strings(a), useful_strings(b)), 1 << 30)


# ---- similarity


def ratio(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), 1.0).otherwise(1.0 - F.abs(a - b) / F.greatest(a, b, F.lit(1)))


def bag_jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Sum of minima over sum of maxima of two bags (arrays with repeats)."""
    count = lambda bag, key: F.size(F.filter(bag, lambda x: x == key))

    def share(x: Column, y: Column) -> Column:
        both = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, k: n + F.least(count(x, k), count(y, k)))
        either = lambda n: F.when(F.size(x) + F.size(y) == 0, F.lit(empty)).otherwise(n / (F.size(x) + F.size(y) - n))
        return let(both, either)

    # equal arrays are equal bags; nulls equal nothing, so arrays that hold one are counted
    same = lambda x, y: (x == y) & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull())
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.when(same(p["a"], p["b"]), 1.0).otherwise(share(p["a"], p["b"])))


def flag_jaccard(a: Column, b: Column) -> Column:
    x, y = a.bitwiseAND(ACCESS_MASK), b.bitwiseAND(ACCESS_MASK)
    return F.when(x.bitwiseOR(y) == 0, 1.0).otherwise(F.bit_count(x.bitwiseAND(y)) / F.bit_count(x.bitwiseOR(y)))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


SIGNATURE_PARTS = ("cls", "fld", "mth", "code")


def hamming(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for part in SIGNATURE_PARTS:
        out = out + F.bit_count(a[part].bitwiseXOR(b[part]))
    return out


def signature_hex(sig: ColumnOrName = "sig") -> Column:
    return F.format_string("%08x%08x%08x%08x", *[col(sig)[p] for p in SIGNATURE_PARTS])


def signature_from_hex(text: ColumnOrName) -> Column:
    part = lambda i: F.conv(F.substring(col(text), 8 * i + 1, 8), 16, 10).cast("long")
    return F.struct(*[part(i).alias(p) for i, p in enumerate(SIGNATURE_PARTS)])


# ---- predicates of classes


def is_boilerplate() -> Column:
    return F.array_contains("interfaces", COMPARATOR) & (F.size("methods") <= 2)


def is_library() -> Column:
    return starts_with_any("descriptor", LIBRARY_PREFIXES) | F.coalesce(F.contains(F.col("source_file"), F.lit(":")), F.lit(False))


# ---- origin


def dev_prefix(package: str | None) -> str | None:
    """The descriptor prefix of a package given with dots, slashes or as a descriptor."""
    p = (package or "").strip()
    p = p[1:-1] if p.startswith("L") and p.endswith(";") else p
    p = p.replace(".", "/").strip("/")
    return f"L{p}/" if p else None


def dev_prefixes(packages: str | list[str] | tuple[str, ...] | None) -> tuple[str, ...]:
    listed = [packages] if isinstance(packages, str) else list(packages or [])
    return tuple(dict.fromkeys(d for d in map(dev_prefix, listed) if d))


def origin(descriptor: Column, source_file: Column, prefixes: tuple[str, ...] = ()) -> Column:
    return (
        F.when(starts_with_any(descriptor, prefixes), "app")
        .when(F.contains(source_file, F.lit(":")), "library")
        .when(starts_with_any(descriptor, LIBRARY_PREFIXES), "library")
        .otherwise("unknown")
    )


def component_name(code: ColumnOrName) -> Column:
    names = {c: n for c, n in [*SENSITIVE_COMPONENTS.values(), *GENERIC_COMPONENTS.values()]}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), col(code)), col(code))


# ---- names


def looks_obfuscated(simple: Column) -> Column:
    lower = (F.lower(simple) == simple) & simple.rlike("\\p{Ll}")
    return (F.length(simple) <= 2) | ((F.length(simple) <= 3) & lower)


def _identifier(name: Column) -> Column:
    clean = F.regexp_replace(name, "[^A-Za-z0-9_$]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def recovered_head(source_file: Column, name: Column) -> Column:
    """A class' clear simple name: the stem of its source file, else its own outer name, else null."""
    leaf = F.regexp_extract(F.regexp_replace(source_file, "\\\\", "/"), "[^/]*$", 0)
    known = leaf.rlike("(?i)\\.(java|kt|scala|groovy)$")
    stem = _identifier(F.when(known, F.regexp_replace(leaf, "(?i)\\.(java|kt|scala|groovy)$", "")).otherwise(F.regexp_extract(leaf, "^[^.]*", 0)))
    usable = source_file.isNotNull() & ~source_file.isin("", "SourceFile") & ~looks_obfuscated(stem)
    own = _identifier(F.regexp_extract(name, "^[^$]*", 0))
    return F.when(usable, stem).when(~looks_obfuscated(own), own)


def with_head(package: Column, name: Column, head: Column) -> Column:
    """The class' full name with its outer name replaced."""
    return fqcn(package, F.concat(head, F.regexp_extract(name, "\\$.*$", 0)))


def suggested_prefix(package: Column, components: Column) -> Column:
    """The longest dotted prefix that all components share; a sole or whole name loses its last segment."""
    full = F.transform(F.filter(components, lambda c: c != ""), lambda c: F.split(F.when(c.startswith(".") & (package != ""), F.concat(package, c)).otherwise(c), "\\."))
    first = F.element_at(full, 1)
    shortest = F.array_min(F.transform(full, F.size))
    agreed = F.filter(F.sequence(F.lit(1), shortest), lambda i: F.forall(full, lambda s: F.forall(F.sequence(F.lit(1), i), lambda j: F.element_at(s, j) == F.element_at(first, j))))
    n = F.size(agreed)
    kept = F.when(n == F.size(first), n - 1).otherwise(n)
    prefix = F.array_join(F.slice(first, 1, kept), ".")
    return F.when(F.size(full) == 0, package).otherwise(F.when(prefix == "", package).otherwise(prefix))
