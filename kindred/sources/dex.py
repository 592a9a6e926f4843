"""Class tables from Dalvik executables, by the public DEX format.

`scan_dex` reads files (path, content) with Spark's binaryFile source and parses each on an executor;
a blob that does not parse is reported, not fatal, unless none parses. `scan_apk` opens zip archives
and reads every `classes*.dex` in them. Of equal descriptors the first wins, in the order of files.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.functions import scalars as S
from kindred.operators.grouped import numbered
from kindred.plans.lineage import kept
from kindred.schema import CLASSES, with_positions
from kindred.session import ship


class LoadError(ValueError):
    """An input that cannot be read, in words for the user."""


# Fixed values of the format: an instruction's length in 16-bit units, by stretches of opcodes; others have one.
_LENGTHS = (
    (0x02, 0x02, 2), (0x03, 0x03, 3), (0x05, 0x05, 2), (0x06, 0x06, 3), (0x08, 0x08, 2), (0x09, 0x09, 3), (0x13, 0x13, 2), (0x14, 0x14, 3), (0x15, 0x16, 2),
    (0x17, 0x17, 3), (0x18, 0x18, 5), (0x19, 0x1A, 2), (0x1B, 0x1B, 3), (0x1C, 0x1C, 2), (0x1F, 0x20, 2), (0x22, 0x23, 2), (0x24, 0x26, 3), (0x29, 0x29, 2),
    (0x2A, 0x2C, 3), (0x2D, 0x3D, 2), (0x44, 0x6D, 2), (0x6E, 0x72, 3), (0x74, 0x78, 3), (0x90, 0xAF, 2), (0xD0, 0xE2, 2), (0xFA, 0xFB, 4), (0xFC, 0xFD, 3),
    (0xFE, 0xFF, 2),
)
UNITS = [1] * 256
for _a, _b, _n in _LENGTHS:
    for _i in range(_a, _b + 1):
        UNITS[_i] = _n
INVOKES = {*range(0x6E, 0x73), *range(0x74, 0x79)}
NEW_INSTANCE, CONST_STRING, CONST_STRING_JUMBO = 0x22, 0x1A, 0x1B


def _clean(text: str) -> str:
    """Lone surrogates as \\uXXXX: the JVM's UTF-8 cannot hold them."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


class Dex:
    """The tables of one DEX blob."""

    def __init__(self, data: bytes):
        if data[:4] != b"dex\n" or len(data) < 0x70:
            raise LoadError("not a DEX file")
        self.data = data
        head = struct.unpack_from("<20I", data, 0x20)
        table = lambda i: (head[i], head[i + 1])  # noqa: E731  count and offset
        sizes = {"strings": table(6), "types": table(8), "protos": table(10), "fields": table(12), "methods": table(14), "classes": table(16)}
        n, at = sizes["strings"]
        self.strings = [self._string(o) for o in struct.unpack_from(f"<{n}I", data, at)]
        n, at = sizes["types"]
        self.types = [self.strings[i] for i in struct.unpack_from(f"<{n}I", data, at)]
        n, at = sizes["protos"]
        self.protos = [self._proto(at + 12 * i) for i in range(n)]
        n, at = sizes["fields"]
        self.fields = [(self.types[c], self.strings[name], self.types[t]) for c, t, name in (struct.unpack_from("<HHI", data, at + 8 * i) for i in range(n))]
        n, at = sizes["methods"]
        self.methods = [(self.types[c], self.strings[name], self.protos[p]) for c, p, name in (struct.unpack_from("<HHI", data, at + 8 * i) for i in range(n))]
        n, at = sizes["classes"]
        self.classes = [struct.unpack_from("<8I", data, at + 32 * i) for i in range(n)]

    def uleb(self, at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = self.data[at]
            out |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b < 0x80:
                return out, at

    def _string(self, at: int) -> str:
        _, at = self.uleb(at)
        raw = self.data[at : self.data.index(b"\0", at)].replace(b"\xc0\x80", b"\0")
        text = raw.decode("utf-8", "surrogatepass")
        return _clean(text.encode("utf-16", "surrogatepass").decode("utf-16", "surrogatepass") if re.search("[\ud800-\udfff]", text) else text)

    def _list(self, at: int) -> list[str]:
        if not at:
            return []
        (n,) = struct.unpack_from("<I", self.data, at)
        return [self.types[i] for i in struct.unpack_from(f"<{n}H", self.data, at + 4)]

    def _proto(self, at: int) -> str:
        _, ret, params = struct.unpack_from("<III", self.data, at)
        return f"({''.join(self._list(params))}){self.types[ret]}"

    def code(self, at: int) -> tuple[bytes, list[str], list[str], list[str]]:
        """Opcode bytes, calls, instantiated types and strings of a body; a broken body is empty."""
        ops, calls, made, strings = bytearray(), [], [], []
        try:
            (n,) = struct.unpack_from("<I", self.data, at + 12)
            units = struct.unpack_from(f"<{n}H", self.data, at + 16)
            i = 0
            while i < n:
                unit = units[i]
                op = unit & 0xFF
                if op == 0 and unit >> 8 in (1, 2, 3):  # tables in the code, not instructions
                    kind = unit >> 8
                    size = units[i + 1]
                    i += size * 2 + 4 if kind == 1 else size * 4 + 2 if kind == 2 else ((units[i + 2] | units[i + 3] << 16) * size + 1) // 2 + 4
                    continue
                ops.append(op)
                if op in INVOKES:
                    owner, name, proto = self.methods[units[i + 1]]
                    calls.append(f"{owner}->{name}{proto}")
                elif op == NEW_INSTANCE:
                    made.append(self.types[units[i + 1]])
                elif op == CONST_STRING:
                    strings.append(self.strings[units[i + 1]])
                elif op == CONST_STRING_JUMBO:
                    strings.append(self.strings[units[i + 1] | units[i + 2] << 16])
                i += UNITS[op]
        except (IndexError, struct.error):
            return b"", [], [], []
        return bytes(ops), calls, made, strings

    def rows(self) -> list[dict]:
        """Classes with raw methods; packages, flags and tallies are made by the plan."""
        out = []
        for kind, access, above, faces, source, _, body, _ in self.classes:
            row = {"descriptor": self.types[kind], "access": access, "superclass": None if above == 0xFFFFFFFF else self.types[above], "interfaces": self._list(faces), "source_file": None if source == 0xFFFFFFFF else self.strings[source]}
            fields, methods, strings = [], [], set()
            if body:
                counts, at = [], body
                for _ in range(4):
                    n, at = self.uleb(at)
                    counts.append(n)
                for n in counts[:2]:
                    index = 0
                    for _ in range(n):
                        step, at = self.uleb(at)
                        flags, at = self.uleb(at)
                        index += step
                        _, name, type_desc = self.fields[index]
                        fields.append((name, type_desc, flags))
                for n in counts[2:]:
                    index = 0
                    for _ in range(n):
                        step, at = self.uleb(at)
                        flags, at = self.uleb(at)
                        code, at = self.uleb(at)
                        index += step
                        _, name, proto = self.methods[index]
                        ops, calls, made, said = self.code(code) if code else (b"", [], [], [])
                        strings |= set(said)
                        xor = 0
                        for b in ops:
                            xor ^= b
                        methods.append((name, proto, flags, ops, len(ops), xor, calls, made))
            out.append(row | {"fields": fields, "methods": methods, "strings": sorted(strings)})
        return out


_RAW = (
    "blob int, cls int, ok boolean, error string, descriptor string, access int, superclass string, interfaces array<string>, source_file string, "
    "fields array<struct<name:string,type_desc:string,access:int>>, "
    "methods array<struct<name:string,descriptor:string,access:int,bytecode:binary,instr_count:int,opcode_xor:int,calls:array<string>,instantiates:array<string>>>, strings array<string>"
)
_NAMES = ("descriptor", "access", "superclass", "interfaces", "source_file", "fields", "methods", "strings")


def _parsed(blobs: DataFrame) -> DataFrame:
    """(digest, nth, blob, ...) raw classes of (digest, nth, path, content); one blob is parsed in one task."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(blobs.sparkSession)
    schema = StructType([*blobs.select("digest", "nth").schema.fields, *StructType.fromDDL(_RAW).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for digest, nth, path, content in zip(*(batch.column(c).to_pylist() for c in ("digest", "nth", "path", "content"))):
                found = [(0, content)]
                if content[:4] == b"PK\x03\x04":
                    try:
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            names = sorted((n for n in z.namelist() if re.fullmatch(r"classes\d*\.dex", n)), key=lambda n: (len(n), n))
                            found = [(i, z.read(n)) for i, n in enumerate(names)]
                    except zipfile.BadZipFile:
                        found = [(0, b"")]
                out = []
                for i, blob in found:
                    base = {"digest": digest, "nth": nth, "blob": i}
                    try:
                        out += [base | {"cls": k, "ok": True} | r for k, r in enumerate(Dex(blob).rows())]
                    except (LoadError, IndexError, ValueError, struct.error, UnicodeError) as e:
                        out.append(base | {"cls": 0, "ok": False, "error": f"{path}: {e}"})
                cols = []
                for f in arrow:
                    values = [r.get(f.name) for r in out]
                    if f.name in ("fields", "methods"):
                        keys = [x.name for x in f.type.value_type]
                        values = [None if v is None else [dict(zip(keys, x)) for x in v] for v in values]
                    cols.append(pa.array(values, f.type))
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return blobs.select("digest", "nth", "path", "content").mapInArrow(run, schema)


#: Builds whose first places are broadcast.
MOST_DIGESTS = 100_000


def assemble(raw: DataFrame) -> DataFrame:
    """Class rows of raw ones (digest, nth, blob, cls, descriptor, ...): first wins, names split, calls tallied."""
    # places are counted over sorted ranges: a window a digest would hold a whole build in one task
    rows = numbered(raw.where("ok"), ["digest", "nth", "blob", "cls"], "_n", kept)
    starts = rows.groupBy("digest").agg(F.min("_n").alias("_start"))
    few = starts.limit(MOST_DIGESTS + 1).count() <= MOST_DIGESTS
    rows = rows.join(F.broadcast(starts) if few else starts, rows["digest"].eqNullSafe(starts["digest"])).drop(starts["digest"])
    rows = with_positions(rows.withColumn("pos", (F.col("_n") - F.col("_start") + 1).cast("int")).drop("_n", "_start"))
    tally = rows.select("digest", F.explode(F.flatten(F.transform("methods", lambda m: m["calls"]))).alias("ref")).groupBy("digest", "ref").agg(F.count("*").cast("int").alias("n"))
    own = rows.select("digest", "descriptor", F.explode(F.transform("methods", lambda m: F.concat(F.col("descriptor"), F.lit("->"), m["name"], m["descriptor"]))).alias("ref"))
    known = own.join(tally, ["digest", "ref"]).groupBy("digest", "descriptor").agg(F.map_from_entries(F.collect_set(F.struct("ref", "n"))).alias("_known"))
    rows = rows.join(known, ["digest", "descriptor"], "left")

    def method(m):
        ref = F.concat(F.col("descriptor"), F.lit("->"), m["name"], m["descriptor"])
        count = F.coalesce(F.try_element_at(F.col("_known"), ref), F.lit(0))
        return F.struct(
            m["name"].alias("name"), m["descriptor"].alias("descriptor"), m["access"].alias("access"), F.size(S.parameters(m["descriptor"])).alias("arg_count"), S.return_type(m["descriptor"]).alias("return_type"),
            count.alias("xref_count"), m["bytecode"].alias("bytecode"), m["instr_count"].alias("instr_count"), m["opcode_xor"].alias("opcode_xor"), F.lit(None).cast("string").alias("abstract"),
            m["calls"].alias("calls"), m["instantiates"].alias("instantiates"),
        )

    out = rows.select(
        "digest", "pos", "descriptor", S.package_of("descriptor").alias("package"), S.name_of("descriptor").alias("name"), "source_file", "access",
        F.contains(S.name_of("descriptor"), F.lit("$")).alias("is_inner"), (F.col("access").bitwiseAND(0x1000) != 0).alias("is_synthetic"),
        F.forall("methods", lambda m: m["instr_count"] == 0).alias("is_external"), "superclass", "interfaces", "strings", "fields", F.transform("methods", method).alias("methods"),
    )
    return out.to(rows.sparkSession.createDataFrame([], CLASSES).schema)


def scan(spark: SparkSession, paths: list[str], digest: str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, failures): the classes of all DEX blobs of files or folders as one build; failures (error).

    Raises LoadError if there is no file, or no blob parses.
    """
    from kindred.plans.lineage import cut
    from kindred.sources.store import files

    try:
        found = files(spark, paths, glob).withColumn("digest", F.lit(digest))
        raw = cut(_parsed(found))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise LoadError(f"no such file: {', '.join(paths)}") from None
        raise
    if raw.where("ok").isEmpty():
        first = raw.select("error").first()
        raise LoadError(f"nothing to read in {', '.join(paths)}" + (f" ({first['error']})" if first else ""))
    return assemble(raw), raw.where("not ok").select("error")


def scan_dex(spark: SparkSession, paths: list[str], digest: str) -> tuple[DataFrame, DataFrame]:
    """DEX files and folders of them; explicit files may have any extension."""
    folders = [p for p in paths if _is_folder(spark, p)]
    return scan(spark, paths, digest, "*.dex" if folders == paths else None)


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asks the path's file system; a path that is not there, or a pattern, is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(conf)
    return bool(system.exists(where) and system.getFileStatus(where).isDirectory())


def scan_apk(spark: SparkSession, path: str, digest: str) -> tuple[DataFrame, DataFrame]:
    return scan(spark, [path], digest)
