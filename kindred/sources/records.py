"""Prepared records of other tools' stores as class tables: packed ones and JSON ones.

A packed record is a magic, a layout version, and a deflated payload: three stamps of 8 bytes, the digest,
the kind of input, flags, a table of strings, the manifest where there is one, and the classes, whose strings are
places in the table. The layout of a class is declared below as a table of fields and read by it. JSON records spell
the same out; the first layout has one stamp for all layers, which does not say what is stale.

Spark's binaryFile reads the files, whatever store they are in; a file's classes are decoded in the task that
read it, and emitted in batches.
"""

from __future__ import annotations

import base64
import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kindred.schema import CLASSES, SIGNATURE
from kindred.session import ship
from kindred.sources.store import StaleStore

# Fixed values of the packed layout.
MAGIC, LAYOUT = b"TFR", 2
INPUT_KINDS = ("apk", "dex", "dex-dir")
#: By field: a number, a string of the table, an optional one (0 is none), a list of strings, raw bytes with their
#: length, so many bytes, or a list of items with fields of their own. Names after _ are taken apart further on.
METHOD_LAYOUT = (
    ("name", "string"), ("descriptor", "string"), ("access", "number"), ("arg_count", "number"), ("return_type", "string"), ("xref_count", "number"),
    ("instr_count", "number"), ("opcode_xor", "number"), ("calls", "strings"), ("instantiates", "strings"), ("abstract", "raw"),
)
FIELD_LAYOUT = (("name", "string"), ("type_desc", "string"), ("access", "number"))
CLASS_LAYOUT = (
    ("descriptor", "string"), ("package", "string"), ("name", "string"), ("source_file", "optional"), ("superclass", "optional"), ("access", "number"),
    ("_flags", 1), ("_signature", 16), ("interfaces", "strings"), ("strings", "strings"), ("fields", FIELD_LAYOUT), ("methods", METHOD_LAYOUT),
)
MANIFEST_LAYOUT = (("package", "string"), ("activities", "strings"), ("services", "strings"), ("receivers", "strings"), ("providers", "strings"))
FLAGS = ("is_inner", "is_synthetic", "is_external")
STAMPS = ("extraction_stamp", "abstract_stamp", "signature_stamp")
SCHEMA = f"path string, {CLASSES}, sig {SIGNATURE}, input_kind string, normalized boolean, {', '.join(f'{s} string' for s in STAMPS)}"
BATCH = 2000


class _Payload:
    def __init__(self, data: bytes):
        self.data, self.at, self.table = data, 0, []

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("a record ends too early")
        self.at += n
        return out

    def number(self) -> int:
        """Seven bits a byte, the lowest first; the top bit says that more follow."""
        out = shift = 0
        more = True
        while more:
            (byte,) = self.take(1)
            out |= (byte & 0x7F) << shift
            shift, more = shift + 7, byte > 0x7F
        return out

    def value(self, kind):
        match kind:
            case int():
                return self.take(kind)
            case "number":
                return self.number()
            case "string":
                return self.table[self.number()]
            case "optional":
                place = self.number()
                return self.table[place - 1] if place else None
            case "strings":
                return [self.table[self.number()] for _ in range(self.number())]
            case "raw":
                return self.take(self.number())
            case _:
                return [self.item(kind) for _ in range(self.number())]

    def item(self, layout) -> dict:
        return {name: self.value(kind) for name, kind in layout}


def _letters(categories: bytes) -> str:
    """Categories as this library keeps them: a letter each."""
    return "".join(chr(97 + c) for c in categories)


def _text(raw: bytes) -> str:
    """Lone surrogates, which strings of classes may hold, become replacement characters: a table's strings are UTF-8."""
    return raw.decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def packed_rows(data: bytes):
    """(what holds for the record, its classes one by one) of a packed record."""
    if data[:3] != MAGIC:
        raise ValueError("not a packed record")
    if data[3] != LAYOUT:
        raise StaleStore(f"layout {data[3]} of a packed record is not read; prepare its sample again")
    own = _Payload(zlib.decompress(data[4:]))
    head = {name: own.take(8).hex() for name in STAMPS}
    head["digest"] = own.take(own.number()).decode()
    head["input_kind"] = INPUT_KINDS[own.take(1)[0]]
    flags = own.take(1)[0]
    head["normalized"] = bool(flags & 1)
    own.table = [_text(own.take(own.number())) for _ in range(own.number())]
    if flags & 2:
        own.item(MANIFEST_LAYOUT)

    def classes():
        for _ in range(own.number()):
            row = own.item(CLASS_LAYOUT)
            bits, sig = row.pop("_flags")[0], row.pop("_signature")
            row |= {name: bool(bits >> i & 1) for i, name in enumerate(FLAGS)}
            yield row | {"_sig": [int.from_bytes(sig[k : k + 4], "big") for k in range(0, 16, 4)]}

    return head, classes()


def json_rows(data: bytes):
    """The same of a JSON record. One of the first layout has its one stamp, marked, in place of all three."""
    doc = json.loads(data)
    old = f"legacy:{doc.get('algo_version')}"
    head = {stamp: doc.get(stamp.removesuffix("_stamp") + "_version", old) for stamp in STAMPS}
    head |= {name: doc[name] for name in ("digest", "input_kind", "normalized")}
    keep = lambda item, layout: {name: item[name] for name, kind in layout if not isinstance(kind, tuple) and name[0] != "_"}

    def classes():
        for c in doc["classes"]:
            row = keep(c, CLASS_LAYOUT) | {name: c[name] for name in FLAGS}
            row["fields"] = [keep(f, FIELD_LAYOUT) for f in c["fields"]]
            row["methods"] = [keep(m, METHOD_LAYOUT) | {"abstract": base64.b64decode(m["abstract"])} for m in c["methods"]]
            yield row | {"_sig": c["signature"]}

    return head, classes()


def read_records(spark: SparkSession, paths: list[str] | str, stamps: dict[str, str] | None = None) -> DataFrame:
    """Class rows (path, the columns of a class table, sig, input_kind, normalized and the three stamps) of record files.

    stamps names what layers must have been made with; a record with others is refused. A file that is no
    record, or is cut short, fails its task with the file's name.
    """
    ship(spark)
    target = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                try:
                    head, classes = (json_rows if data[:1] == b"{" else packed_rows)(data)
                    rows = []
                    for pos, row in enumerate(classes):
                        for m in row["methods"]:
                            m["abstract"], m["bytecode"] = _letters(m["abstract"]), b""
                        sig = dict(zip(("cls", "fld", "mth", "code"), row.pop("_sig")))
                        rows.append(row | head | {"path": path, "pos": pos, "sig": sig})
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema=target)
                            rows = []
                except (ValueError, KeyError, IndexError, zlib.error) as e:
                    raise ValueError(f"{path}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")
    rows = files.mapInArrow(decode, SCHEMA)
    if stamps:
        flags = rows.agg(*[F.max((F.col(n) != s).cast("int")).alias(n) for n, s in stamps.items()]).first()
        if stale := [n.removesuffix("_stamp") for n in stamps if flags[n]]:
            raise StaleStore(f"stale layers {', '.join(stale)}; {'sign the classes again' if stale == ['signature'] else 'prepare the samples again'}")
    return rows
