"""The entity model: nested class rows, options, and the constants that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELD = "struct<name:string,type_desc:string,access:int>"
METHOD = (
    "struct<name:string,descriptor:string,access:int,arg_count:int,return_type:string,xref_count:int,"
    "bytecode:binary,instr_count:int,opcode_xor:int,abstract:string,calls:array<string>,instantiates:array<string>>"
)
#: One row per class; pos is its place in its build after the first-wins union.
CLASSES = (
    "digest string, pos int, descriptor string, package string, name string, source_file string, access int, "
    "is_inner boolean, is_synthetic boolean, is_external boolean, superclass string, interfaces array<string>, "
    f"strings array<string>, fields array<{FIELD}>, methods array<{METHOD}>"
)
SIGNATURE = "struct<cls:bigint,fld:bigint,mth:bigint,code:bigint>"

# Fixed values that results must share with other readers of the same data.
FRAMEWORK_PREFIXES = ("Landroid/", "Landroidx/", "Ljava/", "Ljavax/", "Lkotlin/", "Lkotlinx/")
LIBRARY_PREFIXES = (
    "Landroid/", "Landroidx/", "Ljava/", "Ljavax/", "Lkotlin/", "Lkotlinx/", "Lcom/google/", "Lcom/fasterxml/", "Lavro/", "Lokhttp3/",
    "Lokio/", "Lretrofit2/", "Lcom/squareup/", "Lio/grpc/", "Lio/reactivex/", "Lio/sentry/", "Ldagger/", "Lorg/", "Lcom/bumptech/",
    "Lcom/facebook/", "Lcom/jakewharton/",
)
OBJECT = "Ljava/lang/Object;"
COMPARATOR = "Ljava/util/Comparator;"
#: Access bits with a name; others are ignored.
ACCESS_FLAGS = {
    0x1: "PUBLIC", 0x2: "PRIVATE", 0x4: "PROTECTED", 0x8: "STATIC", 0x10: "FINAL", 0x20: "SYNCHRONIZED", 0x40: "VOLATILE", 0x80: "TRANSIENT",
    0x100: "NATIVE", 0x200: "INTERFACE", 0x400: "ABSTRACT", 0x800: "STRICT", 0x1000: "SYNTHETIC", 0x2000: "ANNOTATION", 0x4000: "ENUM",
    0x10000: "CONSTRUCTOR", 0x20000: "DECLARED_SYNCHRONIZED",
}
ACCESS_MASK = 0x37FFF
#: First and last opcode of each stretch and its category; opcodes in none are category 0.
OPCODE_CATEGORIES = (
    (0x01, 0x0D, 11), (0x0E, 0x11, 2), (0x12, 0x19, 12), (0x1A, 0x1B, 10), (0x1F, 0x20, 6), (0x21, 0x21, 9), (0x23, 0x26, 9), (0x27, 0x2C, 2),
    (0x2D, 0x31, 3), (0x32, 0x3D, 1), (0x44, 0x51, 9), (0x52, 0x5F, 8), (0x60, 0x6D, 7), (0x6E, 0x72, 4), (0x74, 0x78, 4), (0x7B, 0x80, 5),
    (0x81, 0x8F, 6), (0x90, 0xE2, 5), (0xFA, 0xFD, 4),
)
SENSITIVE_COMPONENTS = {
    "Landroid/service/notification/NotificationListenerService;": ("BNL", "BindNotificationListener"),
    "Landroid/accessibilityservice/AccessibilityService;": ("BAS", "BindAccessibilityService"),
    "Landroid/app/admin/DeviceAdminReceiver;": ("BDA", "BindDeviceAdmin"),
    "Landroid/inputmethodservice/InputMethodService;": ("BIM", "BindInputMethod"),
    "Landroid/service/autofill/AutofillService;": ("BAF", "BindAutofill"),
    "Landroid/telephony/SmsMessage;": ("SMS", "SmsHandling"),
}
GENERIC_COMPONENTS = {
    "Landroid/app/Service;": ("SVC", "Service"),
    "Landroid/content/BroadcastReceiver;": ("RCV", "BroadcastReceiver"),
    "Landroid/content/ContentProvider;": ("PRV", "ContentProvider"),
    "Landroid/app/Application;": ("APP", "Application"),
}
LSH_SEED, LSH_TABLES, LSH_BITS = 0xA9C1D, 16, 16
SCORE_WEIGHTS = {"bytecode": 0.6, "features": 0.4, "method_bytecode": 0.7, "method_proto": 0.2, "method_xref": 0.1}
METHOD_FLOOR, ANCHOR_FLOOR, CALL_SITE_FLOOR = 0.4, 0.5, 0.15
FRAMEWORK_WEIGHT, HIERARCHY_WEIGHT, USEFUL_LENGTH = 0.25, 1.0, 4
MAX_REFS, MAX_ROUNDS, TOP_K, MAX_FRONTIER = 32, 25, 3, 50_000
HUNGARIAN_LIMIT = 100
BUILD_RADIUS, MATCH_RADIUS, LIBRARY_RADIUS, NEAREST_RADIUS = 4, 12, 4, 32
MIN_MINED_INSTRUCTIONS, MIN_LIBRARY_CLASSES, MAX_ENTRY_STRINGS, MEDOID_SAMPLE = 20, 5, 32, 256
OBFUSCATED_POOL, GLOBAL_POOL = "__obfuscated__", "__global__"
REPORT_SCHEMA = 3


@dataclass(frozen=True)
class DiffOptions:
    """Knobs of a diff. `buckets` is the number of LSH tables."""

    inner_skipping: bool = False
    external_skipping: bool = False
    synthetic_skipping: bool = True
    skip_boilerplate: bool = True
    find_obfuscated_packages: bool = False
    min_inst_size_threshold: int = 2
    top_match_threshold: int = TOP_K
    buckets: int = LSH_TABLES
    probe_radius: int = 0
    jobs: int = 1
    use_source_file: bool = False
    use_strings: bool = False
    cluster: bool = True
    anchoring: bool = True
    propagation: bool = True
    assignment: str = "auto"
    progress: bool = False
    #: Free classes a side beyond which type references are left out of a round; MAX_FRONTIER as other readers have it.
    max_frontier: int | None = None

    @classmethod
    def from_dict(cls, raw: dict | None) -> DiffOptions:
        """Unknown keys are ignored."""
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (raw or {}).items() if k in names})


def classes_from_rows(spark, rows: list[dict]) -> DataFrame:
    """A class table from plain dicts; what a dict leaves out takes the fixture defaults."""
    method = {"name": "m", "descriptor": "()V", "access": 1, "arg_count": 0, "return_type": "V", "xref_count": 0, "bytecode": b"\x0e", "instr_count": 0, "opcode_xor": None, "abstract": None, "calls": [], "instantiates": []}
    out = []
    for i, r in enumerate(rows):
        body = r["descriptor"][1:-1]
        package, _, name = body.rpartition("/")
        methods = []
        for m in r.get("methods", []):
            m = method | m
            m["instr_count"] = m["instr_count"] or len(m["bytecode"])
            if m["opcode_xor"] is None:
                m["opcode_xor"] = 0
                for b in m["bytecode"]:
                    m["opcode_xor"] ^= b
            m["bytecode"] = bytearray(m["bytecode"])
            methods.append(m)
        fields_ = [{"name": "f", "type_desc": "I", "access": 1} | f for f in r.get("fields", [])]
        base = {"digest": "d", "pos": i, "package": package.replace("/", "."), "name": name, "source_file": None, "access": 1, "is_inner": "$" in name, "is_synthetic": False, "is_external": False, "superclass": None, "interfaces": [], "strings": []}
        out.append(base | {k: v for k, v in r.items() if k not in ("methods", "fields")} | {"methods": methods, "fields": fields_})
    names = [c.strip().split(" ")[0] for c in "digest,pos,descriptor,package,name,source_file,access,is_inner,is_synthetic,is_external,superclass,interfaces,strings,fields,methods".split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in out], CLASSES)


def with_positions(classes: DataFrame) -> DataFrame:
    """First-wins union of a build's parts: of equal descriptors the least pos stays."""
    from pyspark.sql import Window

    first = Window.partitionBy("digest", "descriptor").orderBy("pos")
    return classes.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
