"""Manifests: binary or plain XML to package and components, and the development prefix they suggest."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.scalars import suggested_prefix

LISTS = {"activity": "activities", "service": "services", "receiver": "receivers", "provider": "providers"}
SCHEMA = "struct<package:string,activities:array<string>,services:array<string>,receivers:array<string>,providers:array<string>>"
_ANDROID = "{http://schemas.android.com/apk/res/android}"


def _binary(data: bytes) -> list[tuple[str, dict[str, str]]]:
    """(tag, attributes) of the start tags of binary XML; attribute names come without a namespace."""
    strings, out, at = [], [], 8
    while at + 8 <= len(data):
        kind, head, size = struct.unpack_from("<HHI", data, at)
        if size < 8:
            break
        if kind == 1:  # the string pool
            n, _, flags, start = struct.unpack_from("<IIII", data, at + 8)
            for o in struct.unpack_from(f"<{n}I", data, at + 28):
                p = at + start + o
                if flags & 0x100:
                    p += 2 if data[p] & 0x80 else 1
                    length = (data[p] & 0x7F) << 8 | data[p + 1] if data[p] & 0x80 else data[p]
                    p += 2 if data[p] & 0x80 else 1
                    strings.append(data[p : p + length].decode("utf-8", "replace"))
                else:
                    (length,) = struct.unpack_from("<H", data, p)
                    strings.append(data[p + 2 : p + 2 + 2 * length].decode("utf-16-le", "replace"))
        elif kind == 0x102:  # a start tag
            name, start, width, n = struct.unpack_from("<4xIHHH", data, at + 16)
            attributes = {}
            for i in range(n):
                _, key, raw = struct.unpack_from("<III", data, at + 16 + start + i * width)
                attributes[strings[key]] = strings[raw] if raw != 0xFFFFFFFF else ""
            out.append((strings[name], attributes))
        at += size
    return out


def parse(data: bytes | None) -> dict | None:
    """Package and component names; a list that cannot be read is empty, no manifest at all is null."""
    if not data:
        return None
    if data[:4] == b"PK\x03\x04":  # an archive: the manifest within
        try:
            data = zipfile.ZipFile(io.BytesIO(data)).read("AndroidManifest.xml")
        except (KeyError, zipfile.BadZipFile):
            return None
    out: dict = {"package": ""} | {v: [] for v in LISTS.values()}
    try:
        if data[:4] == b"\x03\x00\x08\x00":
            tags = _binary(data)
        else:
            tags = [(e.tag, {k.removeprefix(_ANDROID): v for k, v in e.attrib.items()}) for e in ET.fromstring(data).iter()]
    except (ET.ParseError, struct.error, IndexError):
        return out
    for tag, attributes in tags:
        if tag == "manifest":
            out["package"] = attributes.get("package", "")
        elif tag in LISTS and attributes.get("name"):
            out[LISTS[tag]].append(attributes["name"])
    return out


def with_manifest(files: DataFrame) -> DataFrame:
    """(path, manifest, prefix) of manifests, or of archives that hold one, (path, content): the parsed struct and the suggested development prefix."""
    read = F.udf(parse, SCHEMA)  # one call a file
    rows = files.select("path", read("content").alias("manifest"))
    m = F.col("manifest")
    return rows.withColumn("prefix", suggested_prefix(m["package"], F.concat(m["activities"], m["services"], m["receivers"], m["providers"])))
