"""One way in for every kind of input: class tables, stores, DEX files and folders, archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources import dex, store


def load(spark: SparkSession, path: str, digest: str | None = None, cache: str | None = None) -> tuple[DataFrame, dict]:
    """(classes, facts) of an input; facts tell kind, digest and whether a cached record served.

    kind: 'store' (a folder of prepared classes; digest picks the sample where it holds several), 'dex',
    'apk'. With `cache`, a folder that is a store, a parsed input is kept there by its digest and reused
    while its layers are fresh; a failure to keep it is not fatal.
    """
    try:
        stored = spark.read.parquet(path)
        if {"digest", "descriptor", "sig"} <= set(stored.columns):
            rows = store.load(spark, path, [digest] if digest else None)
            found = [r["digest"] for r in rows.select("digest").distinct().limit(2).collect()]
            if len(found) != 1:
                raise dex.LoadError(f"{path} holds {'several samples; name a digest' if found else 'no such sample'}")
            return rows, {"kind": "store", "digest": found[0], "from_cache": False}
    except store.StaleStore as e:
        raise dex.LoadError(str(e)) from None
    except dex.LoadError:
        raise
    except Exception as e:
        if not any(x in str(e) for x in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND", "CANNOT_READ_FILE", "FAILED_READ_FILE", "is not a Parquet file")):
            raise
        if "PATH_NOT_FOUND" in str(e):
            raise dex.LoadError(f"no such file: {path}") from None
    files = store.files(spark, [path])
    kind = store.kinds(files.select("path", "content")).select("kind").distinct().limit(5).collect()
    kinds = {r["kind"] for r in kind}
    own = digest or (store.folder_digest(files) if files.count() != 1 else store.digests(files).first()["digest"])
    if cache:
        wanted = spark.createDataFrame([(own,)], "digest string")
        if store.missing(spark, cache, wanted).isEmpty():
            try:
                return store.load(spark, cache, [own]), {"kind": sorted(kinds)[0], "digest": own, "from_cache": True}
            except store.StaleStore:
                pass  # made anew below
    if not kinds & {"dex", "apk"}:
        raise dex.LoadError(f"{path}: no DEX code in it")
    rows, _ = dex.scan_dex(spark, [path], own) if "dex" in kinds else dex.scan_apk(spark, path, own)
    made = store.prepare(rows)
    if cache:
        try:
            store.save(made, cache, "overwrite")
        except Exception as e:  # noqa: BLE001  the cache is a convenience
            spark.sparkContext.setJobDescription(f"cache not written: {e}"[:200])
    return made.withColumn("digest", F.lit(own)), {"kind": "dex" if "dex" in kinds else "apk", "digest": own, "from_cache": False}
