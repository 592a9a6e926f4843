"""Session helpers: a local session for scripts, and this package shipped to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, by a zip that Spark serves to executors."""
    context = spark.sparkContext
    if getattr(context, "_kindred_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="kindred-src-")
    archive = os.path.join(folder, "kindred_src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, Path("kindred") / path.relative_to(_PACKAGE))
    context.addPyFile(archive)
    context._kindred_shipped = True


def local_session(cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session in UTC, with adaptive execution on."""
    build = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        build = build.config(key, value)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
