"""Session settings and code shipping."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def build(app: str = "sparkgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package, once per Spark context, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_sparkgauge_shipped", False):
        path = os.path.join(tempfile.mkdtemp(prefix="sparkgauge-code-"), "sparkgauge.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(ROOT.rglob("*.py")):
                z.write(f, f"sparkgauge/{f.relative_to(ROOT)}")
        context.addPyFile(path)
        context._sparkgauge_shipped = True
    return spark
