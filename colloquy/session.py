"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Settings that bound what a Python worker is sent at once: name, Spark's default, ours.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"))


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the Python workers, once a context; Spark's file server carries them.

    Arrow batches are made small enough for long texts, in a session that has Spark's default for their size.
    """
    for name, default, ours in BATCHES:
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)
    context = spark.sparkContext
    if getattr(context, "_colloquy_shipped", False):
        return spark
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="colloquy-py-")) / "colloquy-modules.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, f"colloquy/{source.relative_to(home)}")
    context.addPyFile(str(path))
    context._colloquy_shipped = True
    return spark


def session(app: str = "colloquy", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings as ``key__part="value"``."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(builder.getOrCreate())
