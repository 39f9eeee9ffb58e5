"""Tables written to the folder that driver and executors share, to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where Spark runs in one process without that setting."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="colloquy-")
    return shared_dir.own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, which ``clear_scratch`` knows of."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_colloquy_scratch", []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this context has staged, once no table that was made from it is needed any more; returns how many places."""
    context = spark.sparkContext
    paths = context.__dict__.get("_colloquy_scratch", [])
    for name in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(name)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    n = len(paths)
    paths.clear()
    return n


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it again. Lost executors cost nothing then, and the planner knows the true size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_with(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``staged``, and aggregates of the rows written, found on the way.

    Rows of a stage that runs again may count twice: use them to tell none from some, or sizes roughly.
    """
    seen = Observation()
    out = staged(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), label)
    return out, seen.get
