"""Session helpers: the shared folder, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset and the
    session is local (as in tests) a temporary folder is set instead.
    """
    d = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="auralake-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        d = "file://" + local
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return os.path.join(shared_dir(spark), "auralake", f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back (survives lost executors)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only after counting that the side has at most ``max_rows`` rows.

    The count stops at ``max_rows + 1`` rows; beyond the bound no hint is given
    and the planner shuffles both sides.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once per context.

    Workers don't inherit the driver's module path; without this they could
    import the package only if it lay on their own.
    """
    sc = spark.sparkContext
    if getattr(sc, "_auralake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="auralake-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "auralake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, dirs, files in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("auralake", os.path.relpath(full, root)))
    sc.addPyFile(path)  # Spark's own file server hands it on
    sc._auralake_shipped = True
