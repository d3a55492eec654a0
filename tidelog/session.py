"""Session settings that every plan here relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; on a cluster the master and the resources come from the submit command."""
    builder = SparkSession.builder.appName("tidelog").config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless they find it where they start: in the working folder or on PYTHONPATH."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(root) in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) or getattr(context, "_tidelog_shipped", False):
        return
    at = Path(tempfile.mkdtemp(prefix="tidelog-")) / "tidelog.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in [*(root / "tidelog").rglob("*.py"), *root.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(root))
    context.addPyFile(str(at))
    context._tidelog_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where none is set, a session inside one
    process makes its own; on a cluster there is an error, as a local folder there would be lost to the other machines."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidelog-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows from the shared folder, computed once: for tables that several parts of a plan read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
