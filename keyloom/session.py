"""Session defaults, and shipping the package to executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Applied where the cluster sets nothing itself.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf names use _ for the dots."""
    builder = SparkSession.builder.appName("keyloom")
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_keyloom_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="keyloom-package-")  # executors fetch the file from the driver, also late
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/keyloom_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    context.addPyFile(path)
    context._keyloom_shipped = True
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed and checkpointed to the shared folder that spark.checkpoint.dir names; only with a local master,
    and without that setting, to a local one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="keyloom-checkpoints-"))
    return df.checkpoint()
