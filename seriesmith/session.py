"""Session helpers: local builder for tests and benchmarks, checkpoint and scratch folders."""

from __future__ import annotations

import atexit
import importlib.metadata
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: str | int = "*", partitions: int = 8, app: str = "seriesmith") -> SparkSession:
    """Local session for tests and benchmarks; a cluster job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SERIESMITH_DRIVER_MEMORY", "12g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a missing setting is an error,
    because a machine-local folder would lose the data together with an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="seriesmith-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers unless it is installed; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    try:
        importlib.metadata.distribution("seriesmith")
        return
    except importlib.metadata.PackageNotFoundError:
        pass
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="seriesmith-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "seriesmith-package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for top, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                inner = os.path.relpath(os.path.join(top, name), os.path.dirname(package))
                archive.write(os.path.join(top, name), inner)
    context.addPyFile(path)  # the driver serves the file to the executors


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and fixes the rows, so a lost executor cannot change them."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str) -> DataFrame:
    """The rows written down like those of ``pin``, as compressed columns of the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written by a job."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
