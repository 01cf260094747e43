"""Session helpers: building a local session, shipping the package to executors, shared folders."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "kestrelq", **conf: str) -> SparkSession:
    """A local session for tests, the CLI and the benchmark; on a cluster the caller brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors, through Spark's own file distribution, where it is not on their path."""
    root = str(PACKAGE.parent)
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    sc = spark.sparkContext
    if root in paths or getattr(sc, "_kestrelq_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), "kestrelq.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(target)
    sc._kestrelq_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only where all run in one process one is made here."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="kestrelq-shared-")
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")
