"""Sessions for this engine."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def session(master: str = "local[*]", name: str = "quirelake", **conf: object) -> SparkSession:
    """A session with the settings that the operators count on: UTC, adaptive plans, Kryo, columnar Arrow transfer."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(name).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, where their PYTHONPATH doesn't hold it."""
    app = spark.sparkContext.applicationId
    held = [str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or str(ROOT.parent) in held:
        return
    # the driver serves this file to the executors; it isn't read from their disks
    path = Path(tempfile.mkdtemp(prefix="quirelake-")) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in ROOT.rglob("*.py"):
            z.write(f, f.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in what driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode, else
    one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = tempfile.mkdtemp(prefix="quirelake-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
