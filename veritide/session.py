"""Session helpers: building a local session and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "veritide", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the queries assume (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Rows of an Arrow batch on its way to Python; Spark's own default fits rows of a few numbers, not of long texts.
BATCH_ROWS, _BATCH = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Arrow functions are pickled by reference, so a worker must be able to import the
    package. Spark's own file server carries the archive; no shared folder is assumed.
    """
    if spark.conf.get(_BATCH, "10000") == "10000":  # left as it is if the session sets it
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="veritide-"), "veritide_src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
