"""The package's source on executors that don't have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Gives the executors this package's source, once for each application; without a session, those of the active one."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lexiforge-source-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it from the driver at any time
    path = f"{folder}/lexiforge-source.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
