"""Makes this package importable in the Python workers of a session, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application; returns the session.

    The driver serves the archive to executors that come later too, so it stays until the driver ends.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix=f"{top.name}-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder, f"{top.name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(top.rglob("*.py")):
                out.write(p, p.relative_to(top.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
    return spark
