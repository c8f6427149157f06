"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to all workers, once for each application.

    Functions that run in workers are found there by name.  The archive is made on the driver
    and served by Spark, so nothing needs a shared folder or a search path set beforehand.
    """
    sc = spark.sparkContext
    if getattr(sc, "_fieldlark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), "fieldlark.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._fieldlark_shipped = True
