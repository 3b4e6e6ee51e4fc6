"""Making this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per Spark context.

    Executors that start later fetch the archive from the driver as well, so
    losing one does not break running jobs.
    """
    sc = spark.sparkContext
    if getattr(sc, "_larkspur_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    handle, path = tempfile.mkstemp(prefix="larkspur-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"{root.name}/{file.relative_to(root).as_posix()}")
    sc.addPyFile(path)
    sc._larkspur_shipped = True
