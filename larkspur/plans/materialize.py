"""Cutting lineage through shared storage.

Executors may disappear, so nothing here keeps the only copy of a block on one
machine: ``cut`` writes a reliable checkpoint to the folder the session names
in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a private one only if none is configured.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is left as it
    is.  Without it (unit tests, notebooks in local mode) a fresh temporary
    folder is used; a non-local master without the setting is an error, because
    a folder of the driver's machine would not be visible to the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="larkspur-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of ``df`` (survives the loss of any executor)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
