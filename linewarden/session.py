"""Session settings the operators rely on, and the shared folder for cut lineage."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Runtime settings needed for right results: duplicate JSON keys keep the last value.
REQUIRED = {"spark.sql.variant.allowDuplicateKeys": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that results depend on; tuning is left to the caller."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, which every executor can reach.

    The session names it in ``spark.checkpoint.dir``; where that is unset, it lies in the
    warehouse, which is shared as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")
