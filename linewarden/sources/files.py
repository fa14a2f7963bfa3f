"""Files tables: preparing and reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.functions.paths import is_listed, manifest
from linewarden.operators.git import CONFIG_PATH


def file_kind(path: Column) -> Column:
    """``git-config``, ``binary`` (not listed), ``manifest`` (in any folder) or ``other``."""
    return (
        F.when(path == CONFIG_PATH, "git-config")
        .when(~is_listed(path), "binary")
        .when(manifest(path, nested=True).isNotNull(), "manifest")
        .otherwise("other")
    )


def write_files(files: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a files table partitioned by ``kind``.

    The dependency and remote analyzers then prune to the partitions that hold their files
    instead of reading the content of the whole corpus again.
    """
    kinds = files.withColumn("kind", file_kind(F.col("path")))
    kinds.hint("rebalance", "kind").write.mode(mode).partitionBy("kind").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
