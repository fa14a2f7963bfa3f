"""Exact deduplication as a stream with disk-backed keyed state.

The stream keeps, per SHA-256 of the normalised text, one state row without expiry: how many rows
had it, the row that stays (longest text, then smallest id) and where that row's content lies.
The state is RocksDB's, so it may outgrow memory; its files are in the query's checkpoint folder,
so a later run over new files goes on from it and a lost executor restores it.  The state is read
back as a table.  Where a digest was hit more than once, the full normalised bytes of its rows are
compared; rows that differ under one digest form groups of their own.

Defined cases: a null text counts as empty; all empty texts form one group; rows that repeat a
``doc_id`` count each and share the verdict of their id; a null ``doc_id`` stays only where no
other row of its group has as many code points; further columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, new_path, text_or_empty, written

#: Rows of one digest that a task compares at once.
COMPARED_TOGETHER = 2000

_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # without it, each state partition takes megabytes of disk before it holds a row
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(text, SPACE + "+", "")


def digested(docs: DataFrame) -> DataFrame:
    """``doc_id``, code points, digest of the normalised text, and the normalised text."""
    norm = docs.select(
        F.col("doc_id"),
        F.length(text_or_empty()).alias("points"),
        normalised(text_or_empty()).alias("norm"),
    )
    return norm.withColumn("text_sha256", F.sha2("norm", 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def update_state(stream: DataFrame, checkpoint: str, locator: Column | None = None) -> None:
    """Take every row that the stream holds now into the state at ``checkpoint``."""
    where = F.lit(None).cast("string") if locator is None else locator
    rows = stream.select(
        F.sha2(normalised(text_or_empty()), 256).alias("text_sha256"),
        # ~doc_id falls as doc_id rises and, unlike -doc_id, never overflows
        F.struct(
            F.length(text_or_empty()).alias("points"),
            F.bitwise_not("doc_id").alias("inverted_id"),
            where.alias("locator"),
        ).alias("row"),
    )
    state = rows.groupBy("text_sha256").agg(
        F.count("*").alias("group_size"), F.max("row").alias("best")
    )
    with _settings(stream.sparkSession, _STATE):
        query = (
            state.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, group size, id that stays and its content's place."""
    with _settings(spark, _STATE):
        state = spark.read.format("statestore").load(checkpoint)
    count, best = state.schema["value"].dataType.fieldNames()
    best = F.col("value").getField(best)
    return state.select(
        F.col("key.text_sha256").alias("text_sha256"),
        F.col("value").getField(count).alias("group_size"),
        F.bitwise_not(best.getField("inverted_id")).alias("keep_id"),
        best.getField("locator").alias("keep_locator"),
    )


def mixed_digests(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Digests under which the full normalised bytes differ.

    Only rows of digests with more than one row are compared.  A large group is cut into parts by
    a hash of the id; equal parts share their smallest and largest text.
    """
    hits = state.where("group_size > 1").select("text_sha256", "group_size")
    parts = F.ceil(F.col("group_size") / COMPARED_TOGETHER)
    cut = rows.select("doc_id", "text_sha256", "norm").join(hits, "text_sha256").select(
        F.concat_ws(
            ":", "text_sha256", F.pmod(F.xxhash64("doc_id"), parts).cast("string")
        ).alias("part"),
        "norm",
    )
    ends = cut.groupBy("part").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    by_digest = ends.groupBy(F.substring("part", 1, 64).alias("text_sha256")).agg(
        F.min("low").alias("low"), F.max("high").alias("high")
    )
    return by_digest.where("low != high").select("text_sha256")


def resolved(rows: DataFrame, state: DataFrame, mixed: DataFrame) -> DataFrame:
    """Each row with its group: by digest, or by the exact bytes where a digest is mixed."""
    plain = rows.select("doc_id", "text_sha256").join(
        mixed.select("text_sha256", F.lit(True).alias("mixed")), "text_sha256", "left"
    ).where("mixed is null").drop("mixed")
    by_digest = plain.join(state.select("text_sha256", "group_size", "keep_id"), "text_sha256")
    # what is mixed is grouped by its bytes
    odd = rows.join(mixed, "text_sha256", "left_semi")
    exact = odd.groupBy("text_sha256", "norm").agg(
        F.count("*").alias("group_size"),
        F.max(F.struct("points", F.bitwise_not("doc_id").alias("inverted_id"))).alias("best"),
    )
    by_bytes = odd.select("doc_id", "text_sha256", "norm").join(
        exact, ["text_sha256", "norm"]
    ).select(
        "doc_id", "text_sha256", "group_size",
        F.bitwise_not(F.col("best.inverted_id")).alias("keep_id"),
    )
    return by_digest.select("doc_id", "text_sha256", "group_size", "keep_id").unionByName(by_bytes)


def exact_dedup(docs: DataFrame, stream: DataFrame, checkpoint: str,
                locator: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` with the row of its group that stays.

    ``stream`` brings the rows that the state at ``checkpoint`` has not seen; ``docs`` are all
    rows that it has seen then.
    """
    spark = docs.sparkSession
    update_state(stream, checkpoint, locator)
    state = read_state(spark, checkpoint)
    rows = digested(docs)
    mixed = written(mixed_digests(rows, state), "mixed-digests")
    return resolved(rows, state, mixed).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def dedup_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """``exact_dedup`` over a Parquet table that is read as a stream of files."""
    docs = spark.read.parquet(path)
    reader = spark.readStream.schema(docs.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern, since the stream would take a plain path for a folder and fail on one file
    stream = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    return exact_dedup(docs, stream, new_path(spark, "dedup-state"), F.col("_metadata.file_path"))
