"""Files to lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.text import decode_utf8, line_count, raw_lines, strip_cr


def explode_lines(
    files: DataFrame, keep: list[str], wanted: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per line of every file that decodes as UTF-8: ``keep`` columns, line, text.

    With ``wanted``, a condition that holds for a text if it holds for one of its lines, only
    such texts and lines go on.  It is tested on the whole text first: a file without any hit
    is neither checked for valid UTF-8 nor cut into lines.
    """
    if wanted:
        files = files.where(wanted(F.col("content").cast("string")))
    decoded = files.select(*keep, decode_utf8(F.col("content")).alias("content"))
    cut = decoded.select(*keep, F.posexplode(raw_lines(F.col("content"))).alias("line", "raw"))
    if wanted:
        cut = cut.where(wanted(F.col("raw")))
    return cut.select(*keep, "line", strip_cr(F.col("raw")).alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """``(repo, path, line, text)`` of all files that decode as UTF-8, also of those in pieces."""
    if "first_line" not in files.columns:
        return explode_lines(files, ["repo", "path"])
    cut = explode_lines(files, ["repo", "path", "first_line"])
    line = (F.col("first_line") + F.col("line")).cast("int")
    return cut.withColumn("line", line).drop("first_line")


def file_stats(files: DataFrame) -> DataFrame:
    """Byte length and number of lines of each readable file."""
    text = decode_utf8(F.col("content"))
    decoded = files.select("repo", "path", text.alias("content")).where("content IS NOT NULL")
    return decoded.select(
        "repo",
        "path",
        F.octet_length("content").cast("bigint").alias("n_bytes"),
        line_count(F.col("content")).cast("bigint").alias("n_lines"),
    )
