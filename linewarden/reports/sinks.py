"""Choice of the report format, and the findings table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linewarden.operators.findings import numbered
from linewarden.reports.html import html_document
from linewarden.reports.sarif import sarif_document
from linewarden.reports.text import text_report

# The names a built-in format can be asked for by.
FORMATS = {
    "console": text_report,
    "text": text_report,
    "html": html_document,
    "sarif": sarif_document,
    "json": sarif_document,
}


def report(
    findings: DataFrame,
    repos: DataFrame,
    scan_time: str,
    format: str | Callable[..., DataFrame] = "console",
    **options,
) -> DataFrame:
    """Document fragments in the named format, case-insensitive; unknown names raise.

    A format of the caller is a function: it gets findings, repositories, scan time and the
    options, and returns document fragments.  Pass :func:`stored` findings unless scanning again
    is cheaper than writing them.
    """
    build = format if callable(format) else FORMATS.get(format.lower())
    if build is None:
        raise ValueError(f"Unknown report format: {format}")
    return build(findings, repos, scan_time, **options)


def write_findings(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the findings as Parquet, partitioned by analyzer and severity.

    The rebalance hint lets adaptive execution split large partitions and join small ones, so
    neither a frequent rule nor a rare one decides the file sizes.
    """
    balanced = findings.hint("rebalance", "analyzer", "severity")
    balanced.write.mode(mode).partitionBy("analyzer", "severity").parquet(path)


def stored(findings: DataFrame, path: str) -> DataFrame:
    """The findings, written once to ``path`` and read back.  Runs a job.

    A report reads its findings several times.  Reading them from a table scans the corpus
    once, and a lost executor costs a reread of that table instead of a new scan.
    """
    write_findings(findings, path)
    return read_findings(findings.sparkSession, path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    from linewarden import schema

    return spark.read.schema(schema.FINDINGS).parquet(path)


def numbered_report(findings: DataFrame, path: str) -> DataFrame:
    """The findings in report order with an ``ordinal``, from tables below ``path``.

    The findings are stored first, so that the corpus is scanned once.
    """
    return numbered(stored(findings, f"{path}/findings"), f"{path}/ordered")
