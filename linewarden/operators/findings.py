"""The findings table: one projection builds it, filters and display columns read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewarden.functions.severity import parse_severity
from linewarden.functions.text import (
    console_evidence,
    display_location,
    evidence_fingerprint,
)
from linewarden.schema import FINDING_COLUMNS, ORD

#: Built-in analyzers in registration order.
ANALYZER_ORDER = {"url": 0, "secrets": 1, "file-ops": 2, "dependencies": 3}

_SEPARATOR = "\u001f"


def _column(value, sql_type: str) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast(sql_type)


def to_findings(
    rows: DataFrame,
    *,
    analyzer,
    rule_id,
    severity,
    title,
    file,
    order,
    severity_rank=None,
    description="",
    line=None,
    column=None,
    evidence=None,
    remediation=None,
    references=None,
    same_place_key=None,
) -> DataFrame:
    """Project ``rows`` (with a ``repo`` column) to the findings schema.

    ``order`` is (analyzer, phase, line, rule, position), the place of the finding in the
    report; the file comes after the phase.  The id is a hash of what the finding says and of
    that place, so that a rerun gives the same ids and equal findings stay apart;
    ``same_place_key`` tells apart those that even share the place.
    """
    rank = parse_severity(severity) if severity_rank is None else severity_rank
    analyzer_ord, phase, line_ord, rule_ord, pos = order
    body = rows.select(
        F.col("repo"),
        _column(analyzer, "string").alias("analyzer"),
        _column(rule_id, "string").alias("rule_id"),
        _column(severity, "string").alias("severity"),
        _column(rank, "int").alias("severity_rank"),
        _column(title, "string").alias("title"),
        _column(description, "string").alias("description"),
        _column(file, "string").alias("file"),
        _column(line, "int").alias("line"),
        _column(column, "int").alias("column"),
        _column(evidence, "string").alias("evidence"),
        _column(remediation, "string").alias("remediation"),
        (references if references is not None else F.array()).cast("array<string>").alias("references"),
        _column("" if same_place_key is None else same_place_key, "string").alias("same_place_key"),
        F.struct(
            _column(analyzer_ord, "int"), _column(phase, "int"), _column(file, "string"),
            _column(line_ord, "int"), _column(rule_ord, "int"), _column(pos, "int"),
        ).cast(ORD).alias("ord"),
    )
    identity = F.concat_ws(
        _SEPARATOR,
        "repo", "analyzer", "rule_id", "title", "file",
        F.coalesce(F.col("line").cast("string"), F.lit("")),
        F.coalesce(F.col("column").cast("string"), F.lit("")),
        F.coalesce("evidence", F.lit("")),
        *[F.col(f"ord.{part}").cast("string") for part in ("phase", "line", "rule", "pos")],
        "same_place_key",
    )
    return body.withColumn("id", F.sha2(identity, 256)).select(*FINDING_COLUMNS)


def at_least(findings: DataFrame, min_severity: str) -> DataFrame:
    """Findings of this severity or above."""
    return findings.where(F.col("severity_rank") >= parse_severity(min_severity))


def by_analyzer(findings: DataFrame, analyzer: str) -> DataFrame:
    return findings.where(F.col("analyzer") == analyzer)


def with_location(findings: DataFrame) -> DataFrame:
    """Add ``location``, the one-based display form."""
    shown = display_location(F.col("file"), F.col("line"), F.col("column"))
    return findings.withColumn("location", shown)


def with_report_columns(findings: DataFrame) -> DataFrame:
    """Add the display location, the cut evidence and the fingerprint."""
    return with_location(findings).select(
        "*",
        console_evidence(F.col("evidence")).alias("console_evidence"),
        evidence_fingerprint(F.col("evidence")).alias("fingerprint"),
    )


def _in_report_order() -> list[Column]:
    """Repository, most severe first, scan order inside; the whole key ends inside a file."""
    return [F.col("repo"), F.desc("severity_rank"), F.col("ord"), F.col("id")]


def report_order(findings: DataFrame) -> DataFrame:
    """Most severe first, scan order inside.

    A global sort: Spark range-partitions on the whole key, which ends in the position inside
    a file, so one very large repository is spread over many tasks.
    """
    return findings.orderBy(*_in_report_order())


def numbered(findings: DataFrame, folder: str) -> DataFrame:
    """Stored findings with ``ordinal``, their place in the report order of all, without gaps.

    Range partitions are written once below ``folder``, a new one of the caller's; an ordinal is
    a row's place in its partition and the rows of the partitions before.  Range partitioning
    reads its input twice, to sample it as well, so ``findings`` are to be a table: see
    :func:`linewarden.reports.sinks.numbered_report`.
    """
    order = _in_report_order()
    ranges = findings.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.withColumn("_at", F.monotonically_increasing_id()).write.parquet(folder)
    stored = findings.sparkSession.read.parquet(folder).withColumn("_range", F.shiftright("_at", 33))
    # one row per range partition, so as many as the setting for shuffles says at most
    counts = stored.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")
    starts = F.broadcast(counts.select("_range", before.alias("_before")))
    in_range = F.col("_at").bitwiseAND((1 << 33) - 1)
    return stored.join(starts, "_range").withColumn("ordinal", F.col("_before") + in_range).drop(
        "_at", "_range", "_before"
    )
