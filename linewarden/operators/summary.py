"""Per-repository aggregates of the findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.severity import RANKS, severity_name

COUNTS = tuple(name.lower() for name in RANKS)
#: What the first finding says of its rule.
CARRIED = ("title", "description", "remediation", "severity", "analyzer")


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("severity_rank") == rank).alias(name.lower())
        for name, rank in RANKS.items()
    ]


def severity_summary(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Counts per severity, total and highest severity of every repository, zero-filled.

    ``repos`` is any DataFrame with a ``repo`` column, normally the files.  Both inputs are
    reduced by one aggregation: rows without a severity only make the repository known, and
    partial aggregation leaves one row per repository and task to shuffle.
    """
    known = repos.select("repo", F.lit(None).cast("int").alias("severity_rank"))
    rows = findings.select("repo", "severity_rank").unionByName(known)
    return _finish(rows.groupBy("repo").agg(*_counts(), F.max("severity_rank").alias("rank")))


def total_summary(findings: DataFrame) -> DataFrame:
    """One row over all findings."""
    return _finish(findings.agg(*_counts(), F.max("severity_rank").alias("rank")))


def _finish(counted: DataFrame) -> DataFrame:
    total = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    return counted.withColumns(
        {"total": total, "max_severity": severity_name(F.col("rank"))}
    ).drop("rank")


def ci_gate(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """``(repo, failed)``: any finding of high or critical severity, filters not applied."""
    summary = severity_summary(findings, repos)
    return summary.select("repo", ((F.col("critical") > 0) | (F.col("high") > 0)).alias("failed"))


def rules_first(findings: DataFrame) -> DataFrame:
    """One row per repository and rule id, described by its first finding in scan order.

    ``min_by`` keeps one candidate per key in each task before the shuffle.
    """
    first = F.min_by(F.struct(*CARRIED), F.col("ord")).alias("first")
    return findings.groupBy("repo", "rule_id").agg(first).select("repo", "rule_id", "first.*")


def rule_state(findings: DataFrame) -> DataFrame:
    """One row per repository, rule id and severity: count, first finding and its place.

    One aggregation that both the summary and the list of rules follow from; kept as a table, its
    rows are as many as the kinds of findings of a repository.
    """
    first = F.min_by(F.struct(*CARRIED), F.col("ord")).alias("first")
    return findings.groupBy("repo", "rule_id", "severity_rank").agg(
        F.count("*").alias("n"), first, F.min("ord").alias("first_ord")
    )


def summary_of_state(state: DataFrame, repos: DataFrame) -> DataFrame:
    """:func:`severity_summary` of the findings of a state."""
    known = repos.select("repo", F.lit(None).cast("int").alias("severity_rank"), F.lit(0).cast("long").alias("n"))
    rows = state.select("repo", "severity_rank", "n").unionByName(known)
    counts = [
        F.sum(F.when(F.col("severity_rank") == rank, F.col("n")).otherwise(0)).alias(name.lower())
        for name, rank in RANKS.items()
    ]
    return _finish(rows.groupBy("repo").agg(*counts, F.max("severity_rank").alias("rank")))


def rules_of_state(state: DataFrame) -> DataFrame:
    """:func:`rules_first` of the findings of a state."""
    first = F.min_by("first", "first_ord").alias("first")
    return state.groupBy("repo", "rule_id").agg(first).select("repo", "rule_id", "first.*")


def scan_reports(
    findings: DataFrame, repos: DataFrame, analyzers: list[str], scan_time: str, duration_secs: float
) -> DataFrame:
    """Report header of every repository: when and how it was scanned, and its counts."""
    return severity_summary(findings, repos).select(
        F.col("repo").alias("repository"),
        F.lit(scan_time).cast("timestamp").alias("scan_time"),
        F.lit(float(duration_secs)).alias("duration_secs"),
        F.array(*map(F.lit, analyzers)).alias("analyzers"),
        *COUNTS,
        "total",
        "max_severity",
    )
