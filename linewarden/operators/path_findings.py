"""Findings that need only the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.paths import SUSPICIOUS_EXTENSIONS
from linewarden.functions.severity import RANKS
from linewarden.operators.findings import ANALYZER_ORDER, to_findings


# Fixed value: the remediation of these findings.
AUDIT_NOTE = "Consider whether this file should be in version control"


def suspicious_suffix(path: Column) -> Column:
    """The plain disjunction; it can be tested before anything is built."""
    any_suffix = F.lit(False)
    for suffix, _, _ in SUSPICIOUS_EXTENSIONS:
        any_suffix = any_suffix | path.endswith(suffix)
    return any_suffix


def suspicious_extensions(files: DataFrame) -> DataFrame:
    """One finding per suspicious suffix of the path, also for unreadable files."""
    matched = F.array(
        *[
            F.when(
                F.col("path").endswith(suffix),
                F.struct(
                    F.lit(i).alias("rule"),
                    F.lit(title).alias("title"),
                    F.lit(severity).alias("severity"),
                    F.lit(RANKS[severity]).alias("severity_rank"),
                ),
            )
            for i, (suffix, title, severity) in enumerate(SUSPICIOUS_EXTENSIONS)
        ]
    )
    rows = (
        files.select("repo", "path")
        .where(suspicious_suffix(F.col("path")))
        .select("repo", "path", F.explode(F.array_compact(matched)).alias("x"))
    )
    return to_findings(
        rows,
        analyzer="file-ops",
        rule_id="FILE-EXT-001",
        severity=F.col("x.severity"),
        severity_rank=F.col("x.severity_rank"),
        title=F.col("x.title"),
        file=F.col("path"),
        remediation=AUDIT_NOTE,
        order=(ANALYZER_ORDER["file-ops"], 0, -1, F.col("x.rule"), 0),
    )
