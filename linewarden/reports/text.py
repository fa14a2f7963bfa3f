"""Plain text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.severity import RANKS, parse_severity
from linewarden.functions.text import console_evidence
from linewarden.operators.findings import at_least, with_location
from linewarden.operators.summary import COUNTS, severity_summary
from linewarden.reports import fragments as fr

RULE_LINE = "─" * 60
NOTHING = "No findings above the minimum severity threshold."


def _line(label: str, value: Column) -> Column:
    """An indented ``label: value`` line; null, and so left out, when the value is null."""
    return F.concat(F.lit(f"  {label}: "), value)


def finding_text() -> Column:
    """Lines of a finding that has a ``location``, closed by an empty line."""
    references = F.when(F.size("references") > 0, F.array_join("references", ", "))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), "severity", F.lit("] "), "title"),
        _line("Rule", F.col("rule_id")),
        _line("Location", F.col("location")),
        _line("Description", F.nullif("description", F.lit(""))),
        _line("Evidence", console_evidence(F.col("evidence"))),
        _line("Remediation", F.col("remediation")),
        _line("References", references),
        F.lit(""),
    )


def text_report(
    findings: DataFrame,
    repos: DataFrame,
    scan_time: str,
    duration_secs: float = 0.0,
    min_severity: str = "info",
) -> DataFrame:
    """Report fragments per repository; the summary counts all findings."""
    counts = severity_summary(findings, repos)
    some = [
        _line(name.capitalize(), F.when(F.col(name) > 0, F.col(name)).cast("string"))
        for name in COUNTS
    ]
    head = F.concat_ws(
        "\n",
        F.lit("Security Scan Report"),
        F.lit(RULE_LINE),
        F.lit(""),
        F.concat(F.lit("Repository: "), "repo"),
        F.lit(f"Scan Time: {scan_time}"),
        F.lit(f"Duration: {duration_secs:.2f}s"),
        F.lit(""),
        F.lit("Summary"),
        *some,
        _line("Total", F.col("total").cast("string")),
        F.lit(""),
    )
    kept = with_location(at_least(findings, min_severity))
    # Headings come from the counts, not from the findings: nothing is grouped again.
    lowest = parse_severity(min_severity)
    shown = [(name, rank) for name, rank in RANKS.items() if rank >= lowest]
    n_shown = sum((F.col(name.lower()) for name, _ in shown), F.lit(0))
    headings = [
        (fr.FINDINGS, -rank, F.lit(f"{name} Findings"), F.col(name.lower()) > 0) for name, rank in shown
    ]
    about_repos = fr.rows_of_each(
        counts,
        (fr.HEAD, 0, head, None),
        *headings,
        (fr.FINDINGS, 0, F.lit(NOTHING), n_shown == 0),
        (fr.TAIL, 0, F.lit(f"{RULE_LINE}\nGenerated by linewarden"), None),
    )
    return about_repos.unionByName(
        fr.rows(kept, fr.FINDINGS, finding_text(), -F.col("severity_rank"), with_place=True)
    )
