"""HTML documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.severity import severity_class, severity_icon
from linewarden.functions.text import html_escape
from linewarden.operators.findings import at_least, with_location
from linewarden.operators.summary import COUNTS, severity_summary
from linewarden.reports import fragments as fr


def _block(name: str, label: str, value: Column, present: Column) -> Column:
    opened = f'<p class="{name}">' + (f"<b>{label}</b> " if label else "")
    return F.when(present, F.concat(F.lit(opened), value, F.lit("</p>"))).otherwise("")


def finding_html() -> Column:
    """Fragment of a finding that has a ``location``; the severity attribute is lower case."""
    link = F.transform(
        "references",
        lambda r: F.concat(
            F.lit('<a href="'), html_escape(r), F.lit('">'), html_escape(r), F.lit("</a>")
        ),
    )
    evidence = F.concat(F.lit("<code>"), html_escape(F.col("evidence")), F.lit("</code>"))
    return F.concat(
        F.lit('<article class="finding '), severity_class(F.col("severity")),
        F.lit('" data-severity="'), F.lower("severity"),
        F.lit('" data-analyzer="'), html_escape(F.col("analyzer")), F.lit('">'),
        F.lit("<h3>"), severity_icon(F.col("severity")),
        F.lit("<span>"), F.col("severity"), F.lit("</span> "), html_escape(F.col("title")),
        F.lit(" <small>"), html_escape(F.col("rule_id")), F.lit("</small></h3>"),
        F.lit("<p class=\"location\"><b>Location:</b> <code>"),
        html_escape(F.col("location")), F.lit("</code></p>"),
        _block("description", "", html_escape(F.col("description")), F.col("description") != ""),
        _block("evidence", "Evidence:", evidence, F.col("evidence").isNotNull()),
        _block(
            "remediation", "Remediation:", html_escape(F.col("remediation")),
            F.col("remediation").isNotNull(),
        ),
        _block("references", "References:", F.array_join(link, ", "), F.size("references") > 0),
        F.lit("</article>"),
    )


def html_document(
    findings: DataFrame,
    repos: DataFrame,
    scan_time: str,
    duration_secs: float = 0.0,
    min_severity: str = "info",
) -> DataFrame:
    """Document fragments per repository.  The counts in the head are of all findings."""
    counts = severity_summary(findings, repos)
    cells = [
        F.concat(
            F.lit(f'<li class="{name}">{name.capitalize()}: '), F.col(name).cast("string"),
            F.lit("</li>"),
        )
        for name in (*COUNTS, "total")
    ]
    head = F.concat(
        F.lit("<!DOCTYPE html>\n<html lang=\"en\"><head><meta charset=\"utf-8\"><title>"),
        html_escape(F.col("repo")),
        F.lit("</title></head><body>\n<h1>Security Scan Report</h1>\n<p>"),
        html_escape(F.col("repo")),
        F.lit(f"</p>\n<p>Scan Time: {scan_time} | Duration: {duration_secs:.2f}s</p>\n<ul>"),
        *cells,
        F.lit("</ul>\n<main>"),
    )
    kept = with_location(at_least(findings, min_severity))
    about_repos = fr.rows_of_each(
        counts, (fr.HEAD, 0, head, None), (fr.TAIL, 0, F.lit("</main>\n</body></html>"), None)
    )
    return about_repos.unionByName(fr.rows(kept, fr.FINDINGS, finding_html(), with_place=True))
