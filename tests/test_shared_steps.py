"""Steps that many queries share: what runs once, and what is worked out before rows meet."""

import pytest
from pyspark.sql import functions as F

from linewarden import schema
from linewarden.functions.arrays import let, let_sql
from linewarden.operators import dependencies as deps
from linewarden.operators.matching import _under_anchors
from linewarden.reports import fragments as fr
from linewarden.reports import html, sarif, text

WHEN = "2024-01-01T00:00:00Z"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("build", "node", "times"), [
    (text.text_report, "Aggregate", 1), (html.html_document, "Aggregate", 1), (sarif.sarif_document, "Join", 3),
])
def test_a_report_works_out_its_repositories_once(spark, build, node, times):
    findings = spark.createDataFrame([], schema.FINDINGS)
    repos = spark.range(4).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("repo"))
    findings = findings.sparkSession.createDataFrame(findings.rdd, schema.FINDINGS)
    made = build(findings, repos, WHEN, 1.0, "low")
    assert plan(made).count(f"{node} ") <= times


def test_rows_of_each_keep_repositories_without_name(spark):
    frame = spark.createDataFrame([("a", 1), (None, 0)], "repo string, n int")
    rows = fr.rows_of_each(
        frame, (fr.HEAD, 0, F.concat(F.lit("head "), "repo"), None), (fr.FINDINGS, -2, F.lit("some"), F.col("n") > 0),
        (fr.TAIL, 0, F.lit("tail"), None),
    ).select("repo", "section", "band", "fragment").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([
        ("a", 0, 0, "head a"), ("a", 1, -2, "some"), ("a", 2, 0, "tail"), (None, 0, 0, None), (None, 2, 0, "tail"),
    ], key=str)


def test_findings_of_a_table_are_worded_before_the_rows_meet(spark):
    files = spark.createDataFrame(
        [(f"r{i}", "package.json", '{"dependencies":{"a":"^1.0.0","b":"2.0"}}') for i in range(3)],
        "repo string, path string, content string",
    )
    advisories = spark.createDataFrame(
        [("a", "1.0", "CVE-1", "one", "high"), ("a", "1.0.0", "CVE-2", "two", "low")], schema.NPM_ADVISORIES
    )
    found = deps.npm_vulnerabilities(deps.npm_dependencies(files), advisories)
    assert "Upgrade " not in plan(found.drop("id")).split("Join ")[0]
    assert sorted((r.repo, r.title, r.severity, r.severity_rank, r.evidence, r.remediation) for r in found.collect()) == sorted(
        (f"r{i}", f"Vulnerable dependency: {cve}", severity, rank, "a@1.0.0", "Upgrade a to a patched version")
        for i in range(3) for cve, severity, rank in (("CVE-1: one", "HIGH", 4), ("CVE-2: two", "LOW", 2))
    )


def test_let_reads_a_value_that_may_be_null(spark):
    frame = spark.createDataFrame([(1,), (None,)], "x int").select(
        let(F.col("x"), "int", lambda v: F.coalesce(v + 1, F.lit(0))).alias("a"),
        F.expr(let_sql("x", "v", "array<int>", "array(v, v)")).alias("b"),
    )
    assert [tuple(r) for r in frame.collect()] == [(2, [1, 1]), (0, [None, None])]


def test_gates_are_asked_for_by_halves():
    assert _under_anchors([(1, "a")]) == "a"
    made = _under_anchors([(1 << i, f"b{i}") for i in range(8)])
    assert made.startswith("concat(IF((met & 15L) <> 0, ") and made.count("(met & 240L) <> 0") == 1
