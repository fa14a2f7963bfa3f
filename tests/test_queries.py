"""Registered queries against their SQL, and the shape of their plans."""

from collections import Counter

import pytest

import __spark_entry__ as entry
from linewarden.catalog import corpora, oracles
from linewarden.catalog import queries as catalog
from linewarden.plans.scan import scan

duckdb = pytest.importorskip("duckdb")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations".split()
)
#: Without those that only project the same scan again.
CHECKED = [
    "lines_documents", "file_stats", "source_listing", "path_ignored", "path_extension", "indicators_all",
    "indicators_url", "scan_all", "scan_pruned", "scan_dependencies", "deps_npm", "deps_python", "git_remotes",
    "git_recent_commits", "git_files_changed", "repo_urls", "repo_names", "rules_first", "severity_summary",
    "sarif_document", "text_report", "html_document", "report_evidence", "lines_bytes", "deps_python_table",
    "git_insecure_remote", "scan_secrets", "scan_url", "scan_extensions", "report_user", "user_analyzer",
    "findings_by_analyzer", "ci_gate", "report_order", "rule_state", "deps_npm_table", "git_head_commits",
]


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.registered()) == set(oracles.sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, oracle, name):
    frame = entry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = Counter(tuple(repr(r[c]) for c in columns) for r in frame.collect())
    cursor = oracle.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(tuple(repr(r[i]) for i in order) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "repo"


@pytest.mark.parametrize("name", ["scan_all", "severity_summary", "rules_first", "git_files_changed", "deps_npm_vuln"])
def test_plans_have_no_cross_join_or_python(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("NestedLoop", "Cartesian", "PythonUDF", "EvalPython", "InPandas", "InArrow", "- Window ["):
        assert unwanted not in plan


def test_a_scan_reads_each_source_once(spark, sf_dir):
    found = scan(corpora.corpus(spark, sf_dir))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4  # documents, pages, conversations, lineitem
    assert "Union" not in plan.split("Generate inline(concat")[0]  # one pass above the corpus


def test_path_queries_do_not_read_text(spark, sf_dir):
    frame = entry.queries()["is_git"](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
