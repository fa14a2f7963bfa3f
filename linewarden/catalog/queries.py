"""The registered queries: every operator over the driver's whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.catalog import corpora as c
from linewarden.functions import paths, repo_urls, severity, text
from linewarden.operators import dependencies as deps
from linewarden.operators import findings as fi
from linewarden.operators import git, indicators, lines
from linewarden.functions.severity import RANKS
from linewarden.operators import path_findings, summary
from linewarden.plans.registry import Analyzer, AnalyzerRegistry, default_registry
from linewarden.plans.scan import Corpus, scan, scan_filtered
from linewarden.reports import fragments, html, sarif, sinks
from linewarden.reports import text as text_reports
from linewarden.rules import Rule
from linewarden.session import configure, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

SCAN_TIME = "2024-01-01T00:00:00Z"
FLAT = [col for col in (
    "id", "repo", "analyzer", "rule_id", "severity", "severity_rank", "title", "description",
    "file", "line", "column", "evidence", "remediation",
)]
_QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        return fn

    return add


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


# -- lines and files --------------------------------------------------------------------


@query("lines_documents")
def lines_documents(spark, sf):
    return lines.lines(c.spread(c.document_files(spark, sf)))


@query("lines_bytes")
def lines_bytes(spark, sf):
    """Lines of binary content; a file that is no valid UTF-8 has none."""
    return lines.lines(c.spread(c.byte_files(spark, sf)))


@query("file_stats")
def file_stats(spark, sf):
    return lines.file_stats(c.planted_and_pages(spark, sf))


@query("source_listing")
def source_listing(spark, sf):
    return c.path_files(spark, sf).select(
        "repo",
        "path",
        paths.is_listed(F.col("path")).alias("listed"),
        paths.below_ignored_dir(F.col("path")).alias("below_ignored"),
    )


def _path_query(name: str, column: str, expression) -> None:
    @query(name)
    def classify(spark, sf):
        return c.path_files(spark, sf).select("repo", "path", expression(F.col("path")).alias(column))


_path_query("path_binary", "is_binary", paths.is_binary_file)
_path_query("path_lockfile", "is_lock_file", paths.is_dependency_file)
_path_query("path_text", "is_text", paths.is_text_file)
_path_query("path_extension", "extension", paths.extension)
_path_query("path_language", "language", paths.detect_language)
_path_query("path_url_skipped", "url_skipped", paths.is_url_skipped)


@query("path_ignored")
def path_ignored(spark, sf):
    """Each folder on each path, and whether its name is ignored."""
    files = c.path_files(spark, sf)
    folders = files.select(
        "repo", "path", F.posexplode(F.split("path", "/", -1)).alias("depth", "name"),
    ).where(F.col("depth") < F.size(F.split("path", "/", -1)) - 1)
    return folders.withColumn("is_ignored", paths.is_ignored_dir(F.col("name")))


# -- indicators -------------------------------------------------------------------------


def _indicator_query(name: str) -> None:
    @query(f"indicators_{name}")
    def find(spark, sf):
        return indicators.extract(c.indicator_texts(spark, sf), name)


for _name in indicators.INDICATORS:
    _indicator_query(_name)


@query("indicators_all")
def indicators_all(spark, sf):
    """All indicators in one pass, counted per origin."""
    found = indicators.extract_all(c.indicator_texts(spark, sf))
    return found.groupBy("origin", "indicator").agg(
        F.count("*").alias("n_matches"), F.countDistinct("row_id").alias("n_rows")
    )


# -- scans ------------------------------------------------------------------------------


def _flat(findings: DataFrame) -> DataFrame:
    return findings.select(*FLAT)


@query("scan_url")
def scan_url(spark, sf):
    found = scan(Corpus(c.planted_pages_configs(spark, sf)), ["url"])
    return _flat(found)


@query("scan_domains")
def scan_domains(spark, sf):
    files = c.planted_and_pages(spark, sf)
    found = scan(Corpus(files), ["url"])
    return _flat(found.where("rule_id = 'URL-SUSPICIOUS-DOMAIN'"))


@query("scan_secrets")
def scan_secrets(spark, sf):
    return _flat(scan(Corpus(c.text_files(spark, sf)), ["secrets"]))


@query("scan_file_ops")
def scan_file_ops(spark, sf):
    return _flat(scan(Corpus(c.planted_pages_paths(spark, sf)), ["file-ops"]))


@query("scan_language_rules")
def scan_language_rules(spark, sf):
    found = scan(Corpus(c.text_files(spark, sf)), ["file-ops"])
    return _flat(found.where("rule_id = 'FILE-LANG-001'"))


@query("scan_extensions")
def scan_extensions(spark, sf):
    return _flat(path_findings.suspicious_extensions(c.path_files(spark, sf)))


@query("scan_dependencies")
def scan_dependencies(spark, sf):
    return _flat(scan(Corpus(c.manifest_files(spark, sf)), ["dependencies"]))


def _everything(spark, sf) -> DataFrame:
    return scan(c.corpus(spark, sf))


@query("scan_all")
def scan_all(spark, sf):
    return _flat(_everything(spark, sf))


@query("scan_pruned")
def scan_pruned(spark, sf):
    """The scan with ignored folders left out and manifests taken in any folder."""
    files = c.all_files(spark, sf)
    options = Corpus(files, prune=True, nested_manifests=True, rust_notes=True)
    return _flat(scan(options, ["file-ops", "dependencies"]))


# -- dependencies -----------------------------------------------------------------------


@query("manifests")
def manifests(spark, sf):
    return _flat(deps.manifest_findings(c.path_files(spark, sf)))


@query("deps_npm")
def deps_npm(spark, sf):
    configure(spark)
    found = deps.npm_dependencies(c.manifest_files(spark, sf))
    return found.select("repo", "path", "section", "package", "version", "raw_version")


@query("deps_npm_vuln")
def deps_npm_vuln(spark, sf):
    configure(spark)
    return _flat(deps.npm_vulnerabilities(deps.npm_dependencies(c.manifest_files(spark, sf))))


@query("deps_npm_outdated")
def deps_npm_outdated(spark, sf):
    configure(spark)
    return _flat(deps.npm_outdated(deps.npm_dependencies(c.manifest_files(spark, sf))))


@query("deps_python")
def deps_python(spark, sf):
    found = deps.python_requirements(c.planted_manifests(spark, sf))
    return found.select("repo", "path", "line", "package", "version")


@query("deps_python_vuln")
def deps_python_vuln(spark, sf):
    return _flat(deps.python_vulnerabilities(deps.python_requirements(c.planted_manifests(spark, sf))))


@query("deps_python_table")
def deps_python_table(spark, sf):
    """Requirements and advisories that both grow with the parts."""
    found = deps.python_requirements(c.part_requirements(spark, sf))
    return _flat(deps.python_vulnerabilities(found, c.part_advisories(spark, sf))).drop("id")


@query("deps_npm_table")
def deps_npm_table(spark, sf):
    """Manifests and advisories that both grow with the parts, all on three packages."""
    configure(spark)
    found = deps.npm_dependencies(c.part_manifests(spark, sf))
    return _flat(deps.npm_vulnerabilities(found, c.part_npm_advisories(spark, sf))).drop("id")


@query("deps_rust_info")
def deps_rust_info(spark, sf):
    return _flat(deps.rust_notes(c.planted_manifests(spark, sf)))


# -- git --------------------------------------------------------------------------------


@query("git_remotes")
def git_remotes(spark, sf):
    return git.remotes_from_config(c.config_files(spark, sf))


@query("git_origin")
def git_origin(spark, sf):
    return git.origin_urls(git.remotes_from_config(c.config_files(spark, sf)))


@query("git_insecure_remote")
def git_insecure_remote(spark, sf):
    return _flat(git.insecure_remotes(git.remotes_from_config(c.config_files(spark, sf))))


@query("git_recent_commits")
def git_recent_commits(spark, sf):
    return _commits(git.recent_commits(c.commits(spark, sf)))


@query("git_head_commits")
def git_head_commits(spark, sf):
    """The newest commits that a head leads to; some branches are merged, others are not."""
    return _commits(git.recent_commits(c.branched_commits(spark, sf), heads=c.heads(spark, sf)))


def _commits(recent: DataFrame) -> DataFrame:
    return recent.select(
        "repo", "hash", "author", "message", "commit_time", "position",
        F.size("parents").alias("n_parents"),
    )


@query("git_files_changed")
def git_files_changed(spark, sf):
    return git.files_changed(c.commits(spark, sf), c.tree_entries(spark, sf))


@query("is_git")
def is_git(spark, sf):
    return git.is_git(c.all_paths(spark, sf))


@query("repo_urls")
def repo_urls_query(spark, sf):
    """Page URLs as candidates, plain and in the other accepted spellings."""
    urls = c.table(spark, sf, "pages").select("page_id", "url")
    rest = F.regexp_replace("url", "^https?://", "")
    spelled = urls.select(
        "page_id",
        F.explode(F.array(
            F.col("url"),
            F.concat(F.lit("  "), "url", F.lit(".git\t")),
            F.concat(F.lit("git@"), rest),
            F.concat(F.lit("ssh://"), rest),
            F.concat(F.lit("https://github.com/"), rest),
            F.concat(F.lit("GIT://"), rest, F.lit(".git")),
            F.lit(" "),
        )).alias("candidate"),
    )
    return spelled.withColumn("is_valid", repo_urls.is_repo_url(F.col("candidate")))


@query("repo_names")
def repo_names(spark, sf):
    urls = c.table(spark, sf, "pages").select("page_id", "url")
    spelled = urls.select(
        "page_id",
        F.explode(F.array(
            F.col("url"), F.concat("url", F.lit(".git")), F.concat("url", F.lit("/")),
            F.lit("/"), F.concat(F.lit("/srv/é-"), F.col("page_id").cast("string"), F.lit(".git.git//")),
        )).alias("root"),
    )
    name = paths.repo_name(F.col("root"))
    return spelled.select(
        "page_id",
        "root",
        repo_urls.repo_name_from_url(F.col("root")).alias("url_name"),
        name.alias("name"),
        repo_urls.report_file_part(name).alias("file_part"),
    )


# -- filters and aggregates over the findings ---------------------------------------------


@query("findings_min_severity")
def findings_min_severity(spark, sf):
    return _flat(scan_filtered(c.corpus(spark, sf), "Medium"))


@query("findings_by_analyzer")
def findings_by_analyzer(spark, sf):
    """One analyzer is chosen when planning, so the rules of the others do not run."""
    return _flat(scan(c.corpus(spark, sf), ["secrets"]))


@query("analyzer_list")
def analyzer_list(spark, sf):
    """The analyzers, with what each of them finds."""
    registry = default_registry()
    registry.disable("secrets")
    counts = scan(c.corpus(spark, sf), registry=registry).groupBy("analyzer").agg(
        F.count("*").alias("n_findings")
    )
    listed = registry.list_frame(spark).withColumnRenamed("name", "analyzer")
    joined = listed.join(counts, "analyzer", "left")
    return joined.withColumn("n_findings", F.coalesce("n_findings", F.lit(0).cast("bigint")))


@query("severity_summary")
def severity_summary(spark, sf):
    corpus = c.corpus(spark, sf)
    return summary.severity_summary(scan(corpus), c.all_paths(spark, sf)).drop("max_severity")


@query("filtered_summary")
def filtered_summary(spark, sf):
    """The summary recomputed on the findings a filter keeps."""
    corpus = c.corpus(spark, sf)
    return summary.severity_summary(scan_filtered(corpus, "high"), c.all_paths(spark, sf))


@query("scan_reports")
def scan_reports(spark, sf):
    corpus, registry = c.corpus(spark, sf), default_registry()
    names = [a.name for a in registry.enabled()]
    headers = summary.scan_reports(scan(corpus, registry=registry), c.all_paths(spark, sf), names, SCAN_TIME, 2.45)
    return headers.withColumn("analyzers", F.array_join("analyzers", ","))


@query("max_severity")
def max_severity(spark, sf):
    corpus = c.corpus(spark, sf)
    return summary.severity_summary(scan(corpus), c.all_paths(spark, sf)).select("repo", "max_severity")


@query("total_summary")
def total_summary(spark, sf):
    return summary.total_summary(_everything(spark, sf))


@query("ci_gate")
def ci_gate(spark, sf):
    corpus = c.corpus(spark, sf)
    # only findings from high severity on can fail the gate
    return summary.ci_gate(scan(corpus, min_rank=RANKS["HIGH"]), c.all_paths(spark, sf))


@query("rules_first")
def rules_first(spark, sf):
    return summary.rules_first(_everything(spark, sf))


@query("rule_state")
def rule_state(spark, sf):
    """One aggregation that the summary and the list of rules follow from."""
    state = summary.rule_state(_everything(spark, sf))
    return state.select("repo", "rule_id", "severity_rank", "n", "first.title", "first.severity")


@query("report_order")
def report_order(spark, sf):
    """Findings with their place in the report; the corpus is scanned once, into a table."""
    folder = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    return sinks.numbered_report(_everything(spark, sf), folder).select(
        "ordinal", "repo", "severity_rank",
        F.col("ord.analyzer").alias("analyzer_ord"), F.col("ord.phase").alias("phase"),
        "file", F.col("ord.line").alias("line_ord"), F.col("ord.rule").alias("rule_ord"),
        F.col("ord.pos").alias("pos"), "id",
    )


@query("report_location")
def report_location(spark, sf):
    return fi.with_location(_everything(spark, sf)).select("id", "location")


@query("report_evidence")
def report_evidence(spark, sf):
    """Display columns of the findings, and of the documents' own text as evidence."""
    docs = c.documents(spark, sf).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("evidence")
    )
    found = _everything(spark, sf).select("id", "evidence")
    return found.unionByName(docs).select(
        "id",
        text.console_evidence(F.col("evidence")).alias("console_evidence"),
        text.evidence_fingerprint(F.col("evidence")).alias("fingerprint"),
        text.html_escape(F.col("evidence")).alias("html_evidence"),
    )


@query("severity_columns")
def severity_columns(spark, sf):
    """Severity-derived columns per rule, from mixed-case names."""
    kinds = _everything(spark, sf).select("rule_id", F.initcap("severity").alias("severity"))
    counted = kinds.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))
    upper = F.upper("severity")
    return counted.select(
        "rule_id", "severity", "n",
        severity.severity_rank(F.col("severity")).alias("severity_rank"),
        severity.sarif_level(upper).alias("level"),
        severity.sarif_rank(upper).alias("rank"),
        severity.severity_class(upper).alias("css_class"),
        severity.severity_icon(upper).alias("icon"),
    )


# -- reports ----------------------------------------------------------------------------


@query("sarif_results")
def sarif_results(spark, sf):
    return sarif.sarif_results(_everything(spark, sf)).select("repo", "id", "result")


def _stored(findings: DataFrame) -> DataFrame:
    """The findings from a new table in the shared folder, so that reports scan the corpus once."""
    folder = shared_dir(findings.sparkSession)
    return sinks.stored(findings, f"{folder}/findings-{uuid.uuid4().hex}")


def _document(fragments: DataFrame) -> DataFrame:
    return fragments.select("repo", "section", "band", "id", "fragment")


@query("sarif_document")
def sarif_document(spark, sf):
    corpus = c.corpus(spark, sf)
    return _document(sarif.sarif_document(_stored(scan(corpus)), c.all_paths(spark, sf), SCAN_TIME, 2.45, "low"))


@query("html_document")
def html_document(spark, sf):
    corpus = c.corpus(spark, sf)
    return _document(html.html_document(_stored(scan(corpus)), c.all_paths(spark, sf), SCAN_TIME, 2.45, "low"))


@query("text_report")
def text_report(spark, sf):
    corpus = c.corpus(spark, sf)
    return _document(text_reports.text_report(_stored(scan(corpus)), c.all_paths(spark, sf), SCAN_TIME, 2.45, "medium"))


def _report(spark, sf, name, **options) -> DataFrame:
    corpus = c.corpus(spark, sf)
    found = _stored(scan(corpus))
    return _document(sinks.report(found, c.all_paths(spark, sf), SCAN_TIME, name, **options))


@query("report_console")
def report_console(spark, sf):
    return _report(spark, sf, "Console", duration_secs=2.45, min_severity="medium")


@query("report_web")
def report_web(spark, sf):
    return _report(spark, sf, "HTML", duration_secs=2.45, min_severity="low")


@query("report_json")
def report_json(spark, sf):
    return _report(spark, sf, "json", duration_secs=2.45, min_severity="low")


def _short(findings: DataFrame, repos: DataFrame, scan_time: str) -> DataFrame:
    """A report of a user: one line per finding."""
    line = F.concat_ws(" ", F.lit(scan_time), "rule_id", "file")
    return fragments.rows(findings, fragments.FINDINGS, line, with_place=True)


@query("report_user")
def report_user(spark, sf):
    """A format of the caller."""
    return _report(spark, sf, _short)


#: A rule of a user, and findings that need only the path.
USER_RULE = Rule(
    "N1", "notes", "NOTE-001", "LOW", "License named", r"\b[A-Z]+ License\b",
    description="A license is named", remediation="Check the license",
)


def _user_findings(corpus: Corpus) -> list[DataFrame]:
    return [fi.to_findings(
        corpus.listed().where(F.col("path").endswith(".html")).select("repo", "path"),
        analyzer="notes", rule_id="NOTE-002", severity="INFO", title="Web page", file=F.col("path"),
        references=F.array(F.lit("https://example.net/notes"), F.col("path")), order=(0, 0, -1, 0, 0),
    )]


@query("user_analyzer")
def user_analyzer(spark, sf):
    """An analyzer of a user before a built-in one; both stand in the order of registration."""
    secrets = next(a for a in default_registry().analyzers if a.name == "secrets")
    registry = AnalyzerRegistry().register(
        Analyzer("notes", "Notes", rules=(USER_RULE,), analyze=_user_findings)
    ).register(secrets)
    found = scan(Corpus(c.text_files(spark, sf)), registry=registry)
    return found.select(
        *FLAT, F.array_join("references", " ").alias("refs"), F.col("ord.analyzer").alias("place")
    )


@query("findings_table")
def findings_table(spark, sf):
    """Written as a partitioned table in the shared folder and read back."""
    return _flat(_stored(_everything(spark, sf)))
