"""Canonical schemas."""

FILES = "repo STRING, path STRING, content BINARY"
#: Files of a tree: what the path says, and which piece of how many a row is.
TREE_FILES = (
    "repo STRING, path STRING, kind STRING, ignored BOOLEAN, size BIGINT, chunk INT, chunks INT, "
    "content BINARY"
)
REMOTES = "repo STRING, remote STRING, url STRING"
COMMITS = (
    "repo STRING, hash STRING, parents ARRAY<STRING>, author STRING, message STRING, "
    "commit_time TIMESTAMP"
)
HEADS = "repo STRING, hash STRING"
#: A change of the mode alone counts as a change, so entries carry it.
TREE_ENTRIES = "repo STRING, commit STRING, path STRING, blob STRING, mode STRING"
NPM_ADVISORIES = "package STRING, version STRING, cve STRING, text STRING, severity STRING"
PYTHON_ADVISORIES = "package STRING, version STRING, cve STRING, severity STRING"
OUTDATED = "package STRING, min_major INT, advice STRING"

#: Report order of a finding inside its repository; the file sits between phase and line.
ORD = "STRUCT<analyzer: INT, phase: INT, file: STRING, line: INT, rule: INT, pos: INT>"

FINDINGS = (
    "id STRING, repo STRING, analyzer STRING, rule_id STRING, severity STRING, "
    "severity_rank INT, title STRING, description STRING, file STRING, line INT, "
    "column INT, evidence STRING, remediation STRING, references ARRAY<STRING>, "
    f"ord {ORD}"
)
FINDING_COLUMNS = (
    "id", "repo", "analyzer", "rule_id", "severity", "severity_rank", "title",
    "description", "file", "line", "column", "evidence", "remediation", "references", "ord",
)
