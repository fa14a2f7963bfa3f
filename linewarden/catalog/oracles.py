"""The registered queries in SQL, for DuckDB over the same tables.

Written from the definitions, not from the Spark plans: matching is RE2, offsets come from the
pieces and full matches of each rule, joins and windows are spelled out.  RE2's ``\\b``, ``\\s``
and ``\\w`` are ASCII, so they are written out here.
"""

from __future__ import annotations

import re

from linewarden.catalog import expected, planted
from linewarden.catalog.corpora import LOCKED_AT, LOCKED_EVERY
from linewarden.functions.severity import CRITICAL_ICON, RANKS, SARIF_LEVELS, SARIF_RANKS
from linewarden.functions.text import HTML_ESCAPES
from linewarden.plans.registry import default_registry
from linewarden.reports import sarif, text as text_reports

SCAN_TIME = "2024-01-01T00:00:00Z"
SEP = "chr(31)"


def q(value) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        parts = re.split(r"([\n\t\r])", value)
        pieces = [
            f"chr({ord(p)})" if p in ("\n", "\t", "\r") else "'" + p.replace("'", "''") + "'"
            for p in parts if p
        ]
        return "(" + " || ".join(pieces) + ")" if len(pieces) > 1 else (pieces[0] if pieces else "''")
    return str(value)


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) {columns}"


def slot(rows, columns: str) -> str:
    """VALUES with a leading slot number."""
    return values([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], columns)


def in_list(names) -> str:
    return "(" + ", ".join(q(n) for n in names) + ")"


# -- corpora ----------------------------------------------------------------------------

N_LINES, N_PATHS, N_MANIFESTS = len(planted.LINES), len(planted.PATHS), len(planted.MANIFESTS)

DOCUMENT_FILES = """SELECT source AS repo, 'docs/' || doc_id || '.txt' AS path, text AS content FROM documents"""

PLANTED_FILES = f"""
SELECT source AS repo,
       CASE WHEN doc_id % {LOCKED_EVERY} = {LOCKED_AT} THEN 'yarn.lock.d/f' ELSE 'src/f' END
         || doc_id || '.' || ext AS path,
       text || chr(10) || planted AS content
FROM documents JOIN {slot([(e, l) for e, _, l in planted.LINES], "p(slot, ext, planted)")}
  ON slot = doc_id % {N_LINES}"""

PAGE_FILES = """
SELECT regexp_extract(url, '://([^/:]+)', 1) AS repo, 'pages/' || page_id || '.html' AS path,
       html || chr(10) || url AS content FROM pages"""

URL_PATH = "regexp_replace(url, '^[a-z]+://[^/]*/?', '')"
PATH_FILES = f"""
SELECT 'tree-' || doc_id AS repo, p.path AS path, CAST(NULL AS VARCHAR) AS content
FROM documents JOIN {slot(planted.PATHS, "p(slot, path)")} ON slot = doc_id % {N_PATHS}
UNION ALL SELECT 'web-' || page_id, {URL_PATH}, NULL FROM pages
UNION ALL SELECT 'web-' || page_id, {URL_PATH} || '/' || p.path, NULL
FROM pages JOIN {slot(planted.PATHS, "p(slot, path)")} ON slot = page_id % {N_PATHS}"""

PART_REQUIREMENTS = """
SELECT 'part-' || p_partkey AS repo, 'requirements.txt' AS path,
       replace(p_name, ' ', '-') || '==' || p_size || '.0' || chr(10) || '# pinned' || chr(10)
         || lower(replace(p_brand, '#', '')) || ' == ' || p_size || '.0' || chr(10) AS content
FROM part"""
PART_ADVISORIES = """(SELECT split_part(p_name, ' ', 1) AS a_package, p_size || '.0' AS a_version, 'CVE-' || p_partkey AS cve,
  'HIGH' AS a_severity, 4 AS a_rank, 0 AS adv FROM part WHERE p_partkey % 10 = 0) a"""

_PART_PACKAGE = slot(planted.PACKAGES[:3], "p(slot, package)")
PART_MANIFESTS = f"""
SELECT 'npm-' || p_partkey AS repo, 'package.json' AS path,
       '{{"dependencies":{{"' || package || '":"^' || (p_partkey % 6) || '.' || (p_size % 25) || '.' || (p_partkey % 50) || '"}}}}' AS content
FROM part JOIN {_PART_PACKAGE} ON slot = p_partkey % 3"""
PART_NPM_ADVISORIES = f"""(SELECT package AS a_package, 'CVE-' || p_partkey AS cve, p_name AS a_text,
  (p_partkey % 6) || '.' || (p_size % 25) || CASE WHEN p_partkey % 7 <> 0 THEN '.' || (p_partkey % 50) ELSE '' END AS a_version,
  'MEDIUM' AS a_severity, 3 AS a_rank, 0 AS adv
  FROM part JOIN {_PART_PACKAGE} ON slot = p_partkey % 3) a"""

PLANTED_MANIFESTS = f"""
SELECT 'app-' || doc_id AS repo, p.path AS path, p.content AS content
FROM documents JOIN {slot(planted.MANIFESTS, "p(slot, path, content)")} ON slot = doc_id % {N_MANIFESTS}"""

ORDER_MANIFESTS = f"""
SELECT 'order-' || l_orderkey AS repo, 'package.json' AS path,
       '{{"dependencies":{{' || string_agg('"' || package || '":"' || version || '"', ',' ORDER BY package) || '}}}}' AS content
FROM (SELECT l_orderkey, package, max(version) AS version
      FROM lineitem JOIN {slot(planted.PACKAGES, "a(sa, package)")} ON sa = l_partkey % {len(planted.PACKAGES)}
                    JOIN {slot(planted.VERSIONS, "b(sb, version)")} ON sb = l_suppkey % {len(planted.VERSIONS)}
      GROUP BY ALL)
GROUP BY l_orderkey"""

CONFIG_FILES = f"""
SELECT 'site-' || page_id AS repo, '.git/config' AS path, before || url || after AS content
FROM pages JOIN {slot([tuple(c.split("{url}")) for c in planted.CONFIGS], "p(slot, before, after)")}
  ON slot = page_id % {len(planted.CONFIGS)}"""


def union(*parts: str) -> str:
    return " UNION ALL ".join(f"SELECT repo, path, content FROM ({p})" for p in parts)


CHAT_FILES = """
SELECT 'chat-' || conv_id AS repo, 'turns/' || turn || '.txt' AS path, text AS content FROM conversations"""
ALL_FILES = union(
    PLANTED_FILES, PAGE_FILES, PATH_FILES, PLANTED_MANIFESTS, CONFIG_FILES, CHAT_FILES, ORDER_MANIFESTS
)
TEXT_FILES = union(PLANTED_FILES, PAGE_FILES, CHAT_FILES)
MANIFEST_FILES = union(PLANTED_MANIFESTS, ORDER_MANIFESTS)

# -- path expressions --------------------------------------------------------------------

BASE = "regexp_extract(path, '[^/]*$')"
RAW_EXT = (
    f"CASE WHEN regexp_matches({BASE}, '^.+\\.[^.]*$') AND {BASE} <> '..' "
    f"THEN regexp_extract({BASE}, '([^.]*)$', 1) END"
)
EXT = f"lower({RAW_EXT})"
LISTED = f"NOT coalesce({RAW_EXT} IN {in_list(expected.LISTING_BINARY_EXTENSIONS)}, false)"
LANGUAGE = "CASE " + RAW_EXT + " " + " ".join(
    f"WHEN {q(k)} THEN {q(v)}" for k, v in expected.LANGUAGES.items()
) + " END"
URL_SKIPPED = "(" + " OR ".join(f"contains(path, {q(n)})" for n in expected.URL_SKIPPED_NAMES) + ")"


def below_ignored(names) -> str:
    return " OR ".join(f"contains('/' || path, {q('/' + n + '/')})" for n in names)


# -- lines and rules ---------------------------------------------------------------------


def lines_cte(files: str) -> str:
    return f"""
files AS ({files}),
cut AS (SELECT repo, path, string_split(content, chr(10)) AS parts FROM files
        WHERE content IS NOT NULL AND content <> ''),
numbered AS (SELECT repo, path, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut),
lines AS (
  SELECT repo, path, CAST(i - 1 AS INTEGER) AS line,
         CASE WHEN i < len(parts) AND ends_with(parts[i], chr(13))
              THEN left(parts[i], length(parts[i]) - 1) ELSE parts[i] END AS text
  FROM numbered WHERE NOT (i = len(parts) AND parts[i] = ''))"""


WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
SPACE = r"\s\v\x{85}\p{Z}"
#: The nested forms of two rules, which RE2 matches in linear time.
NESTED = {
    "L03": r"fs\.(readFile|writeFile|unlink)\s*\(\s*[^,]*\s*\+",
    "L04": r"require\s*\(\s*[^)]*\+",
}


def re2(pattern: str, ci: bool) -> str:
    """(lead)(match) with Unicode classes written out."""
    lead, tail = "()", ""
    if pattern.startswith(r"\b"):
        lead, pattern = rf"((?:^|[^{WORD}]))", pattern[2:]
    if pattern.endswith(r"\b"):
        tail, pattern = rf"(?:$|[^{WORD}])", pattern[:-2]
    out, in_class, i = "", False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\w"):
            body = SPACE if two == r"\s" else WORD
            out += body if in_class else f"[{body}]"
            i += 2
            continue
        if two[0] == "\\":
            out += two
            i += 2
            continue
        in_class = (two[0] == "[") if not in_class else two[0] != "]"
        out += two[0]
        i += 1
    return f"{'(?i)' if ci else ''}{lead}({out}){tail}"


def _placed():
    for a_ord, analyzer in enumerate(expected.ANALYZERS):
        rules = [rule for rule in expected.RULES if rule.analyzer == analyzer]
        for r_ord, rule in enumerate(rules):
            yield a_ord, r_ord, rule


def rule_matches(condition=lambda rule: True, placed=None) -> str:
    """UNION ALL of every rule's matches over the CTE ``lines``."""
    parts = []
    for a_ord, r_ord, rule in placed or _placed():
        if not condition(rule):
            continue
        pattern = q(re2(NESTED.get(rule.code, rule.pattern), rule.ci))
        where = [f"regexp_matches(text, {pattern})", LISTED]
        if rule.skips_lock_files:
            where.append(f"NOT {URL_SKIPPED}")
        if rule.language:
            where.append(f"({LANGUAGE}) = {q(rule.language)}")
        title = q(rule.title) + (" || m[i]" if rule.title_takes_match else "")
        parts.append(f"""
SELECT repo, {q(rule.analyzer)} AS analyzer, {q(rule.rule_id)} AS rule_id, {q(rule.severity)} AS severity,
       {RANKS[rule.severity]} AS severity_rank, {title} AS title, {q(rule.description)} AS description,
       path AS file, line,
       CAST(strlen(coalesce(array_to_string(p[1:i], ''), '')) + strlen(coalesce(array_to_string(f[1:i-1], ''), ''))
            + strlen(l[i]) AS INTEGER) AS "column",
       m[i] AS evidence, {q(rule.remediation)} AS remediation,
       {a_ord} AS o_analyzer, 0 AS o_phase, line AS o_line, {r_ord} AS o_rule, NULL AS o_pos, '' AS o_key
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT repo, path, line, regexp_extract_all(text, {pattern}, 2) AS m, regexp_extract_all(text, {pattern}, 0) AS f,
             regexp_extract_all(text, {pattern}, 1) AS l, regexp_split_to_array(text, {pattern}) AS p
      FROM lines WHERE {' AND '.join(where)}))""")
    return f"SELECT * REPLACE (\"column\" AS o_pos) FROM ({' UNION ALL '.join(parts)})"


def finding(
    source, analyzer, rule_id, severity, title, file, order, *, rank=None, evidence="NULL",
    remediation="NULL", key="''",
) -> str:
    """SELECT of a finding without a line."""
    rank = rank or str(RANKS[severity.strip("'")])
    phase, line, rule, pos = order
    return f"""
SELECT repo, {q(analyzer)} AS analyzer, {q(rule_id)} AS rule_id, {severity} AS severity, {rank} AS severity_rank,
       {title} AS title, '' AS description, {file} AS file, CAST(NULL AS INTEGER) AS line, CAST(NULL AS INTEGER) AS "column",
       {evidence} AS evidence, {remediation} AS remediation,
       {expected.ANALYZERS.index(analyzer)} AS o_analyzer, {phase} AS o_phase, {line} AS o_line, {rule} AS o_rule, {pos} AS o_pos,
       {key} AS o_key
FROM {source}"""


ID = f"""sha256(concat_ws({SEP}, repo, analyzer, rule_id, title, file,
  coalesce(CAST(line AS VARCHAR), ''), coalesce(CAST("column" AS VARCHAR), ''), coalesce(evidence, ''),
  CAST(o_phase AS VARCHAR), CAST(o_line AS VARCHAR), CAST(o_rule AS VARCHAR), CAST(o_pos AS VARCHAR), o_key))"""
FLAT = (
    "id, repo, analyzer, rule_id, severity, CAST(severity_rank AS INTEGER) AS severity_rank, title, description, "
    'file, CAST(line AS INTEGER) AS line, CAST("column" AS INTEGER) AS "column", evidence, remediation'
)


def findings_cte(*parts: str) -> str:
    body = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    return f"findings AS MATERIALIZED (SELECT *, {ID} AS id FROM ({body}))"


# -- path findings -----------------------------------------------------------------------


def extension_findings(files: str = "files") -> str:
    rows = [(i, s, t, sev, RANKS[sev]) for i, (s, t, sev) in enumerate(expected.SUSPICIOUS_EXTENSIONS)]
    source = (
        f"{files} JOIN {values(rows, 'x(k, suffix, x_title, x_severity, x_rank)')} "
        f"ON ends_with(path, suffix) WHERE {LISTED}"
    )
    return finding(
        source, "file-ops", "FILE-EXT-001", "x_severity", "x_title", "path", (0, -1, "k", 0),
        rank="x_rank", remediation="'Consider whether this file should be in version control'",
    )


def manifests_sql(files: str = "files", nested: bool = False) -> str:
    name = BASE if nested else "path"
    exact = [(i, n.lower(), l, d) for i, (n, l, d) in enumerate(expected.MANIFEST_NAMES)]
    suffix = [
        (i, n, l, d) for i, (n, l, d) in enumerate(expected.MANIFEST_SUFFIXES, len(expected.MANIFEST_NAMES))
    ]
    cols = "v(rank, name, language, description)"
    return f"""
SELECT repo, path, content, language, description, rank FROM {files} JOIN {values(exact, cols)} ON lower({name}) = name WHERE {LISTED}
UNION ALL
SELECT repo, path, content, language, description, rank FROM {files} JOIN {values(suffix, cols)} ON ends_with(lower(path), name) WHERE {LISTED}"""


def manifest_findings(nested: bool = False) -> str:
    audit = "CASE language " + " ".join(
        f"WHEN {q(l)} THEN {q(c)}" for l, c in expected.AUDITS.items()
    ) + f" ELSE {q(expected.OTHER_AUDIT)} END"
    return finding(
        f"({manifests_sql(nested=nested)})", "dependencies", "DEP-FILE-001", "'INFO'",
        "description || ' dependency file'", "path", (0, 0, "rank", 0),
        remediation=f"'Consider running a security audit: ' || {audit}",
    )


def npm_cte(nested: bool = False) -> str:
    """CTE npm: packages of the javascript manifests; the last of equal keys counts."""
    return f"""
docs AS (SELECT repo, path, CAST(CASE WHEN language = 'javascript' AND content <> '' AND json_valid(content)
                                         THEN content END AS JSON) AS doc FROM ({manifests_sql(nested=nested)})),
sections AS (
  SELECT repo, path, s, section, json_extract(doc, '$.' || section) AS packages
  FROM docs, (VALUES (0, 'dependencies'), (1, 'devDependencies')) t(s, section)
  WHERE json_type(doc) = 'OBJECT' AND json_type(json_extract(doc, '$.' || section)) = 'OBJECT'),
members AS (SELECT sections.repo, sections.path, s, section, e.key AS package, e.value AS v, e.type AS vtype, e.id AS pos
            FROM sections, json_each(packages) e),
latest AS (SELECT repo, path, s, section, package, max_by(v, pos) AS v, max_by(vtype, pos) AS vtype
           FROM members GROUP BY ALL),
npm AS (
  SELECT repo, path, s, section, package, CASE WHEN vtype = 'VARCHAR' THEN v ->> '$' END AS raw_version,
         regexp_replace(coalesce(CASE WHEN vtype = 'VARCHAR' THEN v ->> '$' END, '*'), '^\\^*~*(?:>=)*=*', '') AS version,
         row_number() OVER (PARTITION BY repo, path, s ORDER BY package) - 1 AS n
  FROM latest)"""


def npm_vuln(advisories: str | None = None) -> str:
    rows = [(i, *r, RANKS[r[4]]) for i, r in enumerate(expected.NPM_ADVISORIES)]
    cols = "a(adv, a_package, a_version, cve, a_text, a_severity, a_rank)"
    return finding(
        f"npm JOIN {advisories or values(rows, cols)} ON package = a_package AND "
        "(version = a_version OR starts_with(version, a_version || '.'))",
        "dependencies", "DEP-VULN-001", "a_severity", "'Vulnerable dependency: ' || cve || ': ' || a_text",
        "path", (1, "s", "n", "adv"), rank="a_rank", evidence="package || '@' || version",
        remediation="'Upgrade ' || package || ' to a patched version'",
    )


def npm_outdated() -> str:
    rows = [(i, *r) for i, r in enumerate(expected.OUTDATED)]
    first = "split_part(version, '.', 1)"
    return finding(
        f"npm JOIN {values(rows, 'a(adv, a_package, min_major, advice)')} ON lower(package) = a_package AND "
        f"CASE WHEN regexp_full_match({first}, '[+-]?[0-9]+') THEN TRY_CAST(ltrim({first}, '+') AS INTEGER) END < min_major",
        "dependencies", "DEP-OUTDATED-001", "'LOW'", "'Outdated major version of ' || package", "path",
        (1, "s", "n", f"adv + {1 << 30}"), evidence="package || '@' || version",
        remediation="advice",
    )


def python_cte(nested: bool = False) -> str:
    return f"""
pyfiles AS (SELECT repo, path, string_split(content, chr(10)) AS parts FROM ({manifests_sql(nested=nested)})
            WHERE language = 'python' AND content <> ''),
pylines AS (SELECT repo, path, i - 1 AS line, trim(parts[i], ' ' || chr(9) || chr(13)) AS t
            FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM pyfiles)),
reqs AS (SELECT repo, path, CAST(line AS INTEGER) AS line,
                lower(trim(left(t, instr(t, '==') - 1))) AS package, trim(substr(t, instr(t, '==') + 2)) AS version
         FROM pylines WHERE t <> '' AND NOT starts_with(t, '#') AND contains(t, '=='))"""


def python_vuln(advisories: str | None = None) -> str:
    rows = [(i, *r, RANKS[r[3]]) for i, r in enumerate(expected.PYTHON_ADVISORIES)]
    given = advisories or values(rows, "a(adv, a_package, a_version, cve, a_severity, a_rank)")
    return finding(
        f"reqs JOIN {given} ON version = a_version AND contains(package, a_package)",
        "dependencies", "DEP-VULN-001", "a_severity", "'Vulnerable Python package: ' || cve", "path",
        (1, "line", 0, "adv"), rank="a_rank", evidence="package || '==' || version",
        remediation="'Upgrade ' || package || ' to a patched version'",
    )


def rust_info(nested: bool = False) -> str:
    return finding(
        f"({manifests_sql(nested=nested)}) WHERE language = 'rust' AND "
        "(contains(content, '[dependencies]') OR contains(content, '[dev-dependencies]'))",
        "dependencies", "DEP-INFO-001", "'INFO'", "'Rust dependencies detected in ' || path", "path",
        (1, 0, 0, 0), remediation="'Run `cargo audit` to check for vulnerabilities'",
    )


def remotes_cte(files: str = "files") -> str:
    """CTE remotes: the section header is carried forward over the lines of the config."""
    return f"""
clines AS (SELECT repo, i, trim(parts[i], ' ' || chr(9) || chr(13)) AS t FROM (
    SELECT repo, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT repo, string_split(content, chr(10)) AS parts FROM {files} WHERE path = '.git/config' AND content IS NOT NULL))),
headed AS (SELECT repo, i, t, last_value(CASE WHEN starts_with(t, '[') THEN t END IGNORE NULLS)
             OVER (PARTITION BY repo ORDER BY i ROWS UNBOUNDED PRECEDING) AS header FROM clines),
remotes AS (
  SELECT repo, remote, max_by(url, i) AS url FROM (
    SELECT repo, i, regexp_extract(header, '(?i)^\\[ *remote +"([^"]*)" *\\]', 1) AS remote,
           trim(replace(regexp_extract(t, '(?i)^url[ ' || chr(9) || ']*=[ ' || chr(9) || ']*("[^"]*"|[^"#;]*)', 1), '"', '')) AS url
    FROM headed WHERE regexp_matches(header, '(?i)^\\[ *remote +"') AND regexp_matches(t, '(?i)^url[ ' || chr(9) || ']*='))
  WHERE url <> '' GROUP BY repo, remote)"""


def insecure_remotes() -> str:
    return finding(
        "remotes WHERE contains(url, 'http://') AND NOT contains(url, 'localhost')",
        "url", "GIT-INSECURE-REMOTE", "'MEDIUM'", "'Git remote uses insecure HTTP protocol'", "'.git/config'",
        (1, 0, 0, 0), evidence="url", key="remote",
        remediation="'Change remote URL to use HTTPS with SSH or HTTPS protocol'",
    )


def _scan(files: str, *parts: str, ctes: tuple[str, ...] = ()) -> str:
    return "WITH " + ",".join((lines_cte(files), *ctes, findings_cte(*parts)))


def everything(condition=lambda rule: True) -> str:
    """WITH clause whose ``findings`` is a scan of all files."""
    return _scan(
        ALL_FILES, rule_matches(condition), insecure_remotes(), extension_findings(), manifest_findings(),
        npm_vuln(), npm_outdated(), python_vuln(), ctes=(remotes_cte(), npm_cte(), python_cte()),
    )


COUNTS = ", ".join(
    f"count(*) FILTER (WHERE severity_rank = {rank}) AS {name.lower()}" for name, rank in RANKS.items()
)
RANK_NAME = "CASE max(severity_rank) " + " ".join(f"WHEN {r} THEN {q(n)}" for n, r in RANKS.items()) + " END"
TOTAL = "count(severity_rank) AS total"


def summary_cte(where: str = "true") -> str:
    return f"""
known AS (SELECT DISTINCT repo FROM files),
summary AS MATERIALIZED (SELECT k.repo AS repo, {COUNTS}, {TOTAL}, {RANK_NAME} AS max_severity
            FROM known k LEFT JOIN (SELECT * FROM findings WHERE {where}) f ON k.repo = f.repo GROUP BY k.repo)"""


LOCATION = (
    "CASE WHEN line IS NULL THEN file WHEN \"column\" IS NULL THEN file || ':' || (line + 1) "
    "ELSE file || ':' || (line + 1) || ':' || (\"column\" + 1) END"
)
ORDERING = "o_analyzer, o_phase, file, o_line, o_rule, o_pos, id"


def console_evidence(column: str = "evidence") -> str:
    """The longest prefix of whole characters within 77 bytes, if longer than 80 bytes."""
    return (
        f"CASE WHEN strlen({column}) > 80 THEN left({column}, CAST(list_max(list_filter(range(0, 78), "
        f"lambda n: strlen(left({column}, n)) <= 77)) AS BIGINT)) || '...' ELSE {column} END"
    )


def html_escape(column: str) -> str:
    for raw, entity in HTML_ESCAPES:
        column = f"replace({column}, {q(raw)}, {q(entity)})"
    return column


def case_of(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def js(value: str) -> str:
    """A JSON string."""
    return f"CAST(to_json({value}) AS VARCHAR)"


RESULT = f"""'{{' || CASE WHEN evidence IS NOT NULL THEN '"fingerprints":{{"evidence":' || {js('left(evidence, 100)')} || '}},' ELSE '' END
 || CASE WHEN remediation IS NOT NULL THEN '"fixes":[{{"description":{{"text":' || {js('remediation')} || '}}}}],' ELSE '' END
 || '"level":' || {js(case_of(SARIF_LEVELS, 'severity'))}
 || ',"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || {js('file')} || '}}'
 || CASE WHEN line IS NULL THEN '' ELSE ',"region":{{' || CASE WHEN "column" IS NULL THEN '' ELSE '"startColumn":' || ("column" + 1) || ',' END
      || '"startLine":' || (line + 1) || '}}' END
 || '}}}}],"message":{{"text":' || {js("CASE WHEN description <> '' THEN title || chr(10) || chr(10) || description ELSE title END")}
 || '}},"ruleId":' || {js('rule_id')} || '}}'"""


def _fragments(*parts: str) -> str:
    return " UNION ALL ".join(
        f'SELECT repo, CAST(section AS INTEGER) AS section, CAST(band AS INTEGER) AS band, id, fragment FROM ({p})'
        for p in parts
    )


def sarif_document() -> str:
    rule = f"""'{{"defaultConfiguration":{{"level":' || {js(case_of(SARIF_LEVELS, 'severity'))} || '}},"fullDescription":{{"text":'
 || {js('description')} || '}},"help":{{"text":' || {js(f"coalesce(remediation, {q(sarif.NO_REMEDIATION)})")} || '}},"id":' || {js('rule_id')}
 || ',"name":' || {js('rule_id')} || ',"properties":{{"analyzer":' || {js('analyzer')} || ',"severity":' || {js('severity')}
 || '}},"shortDescription":{{"text":' || {js('title')} || '}}}}'"""
    head = f"""'{{"$schema":"{sarif.SCHEMA_URI}","runs":[{{"artifacts":[{{"description":{{"text":"Scanned repository"}},"location":{{"uri":'
 || {js('repo')} || '}}}}],"invocation":{{"endTimeUtc":"{SCAN_TIME}","startTimeUtc":"{SCAN_TIME}","toolExecutionNotifications":[{{"level":"info","message":{{"text":"Scan completed in 2.45s"}}}}]}},"results":['"""
    tail = f"""'],"tool":{{"driver":{{"name":"{sarif.TOOL_NAME}","rules":[' || coalesce(rules, '')
 || '],"version":"{sarif.TOOL_VERSION}"}}}}}}],"version":"{sarif.VERSION}"}}'"""
    return everything() + f""",
known AS (SELECT DISTINCT repo FROM files),
kept AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {ORDERING}) AS n,
                row_number() OVER (PARTITION BY repo, rule_id ORDER BY {ORDERING}) AS rn
         FROM findings WHERE severity_rank >= 2),
rules AS (SELECT repo, string_agg({rule}, ',' ORDER BY rule_id) AS rules FROM kept WHERE rn = 1 GROUP BY repo)
""" + _fragments(
        f"SELECT repo, 0 AS section, 0 AS band, NULL AS id, {head} AS fragment FROM known",
        f"SELECT repo, 1 AS section, 0 AS band, id, CASE WHEN n = 1 THEN '' ELSE ',' END || {RESULT} AS fragment FROM kept",
        f"SELECT k.repo, 2 AS section, 0 AS band, NULL AS id, {tail} AS fragment FROM known k LEFT JOIN rules r ON k.repo = r.repo",
    )


def html_document() -> str:
    cells = " || ".join(
        f"'<li class=\"{n}\">{n.capitalize()}: ' || {n} || '</li>'"
        for n in (*[s.lower() for s in RANKS], "total")
    )
    head = f"""'<!DOCTYPE html>' || chr(10) || '<html lang="en"><head><meta charset="utf-8"><title>' || {html_escape('repo')}
 || '</title></head><body>' || chr(10) || '<h1>Security Scan Report</h1>' || chr(10) || '<p>' || {html_escape('repo')} || '</p>' || chr(10)
 || '<p>Scan Time: {SCAN_TIME} | Duration: 2.45s</p>' || chr(10) || '<ul>' || {cells} || '</ul>' || chr(10) || '<main>'"""
    one = f"""'<article class="finding severity-' || lower(severity) || '" data-severity="' || lower(severity) || '" data-analyzer="' || analyzer || '">'
 || '<h3>' || CASE WHEN severity = 'CRITICAL' THEN {q(CRITICAL_ICON)} ELSE '' END || '<span>' || severity || '</span> ' || {html_escape('title')}
 || ' <small>' || {html_escape('rule_id')} || '</small></h3>' || '<p class="location"><b>Location:</b> <code>' || {html_escape(LOCATION)} || '</code></p>'
 || CASE WHEN description <> '' THEN '<p class="description">' || {html_escape('description')} || '</p>' ELSE '' END
 || CASE WHEN evidence IS NOT NULL THEN '<p class="evidence"><b>Evidence:</b> <code>' || {html_escape('evidence')} || '</code></p>' ELSE '' END
 || CASE WHEN remediation IS NOT NULL THEN '<p class="remediation"><b>Remediation:</b> ' || {html_escape('remediation')} || '</p>' ELSE '' END
 || '</article>'"""
    return everything() + "," + summary_cte() + _fragments(
        f"SELECT repo, 0 AS section, 0 AS band, NULL AS id, {head} AS fragment FROM summary",
        f"SELECT repo, 1 AS section, 0 AS band, id, {one} AS fragment FROM findings WHERE severity_rank >= 2",
        "SELECT repo, 2 AS section, 0 AS band, NULL AS id, '</main>' || chr(10) || '</body></html>' AS fragment FROM summary",
    )


def text_report() -> str:
    nl = "chr(10)"
    some = " || ".join(
        f"CASE WHEN {n.lower()} > 0 THEN '  {n.capitalize()}: ' || {n.lower()} || {nl} ELSE '' END" for n in RANKS
    )
    head = f"""'Security Scan Report' || {nl} || '{text_reports.RULE_LINE}' || {nl} || {nl} || 'Repository: ' || repo || {nl}
 || 'Scan Time: {SCAN_TIME}' || {nl} || 'Duration: 2.45s' || {nl} || {nl} || 'Summary' || {nl} || {some} || '  Total: ' || total || {nl}"""
    one = f"""'[' || severity || '] ' || title || {nl} || '  Rule: ' || rule_id || {nl} || '  Location: ' || {LOCATION} || {nl}
 || CASE WHEN description <> '' THEN '  Description: ' || description || {nl} ELSE '' END
 || CASE WHEN evidence IS NOT NULL THEN '  Evidence: ' || {console_evidence()} || {nl} ELSE '' END
 || CASE WHEN remediation IS NOT NULL THEN '  Remediation: ' || remediation || {nl} ELSE '' END"""
    shown = [n for n, r in RANKS.items() if r >= RANKS["MEDIUM"]]
    titles = [
        f"SELECT repo, 1 AS section, {-RANKS[n]} AS band, NULL AS id, '{n} Findings' AS fragment FROM summary WHERE {n.lower()} > 0"
        for n in shown
    ]
    return everything() + "," + summary_cte() + _fragments(
        f"SELECT repo, 0 AS section, 0 AS band, NULL AS id, {head} AS fragment FROM summary",
        *titles,
        f"SELECT repo, 1 AS section, 0 AS band, NULL AS id, '{text_reports.NOTHING}' AS fragment FROM summary "
        f"WHERE {' + '.join(n.lower() for n in shown)} = 0",
        f"SELECT repo, 1 AS section, -severity_rank AS band, id, {one} AS fragment FROM findings WHERE severity_rank >= 3",
        f"SELECT repo, 2 AS section, 0 AS band, NULL AS id, '{text_reports.RULE_LINE}' || {nl} || 'Generated by linewarden' AS fragment FROM summary",
    )


def user_analyzer() -> str:
    rule = expected.Expected(
        "N1", "notes", "NOTE-001", "LOW", "License named", r"\b[A-Z]+ License\b",
        description="A license is named", remediation="Check the license",
    )
    secrets = [r for r in expected.RULES if r.analyzer == "secrets"]
    placed = [(0, 0, rule), *((1, i, r) for i, r in enumerate(secrets))]
    pages = finding(
        f"files WHERE {LISTED} AND ends_with(path, '.html')", "url", "NOTE-002", "'INFO'", "'Web page'", "path",
        (0, -1, 0, 0),
    )
    pages = f"SELECT * REPLACE ('notes' AS analyzer) FROM ({pages})"
    return _scan(TEXT_FILES, rule_matches(placed=placed), pages) + f"""
 SELECT {FLAT}, CASE WHEN rule_id = 'NOTE-002' THEN 'https://example.net/notes ' || file ELSE '' END AS refs,
        CAST(o_analyzer AS INTEGER) AS place FROM findings"""


# -- indicators --------------------------------------------------------------------------

TEXTS = f"""
SELECT 'documents' AS origin, path AS row_id, content AS text FROM ({PLANTED_FILES})
UNION ALL SELECT 'conversations', conv_id || '/' || turn, text FROM conversations
UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), html FROM pages
UNION ALL SELECT 'page_urls', CAST(page_id AS VARCHAR), url FROM pages"""


def indicator(name: str) -> str:
    pattern, ci = expected.PATTERNS[name]
    expression = q(re2(pattern, ci))
    return f"""
SELECT origin, row_id, CAST(i - 1 AS INTEGER) AS position, m[i] AS value FROM (
  SELECT origin, row_id, m, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT origin, row_id, regexp_extract_all(text, {expression}, 2) AS m FROM ({TEXTS})))"""


def _path(column: str, expression: str) -> str:
    return f"SELECT repo, path, {expression} AS {column} FROM ({PATH_FILES})"


def _starts(column: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {q(p)})" for p in prefixes) + ")"


def sql() -> dict[str, str]:
    all_findings = everything()
    flat = f" SELECT {FLAT} FROM findings"
    with_pages = union(PLANTED_FILES, PAGE_FILES)
    manifest_only = "WITH files AS ({}),"
    url = "trim(candidate, ' ' || chr(9) || chr(10) || chr(13))"
    ssh = _starts(url, expected.SSH_PREFIXES)
    known_host = "(" + " OR ".join(f"contains({url}, {q(h)})" for h in expected.KNOWN_HOSTS) + ")"
    rest = "regexp_replace(url, '^https?://', '')"
    name = "coalesce(nullif(regexp_extract(root, '([^/]+)/*$', 1), ''), 'unknown')"
    by_rank = lambda least: f"severity_rank >= {least}"

    out = {
        "lines_documents": f"WITH {lines_cte(DOCUMENT_FILES)} SELECT repo, path, line, text FROM lines",
        "lines_bytes": f"""WITH {lines_cte("SELECT source AS repo, 'raw/' || doc_id AS path, text AS content FROM documents WHERE doc_id % 3 <> 0")}
            SELECT repo, path, line, text FROM lines""",
        "deps_python_table": manifest_only.format(PART_REQUIREMENTS) + python_cte() + ","
        + findings_cte(python_vuln(PART_ADVISORIES)) + f" SELECT * EXCLUDE (id) FROM (SELECT {FLAT} FROM findings)",
        "report_console": text_report(),
        "report_web": html_document(),
        "report_json": sarif_document(),
        "report_user": all_findings + f"""
            SELECT repo, 1 AS section, 0 AS band, id, '{SCAN_TIME} ' || rule_id || ' ' || file AS fragment FROM findings""",
        "user_analyzer": user_analyzer(),
        "file_stats": f"""WITH {lines_cte(with_pages)}
            SELECT f.repo, f.path, strlen(content) AS n_bytes, coalesce(n, 0) AS n_lines
            FROM files f LEFT JOIN (SELECT repo, path, count(*) AS n FROM lines GROUP BY ALL) l
              ON f.repo = l.repo AND f.path = l.path""",
        "source_listing": f"""SELECT repo, path, {LISTED} AS listed, {below_ignored(expected.LISTING_IGNORED_DIRS)} AS below_ignored
            FROM ({PATH_FILES})""",
        "path_binary": _path("is_binary", f"coalesce({EXT} IN {in_list(expected.BINARY_EXTENSIONS)}, false)"),
        "path_lockfile": _path("is_lock_file", f"lower({BASE}) IN {in_list(expected.LOCK_FILES)}"),
        "path_text": _path("is_text", f"coalesce({EXT} IN {in_list(expected.TEXT_EXTENSIONS)}, true)"),
        "path_extension": _path("extension", EXT),
        "path_language": _path("language", LANGUAGE),
        "path_url_skipped": _path("url_skipped", URL_SKIPPED),
        "path_ignored": f"""SELECT repo, path, CAST(i - 1 AS INTEGER) AS depth, parts[i] AS name,
              parts[i] IN {in_list(expected.IGNORED_DIRS)} AS is_ignored
            FROM (SELECT repo, path, parts, unnest(range(1, len(parts))) AS i FROM (
              SELECT repo, path, string_split(path, '/') AS parts FROM ({PATH_FILES})))""",
        "indicators_all": "SELECT origin, indicator, count(*) AS n_matches, count(DISTINCT row_id) AS n_rows FROM ("
        + " UNION ALL ".join(f"SELECT *, {q(n)} AS indicator FROM ({indicator(n)})" for n in expected.PATTERNS)
        + ") GROUP BY origin, indicator",
        "scan_url": _scan(
            union(PLANTED_FILES, PAGE_FILES, CONFIG_FILES), rule_matches(lambda r: r.analyzer == "url"),
            insecure_remotes(), ctes=(remotes_cte(),),
        ) + flat,
        "scan_domains": _scan(with_pages, rule_matches(lambda r: r.code[0] == "D")) + flat,
        "scan_secrets": _scan(TEXT_FILES, rule_matches(lambda r: r.code[0] == "S")) + flat,
        "scan_file_ops": _scan(
            union(PLANTED_FILES, PAGE_FILES, PATH_FILES), rule_matches(lambda r: r.analyzer == "file-ops"),
            extension_findings(),
        ) + flat,
        "scan_language_rules": _scan(TEXT_FILES, rule_matches(lambda r: r.code[0] == "L")) + flat,
        "scan_extensions": f"WITH files AS ({PATH_FILES}), {findings_cte(extension_findings())} {flat}",
        "scan_dependencies": manifest_only.format(MANIFEST_FILES) + npm_cte() + "," + python_cte() + ","
        + findings_cte(manifest_findings(), npm_vuln(), npm_outdated(), python_vuln()) + flat,
        "scan_all": all_findings + flat,
        "scan_pruned": _scan(
            f"SELECT * FROM ({ALL_FILES}) WHERE NOT ({below_ignored(expected.LISTING_IGNORED_DIRS)})",
            rule_matches(lambda r: r.analyzer == "file-ops"), extension_findings(), manifest_findings(True),
            npm_vuln(), npm_outdated(), python_vuln(), rust_info(True), ctes=(npm_cte(True), python_cte(True)),
        ) + flat,
        "manifests": f"WITH files AS ({PATH_FILES}), {findings_cte(manifest_findings())} {flat}",
        "deps_npm": manifest_only.format(MANIFEST_FILES) + npm_cte()
        + " SELECT repo, path, section, package, version, raw_version FROM npm",
        "deps_npm_vuln": manifest_only.format(MANIFEST_FILES) + npm_cte() + "," + findings_cte(npm_vuln()) + flat,
        "deps_npm_outdated": manifest_only.format(MANIFEST_FILES) + npm_cte() + "," + findings_cte(npm_outdated()) + flat,
        "deps_python": manifest_only.format(PLANTED_MANIFESTS) + python_cte()
        + " SELECT repo, path, line, package, version FROM reqs",
        "deps_python_vuln": manifest_only.format(PLANTED_MANIFESTS) + python_cte() + "," + findings_cte(python_vuln()) + flat,
        "deps_npm_table": manifest_only.format(PART_MANIFESTS) + npm_cte() + ","
        + findings_cte(npm_vuln(PART_NPM_ADVISORIES)) + f" SELECT * EXCLUDE (id) FROM (SELECT {FLAT} FROM findings)",
        "deps_rust_info": f"WITH files AS ({PLANTED_MANIFESTS}), {findings_cte(rust_info())} {flat}",
        "git_remotes": f"WITH files AS ({CONFIG_FILES}), {remotes_cte()} SELECT repo, remote, url FROM remotes",
        "git_origin": f"WITH files AS ({CONFIG_FILES}), {remotes_cte()} SELECT repo, url FROM remotes WHERE remote = 'origin'",
        "git_insecure_remote": f"WITH files AS ({CONFIG_FILES}), {remotes_cte()}, {findings_cte(insecure_remotes())} {flat}",
        "git_recent_commits": """
            SELECT repo, hash, author, message, commit_time, CAST(position AS INTEGER) AS position, n_parents FROM (
              SELECT 'r' || (o_orderkey % 100) AS repo, CAST(o_orderkey AS VARCHAR) AS hash,
                     CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority ELSE 'Unknown' END AS author,
                     CASE WHEN o_orderstatus <> 'P' THEN 'order ' || o_orderstatus ELSE '' END AS message,
                     o_orderdate AS commit_time, CAST(CASE WHEN o_orderkey >= 100 THEN 1 ELSE 0 END AS INTEGER) AS n_parents,
                     row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS position
              FROM orders) WHERE position <= 100""",
        "git_head_commits": """
            WITH RECURSIVE base AS (
              SELECT o_orderkey AS k, o_orderkey // 100 AS place, 'r' || (o_orderkey % 100) AS repo, CAST(o_orderkey AS VARCHAR) AS hash,
                     CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority ELSE 'Unknown' END AS author,
                     CASE WHEN o_orderstatus <> 'P' THEN 'order ' || o_orderstatus ELSE '' END AS message, o_orderdate AS commit_time
              FROM orders),
            commits AS (
              SELECT repo, hash, author, message, commit_time,
                     list_filter([CASE WHEN k >= 100 THEN CAST(k - 100 AS VARCHAR) END,
                                  CASE WHEN k >= 100 AND place % 10 = 1 THEN 'c' || (k - 100) END], lambda p: p IS NOT NULL) AS parents
              FROM base
              UNION ALL SELECT repo, 'b' || hash, 'b', message, commit_time, [hash] FROM base WHERE place % 5 = 0
              UNION ALL SELECT repo, 'c' || hash, 'c', message, commit_time, ['b' || hash] FROM base WHERE place % 5 = 0),
            links AS (SELECT repo, hash, unnest(parents) AS parent FROM commits),
            reached(repo, hash) AS (
              SELECT repo, CAST(max(k) AS VARCHAR) FROM base GROUP BY repo
              UNION SELECT l.repo, l.parent FROM reached r JOIN links l ON l.repo = r.repo AND l.hash = r.hash)
            SELECT repo, hash, author, message, commit_time, CAST(position AS INTEGER) AS position, n_parents FROM (
              SELECT c.repo, c.hash, author, message, commit_time, CAST(len(parents) AS INTEGER) AS n_parents,
                     row_number() OVER (PARTITION BY c.repo ORDER BY commit_time DESC, c.hash) AS position
              FROM commits c JOIN reached r ON r.repo = c.repo AND r.hash = c.hash) WHERE position <= 100""",
        "git_files_changed": """
            WITH entries AS (SELECT l_orderkey AS k, 'src/p' || (l_partkey % 20) || '.py' AS path, min(l_suppkey % 3) AS blob, max(l_linenumber) > 4 AS executable
                             FROM lineitem GROUP BY ALL),
            own AS (SELECT e.* FROM entries e JOIN orders ON k = o_orderkey),
            old AS (SELECT o_orderkey AS k, path, blob, executable FROM orders JOIN entries e ON e.k = o_orderkey - 100 WHERE o_orderkey >= 100)
            SELECT 'r' || (coalesce(n.k, p.k) % 100) AS repo, CAST(coalesce(n.k, p.k) AS VARCHAR) AS "commit",
                   coalesce(n.path, p.path) AS path
            FROM own n FULL OUTER JOIN old p ON n.k = p.k AND n.path = p.path
            WHERE n.blob IS DISTINCT FROM p.blob OR n.executable IS DISTINCT FROM p.executable""",
        "is_git": f"""SELECT repo, bool_or(path = '.git' OR starts_with(path, '.git/')) AS is_git FROM ({ALL_FILES}) GROUP BY repo""",
        "repo_urls": f"""
            SELECT page_id, candidate, ({ssh} OR {_starts(url, expected.OTHER_PREFIXES)})
                     AND ({known_host} OR {ssh} OR ends_with({url}, '.git')) AS is_valid
            FROM (SELECT page_id, unnest([url, '  ' || url || '.git' || chr(9), 'git@' || {rest}, 'ssh://' || {rest},
                    'https://github.com/' || {rest}, 'GIT://' || {rest} || '.git', ' ']) AS candidate FROM pages)""",
        "repo_names": f"""
            SELECT page_id, root, replace(regexp_extract(root, '[^/]*$'), '.git', '') AS url_name, {name} AS name,
                   regexp_replace({name}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '_', 'g') AS file_part
            FROM (SELECT page_id, unnest([url, url || '.git', url || '/', '/', '/srv/é-' || page_id || '.git.git//']) AS root FROM pages)""",
        "findings_min_severity": everything(lambda r: RANKS[r.severity] >= 3) + flat + " WHERE severity_rank >= 3",
        "findings_by_analyzer": all_findings + flat + " WHERE analyzer = 'secrets'",
        "severity_summary": all_findings + "," + summary_cte() + "SELECT * EXCLUDE (max_severity) FROM summary",
        "filtered_summary": all_findings + "," + summary_cte(by_rank(4)) + "SELECT * FROM summary",
        "scan_reports": all_findings + "," + summary_cte() + """SELECT repo AS repository,
              TIMESTAMP '2024-01-01 00:00:00' AS scan_time, CAST(2.45 AS DOUBLE) AS duration_secs,
              'url,secrets,file-ops,dependencies' AS analyzers, * EXCLUDE (repo) FROM summary""",
        "max_severity": all_findings + "," + summary_cte() + "SELECT repo, max_severity FROM summary",
        "total_summary": all_findings + f" SELECT {COUNTS}, {TOTAL}, {RANK_NAME} AS max_severity FROM findings",
        "ci_gate": all_findings + "," + summary_cte() + "SELECT repo, critical > 0 OR high > 0 AS failed FROM summary",
        "rules_first": all_findings + f"""
            SELECT repo, rule_id, title, description, remediation, severity, analyzer FROM (
              SELECT *, row_number() OVER (PARTITION BY repo, rule_id ORDER BY {ORDERING}) AS rn FROM findings) WHERE rn = 1""",
        "rule_state": all_findings + f"""
            SELECT repo, rule_id, CAST(severity_rank AS INTEGER) AS severity_rank, n, title, severity FROM (
              SELECT *, count(*) OVER (PARTITION BY repo, rule_id, severity_rank) AS n,
                     row_number() OVER (PARTITION BY repo, rule_id, severity_rank ORDER BY {ORDERING}) AS rn FROM findings) WHERE rn = 1""",
        "report_order": all_findings + """
            SELECT row_number() OVER (ORDER BY repo, severity_rank DESC, o_analyzer, o_phase, file, o_line, o_rule, o_pos, id) - 1 AS ordinal,
                   repo, CAST(severity_rank AS INTEGER) AS severity_rank, CAST(o_analyzer AS INTEGER) AS analyzer_ord,
                   CAST(o_phase AS INTEGER) AS phase, file, CAST(o_line AS INTEGER) AS line_ord,
                   CAST(o_rule AS INTEGER) AS rule_ord, CAST(o_pos AS INTEGER) AS pos, id
            FROM findings ORDER BY repo, severity_rank DESC, o_analyzer, o_phase, file, o_line, o_rule, o_pos, id""",
        "report_location": all_findings + f" SELECT id, {LOCATION} AS location FROM findings",
        "report_evidence": all_findings + f"""
            SELECT id, {console_evidence()} AS console_evidence, left(evidence, 100) AS fingerprint,
                   {html_escape('evidence')} AS html_evidence
            FROM (SELECT id, evidence FROM findings UNION ALL SELECT 'doc-' || doc_id, text FROM documents)""",
        "severity_columns": all_findings + f"""
            SELECT rule_id, upper(severity[1]) || lower(severity[2:]) AS severity, count(*) AS n,
                   CAST(severity_rank AS INTEGER) AS severity_rank, {case_of(SARIF_LEVELS, 'severity')} AS level,
                   CAST({case_of(SARIF_RANKS, 'severity')} AS DOUBLE) AS rank, 'severity-' || lower(severity) AS css_class,
                   CASE WHEN severity = 'CRITICAL' THEN {q(CRITICAL_ICON)} ELSE '' END AS icon
            FROM findings GROUP BY rule_id, findings.severity, severity_rank""",
        "sarif_results": all_findings + f" SELECT repo, id, {RESULT} AS result FROM findings",
        "sarif_document": sarif_document(),
        "html_document": html_document(),
        "text_report": text_report(),
        "findings_table": all_findings + flat,
    }
    for name_ in expected.PATTERNS:
        out[f"indicators_{name_}"] = indicator(name_)
    registry = default_registry()
    registry.disable("secrets")
    out["analyzer_list"] = all_findings + f"""
        SELECT a.analyzer, description, enabled, count(f.analyzer) AS n_findings
        FROM {values([(n, d, e) for n, d, e in registry.list()], 'a(analyzer, description, enabled)')}
        LEFT JOIN (SELECT analyzer FROM findings WHERE analyzer <> 'secrets') f ON a.analyzer = f.analyzer
        GROUP BY a.analyzer, a.description, enabled"""
    return out
