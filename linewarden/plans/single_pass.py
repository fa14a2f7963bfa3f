"""Everything the built-in analyzers find, from one read of the corpus.

Each file becomes an array of typed parts inside its row: matches of the line rules, a suspicious
suffix, a manifest, its packages that meet an advisory, remotes of a git configuration.  A kind is
worked out where it arises, and only what is found leaves the row; one projection makes the findings.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.arrays import let_sql
from linewarden.functions.dialect import sql_literal
from linewarden.functions.paths import (
    SUSPICIOUS_EXTENSIONS,
    below_ignored_dir,
    detect_language,
    is_listed,
    is_url_skipped,
    manifest,
)
from linewarden.functions.severity import RANKS
from linewarden.functions.text import decode_utf8, numbered_lines_sql
from linewarden.operators import dependencies as deps
from linewarden.operators.findings import to_findings
from linewarden.operators.git import CONFIG_PATH, remotes_of
from linewarden.operators.matching import MATCHES, PlacedRule, described, line_matches
from linewarden.operators.path_findings import AUDIT_NOTE, suspicious_suffix
from linewarden.rules import prefilter_sql

#: Kinds of parts; built-in analyzers say which they find.
LINE, SUFFIX, MANIFEST, PACKAGE, RUST, REMOTE = "line", "suffix", "manifest", "package", "rust", "remote"

#: A part.  Lines: number, evidence, rule and column; otherwise what the kind needs.
_PART = "struct<kind:string,line:int,text:string,name:string,a:int,b:int,c:int>"
_PARTS = f"array<{_PART}>"


def _part(kind: str, text=None, name=None, a=None, b=None, c=None) -> Column:
    # fields of the right types: a cast of the whole would be interpreted for each part
    values = {"line": None, "text": text, "name": name, "a": a, "b": b, "c": c}
    typed = [
        (v if isinstance(v, Column) else F.lit(v)).cast("string" if n in ("text", "name") else "int").alias(n)
        for n, v in values.items()
    ]
    return F.struct(F.lit(kind).alias("kind"), *typed)


def _none() -> Column:
    return F.array().cast(_PARTS)


def _lines(placed: list[PlacedRule], use_prefilter: bool) -> Column:
    """Matches in the lines of ``content``; a text that no rule can match is not cut."""
    rules = tuple(p.rule for p in placed)
    text, lines = "try_validate_utf8(CAST(content AS STRING))", "{}"
    if use_prefilter:
        text = f"try_validate_utf8(IF({prefilter_sql(rules, 'CAST(content AS STRING)')}, CAST(content AS STRING), NULL))"
        lines = f"filter({{}}, l -> {prefilter_sql(rules, 'l.raw')})"
    numbered = lines.format(numbered_lines_sql(text))
    line = "IF(endswith(l.raw, '\\r'), substring(l.raw, 1, length(l.raw) - 1), l.raw)"
    matches = let_sql(line, "text", MATCHES, line_matches(rules))
    return F.expr(
        f"flatten(transform({numbered}, l -> transform({matches}, m -> CAST(named_struct('kind', '{LINE}', "
        f"'line', l.line + first_line, 'text', m.evidence, 'name', NULL, 'a', m.rule, 'b', m.column, 'c', NULL) AS {_PART}))))"
    )


def _packages(content: Column, language: Column) -> Column:
    """Packages of a manifest that meet a built-in advisory."""

    def parts(packages: Column, ecosystem: str) -> Column:
        return F.transform(deps.built_in_hits(packages, ecosystem), lambda hit: _part(
            PACKAGE, hit["package"]["version"], hit["package"]["package"], hit["package"]["section_ord"],
            hit["package"]["package_ord"], hit["at"],
        ))

    npm = F.concat(*[deps.npm_known_packages(F.col(name), i) for i, name in enumerate(deps.SECTIONS)])
    return F.when(language == "javascript", parts(npm, "javascript")).when(
        language == "python", parts(deps.python_packages(decode_utf8(content)), "python")
    )


@lru_cache(maxsize=32)
def _parts(application: str, placed: tuple[PlacedRule, ...], kinds: frozenset[str],
           use_prefilter: bool) -> Column:
    """Array of the parts of a file, from columns that ``file_parts`` names.

    Building it costs far more calls into the JVM than using it, so it is kept for each
    application and choice of rules.
    """
    path, content = F.col("path"), F.col("content")
    listed = F.col("listed")
    found = []
    if placed:
        found.append(F.when(listed, _lines(placed, use_prefilter)))
    if SUFFIX in kinds:
        found.append(F.when(listed & F.col("is_head") & suspicious_suffix(path), F.filter(
            F.array(*[
                F.when(path.endswith(suffix), _part(SUFFIX, a=i))
                for i, (suffix, _, _) in enumerate(SUSPICIOUS_EXTENSIONS)
            ]), lambda p: p.isNotNull(),
        )))
    if kinds & {MANIFEST, PACKAGE, RUST}:

        def of_manifest(m: Column) -> Column:
            own = [F.array(_part(MANIFEST, m["description"], m["language"], m["rank"]))]
            if PACKAGE in kinds:
                own.append(F.coalesce(_packages(content, m["language"]), _none()))
            if RUST in kinds:
                text = decode_utf8(content)
                noted = text.contains("[dependencies]") | text.contains("[dev-dependencies]")
                own.append(F.when((m["language"] == "rust") & noted, F.array(_part(RUST))).otherwise(_none()))
            return F.when(m.isNotNull(), F.concat(*own))

        found.append(of_manifest(F.col("manifest")))
    if REMOTE in kinds:
        insecure = F.filter(
            remotes_of(decode_utf8(content)),
            lambda r: r["url"].contains("http://") & ~r["url"].contains("localhost"),
        )
        found.append(F.when(
            path == CONFIG_PATH, F.transform(insecure, lambda r: _part(REMOTE, r["url"], r["remote"]))
        ))
    return F.concat(*[F.coalesce(x, _none()) for x in found])


def _listed(prune: bool) -> Column:
    kept = is_listed(F.col("path"))
    return kept & ~below_ignored_dir(F.col("path")) if prune else kept


def file_parts(corpus, placed: list[PlacedRule], kinds: set[str], use_prefilter: bool) -> DataFrame:
    """``(repo, path, kind, line, text, name, a, b, c)`` of what is found in every file."""
    needed = ["git-config"] * (REMOTE in kinds) + ["manifest"] * bool(kinds - {REMOTE})
    if placed or SUFFIX in kinds:
        needed = ["git-config", "manifest", "other"]
    # the git configuration lies below an ignored folder
    files = corpus.read(tuple(needed), corpus.prune and REMOTE not in kinds, numbered=bool(placed))
    if REMOTE not in kinds:
        files = files.where(_listed(corpus.prune))
    parts = _parts(
        corpus.spark.sparkContext.applicationId, tuple(placed), frozenset(kinds), use_prefilter,
    )
    path = F.col("path")
    first_line = F.col("first_line") if "first_line" in files.columns else F.lit(0)
    # what the path says is found once, in the first piece
    is_head = F.col("chunk") == 0 if "chunk" in files.columns else F.lit(True)
    # the rules ask for what the path says
    listed = _listed(corpus.prune) if REMOTE in kinds else F.lit(True)
    described_files = files.select(
        "repo", "path", "content", is_url_skipped(path).alias("url_skipped"),
        detect_language(path).alias("language"), first_line.cast("int").alias("first_line"),
        is_head.alias("is_head"), listed.alias("listed"),
    )
    if kinds & {MANIFEST, PACKAGE, RUST}:
        found = F.when(F.col("listed"), manifest(path, corpus.nested_manifests))
        described_files = described_files.withColumn("manifest", found)
    if PACKAGE in kinds:
        # projections of their own: inside a higher-order function all of it would be interpreted
        npm = F.when(F.col("manifest.language") == "javascript", decode_utf8(F.col("content")))
        described_files = described_files.withColumn("npm", npm)
        described_files = described_files.withColumn("items", deps.npm_items(F.col("npm")))
        described_files = described_files.withColumns({
            name: deps.npm_members(F.col("items"), F.col("npm"), name) for name in deps.SECTIONS
        })
    return described_files.select("repo", "path", F.inline(parts))


def _known() -> str:
    """SQL for what a finding of each built-in advisory says, by position."""
    rows = ", ".join(
        f"named_struct('title', {sql_literal(k.title)}, 'severity', '{k.severity}', 'advice', "
        + (f"CAST(NULL AS STRING)" if k.advice is None else sql_literal(k.advice))
        + f", 'adv', {k.adv}, 'outdated', {str(k.min_major is not None).lower()}, "
        f"'python', {str(k.ecosystem == 'python').lower()})"
        for k in deps.built_in()
    )
    return f"array({rows})"


def single_pass(corpus, placed: list[PlacedRule], kinds: set[str], places: dict[str, int],
                use_prefilter: bool) -> DataFrame:
    """Findings of the line rules and of ``kinds``; ``places`` are those of the analyzers."""
    rows = file_parts(corpus, placed, kinds, use_prefilter)
    suffixes = ", ".join(
        f"named_struct('title', {sql_literal(t)}, 'severity', '{s}')" for _, t, s in SUSPICIOUS_EXTENSIONS
    )
    says = {SUFFIX: f"get(array({suffixes}), a) AS x", PACKAGE: f"get({_known()}, c) AS k"}
    if placed:
        says[LINE] = f"get({described(placed)}, a) AS r"
    rows = rows.select("*", *[F.expr(sql) for kind, sql in says.items() if kind in kinds | {LINE}])
    dependency, ranks = places.get("dependencies", -1), ", ".join(f"'{n}', {r}" for n, r in RANKS.items())

    def by_kind(default: str = "NULL", **values: str) -> str:
        chosen = " ".join(
            f"WHEN '{kind}' THEN {sql}" for kind, sql in values.items()
            if kind in kinds or (kind == LINE and placed)
        )
        return f"CASE kind {chosen} ELSE {default} END" if chosen else default

    severity = by_kind(
        line="r.severity", suffix="x.severity", manifest="'INFO'", package="k.severity", rust="'INFO'",
        remote="'MEDIUM'",
    )
    audit = "CASE name " + " ".join(
        f"WHEN '{language}' THEN {sql_literal(deps.AUDIT + command)}" for language, command in deps.AUDITS.items()
    ) + f" ELSE {sql_literal(deps.AUDIT + deps.OTHER_AUDIT)} END"
    values = {
        "analyzer": by_kind(
            line="r.analyzer", suffix="'file-ops'", manifest="'dependencies'", package="'dependencies'",
            rust="'dependencies'", remote="'url'",
        ),
        "rule_id": by_kind(
            line="r.rule_id", suffix="'FILE-EXT-001'", manifest="'DEP-FILE-001'",
            package="IF(k.outdated, 'DEP-OUTDATED-001', 'DEP-VULN-001')", rust="'DEP-INFO-001'",
            remote="'GIT-INSECURE-REMOTE'",
        ),
        "severity": severity,
        "severity_rank": f"try_element_at(map({ranks}), {severity})",
        "title": by_kind(
            line="concat(r.title, IF(r.title_takes_match, text, ''))", suffix="x.title",
            manifest="concat(text, ' dependency file')", package="concat(k.title, IF(k.outdated, name, ''))",
            rust=f"concat({sql_literal(deps.RUST_TITLE)}, path)",
            remote="'Git remote uses insecure HTTP protocol'",
        ),
        "description": by_kind("''", line="r.description"),
        "line": by_kind(line="line"),
        "column": by_kind(line="b"),
        "evidence": by_kind(
            line="text", remote="text", package="concat(name, IF(k.python, '==', '@'), text)",
        ),
        "remediation": by_kind(
            line="r.remediation", suffix=sql_literal(AUDIT_NOTE), manifest=audit,
            package="coalesce(k.advice, concat('Upgrade ', name, ' to a patched version'))",
            rust=sql_literal(deps.RUST_ADVICE),
            remote="'Change remote URL to use HTTPS with SSH or HTTPS protocol'",
        ),
        "same_place_key": by_kind("''", remote="name"),
    }
    order = (
        by_kind(
            line="r.analyzer_ord", suffix=f"{places.get('file-ops', -1)}", manifest=f"{dependency}",
            package=f"{dependency}", rust=f"{dependency}", remote=f"{places.get('url', -1)}",
        ),
        by_kind("1", line="0", suffix="0", manifest="0"),
        by_kind("0", line="line", suffix="-1", package="a"),
        by_kind("0", line="r.rule_ord", suffix="a", manifest="a", package="b"),
        by_kind("0", line="b", package="k.adv"),
    )
    return to_findings(
        rows, file=F.col("path"), order=tuple(map(F.expr, order)),
        **{name: F.expr(sql) for name, sql in values.items()},
    )
