"""Manifests to dependency rows, and their joins with advisory tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden import schema
from linewarden.functions.dialect import sql_literal
from linewarden.functions.paths import manifest
from linewarden.functions.severity import severity_rank
from linewarden.functions.arrays import let
from linewarden.functions.text import decode_utf8, fold_name, raw_lines, strip_cr, trim_unicode
from linewarden.operators.findings import ANALYZER_ORDER, to_findings

# The default advisory tables and audit commands.
NPM_ADVISORIES = (
    ("lodash", "4.17.15", "CVE-2020-8203", "Prototype pollution in lodash", "HIGH"),
    ("lodash", "4.17.19", "CVE-2021-23337", "Command injection in lodash", "CRITICAL"),
    ("axios", "0.21.1", "CVE-2021-3749", "SSRF in axios", "HIGH"),
    ("moment", "2.29.1", "CVE-2022-24785", "Path traversal in moment.js", "MEDIUM"),
    ("webpack", "5.0.0", "CVE-2021-37873", "Path traversal in webpack", "MEDIUM"),
    ("minimist", "1.2.5", "CVE-2021-44906", "Prototype pollution", "HIGH"),
)
PYTHON_ADVISORIES = (
    ("urllib3", "1.25.10", "CVE-2021-28363", "HIGH"),
    ("cryptography", "3.3", "CVE-2020-25659", "MEDIUM"),
    ("pillow", "8.2.0", "CVE-2021-34552", "MEDIUM"),
)
OUTDATED = (
    ("express", 4, "Express.js v3 is very old, upgrade to v4"),
    ("react", 16, "React v15 is EOL, upgrade to v16+"),
    ("react-dom", 16, "React-DOM v15 is EOL, upgrade to v16+"),
    ("angular", 8, "AngularJS (v1.x) is deprecated, consider Angular 2+"),
    ("django", 2, "Django 1.x is EOL, upgrade to Django 2+"),
    ("flask", 1, "Flask 0.x is very old, upgrade to 1+"),
    ("rails", 5, "Rails 4.x is EOL, upgrade to Rails 5+"),
    ("spring", 5, "Spring Framework 4.x is EOL, upgrade to Spring 5+"),
)
AUDITS = {
    "javascript": "npm audit",
    "python": "pip-audit or safety check",
    "rust": "cargo audit",
    "go": "govulncheck",
}
OTHER_AUDIT = "Use appropriate security scanner"
AUDIT = "Consider running a security audit: "
RUST_TITLE = "Rust dependencies detected in "
RUST_ADVICE = "Run `cargo audit` to check for vulnerabilities"

SECTIONS = ("dependencies", "devDependencies")

#: What a package is resolved by.
PACKAGE_KEY = ["ecosystem", "package", "version"]
#: What of an advisory decides which packages it concerns.
ADVISORY_KEY = ["ecosystem", "key", "a_package", "a_version", "min_major"]
#: Characters of the runs of an advisory's package that candidates are found by.
GRAM = 3
#: About as many rows of one package, or advisories that concern the same ones, go into one array.
BLOCK = 128


#: Positions of outdated-version findings start here, after all advisories of a package.
OUTDATED_POS = 1 << 30


def _place(given: DataFrame) -> DataFrame:
    """Advisories of the caller get a stable place; the built-in ones carry theirs.

    The place has 30 bits, so the whole hash goes into the finding's id as well.
    """
    whole = F.xxhash64(*given.columns)
    return given.withColumns(
        {"adv": whole.bitwiseAND(OUTDATED_POS - 1).cast("int"), "adv_key": whole.cast("string")}
    )


def npm_advisories(spark: SparkSession, given: DataFrame | None = None) -> DataFrame:
    """npm advisories as join rows; the key is the folded package name."""
    rows = _table(spark, given, NPM_ADVISORIES, schema.NPM_ADVISORIES)
    return rows.select(
        F.lit("javascript").alias("ecosystem"),
        fold_name(F.col("package")).alias("key"),
        F.col("package").alias("a_package"),
        F.col("version").alias("a_version"),
        F.lit(None).cast("int").alias("min_major"),
        F.concat(F.lit("Vulnerable dependency: "), "cve", F.lit(": "), "text").alias("title"),
        F.upper("severity").alias("severity"),
        F.lit(None).cast("string").alias("advice"),
        "adv",
        "adv_key",
    )


def npm_minimums(spark: SparkSession, given: DataFrame | None = None) -> DataFrame:
    """Minimum major versions as join rows, told from advisories by ``min_major``."""
    rows = _table(spark, given, OUTDATED, schema.OUTDATED)
    return rows.select(
        F.lit("javascript").alias("ecosystem"),
        fold_name(F.col("package")).alias("key"),
        F.lit(None).cast("string").alias("a_package"),
        F.lit(None).cast("string").alias("a_version"),
        "min_major",
        F.lit("Outdated major version of ").alias("title"),
        F.lit("LOW").alias("severity"),
        "advice",
        (F.col("adv") + OUTDATED_POS).alias("adv"),
        "adv_key",
    )


def python_advisories(spark: SparkSession, given: DataFrame | None = None) -> DataFrame:
    """Python advisories as join rows; names only need to be contained, so the key is the version.

    That key suits the few built-in advisories; see :func:`resolved` for a table of the caller.
    """
    rows = _table(spark, given, PYTHON_ADVISORIES, schema.PYTHON_ADVISORIES)
    return rows.select(
        F.lit("python").alias("ecosystem"),
        F.col("version").alias("key"),
        F.col("package").alias("a_package"),
        F.col("version").alias("a_version"),
        F.lit(None).cast("int").alias("min_major"),
        F.concat(F.lit("Vulnerable Python package: "), "cve").alias("title"),
        F.upper("severity").alias("severity"),
        F.lit(None).cast("string").alias("advice"),
        "adv",
        "adv_key",
    )


def _table(spark: SparkSession, given, fixed: tuple, sql_schema: str) -> DataFrame:
    if given is not None:
        return _place(given)
    rows = [(*row, i, "") for i, row in enumerate(fixed)]
    return spark.createDataFrame(rows, sql_schema + ", adv INT, adv_key STRING")


def manifests(files: DataFrame, nested: bool = False) -> DataFrame:
    """``(repo, path, language, description, rank)`` of every dependency manifest."""
    if "kind" in files.columns:
        files = files.where("kind = 'manifest'")
    found = files.withColumn("m", manifest(F.col("path"), nested)).where("m IS NOT NULL")
    return found.select("*", "m.language", "m.description", "m.rank").drop("m")


def audit_note(language: Column) -> Column:
    """Remediation of a manifest finding."""
    audit = F.lit(OTHER_AUDIT)
    for known, command in AUDITS.items():
        audit = F.when(language == known, command).otherwise(audit)
    return F.concat(F.lit(AUDIT), audit)


def manifest_findings(files: DataFrame, nested: bool = False) -> DataFrame:
    return to_findings(
        manifests(files.drop("content"), nested),
        analyzer="dependencies",
        rule_id="DEP-FILE-001",
        severity="INFO",
        title=F.concat("description", F.lit(" dependency file")),
        file=F.col("path"),
        remediation=audit_note(F.col("language")),
        order=(ANALYZER_ORDER["dependencies"], 0, 0, F.col("rank"), 0),
    )


#: Stands behind a document, unless its text could hold the same string.
_MARK = "end of document"


def _mark(text: Column) -> Column:
    """A string that no JSON value in the text equals: a text that has it or escapes gets its own hash."""
    return F.when(text.contains(_MARK) | text.contains("\\"), F.sha2(text, 256)).otherwise(_MARK)


def npm_items(text: Column) -> Column:
    """A variant array of the document and a mark, if the text is JSON; null if it is not.

    Spark's parser stops after the first value.  The text is therefore put into an array
    before a mark that it cannot itself contain: only when nothing but one value precedes the mark
    does it stand second.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), _mark(text), F.lit('"]')))


def npm_members(items: Column, text: Column, section: str) -> Column:
    """The members of a section as a map, null unless the whole text is one strict JSON value."""
    whole = F.try_variant_get(items, "$[1]", "string") == _mark(text)
    return F.when(whole, F.try_variant_get(items, f"$[0].{section}", "map<string,variant>"))


def normalize_npm_version(version: Column) -> Column:
    """Strip leading range marks in their fixed order; null (not a string) counts as ``*``."""
    return F.regexp_replace(F.coalesce(version, F.lit("*")), r"\A\^*~*(?:>=)*+=*", "")


_PACKAGE = "struct<section_ord:int,package_ord:int,package:string,raw_version:string,version:string>"


def _raw_version(value: Column) -> Column:
    """A version as it is written; null if it is no string."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def npm_packages(text: Column) -> Column:
    """Array of the packages of an npm document, by section and name."""

    def section(items: Column, i: int, name: str) -> Column:
        members = F.map_entries(npm_members(items, text, name))

        def read(member: Column) -> Column:
            return F.struct(member["key"].alias("package"), _raw_version(member["value"]).alias("raw"))

        def package(member: Column, n: Column) -> Column:
            return F.struct(
                F.lit(i), n, member["package"], member["raw"], normalize_npm_version(member["raw"])
            ).cast(_PACKAGE)

        # names are distinct, so they alone decide the order
        listed = F.transform(F.sort_array(F.transform(members, read)), package)
        return F.coalesce(listed, F.array().cast(f"array<{_PACKAGE}>"))

    return let(
        npm_items(text), f"array<{_PACKAGE}>",
        lambda items: F.concat(*[section(items, i, name) for i, name in enumerate(SECTIONS)]),
    )


def npm_known_packages(members: Column, section: int) -> Column:
    """Those packages of a section that a built-in advisory may concern, in their places among all.

    Most members are not looked at but for their name.
    """
    names = list(dict.fromkeys(known.key for known in built_in() if known.ecosystem == "javascript"))
    placed = F.transform(F.sort_array(F.map_keys(members)), lambda name, n: F.when(
        fold_name(name).isin(names), F.struct(n.alias("n"), name.alias("package"))
    ))

    def package(at: Column) -> Column:
        raw = _raw_version(F.try_element_at(members, at["package"]))
        return F.struct(
            F.lit(section).alias("section_ord"), at["n"].alias("package_ord"), at["package"].alias("package"),
            raw.alias("raw_version"), normalize_npm_version(raw).alias("version"),
        )

    found = F.transform(F.array_compact(placed), package)
    return F.coalesce(found, F.array().cast(f"array<{_PACKAGE}>"))


def python_packages(text: Column) -> Column:
    """Array of the pinned packages of a python manifest, by line (in ``section_ord``)."""
    numbered = F.transform(
        raw_lines(text),
        lambda line, i: F.struct(i.alias("line"), trim_unicode(strip_cr(line)).alias("text")),
    )
    pinned = F.filter(
        numbered, lambda l: l["text"].contains("==") & ~l["text"].startswith("#")
    )

    def package(l: Column) -> Column:
        at = F.locate("==", l["text"])
        name = F.lower(trim_unicode(F.substring(l["text"], F.lit(1), at - 1)))
        version = trim_unicode(F.substring(l["text"], at + 2, F.length(l["text"])))
        return F.struct(l["line"], F.lit(0), name, version, version).cast(_PACKAGE)

    return F.transform(pinned, package)


def dependencies(
    files: DataFrame, nested: bool = False, ecosystems: tuple[str, ...] = ("javascript", "python")
) -> DataFrame:
    """Dependency rows of all manifests, from one pass over the files.

    ``(repo, path, ecosystem, section_ord, package_ord, package, raw_version, version)``.  All
    javascript manifests are tried as JSON and all python manifests as requirement lines.
    """
    readers = {"javascript": npm_packages, "python": python_packages}
    found = manifests(files, nested).where(F.col("language").isin(list(ecosystems)))
    texts = found.select(
        "repo", "path", F.col("language").alias("ecosystem"),
        decode_utf8(F.col("content")).alias("content"),
    )
    packages = None
    for ecosystem in ecosystems:
        chosen, array = F.col("ecosystem") == ecosystem, readers[ecosystem](F.col("content"))
        packages = F.when(chosen, array) if packages is None else packages.when(chosen, array)
    return texts.select("repo", "path", "ecosystem", F.inline(packages))


def npm_dependencies(files: DataFrame, nested: bool = False) -> DataFrame:
    """``(repo, path, section, package, version, raw_version, …)`` of javascript manifests."""
    names = F.array(*map(F.lit, SECTIONS))
    rows = dependencies(files, nested, ("javascript",))
    return rows.withColumn("section", F.get(names, F.col("section_ord")))


def python_requirements(files: DataFrame, nested: bool = False) -> DataFrame:
    """``(repo, path, line, package, version, …)`` of python manifests."""
    return dependencies(files, nested, ("python",)).withColumn("line", F.col("section_ord"))


def keyed(deps: DataFrame) -> DataFrame:
    """Dependency rows with the key that they meet the built-in advisories by."""
    python = F.col("ecosystem") == "python"
    return deps.withColumn("key", F.when(python, F.col("version")).otherwise(fold_name(F.col("package"))))


def is_hit() -> Column:
    """Whether an advisory row of the same key concerns the dependency."""
    a = {name: F.col(name) for name in ("a_package", "a_version", "min_major")}
    python = F.col("package").contains(a["a_package"])
    return F.when(F.col("ecosystem") == "python", python).otherwise(
        is_npm_hit(F.col("package"), F.col("version"), a)
    )


@dataclass(frozen=True)
class Known:
    """A built-in advisory or minimum version: how it is met, and what a finding says."""

    ecosystem: str
    key: str
    package: str | None
    version: str | None
    min_major: int | None
    title: str
    severity: str
    advice: str | None
    adv: int


def built_in() -> list[Known]:
    """All built-in advisories and minimum versions."""
    return [
        Known("javascript", package.lower(), package, version, None,
              f"Vulnerable dependency: {cve}: {text}", severity, None, i)
        for i, (package, version, cve, text, severity) in enumerate(NPM_ADVISORIES)
    ] + [
        Known("javascript", package.lower(), None, None, least, "Outdated major version of ", "LOW",
              advice, i + OUTDATED_POS)
        for i, (package, least, advice) in enumerate(OUTDATED)
    ] + [
        Known("python", version, package, version, None, f"Vulnerable Python package: {cve}", severity,
              None, i)
        for i, (package, version, cve, severity) in enumerate(PYTHON_ADVISORIES)
    ]


def _sql_value(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else sql_literal(value)


def _known_by_key(ecosystem: str) -> Column:
    """A literal map from the key of a package to the built-in advisories that it may meet."""
    by_key: dict[str, list[str]] = {}
    for at, known in enumerate(built_in()):
        if known.ecosystem == ecosystem:
            by_key.setdefault(known.key, []).append(
                f"named_struct('at', {at}, 'a_package', CAST({_sql_value(known.package)} AS STRING), "
                f"'a_version', CAST({_sql_value(known.version)} AS STRING), "
                f"'min_major', CAST({_sql_value(known.min_major)} AS INT))"
            )
    pairs = ", ".join(f"{sql_literal(key)}, array({', '.join(rows)})" for key, rows in by_key.items())
    return F.expr(f"map({pairs})")


def built_in_hits(packages: Column, ecosystem: str) -> Column:
    """Array of ``struct(package, at)`` of an array of packages: the built-in advisories they meet.

    The advisories are a literal that every task has, so packages without one never leave the row
    of their manifest.
    """
    table = _known_by_key(ecosystem)
    python = ecosystem == "python"

    def hits(p: Column) -> Column:
        key = p["version"] if python else fold_name(p["package"])

        def concerns(a: Column) -> Column:
            if python:
                return p["package"].contains(a["a_package"])
            return is_npm_hit(p["package"], p["version"], a)

        met = F.filter(F.try_element_at(table, key), concerns)
        return F.transform(met, lambda a: F.struct(p.alias("package"), a["at"].alias("at")))

    # a package without an advisory gives no array
    return F.flatten(F.array_compact(F.transform(packages, hits)))


def major_version(version: Column) -> Column:
    first = F.split_part(version, F.lit("."), F.lit(1))
    # The cast alone would also take blanks around the digits.
    return F.when(first.rlike(r"\A[+-]?[0-9]+\z"), first.try_cast("int"))


def is_npm_hit(package: Column, version: Column, a: Column) -> Column:
    """Whether an advisory or minimum version of the same key concerns a javascript package."""
    exact = (package == a["a_package"]) & (
        (version == a["a_version"]) | version.startswith(F.concat(a["a_version"], F.lit(".")))
    )
    return F.when(a["min_major"].isNotNull(), major_version(version) < a["min_major"]).otherwise(exact)


def version_prefixes(version: Column) -> Column:
    """The version and what stands before each of its dots: one more than it has dots."""
    parts = F.split(version, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")
    )


def _npm_hits(packages: DataFrame, known: DataFrame) -> DataFrame:
    """Packages with the advisories of their exact name, for their version or one above it.

    An equi-join on (package, version prefix), so that a package with very many advisories is
    no hot key: a version brings as many rows into the join as it has prefixes.
    """
    asked = packages.drop("ecosystem").select("*", F.explode(version_prefixes(F.col("version"))).alias("a_version"))
    exact = known.where("min_major IS NULL").withColumn("package", F.col("a_package"))
    return asked.join(exact.drop("key"), ["package", "a_version"])


def _minimum_hits(packages: DataFrame, known: DataFrame) -> DataFrame:
    """Packages whose numeric major version is under a minimum of their folded name."""
    asked = packages.drop("ecosystem").select(
        "*", fold_name(F.col("package")).alias("key"),
        major_version(F.col("version")).alias("major"),
    ).where("major IS NOT NULL")
    least = known.where("min_major IS NOT NULL")
    return asked.join(least, "key").where("major < min_major").drop("key", "major")


def _grams(name: Column, short: bool) -> Column:
    """Distinct runs of ``GRAM`` characters; a shorter name is its own, ``short`` adds all shorter runs."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - GRAM + 1, F.lit(1)))
    grams = F.transform(starts, lambda i: F.substring(name, i, F.lit(GRAM)))
    if short:
        places = F.sequence(F.lit(1), F.length(name) + 1)
        shorter = F.transform(places, lambda i: F.array(
            *[F.substring(name, i, F.lit(n)) for n in range(GRAM)]
        ))
        grams = F.concat(grams, F.flatten(shorter))
    return F.array_distinct(grams)


def rarest_grams(names: DataFrame) -> DataFrame:
    """``(a_package, gram)``: of the grams of each name, the one that the fewest names have."""
    grams = names.select("a_package", F.explode(_grams(F.col("a_package"), False)).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n_names"))
    return grams.join(counts, "gram").groupBy("a_package").agg(
        F.min_by("gram", F.struct("n_names", "gram")).alias("gram")
    )


def name_candidates(packages: DataFrame, names: DataFrame) -> DataFrame:
    """``(package, a_package)``: names whose rarest gram the package has.

    Names that begin alike do not meet all packages that begin so: what sets them apart is rarer.
    """
    asked = packages.select("package", F.explode(_grams(F.col("package"), True)).alias("gram"))
    return asked.join(rarest_grams(names), "gram").select("package", "a_package")


def _python_hits(packages: DataFrame, known: DataFrame) -> DataFrame:
    """Packages with the advisories of their version whose name they contain.

    A version like 1.0.0 has very many packages and advisories, so it is no join key alone: each
    distinct name is paired with the advisory names that it contains, found by their rarest gram,
    and (package, version) then meets the advisories on (advisory name, version).
    """
    names = packages.select("package").distinct()
    pairs = name_candidates(names, known.select("a_package").distinct()).where(
        F.col("package").contains(F.col("a_package"))
    )
    exact = known.drop("key").withColumn("version", F.col("a_version"))
    return packages.drop("ecosystem").join(pairs, "package").join(exact, ["a_package", "version"])


def _blocks(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """``(*key, name_block, name)``: what the rows of a key say besides, in arrays of about ``BLOCK``.

    ``n`` is the number of rows of the key.  A row's array is drawn by a hash of the row, so a key
    with very many rows is dealt over many tasks.
    """
    rest = [column for column in rows.columns if column not in (*key, "n")]
    block = F.pmod(F.xxhash64(*rest), F.ceil(F.col("n") / BLOCK)).alias(f"{name}_block")
    return rows.select(*key, block, F.struct(*rest).alias(name)).groupBy(*key, f"{name}_block").agg(
        F.collect_list(name).alias(name)
    )


def _advisory_blocks(known: DataFrame) -> DataFrame:
    """Advisories that concern the same packages, in arrays."""
    # the key has nulls; where two keys share a hash, their arrays only become smaller
    hashed = known.withColumn("hash", F.xxhash64(*ADVISORY_KEY))
    sizes = hashed.groupBy("hash").agg(F.count("*").alias("n"))
    return _blocks(hashed.join(sizes, "hash").drop("hash"), ADVISORY_KEY, "advisories")


def _hits(packages: DataFrame, known: DataFrame) -> DataFrame:
    """Packages with the advisories, or arrays of them, that concern them."""
    python = F.col("ecosystem") == "python"
    npm, npm_known = packages.where(~python), known.where(~python)
    return _npm_hits(npm, npm_known).unionByName(_minimum_hits(npm, npm_known)).unionByName(
        _python_hits(packages.where(python), known.where(python))
    )


def resolved(
    deps: DataFrame, known: DataFrame, of_package: dict[str, Column] | None = None,
    of_advisory: Callable[[Column], dict[str, Column]] | None = None,
) -> DataFrame:
    """Dependency rows with the advisories that concern them.

    Distinct (ecosystem, package, version) meet the advisories, and the rows meet what is left.  These
    may be as many as rows times advisories, on few packages: therefore arrays of rows meet arrays of
    advisories, and the pairs of arrays are dealt over all tasks before they become rows.

    ``of_package`` are columns that follow from a package and the kind of its advisory, ``of_advisory``
    those that follow from an advisory's columns.  Both are worked out before the arrays are paired.
    """
    packages = deps.groupBy(*PACKAGE_KEY).agg(F.count("*").alias("n"))
    met = _hits(packages, known.select(*ADVISORY_KEY).distinct()).select(*PACKAGE_KEY, "n").distinct()
    rows = _blocks(deps.join(met, PACKAGE_KEY), PACKAGE_KEY, "rows")

    said = [column for column in known.columns if column not in ADVISORY_KEY]
    advisories = F.transform("advisories", lambda a: F.struct(
        *[a[column].alias(column) for column in said],
        *[value.alias(name) for name, value in (of_advisory(a) if of_advisory else {}).items()],
    ))
    kind = ["a_package", "a_version", "min_major"]
    # with "n" the plan has the same packages a second time, so they are found once
    hits = _hits(packages, _advisory_blocks(known)).select(
        *PACKAGE_KEY, "n", *kind, "advisories_block", advisories.alias("advisories"),
        *[value.alias(name) for name, value in (of_package or {}).items()],
    )
    # a fixed number of partitions: adaptive execution would join them by their size before the rows come out
    tasks = int(deps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pair = [*PACKAGE_KEY, "n", *kind, "rows_block", "advisories_block"]
    found = rows.join(hits, PACKAGE_KEY).repartition(tasks, *pair).drop("n", "rows_block", "advisories_block")
    # no array is empty; without "outer" a filter by their size would work them out for all advisories
    found = found.select(*[c for c in found.columns if c != "advisories"], F.inline_outer("advisories"))
    return found.select(*[c for c in found.columns if c != "rows"], F.inline_outer("rows"))


def advisory_findings(deps: DataFrame, known: DataFrame, small: bool = False) -> DataFrame:
    """Dependency rows joined with advisory rows.

    npm advisories ask for the exact package and for the advisory's version or one below it,
    minimum versions for a numeric major version under the minimum, python advisories for a
    package that contains the advisory's.  ``small`` marks advisory rows whose number is fixed
    for one broadcast join.  A table of the caller has no known bound: see :func:`resolved`.
    """
    python = F.col("ecosystem") == "python"
    outdated = F.col("min_major").isNotNull()
    of_package = {
        "evidence": F.concat("package", F.when(python, "==").otherwise("@"), "version"),
        "upgrade": F.concat(F.lit("Upgrade "), "package", F.lit(" to a patched version")),
    }

    def of_advisory(a) -> dict[str, Column]:
        return {"rank": severity_rank(a["severity"])}

    if small:
        hits = keyed(deps).join(F.broadcast(known), ["ecosystem", "key"]).where(is_hit())
        joined = hits.withColumns(of_package | of_advisory({"severity": F.col("severity")}))
    else:
        used = deps.select(*PACKAGE_KEY, "repo", "path", "section_ord", "package_ord")
        joined = resolved(used, known, of_package, of_advisory)
    return to_findings(
        joined,
        analyzer="dependencies",
        rule_id=F.when(outdated, "DEP-OUTDATED-001").otherwise("DEP-VULN-001"),
        severity=F.col("severity"),
        severity_rank=F.col("rank"),
        title=F.when(outdated, F.concat("title", "package")).otherwise(F.col("title")),
        evidence=F.col("evidence"),
        remediation=F.coalesce("advice", "upgrade"),
        file=F.col("path"),
        order=(
            ANALYZER_ORDER["dependencies"], 1, F.col("section_ord"), F.col("package_ord"), F.col("adv"),
        ),
        same_place_key=F.col("adv_key"),
    )


def npm_vulnerabilities(deps: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    return advisory_findings(deps, npm_advisories(deps.sparkSession, advisories), advisories is None)


def npm_outdated(deps: DataFrame, outdated: DataFrame | None = None) -> DataFrame:
    return advisory_findings(deps, npm_minimums(deps.sparkSession, outdated), outdated is None)


def python_vulnerabilities(deps: DataFrame, advisories: DataFrame | None = None) -> DataFrame:
    return advisory_findings(deps, python_advisories(deps.sparkSession, advisories), advisories is None)


def rust_notes(files: DataFrame, nested: bool = False) -> DataFrame:
    """A note per rust manifest with a dependency section.

    The rule this stands for can never fire in a parity scan, so it is off there.
    """
    rust = manifests(files, nested).where("language = 'rust'")
    text = decode_utf8(F.col("content"))
    has_section = text.contains("[dependencies]") | text.contains("[dev-dependencies]")
    return to_findings(
        rust.where(has_section),
        analyzer="dependencies",
        rule_id="DEP-INFO-001",
        severity="INFO",
        title=F.concat(F.lit(RUST_TITLE), "path"),
        file=F.col("path"),
        remediation=RUST_ADVICE,
        order=(ANALYZER_ORDER["dependencies"], 1, 0, 0, 0),
    )
