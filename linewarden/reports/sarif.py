"""SARIF results and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.severity import sarif_level
from linewarden.functions.text import evidence_fingerprint
from linewarden.operators.findings import at_least
from linewarden.operators.summary import rules_first
from linewarden.reports import fragments as fr

SCHEMA_URI = "https://json.schemastore.org/sarif-2.1.0.json"
VERSION = "2.1.0"
TOOL_NAME = "linewarden"
TOOL_VERSION = "0.1.0"
NO_REMEDIATION = "No remediation available"


def _text(value: Column) -> Column:
    return F.struct(value.alias("text"))


def _place(uri: Column, region: Column | None = None) -> Column:
    parts = [F.struct(uri.alias("uri")).alias("artifactLocation")]
    if region is not None:
        parts.append(region.alias("region"))
    return F.struct(F.struct(*parts).alias("physicalLocation"))


def result_json() -> Column:
    """The result object of a finding; absent parts have no key, a file finding no region."""
    message = F.when(
        F.col("description") != "", F.concat("title", F.lit("\n\n"), "description")
    ).otherwise(F.col("title"))
    region = F.when(
        F.col("line").isNotNull(),
        F.struct(
            (F.col("column") + 1).alias("startColumn"), (F.col("line") + 1).alias("startLine")
        ),
    )
    remedy = F.array(F.struct(_text(F.col("remediation")).alias("description")))
    return F.to_json(
        F.struct(
            F.when(
                F.col("evidence").isNotNull(),
                F.struct(evidence_fingerprint(F.col("evidence")).alias("evidence")),
            ).alias("fingerprints"),
            F.when(F.col("remediation").isNotNull(), remedy).alias("fixes"),
            sarif_level(F.col("severity")).alias("level"),
            F.array(_place(F.col("file"), region)).alias("locations"),
            _text(message).alias("message"),
            F.when(
                F.size("references") > 0, F.transform("references", lambda r: _place(r))
            ).alias("relatedLocations"),
            F.col("rule_id").alias("ruleId"),
        )
    )


def sarif_results(findings: DataFrame, min_severity: str = "info") -> DataFrame:
    """``(repo, ord, id, result)``, one JSON object per finding."""
    kept = at_least(findings, min_severity)
    return kept.select("repo", "ord", "id", result_json().alias("result"))


def _rule() -> Column:
    """The rule object of a row of :func:`rules_first`."""
    return F.struct(
        F.struct(sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration"),
        _text(F.col("description")).alias("fullDescription"),
        _text(F.coalesce("remediation", F.lit(NO_REMEDIATION))).alias("help"),
        F.col("rule_id").alias("id"),
        F.col("rule_id").alias("name"),
        F.struct(F.col("analyzer"), F.col("severity")).alias("properties"),
        _text(F.col("title")).alias("shortDescription"),
    )


def sarif_document(
    findings: DataFrame,
    repos: DataFrame,
    scan_time: str,
    duration_secs: float = 0.0,
    min_severity: str = "info",
) -> DataFrame:
    """Document fragments per repository, also for those without findings.

    The rules of a repository are at most as many as there are rule ids, so they are gathered
    in its tail.  ``scan_time`` is written as given (RFC 3339).
    """
    kept = at_least(findings, min_severity)
    first = kept.groupBy("repo").agg(F.min_by("id", F.struct("ord", "id")).alias("id"))
    # Unique keys on both sides: the mark for the first result does not make a hot key.
    marked = sarif_results(kept).join(first.withColumn("is_first", F.lit(True)), ["repo", "id"], "left")
    comma = F.when(F.col("is_first"), "").otherwise(",")
    results = fr.rows(marked, fr.FINDINGS, F.concat(comma, "result"), with_place=True)

    rules = (
        rules_first(kept)
        .select("repo", "rule_id", F.to_json(_rule()).alias("rule"))
        .groupBy("repo")
        .agg(F.array_sort(F.collect_list(F.struct("rule_id", "rule"))).alias("rules"))
    )
    none = F.array().cast("array<struct<rule_id:string,rule:string>>")
    known = repos.select("repo").distinct().join(rules, "repo", "left")
    rule_list = F.array_join(F.transform(F.coalesce("rules", none), lambda r: r["rule"]), ",")

    artifacts = F.to_json(
        F.array(
            F.struct(
                _text(F.lit("Scanned repository")).alias("description"),
                F.struct(F.col("repo").alias("uri")).alias("location"),
            )
        )
    )
    note = F.lit(f"Scan completed in {duration_secs:.2f}s")
    invocation = F.to_json(
        F.struct(
            F.lit(scan_time).alias("endTimeUtc"),
            F.lit(scan_time).alias("startTimeUtc"),
            F.array(F.struct(F.lit("info").alias("level"), _text(note).alias("message"))).alias(
                "toolExecutionNotifications"
            ),
        )
    )
    head = F.concat(
        F.lit(f'{{"$schema":"{SCHEMA_URI}","runs":[{{"artifacts":'), artifacts,
        F.lit(',"invocation":'), invocation,
        F.lit(',"results":['),
    )
    tail = F.concat(
        F.lit(f'],"tool":{{"driver":{{"name":"{TOOL_NAME}","rules":['), rule_list,
        F.lit(f'],"version":"{TOOL_VERSION}"}}}}}}],"version":"{VERSION}"}}'),
    )
    about_repos = fr.rows_of_each(known, (fr.HEAD, 0, head, None), (fr.TAIL, 0, tail, None))
    return about_repos.unionByName(results)
