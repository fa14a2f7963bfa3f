"""Built-in findings that do not come from the pass over the files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linewarden.operators import dependencies as deps
from linewarden.operators.git import insecure_remotes
from linewarden.session import configure

#: Built-in analyzers by the parts that may be left to this module.
ANALYZER_OF = {"remote": "url", "package": "dependencies"}


def beside(corpus, kinds: set[str]) -> dict[str, DataFrame]:
    """Findings for which the corpus brings tables of its own, by the part they stand for.

    Remotes given as a table, and packages joined with advisories of the caller, whose number has
    no known bound.  Rust notes are left out unless they are asked for.
    """
    spark = configure(corpus.spark)
    found = {}
    if "remote" in kinds and corpus.remotes is not None:
        found["remote"] = insecure_remotes(corpus.remotes)
    given = (corpus.npm_advisories, corpus.outdated, corpus.python_advisories)
    if "package" in kinds and any(table is not None for table in given):
        known = (
            deps.npm_advisories(spark, corpus.npm_advisories)
            .unionByName(deps.npm_minimums(spark, corpus.outdated))
            .unionByName(deps.python_advisories(spark, corpus.python_advisories))
        )
        packages = deps.dependencies(corpus.listed(("manifest",)), corpus.nested_manifests)
        found["package"] = deps.advisory_findings(packages, known)
    if not corpus.rust_notes:
        kinds.discard("rust")
    return found
