"""One logical plan from a corpus to its findings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.functions.paths import below_ignored_dir, is_listed
from linewarden.functions.severity import RANKS, parse_severity
from linewarden.operators.matching import PlacedRule
from linewarden.plans import builtin
from linewarden.plans.registry import AnalyzerRegistry, default_registry
from linewarden.plans.single_pass import single_pass
from linewarden.sources.chunks import with_first_lines
from linewarden.sources.tree import Tree


@dataclass(frozen=True)
class Corpus:
    """What is scanned: files, and tables that may stand in for parts of them.

    ``files`` is ``(repo, path, content)`` with binary or string content, or a tree of which only
    what a scan asks for is opened; files in pieces also have ``chunk`` and ``chunks``.  Remotes are read
    from the ``.git/config`` files unless a ``(repo, remote, url)`` table is given.
    """

    files: DataFrame | Tree
    remotes: DataFrame | None = None
    npm_advisories: DataFrame | None = None
    python_advisories: DataFrame | None = None
    outdated: DataFrame | None = None
    #: Leave out files below version control, build and package folders.
    prune: bool = False
    #: Take dependency manifests in any folder, not only at the root.
    nested_manifests: bool = False
    #: Note rust manifests that have a dependency section.
    rust_notes: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.files.spark if isinstance(self.files, Tree) else self.files.sparkSession

    def read(self, kinds: tuple[str, ...] = (), prune: bool = False, numbered: bool = False) -> DataFrame:
        """The files of some kinds, where they are known; ``numbered`` gives pieces their lines."""
        if isinstance(self.files, Tree):
            if not numbered:
                return self.files.files(kinds, prune)
            return with_first_lines(
                self.files.files(kinds, prune, "whole"), self.files.files(kinds, prune, "large")
            )
        files = self.files
        if kinds and "kind" in files.columns:
            files = files.where(F.col("kind").isin(list(kinds)))
        if prune and "ignored" in files.columns:
            files = files.where(~F.col("ignored"))
        if numbered and "chunks" in files.columns:
            files = with_first_lines(files.where("chunks = 1"), files.where("chunks > 1"))
        return files

    def listed(self, kinds: tuple[str, ...] = ()) -> DataFrame:
        """The files a listing of the repository returns."""
        files = self.read(kinds).where(is_listed(F.col("path")))
        return files.where(~below_ignored_dir(F.col("path"))) if self.prune else files

    def repos(self) -> DataFrame:
        """The repositories, as rows to aggregate on (not distinct)."""
        if isinstance(self.files, Tree):
            return self.files.files(columns=("repo",))
        return self.files.select("repo")


def _selected(analyzers, registry: AnalyzerRegistry | None) -> tuple[AnalyzerRegistry, list]:
    """The registry, and what is to run: the named analyzers, else those it has enabled."""
    registry = registry or default_registry()
    if analyzers is None:
        return registry, registry.enabled()
    return registry, registry.named(analyzers)


def scan(
    corpus: Corpus,
    analyzers: list[str] | None = None,
    registry: AnalyzerRegistry | None = None,
    *,
    min_rank: int = 1,
    use_prefilter: bool = True,
) -> DataFrame:
    """Findings of the enabled analyzers.  No action runs; errors fail the job.

    Line rules and built-in analyzers share one read of the files.  ``min_rank`` leaves rules
    below that severity out of the plan.
    """
    registry, enabled = _selected(analyzers, registry)
    names = registry.all_names()
    placed = [
        PlacedRule(names.index(a.name), i, rule)
        for a in enabled
        for i, rule in enumerate(a.rules)
        if RANKS[rule.severity] >= min_rank
    ]
    kinds = {kind for a in enabled for kind in a.parts}
    places = {name: i for i, name in enumerate(names)}
    # tables of the caller are joined apart from the pass over the files
    beside = builtin.beside(corpus, kinds)
    kinds -= set(beside)
    parts = []
    if placed or kinds:
        parts.append(single_pass(corpus, placed, kinds, places, use_prefilter))
    for kind, found in beside.items():
        place = F.lit(places[builtin.ANALYZER_OF[kind]])
        parts.append(found.withColumn("ord", F.col("ord").withField("analyzer", place)))
    for analyzer in enabled:
        if analyzer.analyze:
            # like the line rules, they stand where the registry has their analyzer
            place = F.col("ord").withField("analyzer", F.lit(places[analyzer.name]))
            parts.extend(part.withColumn("ord", place) for part in analyzer.analyze(corpus))
    if not parts:
        raise ValueError("No analyzer is enabled")
    findings = reduce(DataFrame.unionByName, parts)
    return findings.where(F.col("severity_rank") >= min_rank) if min_rank > 1 else findings


def scan_filtered(corpus: Corpus, min_severity: str, **options) -> DataFrame:
    """Findings of at least ``min_severity``; a summary of them counts only what is kept."""
    return scan(corpus, min_rank=parse_severity(min_severity), **options)
