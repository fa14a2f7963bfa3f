"""Analyzers and the registry that says which of them run."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from linewarden.rules import (
    DOMAIN_RULES,
    FILE_RULES,
    LANGUAGE_RULES,
    SECRET_RULES,
    URL_RULES,
    Rule,
)

if TYPE_CHECKING:
    from linewarden.plans.scan import Corpus


@dataclass(frozen=True)
class Analyzer:
    """A named source of findings.

    ``rules`` are line rules; those of all enabled analyzers run in one pass over the lines, and
    so do the ``parts`` of files that built-in analyzers find.  ``analyze`` gives further findings
    DataFrames of the corpus.
    """

    name: str
    description: str
    rules: tuple[Rule, ...] = ()
    analyze: Callable[[Corpus], Iterable[DataFrame]] | None = None
    parts: tuple[str, ...] = ()
    enabled_by_default: bool = True


@dataclass
class AnalyzerRegistry:
    """Registered analyzers in order, with the set of enabled names."""

    analyzers: list[Analyzer] = field(default_factory=list)
    enabled_names: set[str] = field(default_factory=set)

    def register(self, analyzer: Analyzer) -> AnalyzerRegistry:
        self.analyzers.append(analyzer)
        if analyzer.enabled_by_default:
            self.enabled_names.add(analyzer.name)
        return self

    def _check(self, names: Iterable[str]) -> None:
        for name in names:
            if name not in self.all_names():
                raise ValueError(f"Unknown analyzer: {name}")

    def enable(self, name: str) -> None:
        self._check([name])
        self.enabled_names.add(name)

    def disable(self, name: str) -> None:
        self._check([name])
        self.enabled_names.discard(name)

    def enable_only(self, names: Iterable[str]) -> None:
        names = list(names)
        self._check(names)
        self.enabled_names = set(names)

    def named(self, names: Iterable[str]) -> list[Analyzer]:
        """These analyzers, in the order of registration; what is enabled stays as it is."""
        names = set(names)
        self._check(names)
        return [a for a in self.analyzers if a.name in names]

    def enabled(self) -> list[Analyzer]:
        """Enabled analyzers, in the order of registration."""
        return [a for a in self.analyzers if a.name in self.enabled_names]

    def all_names(self) -> list[str]:
        return [a.name for a in self.analyzers]

    def list(self) -> list[tuple[str, str, bool]]:
        return [(a.name, a.description, a.name in self.enabled_names) for a in self.analyzers]

    def list_frame(self, spark: SparkSession) -> DataFrame:
        """The list as ``(name, description, enabled)``."""
        return spark.createDataFrame(self.list(), "name STRING, description STRING, enabled BOOLEAN")


def default_registry() -> AnalyzerRegistry:
    """The four built-in analyzers."""
    registry = AnalyzerRegistry()
    registry.register(
        Analyzer(
            "url",
            "Scans for hardcoded URLs, connection strings, and suspicious domains",
            rules=URL_RULES + DOMAIN_RULES,
            parts=("remote",),
        )
    )
    registry.register(
        Analyzer(
            "secrets",
            "Scans for hardcoded secrets, credentials, and private keys",
            rules=SECRET_RULES,
        )
    )
    registry.register(
        Analyzer(
            "file-ops",
            "Audits file operations for dangerous patterns (path traversal, code injection, etc.)",
            rules=FILE_RULES + LANGUAGE_RULES,
            parts=("suffix",),
        )
    )
    registry.register(
        Analyzer(
            "dependencies",
            "Checks for known vulnerabilities in dependencies and outdated packages",
            parts=("manifest", "package", "rust"),
        )
    )
    return registry
