"""linewarden: security analytics over source corpora, as Spark jobs.

A corpus is a DataFrame of files ``(repo, path, content)``.  :func:`scan` turns it into a
findings DataFrame in one declarative plan; summaries, gates and reports are DataFrames
derived from the findings.
"""

from linewarden.plans.registry import Analyzer, AnalyzerRegistry, default_registry
from linewarden.plans.scan import Corpus, scan, scan_filtered
from linewarden.session import configure

__all__ = [
    "Analyzer",
    "AnalyzerRegistry",
    "Corpus",
    "configure",
    "default_registry",
    "scan",
    "scan_filtered",
]
