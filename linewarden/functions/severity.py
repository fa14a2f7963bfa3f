"""Severity scale and its projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The severity scale, its report levels and ranks.
RANKS = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
SARIF_LEVELS = {
    "CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note",
}
SARIF_RANKS = {"CRITICAL": 100.0, "HIGH": 75.0, "MEDIUM": 50.0, "LOW": 25.0, "INFO": 0.0}
CRITICAL_ICON = "\u26a0\ufe0f"


def _lookup(table: dict, key: Column) -> Column:
    def literal(value) -> str:
        return f"'{value}'" if isinstance(value, str) else f"{value}D" if isinstance(value, float) else str(value)

    pairs = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def parse_severity(name: str) -> int:
    """Rank of a severity name, case-insensitive; ``ValueError`` for anything else."""
    try:
        return RANKS[name.upper()]
    except KeyError:
        raise ValueError(f"Invalid severity: {name}") from None


def severity_rank(severity: Column) -> Column:
    """Rank 1..5 of a severity column in any case; the row fails on an unknown name."""
    rank = _lookup(RANKS, F.upper(severity))
    problem = F.raise_error(F.concat(F.lit("Invalid severity: "), severity))
    return F.when(severity.isNull() | rank.isNotNull(), rank).otherwise(problem.cast("int"))


def severity_name(rank: Column) -> Column:
    """Upper-case name of a rank, null for null."""
    return _lookup({rank: name for name, rank in RANKS.items()}, rank)


def sarif_level(severity: Column) -> Column:
    return _lookup(SARIF_LEVELS, severity)


def sarif_rank(severity: Column) -> Column:
    return _lookup(SARIF_RANKS, severity)


def severity_class(severity: Column) -> Column:
    return F.concat(F.lit("severity-"), F.lower(severity))


def severity_icon(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", CRITICAL_ICON).otherwise("")
