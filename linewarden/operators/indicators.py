"""Indicator extraction from any text table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.dialect import java_pattern

# The indicator patterns.
PATTERNS = {
    "email": (r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", True),
    "ipv4": (
        r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
        False,
    ),
    "uuid": (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", False),
    "base64": (r"[A-Za-z0-9+/]{20,}={0,2}", False),
    "hex": (r"[0-9a-f]{16,}", True),
    "url": (r"""https?://[^\s\"'<>]+""", True),
}
#: A literal without which there is no match.
NEEDS = {"email": "@", "ipv4": ".", "uuid": "-", "url": "://"}


@dataclass(frozen=True)
class Indicator:
    """A pattern as Spark runs it; ``group`` holds the match."""

    name: str
    java: str
    group: int = 0

    def found(self, text: Column) -> Column:
        """Array of all matches, empty when there is none, null for a null text."""
        matches = F.regexp_extract_all(text, F.lit(self.java), F.lit(self.group))
        needed = NEEDS.get(self.name)
        if needed is None:
            return matches
        return F.when(text.contains(needed), matches).when(
            text.isNotNull(), F.array().cast("array<string>")
        )


# The e-mail pattern tries every word start of a long dotted run and each try reads the whole
# run.  All starts of a run fail or succeed together, so only its first one is tried: at the
# start of the run, or where the previous match ended inside it.
_LOCAL = "[a-z0-9._%+-]"
_EMAIL = rf"(?:\G|(?<!{_LOCAL}))(?>{_LOCAL}*?\b)({_LOCAL}++@[a-z0-9.-]+\.[a-z]{{2,}}\b)"

INDICATORS = {
    name: Indicator(name, java_pattern(pattern, ci)) for name, (pattern, ci) in PATTERNS.items()
}
INDICATORS["email"] = Indicator("email", java_pattern(_EMAIL, True), group=1)


def extract(texts: DataFrame, name: str, text: str = "text") -> DataFrame:
    """One row per match: the other columns of ``texts``, position in the text, value."""
    keep = [c for c in texts.columns if c != text]
    found = INDICATORS[name].found(F.col(text))
    return texts.select(*keep, F.posexplode(found).alias("position", "value"))


def extract_all(texts: DataFrame, text: str = "text") -> DataFrame:
    """Matches of every indicator in one pass, with the name in ``indicator``."""
    keep = [c for c in texts.columns if c != text]
    found = F.array(
        *[
            F.struct(F.lit(name).alias("indicator"), i.found(F.col(text)).alias("values"))
            for name, i in INDICATORS.items()
        ]
    )
    named = texts.select(*keep, F.inline(found)).where(F.size("values") > 0)
    return named.select(*keep, "indicator", F.posexplode("values").alias("position", "value"))
