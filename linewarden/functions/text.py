"""Text helpers: strict decoding, line arrays, report scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewarden.functions.arrays import let_sql


def decode_utf8(content: Column) -> Column:
    """Strictly decoded text of a binary or string column, null when it is not UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def raw_lines(text: Column) -> Column:
    """Array of the lines of ``text``; each still carries at most one ``\\r`` to drop.

    A line ends at ``\\n`` or ``\\r\\n`` and there is no empty last line.  A bare ``\\r`` at the
    very end is text, so it is doubled here: :func:`strip_cr` can then treat all lines alike.
    """
    body = (
        F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1))
        .when(text.endswith("\r"), F.concat(text, F.lit("\r")))
        .otherwise(text)
    )
    return F.when(text != "", F.split(body, "\n", -1))


def numbered_lines_sql(text: str) -> str:
    """SQL for the array of ``(line, raw)`` of a text, as :func:`raw_lines` cuts it."""
    body = (
        "CASE WHEN endswith(t, '\\n') THEN substring(t, 1, length(t) - 1) "
        "WHEN endswith(t, '\\r') THEN concat(t, '\\r') ELSE t END"
    )
    cut = f"transform(split({body}, '\\n', -1), (raw, i) -> named_struct('line', i, 'raw', raw))"
    return let_sql(text, "t", "array<struct<line:int,raw:string>>", f"IF(t <> '', {cut}, NULL)")


def strip_cr(line: Column) -> Column:
    return F.when(
        line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)
    ).otherwise(line)


def line_count(text: Column) -> Column:
    """Number of lines, without building them."""
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    open_end = F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)
    return newlines + open_end


def trim_unicode(text: Column) -> Column:
    """Strip Unicode white space at both ends."""
    left = F.regexp_replace(text, r"(?U)\A\s+", "")
    return F.regexp_replace(left, r"(?U)(?<!\s)\s+\z", "")


def fold_name(text: Column) -> Column:
    """Key for case-insensitive name equality under Unicode simple folding."""
    # the two letters stand outside ASCII, and the search for them takes each character apart
    plain = F.octet_length(text) == F.length(text)
    return F.lower(F.when(plain, text).otherwise(F.translate(text, "\u017f\u212a", "sk")))


def display_location(file: Column, line: Column, column: Column) -> Column:
    """``file:line:column`` with one-based numbers; a column needs a line."""
    return F.concat_ws(
        ":", file, (line + 1).cast("string"), F.when(line.isNotNull(), column + 1).cast("string")
    )


def console_evidence(evidence: Column) -> Column:
    """Evidence cut for a text report: over 80 bytes, the whole characters of the first 77.

    77 bytes may end inside a character; its bytes are then the invalid tail, which is taken
    off by looking for the longest valid prefix among the four candidates.
    """
    head = F.encode(evidence, "UTF-8")
    candidates = [
        F.try_validate_utf8(F.substring(head, F.lit(1), F.lit(n)).cast("string"))
        for n in (77, 76, 75, 74)
    ]
    return F.when(
        F.octet_length(evidence) > 80, F.concat(F.coalesce(*candidates), F.lit("..."))
    ).otherwise(evidence)


def evidence_fingerprint(evidence: Column) -> Column:
    """First 100 characters of the evidence."""
    return F.substring(evidence, 1, 100)


# The characters escaped in HTML text, ampersand first.
HTML_ESCAPES = (
    ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"),
)


def html_escape(text: Column) -> Column:
    for raw, entity in HTML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text
