"""Rule patterns as Java patterns.

Rules are written for a matcher whose ``\\w \\s \\b`` are Unicode, whose ``.`` stops only at a
newline and whose case folding is Unicode *simple* folding.  Java's own case-insensitive
Unicode mode folds more than that (dotless and dotted i), so case is written out as classes:
only ``k`` and ``s`` have a partner outside ASCII.
"""

from __future__ import annotations

import re

PREFIX = "(?dU)"

_TOKEN = re.compile(
    r"""
      \\[pP]\{[^}]*\} | \\x[0-9A-Fa-f]{2} | \\u[0-9A-Fa-f]{4} | \\.   # escapes
    | \(\?(?:[:=!>]|<[=!]|<[A-Za-z]\w*>|[A-Za-z-]+[:)])             # group openers
    | \[(?:\\.|[^\]\\])+\]                                          # classes
    | .                                                             # anything else
    """,
    re.S | re.X,
)
_CLASS_ITEM = re.compile(r"\\.|[A-Za-z0-9]-[A-Za-z0-9]|.", re.S)
_PARTNERS = {"k": "\u212a", "s": "\u017f"}


def _partners(first: str, last: str) -> str:
    return "".join(p for c, p in _PARTNERS.items() if first.lower() <= c <= last.lower())


def _fold_class(text: str) -> str:
    extra = ""
    for item in _CLASS_ITEM.findall(text[1:-1]):
        if item[0].isalpha() and item[-1].isalpha() and item.isascii():
            extra += item.swapcase() + _partners(item[0], item[-1])
    # In front, where a hyphen at the end of the class stays a hyphen.
    start = 2 if text.startswith("[^") else 1
    return text[:start] + extra + text[start:]


def _fold(token: str) -> str:
    if len(token) == 1 and token.isascii() and token.isalpha():
        return f"[{token.lower()}{token.upper()}{_PARTNERS.get(token.lower(), '')}]"
    if token[0] == "[" and len(token) > 1:
        return _fold_class(token)
    return token


def fold_case(pattern: str) -> str:
    """The pattern with every ASCII letter widened to all characters that fold to it."""
    return "".join(map(_fold, _TOKEN.findall(pattern)))


def java_pattern(pattern: str, ci: bool = False) -> str:
    return PREFIX + (fold_case(pattern) if ci else pattern)


def sql_literal(value: str) -> str:
    """A string as a Spark SQL literal.

    Rule tables become long expressions; written as SQL they reach Spark in one call instead
    of several per node.
    """
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
