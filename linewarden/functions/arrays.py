"""Array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256
_SUMS = "array<bigint>"


def let(value: Column, kind: str, body: Callable[[Column], Column]) -> Column:
    """``body``, of type ``kind``, of a value that is computed once.

    A column that an outer lambda reads would otherwise be inlined into it by the optimizer
    and computed again for every element.  An aggregate has the type of its start; an element of a
    transformed array would derive it anew from the whole body, for each row.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: body(v))


def let_sql(value: str, name: str, kind: str, body: str) -> str:
    """The same in SQL: ``body`` reads the value by its name."""
    return f"aggregate(array({value}), CAST(NULL AS {kind}), (_, {name}) -> {body})"


def running_totals_sql(values: str) -> str:
    """SQL for the inclusive prefix sums of an array of BIGINT, in two levels.

    A plain ``aggregate`` over each prefix is quadratic in the array; one line can hold very
    many matches, so whole chunks are summed once and only the rest of a chunk per element.
    """
    def total(items: str) -> str:
        return f"aggregate({items}, 0L, (total, x) -> total + x)"

    chunks = f"sequence(0, CAST(floor((size(v) - 1) / {_CHUNK}) AS INT))"
    sums = f"transform({chunks}, c -> {total(f'slice(v, c * {_CHUNK} + 1, {_CHUNK})')})"
    bases = f"transform(sums, (s, n) -> {total('slice(sums, 1, n)')})"
    rest = f"slice(v, j - j % {_CHUNK} + 1, j % {_CHUNK} + 1)"
    each = f"transform(v, (x, j) -> get(bases, CAST(floor(j / {_CHUNK}) AS INT)) + {total(rest)})"
    whole = let_sql(sums, "sums", _SUMS, let_sql(bases, "bases", _SUMS, each))
    return let_sql(values, "v", _SUMS, f"IF(size(v) < 2, v, {whole})")
