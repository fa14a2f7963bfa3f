"""Report documents as ordered rows.

A repository may hold any share of all findings, so its document is never built in one value.
It is a set of rows ``(repo, section, band, ord, id, fragment)`` that, sorted by those columns
and joined with newlines, read as the document: head, findings, tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.schema import ORD

HEAD, FINDINGS, TAIL = 0, 1, 2
PLACE = ("repo", "section", "band", "ord", "id")


def rows(
    frame: DataFrame, section: int, fragment: Column, band=0, with_place: bool = False
) -> DataFrame:
    """Rows of one section; findings keep their ``ord`` and ``id`` as place."""
    place = [
        F.col("ord") if with_place else F.lit(None).cast(ORD),
        F.col("id") if with_place else F.lit(None).cast("string"),
    ]
    band = band if isinstance(band, Column) else F.lit(band)
    return frame.select(
        "repo",
        F.lit(section).alias("section"),
        band.cast("int").alias("band"),
        place[0].alias("ord"),
        place[1].alias("id"),
        fragment.alias("fragment"),
    )


def rows_of_each(frame: DataFrame, *parts: tuple) -> DataFrame:
    """Rows of several sections from each row of ``frame``, whose plan runs once for all of them.

    A part is (section, band, fragment, condition); a condition of ``None`` always holds.
    """
    made = [
        F.struct(F.lit(section).alias("section"), F.lit(band).alias("band"), fragment.alias("fragment"))
        for section, band, fragment, _ in parts
    ]
    asked = [row if part[3] is None else F.when(part[3], row) for row, part in zip(made, parts)]
    each = frame.select("repo", F.array(*asked).alias("rows")).select("repo", F.inline("rows"))
    return each.where("section IS NOT NULL").select(
        "repo", "section", "band", F.lit(None).cast(ORD).alias("ord"),
        F.lit(None).cast("string").alias("id"), "fragment",
    )


def in_order(fragments: DataFrame) -> DataFrame:
    """Fragments in document order, range-partitioned so that hot repositories are split."""
    return fragments.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)


def write_documents(fragments: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one folder of text parts per repository.

    The parts of a folder, taken in the order of their names, are the document.
    """
    ordered = in_order(fragments).select("repo", F.col("fragment").alias("value"))
    ordered.write.mode(mode).partitionBy("repo").text(path)
