"""Removal of repeated passages: runs of lines that stand at more than one place of the corpus.

A passage is a run with at least two lines of text, or a line of ``PASSAGE_WORDS`` words.  Every
such run is made of pairs of neighbouring lines of text (``line_pairs``), so a pair that occurs
elsewhere is extended to the whole maximal run by the pairs beside it: all lines of the run go
but those at the first place (smallest id, then first line), after their bytes have been compared:
pairs that differ under one hash are grouped by their bytes.  Each line that goes stands in
front, at the first place of its text.

``line_chunks`` are coarser units, cut by a rolling hash: fewer, but the ends of a passage fall into
chunks with the document's own lines and stay.

Only hashes and places are grouped; a document's lines meet its own list of places.

Defined cases: a null text stays null; an empty text has no passage; rows that repeat id and text are
one document and lose the same lines; a null id counts as the smallest; lines without any letter
or digit are no lines of text: they go between two lines of a run, and stay at its ends; of one line
that follows itself again and again, two stay; an empty table gives no rows; columns named like an
output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

#: Lines that the rolling hash covers, and the mean number of lines from end to end.
WINDOW, MEAN_LINES = 2, 3
#: Lines with text that a chunk has at least to be removed, or words of a single line.
LEAST_LINES, PASSAGE_WORDS = 2, 50

_KEY = ["doc_id", "text_hash"]


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _is_passage(line: Column) -> Column:
    long_enough = F.octet_length(line) >= 2 * PASSAGE_WORDS - 1
    return long_enough & (F.size(F.split(F.trim(line), SPACE + "+")) >= PASSAGE_WORDS)


def line_chunks(text: Column) -> Column:
    """Chunks as structs: first line, number of lines, whether it is removed if repeated, hash."""

    def rolled(hashes: Column, i: Column) -> Column:
        """The hash over the lines of the window that ends with line i."""
        return F.xxhash64(*[F.get(hashes, i - back) for back in range(WINDOW)])

    def cut(lines: Column, hashes: Column, passages: Column) -> Column:
        last = F.size(lines) - 1
        ends = F.filter(
            F.sequence(F.lit(0), last),
            lambda i: (i == last) | F.get(passages, i) | F.get(passages, i + 1) | (
                (i >= WINDOW - 1) & (F.pmod(rolled(hashes, i), F.lit(MEAN_LINES)) == 0)
            ),
        )

        def chunk(ends: Column, end: Column, k: Column) -> Column:
            first = F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1)
            return _let(first, lambda first: F.struct(
                first.alias("first"), (end - first + 1).alias("lines"),
                (F.get(passages, first) | (F.size(F.filter(
                    F.slice(lines, first + 1, end - first + 1), lambda x: x.rlike(r"[\p{L}\p{N}]")
                )) >= LEAST_LINES)).alias("counts"),
                F.xxhash64(F.slice(hashes, first + 1, end - first + 1)).alias("chunk_hash"),
            ))

        return _let(ends, lambda ends: F.transform(ends, lambda end, k: chunk(ends, end, k)))

    return _let(lines_of(text), lambda lines: _let(
        F.transform(lines, lambda x: F.xxhash64(x)), lambda hashes: _let(
            F.transform(lines, _is_passage), lambda passages: cut(lines, hashes, passages)
        )
    ))


def line_pairs(text: Column) -> Column:
    """Each line of text up to the next one, and each passage of one line, as such structs."""

    def pairs(lines: Column, hashes: Column) -> Column:
        last = F.size(lines) - 1
        with_text = F.filter(
            F.sequence(F.lit(0), last), lambda i: F.get(lines, i).rlike(r"[\p{L}\p{N}]")
        )

        def unit(first: Column, end: Column) -> Column:
            n = (end - first + 1).cast("int")
            return F.struct(
                first.alias("first"), n.alias("lines"), F.lit(True).alias("counts"),
                F.xxhash64(F.slice(hashes, first + 1, n)).alias("chunk_hash"),
            )

        def of_two(starts: Column) -> Column:
            found = F.filter(
                F.transform(starts, lambda i, k: F.struct(
                    i.alias("first"), F.get(starts, k + 1).alias("end")
                )), lambda p: p["end"].isNotNull()
            )
            return F.transform(found, lambda p: unit(p["first"], p["end"]))

        alone = F.transform(
            F.filter(with_text, lambda i: _is_passage(F.get(lines, i))), lambda i: unit(i, i)
        )
        return F.concat(_let(with_text, of_two), alone)

    return _let(lines_of(text), lambda lines: _let(
        F.transform(lines, lambda x: F.xxhash64(x)), lambda hashes: pairs(lines, hashes)
    ))


def _text_hash() -> Column:
    return F.xxhash64("text")


def _shared(lines: Column, place: Column) -> Column:
    """1 if the pair before has the same lines, so that its last line is this one's first; else 0.

    Of such pairs the first may be the place that stays.
    """
    first, n = place["first"], place["lines"]
    same = (n > 1) & (first >= n - 1) & (
        F.slice(lines, F.greatest(first - n + 2, F.lit(1)), n) == F.slice(lines, first + 1, n)
    )
    return F.when(same, 1).otherwise(0)


def repeated_places(docs: DataFrame, units=line_chunks) -> DataFrame:
    """Places of units whose hash occurs at several places, and whether an earlier one is there."""
    chunks = docs.where(F.col("text").isNotNull()).select(
        "doc_id", _text_hash().alias("text_hash"), F.explode(units(F.col("text"))).alias("c")
    ).where("c.counts").select(
        *_KEY, "c.first", "c.lines", "c.chunk_hash"
    )
    place = F.struct(*_KEY, "first")
    repeated = chunks.groupBy("chunk_hash").agg(
        F.min(place).alias("first_place"), F.max(place).alias("last_place")
    ).where("first_place != last_place").select("chunk_hash", "first_place")
    return chunks.join(repeated, "chunk_hash").select(
        *_KEY, "first", "lines", "chunk_hash",
        (~place.eqNullSafe(F.col("first_place"))).alias("later"),
    )


def _by_document(places: DataFrame) -> DataFrame:
    """One row per document with its places; no longer than the document's list of lines."""
    return places.groupBy(*_KEY).agg(
        F.collect_set(F.struct("first", "lines", "chunk_hash")).alias("places")
    )


def _with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """``docs`` with ``_places``; columns of ``docs`` may have any other name."""
    marks = _by_document(places).toDF("_doc_id", "_text_hash", "_places")
    same = docs["doc_id"].eqNullSafe(marks["_doc_id"]) & (
        F.xxhash64(docs["text"]) == marks["_text_hash"]
    )
    return docs.join(marks, same, how).drop("_doc_id")


def chunk_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The text at each place."""
    rows = _with_places(docs.select("doc_id", "text"), places, "inner")
    cut = _let(lines_of(F.col("text")), lambda lines: F.transform("_places", lambda p: F.struct(
        p["first"].alias("first"), p["lines"].alias("lines"), p["chunk_hash"].alias("chunk_hash"),
        F.array_join(F.slice(lines, p["first"] + 1, p["lines"]), "\n").alias("chunk"),
    )))
    return rows.select(
        "doc_id", F.col("_text_hash").alias("text_hash"), F.explode(cut).alias("c")
    ).select(*_KEY, "c.*")


def compared(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The places after the bytes of chunks with the same hash have been compared."""
    texts = chunk_texts(docs, places)
    mixed = texts.groupBy("chunk_hash").agg(
        F.min("chunk").alias("low"), F.max("chunk").alias("high")
    ).where("low != high").select("chunk_hash")
    mixed = written(mixed, "mixed-chunks")
    if mixed.isEmpty():
        return places
    # what is mixed is grouped by its bytes
    odd = texts.join(mixed, "chunk_hash", "left_semi")
    place = F.struct(*_KEY, "first")
    first = odd.groupBy("chunk_hash", "chunk").agg(F.min(place).alias("first_place"))
    exact = odd.join(first, ["chunk_hash", "chunk"]).select(
        *_KEY, "first", "lines", "chunk_hash",
        (~place.eqNullSafe(F.col("first_place"))).alias("later"),
    )
    return places.join(mixed, "chunk_hash", "left_anti").select(exact.columns).unionByName(exact)


def line_dedup(docs: DataFrame, units=line_chunks) -> DataFrame:
    """``docs`` with the remaining text, and ``removed_chunks``, ``removed_lines``, ``n_lines``.

    ``removed_chunks`` counts the runs of lines taken out.
    """
    docs = docs.drop("removed_chunks", "removed_lines", "n_lines")
    places = compared(docs, written(repeated_places(docs, units), "repeated-places"))
    rows = _with_places(docs, places.where("later"), "left")

    def gone(lines: Column, places: Column) -> Column:
        """Numbers of the lines that go."""
        return F.array_sort(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(
            p["first"] + _shared(lines, p), p["first"] + p["lines"] - 1
        )))))

    def taken_out(lines: Column, gone: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.struct(
            F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
            F.size(F.filter(
                gone, lambda i, k: (k == 0) | (F.get(gone, k - 1) < i - 1)
            )).alias("chunks"),
            F.size(gone).alias("lines"),
        )

    done = F.when(F.col("_places").isNotNull(), _let(
        lines_of(F.col("text")), lambda lines: _let(
            gone(lines, F.col("_places")), lambda gone: taken_out(lines, gone)
        )
    ))
    remaining = F.when(F.col("_places").isNull(), F.col("text")).otherwise(F.col("_done.text"))
    return rows.withColumn("_done", done).select(
        *[remaining.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.col("_done.chunks"), F.lit(0)).alias("removed_chunks"),
        F.coalesce(F.col("_done.lines"), F.lit(0)).alias("removed_lines"),
        F.size(lines_of(F.col("text"))).alias("n_lines"),
    )
