"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents become ids and an end id; longer ones are cut into pieces of the capacity.  Pieces above
a third of the capacity lie in a bin at most twice: from the longest down, each is matched with
the longest of them that still fits.  The others go, from the longest down, into the smallest gap
that holds them.  Equal lengths are interchangeable, so the plan is made on the counts per length,
a table of at most ``capacity`` rows, and its result is a list of runs of equal bins.  Spark then
ranks the pieces within each length and looks up each rank's place.

Defined cases: a null or empty text is the end id alone; rows that repeat a ``doc_id`` are packed
each; ties within a length go by id and piece; an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import text_or_empty, written

#: Words whose ids a task remembers; beyond it forgets all and goes on.
REMEMBERED = 700_000
#: Words that are encoded as one text, and what may stand behind a word without changing it.
WORDS_AT_ONCE, PUNCTUATION = 1000, ".,;:!?"
#: Characters that are tokenised at once.
AT_ONCE = 8_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Bits of a rank in the look-up key; the length stands above them.
_RANK_BITS = 40


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray):
    """The runs ``at`` of a flat array one after the other, and where each ends."""
    sizes = sizes[at]
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts[at], sizes)
    return flat[places], ends


class _Known:
    """Ids of texts that have been seen, as runs of one flat array."""

    def __init__(self):
        self._place: dict[str, int] = {}
        self.flat, self.starts, self.sizes = (np.zeros(0, t) for t in ("<u4", np.int64, np.int64))

    def places(self, texts: list[str], encode) -> np.ndarray:
        """Numbers of the texts' runs; ``encode`` gives the ids of a list of new ones."""
        fresh = [t for t in texts if t not in self._place]
        if len(self._place) + len(fresh) > REMEMBERED and self._place:
            self.__init__()
            fresh = texts
        if fresh:
            runs = encode(fresh)
            sizes = np.array(list(map(len, runs)), np.int64) // 4
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(runs), "<u4")])
            self._place.update(zip(fresh, range(len(self._place), len(self._place) + len(fresh))))
        return np.array([self._place[t] for t in texts], np.int64)


class ChunkEncoder:
    """Ids of whole texts from a tokenizer that drops white space and joins nothing across it.

    Texts are cut at ASCII white space, and the distinct chunks of many texts are encoded once.  A
    chunk of letters with some punctuation behind is a word and a run of punctuation for the
    tokenizer.  New words are encoded many at a time, as one text, and told apart by the tokens
    that end a word; where their number is not that of the words, each is encoded alone.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        suffix = json.loads(tokenizer_json)["model"].get("end_of_word_suffix")
        vocabulary = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, id_ in vocabulary.items():
            self._ends_word[id_] = bool(suffix) and token.endswith(suffix)
        self._words, self._others = _Known(), _Known()

    def _alone(self, texts: list[str]) -> list[bytes]:
        coded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in coded]

    def _together(self, words: list[str]) -> list[bytes]:
        found = []
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = words[start:start + WORDS_AT_ONCE]
            ids = np.frombuffer(self._alone([" ".join(some)])[0], "<u4")
            ends = 4 * (np.flatnonzero(self._ends_word[ids]) + 1)
            if len(ends) == len(some):  # each word has one end at least, so each has one
                raw, ends = ids.tobytes(), [0, *ends.tolist()]
                found += map(raw.__getitem__, map(slice, ends, ends[1:]))
            else:
                found += self._alone(some)
        return found

    def _chunks(self, chunks: pa.StringArray):
        """Flat ids of distinct chunks, with starts and sizes."""
        def mask(flags: pa.BooleanArray) -> np.ndarray:
            return flags.to_numpy(zero_copy_only=False)

        stems = pc.utf8_rtrim(chunks, characters=PUNCTUATION)
        ascii_ = pc.string_is_ascii(stems)
        plain = mask(pc.utf8_is_alpha(stems)).copy()
        wide = np.flatnonzero(plain & ~mask(ascii_))
        plain[wide] = [  # letters that stay letters
            unicodedata.normalize("NFC", s).lower().isalpha()
            for s in stems.take(pa.array(wide)).to_pylist()
        ]
        words = pc.if_else(ascii_, pc.ascii_lower(stems), stems).filter(pa.array(plain))
        words = words.dictionary_encode()
        tailed = plain & mask(pc.not_equal(pc.binary_length(chunks), pc.binary_length(stems)))
        tails = [c[len(c.rstrip(PUNCTUATION)):] for c in chunks.filter(pa.array(tailed)).to_pylist()]
        others = tails + chunks.filter(pa.array(~plain)).to_pylist()
        others = pa.array(others, pa.string()).dictionary_encode()
        first, second = self._words, self._others
        at = first.places(words.dictionary.to_pylist(), self._together)[words.indices.to_numpy()]
        others_at = second.places(others.dictionary.to_pylist(), self._alone)[
            others.indices.to_numpy()
        ]
        # a chunk is a word's run and another one, either of which may be empty
        none = len(first.sizes)
        runs = np.full((len(chunks), 2), none, np.int64)
        runs[plain, 0] = at
        runs[tailed, 1] = none + 1 + others_at[:len(tails)]
        runs[~plain, 1] = none + 1 + others_at[len(tails):]
        flat, ends = gathered(
            np.concatenate([first.flat, second.flat]),
            np.concatenate([first.starts, [0], len(first.flat) + second.starts]),
            np.concatenate([first.sizes, [0], second.sizes]), runs.ravel(),
        )
        ends = ends[1::2]
        return flat, np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        words = cut.flatten().dictionary_encode()
        flat, ends = gathered(*self._chunks(words.dictionary), words.indices.to_numpy())
        ends = np.concatenate([[0], ends])[cut.offsets.to_numpy()]
        return [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def in_bounds(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` together; one that is larger stands alone."""
    start = together = 0
    for i, size in enumerate(sizes):
        if together and together + size > limit:
            yield start, i
            start, together = i, 0
        together += size
    if start < len(sizes):
        yield start, len(sizes)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0,
                 with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids; ``ids`` holds them as unsigned 32-bit integers."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer.value)
        schema = pa.schema([
            ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
            ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()),
        ])
        for batch in batches:
            keys, texts = (c.to_pylist() for c in batch.columns)
            for low, high in in_bounds([len(t) for t in texts], AT_ONCE):
                rows = []
                for key, ids in zip(keys[low:high], encoder.encode(texts[low:high]), strict=True):
                    ids = memoryview(ids.astype("<u4").tobytes() + end)
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        kept = bytes(part) if with_ids else None
                        rows.append((key, n, at // 4, len(part) // 4, zlib.crc32(part), kept))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    pieces = texts.mapInArrow(cut, PIECES)
    return pieces if with_ids else pieces.drop("ids")


Segment = tuple[int, int, int, int, int]


def packing_plan(counts: dict[int, int], capacity: int) -> list[Segment]:
    """Segments (length, first rank, first bin, pieces per bin, offset), each up to the next one.

    The piece of the length with rank ``r`` lies in bin ``first_bin + (r - first_rank) //
    per_bin`` at ``offset + (r - first_rank) % per_bin * length``.
    """
    segments: list[Segment] = []
    used = dict.fromkeys(counts, 0)
    left = {length: n for length, n in counts.items() if n}
    gaps: list[int] = []  # sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # by gap: first bin, bins
    bins = 0

    def opened(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in runs:
                insort(gaps, gap)
            runs.setdefault(gap, []).append((first, n))

    def put(length: int, n: int, first: int, per_bin: int, offset: int) -> None:
        if n:
            segments.append((length, used[length], first, per_bin, offset))
            used[length] += n
            left[length] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            partner = next(
                (p for p in reversed(large[:bisect_left(large, capacity - length + 1)])
                 if left[p] > (p == length)), None,
            )
            if partner is None:
                n, gap = left[length], capacity - length
            elif partner == length:
                n, gap = left[length] // 2, capacity - 2 * length
            else:
                n, gap = min(left[length], left[partner]), capacity - length - partner
            put(length, n, bins, 1, 0)
            if partner is not None:
                put(partner, n, bins, 1, length)
            opened(gap, bins, n)
            bins += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                new = -(-left[length] // (capacity // length))
                opened(capacity, bins, new)
                bins += new
                continue
            gap = gaps[at]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[at]
            per_bin = gap // length  # after one piece, the same gap is the smallest that fits
            full, rest = divmod(min(left[length], per_bin * n), per_bin)
            put(length, full * per_bin, first, per_bin, capacity - gap)
            opened(gap - per_bin * length, first, full)
            put(length, rest, first + full, rest, capacity - gap)
            opened(gap - rest * length, first + full, bool(rest))
            opened(gap, first + full + bool(rest), n - full - bool(rest))
    return segments


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; pieces must be a stored table.

    Ranks within a length come from a range partitioning, so a length that most pieces have is
    spread as well.
    """
    order = ["length", "doc_id", "piece"]
    spread = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(spread.withColumn("_at", F.monotonically_increasing_id()), "piece-order")
    part = F.shiftright("_at", 33).alias("_part")
    # a row for each length and partition: partitions hold neighbouring lengths
    runs = placed.groupBy("length", part).agg(
        F.count("*").alias("_rows"), F.min("_at").alias("_first")
    )
    runs = written(runs, "length-runs")
    before = F.sum("_rows").over(Window.partitionBy("length").orderBy("_part")) - F.col("_rows")
    first_rank = runs.select("length", "_part", (F.col("_first") - before).alias("_zero"))
    histogram = runs.groupBy("length").agg(F.sum("_rows").alias("n"))  # at most capacity rows
    plan = sorted(packing_plan({r["length"]: r["n"] for r in histogram.collect()}, capacity))
    table = np.asarray(plan, "int64").reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    fields = [f for f in placed.schema.fields if f.name != "_at"]
    names = [f.name for f in fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = (plan[:, 0] << _RANK_BITS) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1
            _, first, bin_, per_bin, offset = plan[at].T
            full, rest = np.divmod(rank - first, per_bin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(bin_ + full), pa.array(offset + rest * length)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = StructType(fields).add("sequence_id", "long").add("offset", "long")
    return placed.withColumn("_part", F.shiftright("_at", 33)).join(
        first_rank, ["length", "_part"]
    ).select(*names, (F.col("_at") - F.col("_zero")).alias("_rank")).mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
         with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    pieces = written(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    return packed(pieces, capacity)
