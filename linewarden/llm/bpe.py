"""Byte-level BPE: encoding by a fold of ranked merges over distinct words, and decoding.

Documents are taken in blocks of bounded size.  A block's texts are cut by the pattern into words,
each distinct word that is no token itself is encoded once by Spark's higher-order functions, and
the documents' ids are put together from their words' ids.  Words that most blocks would encode anew
are encoded once for the corpus: those that stand in most blocks of some drawn rows, a bounded number;
any other word is encoded where it occurs, so what is drawn decides on time alone.  The fold begins with the ids of a
word's bytes and the ranks of neighbouring pairs; each step joins the first pair of the lowest rank,
whose rank is the id of the joined piece, and looks up the two new neighbours.  Ranks are one
literal: an array of small maps, so that a look-up does not walk through the vocabulary.  A pair of
ids stands for its bytes: the map holds every way to cut a token into two tokens.  Decoding joins
the binary pieces of the ids.

Of the documents nothing is shuffled, and nothing but the vocabulary and the words encoded before are
held by every task.  Blocks are a table in the shared folder, so that a task has one Python process.

Defined cases: a null text counts as empty and has no ids; rows that repeat are encoded each; an
empty table gives no rows; further columns are not read.  The cost of one word grows with the
square of its bytes, as each step writes the remaining pieces anew.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, packed_columns, released, text_or_empty, unpacked_columns, written
from .packing import gathered, in_bounds

#: Bytes of the documents whose words are made distinct together.
BLOCK_BYTES = 6_000_000
#: Words that are encoded before the blocks, bytes of the rows that they are drawn from, bytes of a block of
#: these rows, and parts that the words are dealt out to.
KNOWN_WORDS, DRAWN_BYTES, DRAWN_BLOCK, KNOWN_PARTS = 300_000, 48_000_000, 1_000_000, 48
#: Small maps that the pairs are spread over, and bits that the first id is shifted by.
BUCKETS, SPREAD = 1 << 18, 5
#: A space that begins a longer run of white space or ends the text, or white space that begins it.
ODD_SPACE = rf" [{WHITE}]| \z|\A[{WHITE}]"

BLOCKS = "docs binary, words array<array<long>>"
CODED = "doc_id long, n_tokens long, ids binary, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


@dataclass(frozen=True)
class Layout:
    """Where an element of the fold holds the rank of its pair, the place of its piece and its id."""

    id_bits: int

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Layout:
        found = cls((max(ranks.values(), default=-1) + 2).bit_length())
        if found.place_bits < 20:
            raise ValueError(f"ranks of {found.id_bits} bits leave {found.place_bits} for places in a word")
        return found

    @property
    def place_bits(self) -> int:
        return 62 - 2 * self.id_bits

    @property
    def rank_at(self) -> int:
        return self.id_bits + self.place_bits

    @property
    def id_mask(self) -> int:
        return (1 << self.id_bits) - 1

    @property
    def low_mask(self) -> int:
        """Place and id."""
        return (1 << self.rank_at) - 1

    @property
    def no_rank(self) -> int:
        """Above every rank: the pair is no token."""
        return (1 << 63) - (1 << self.rank_at)


def rank_literal(spark: SparkSession, ranks: dict[bytes, int]) -> tuple[Column, Column, Layout]:
    """The ranks of pairs and the pieces by id, each as one literal value, and the layout of the fold.

    A pair is the number ``first id * 2 ** 31 + second id``; its rank stands where ``Layout`` has it.
    """
    layout = Layout.of(ranks)
    buckets: list[list] = [[] for _ in range(BUCKETS)]
    pieces: list = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
        for cut in range(1, len(piece)):
            first, second = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if first is not None and second is not None:
                bucket = ((first << SPREAD) ^ second) % BUCKETS
                buckets[bucket].append(((first << 31) + second, rank << layout.rank_at))
    row = pa.table({
        "ranks": pa.array([buckets], pa.list_(pa.map_(pa.int64(), pa.int64()))),
        "pieces": pa.array([pieces], pa.list_(pa.binary())),
    })
    frame = spark.createDataFrame(row)
    return frame.select("ranks").scalar(), frame.select("pieces").scalar(), layout


def _let(value: Column, kind: str, use) -> Column:
    """``use``, of type ``kind``, of a value that is computed once."""
    # an element of a transformed array would find out its type anew for each row
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: use(v))


def encoded_word(word: Column, ranks: Column, layout: Layout) -> Column:
    """Ids of one word, given as the ids of its bytes."""
    no_rank, id_mask, low_mask = layout.no_rank, layout.id_mask, layout.low_mask

    def packed(low: Column, id_: Column, following: Column) -> Column:
        # shifts and bits: sums find out their types anew for each row
        bucket = F.shiftleft(id_, SPREAD).bitwiseXOR(following).bitwiseAND(BUCKETS - 1)
        found = F.try_element_at(ranks[bucket], F.shiftleft(id_, 31).bitwiseOR(following))
        return F.coalesce(found, F.lit(no_rank)).bitwiseOR(low)

    # An element is the rank of its pair with the next one, above its place and its own id.  The place
    # is that of its first byte and stays while pieces are joined: the smallest element is the first
    # pair of the lowest rank.
    size = F.size(word)
    placed = F.transform(word, lambda x, i: F.shiftleft(i.cast("long"), layout.id_bits).bitwiseOR(
        x.bitwiseAND(id_mask)
    ))
    start = F.concat(
        F.zip_with(
            F.slice(placed, F.lit(1), size - 1), F.slice(word, F.lit(2), size - 1),
            lambda x, following: packed(x, x.bitwiseAND(id_mask), following.bitwiseAND(id_mask)),
        ),
        F.array(F.element_at(placed, -1).bitwiseOR(no_rank)),
    )

    def joined(state: Column, first: Column, at: Column) -> Column:
        """``first``, element ``at`` from 1, joined with the one behind it."""
        new = F.shiftright(first, layout.rank_at)
        low = new.bitwiseOR(first.bitwiseAND(low_mask ^ id_mask))
        # without an element behind the next one all of it is null
        following = F.coalesce(
            packed(low, new, F.get(state, at + 1).bitwiseAND(id_mask)), low.bitwiseOR(no_rank)
        )
        return F.filter(F.transform(
            state, lambda x, i: F.when(i == at - 1, following).when(
                i == at - 2, packed(x.bitwiseAND(low_mask), x.bitwiseAND(id_mask), new)
            ).when(i != at, x),
        ), lambda x: x.isNotNull())

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state), "array<bigint>", lambda first: F.when(
            first >= no_rank, state
        ).otherwise(_let(
            F.array_position(state, first).cast("int"), "array<bigint>", lambda at: joined(state, first, at)
        )))

    return F.aggregate(
        F.sequence(F.lit(2), size), start, step,
        lambda state: F.transform(state, lambda x: x.bitwiseAND(id_mask).cast("int")),
    )


def decoded_ids(ids: Column, pieces: Column) -> Column:
    """The bytes of a list of ids."""
    empty = F.lit(bytearray())
    return F.aggregate(ids, empty, lambda done, i: F.concat(done, F.get(pieces, i)))


def word_blocks(docs: DataFrame, shared: Broadcast[dict[bytes, int]], pattern: str, block_bytes: int) -> DataFrame:
    """Blocks of documents: distinct words, and each document as indexes of its words.

    ``shared`` gives the indexes of known words, the tokens first; above them the words of the block
    are counted, which are given as the ids of their bytes.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        told = shared.value
        start = max(told.values(), default=-1) + 1
        byte_ids = np.array([told.get(bytes([b]), -1) for b in range(256)], np.int64)
        words_of = regex.compile(pattern).findall
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for low, high in in_bounds(sizes, block_bytes):
                keys, texts = batch.slice(low, high - low).columns
                odd = pc.match_substring_regex(texts, ODD_SPACE)
                # no word of other texts holds a space but as its first character: cut there
                cut = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
                bounds, parts = cut.offsets.to_numpy().astype(np.int64), cut.flatten()
                is_first = np.zeros(len(parts), bool)
                is_first[bounds[:-1]] = True
                chunks = parts.filter(pa.array(~is_first)).dictionary_encode()
                of_chunks = words_of("".join([" " + c for c in chunks.dictionary.to_pylist()]))
                # beginnings of texts, and texts that are not cut
                others = list(map(words_of, chain(
                    parts.filter(pa.array(is_first)).to_pylist(), texts.filter(odd).to_pylist()
                )))
                every = pa.array([*of_chunks, *chain.from_iterable(others)], pa.string()).dictionary_encode()
                words: list[bytes] = []
                numbers = np.zeros(len(every.dictionary), np.int32)
                for at, word in enumerate(every.dictionary.cast(pa.binary()).to_pylist()):
                    found = told.get(word)
                    if found is None:
                        found = start + len(words)
                        words.append(word)
                    numbers[at] = found
                every_number = numbers[every.indices.to_numpy()]
                # each chunk begins with its space
                begins = pc.starts_with(every.dictionary, " ").to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(begins[every.indices.to_numpy()[:len(of_chunks)]])
                counts = np.diff(starts, append=len(of_chunks))
                in_chunks = chunks.indices.to_numpy()
                cut_numbers, _ = gathered(every_number, starts, counts, in_chunks)
                chunk_ends = np.concatenate([[0], np.cumsum(counts[in_chunks])])
                # of the chunks only: each text before has one beginning
                cut_bounds = chunk_ends[bounds - np.arange(len(bounds))].tolist()
                others_bounds = np.cumsum([len(of_chunks), *map(len, others)]).tolist()
                plain, uncut, indexes = 0, len(cut), []
                for is_odd in odd.to_pylist():
                    if is_odd:
                        indexes.append(every_number[others_bounds[uncut]:others_bounds[uncut + 1]].tobytes())
                        uncut += 1
                    else:
                        indexes.append(
                            every_number[others_bounds[plain]:others_bounds[plain + 1]].tobytes()
                            + cut_numbers[cut_bounds[plain]:cut_bounds[plain + 1]].tobytes()
                        )
                        plain += 1
                ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
                ids = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
                words = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([
                    pa.array([packed_columns({"doc_id": keys, "indexes": pa.array(indexes, pa.binary())})]),
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                ], names=["docs", "words"])

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return texts.mapInArrow(released(blocks), BLOCKS)


def frequent_words(docs: DataFrame, shared: Broadcast[dict[bytes, int]], pattern: str) -> DataFrame:
    """Lists of words that are no tokens: those in most blocks of some rows, a bounded number."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    drawn = docs.sample(min(1.0, DRAWN_BYTES / size), seed=0) if size else docs.limit(0)
    most = word_blocks(drawn, shared, pattern, DRAWN_BLOCK).select(F.explode("words").alias("word")) \
        .groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(KNOWN_WORDS)
    part = F.pmod(F.xxhash64("word"), F.lit(KNOWN_PARTS))
    return most.repartition(KNOWN_PARTS, part).groupBy(part).agg(F.collect_list("word").alias("words"))


def coded_words(lists: DataFrame, literals: tuple[Column, Column, Layout]) -> DataFrame:
    """In place of ``words`` their ``ids`` and the bytes that these decode to, ``decoded``."""
    rank_map, pieces, layout = literals
    others = [c for c in lists.columns if c != "words"]
    # a subquery may not stand inside a higher-order function, so a list carries the literals
    coded = lists.withColumns({"ranks": rank_map, "pieces": pieces}).withColumn(
        "ids", F.transform("words", lambda w: encoded_word(w, F.col("ranks"), layout))
    )
    return coded.select(
        *others, "ids", F.transform("ids", lambda ids: decoded_ids(ids, F.col("pieces"))).alias("decoded")
    )


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document: number of ids, the ids as little-endian unsigned 32-bit integers, and the
    bytes that they decode to."""
    context, literals = docs.sparkSession.sparkContext, rank_literal(docs.sparkSession, ranks)
    n_tokens = max(ranks.values(), default=-1) + 1
    # index, ids and bytes of what is known before the blocks
    known = {piece: (rank, np.array([rank], "<u4").tobytes()) for piece, rank in ranks.items()}
    frequent = coded_words(frequent_words(docs, context.broadcast(ranks), pattern), literals)
    for ids, decoded in zip(*(c.to_pylist() for c in frequent.select(
            F.inline(F.arrays_zip("ids", "decoded"))).toArrow().columns), strict=True):
        if decoded is not None:  # a byte may be no token
            known[decoded] = n_tokens + len(known) - len(ranks), np.array(ids, "<u4").tobytes()
    shared = context.broadcast({piece: index for piece, (index, _) in known.items()})
    before = context.broadcast(known)
    blocks = word_blocks(docs, shared, pattern, BLOCK_BYTES)
    coded = written(coded_words(blocks, literals), "coded-blocks")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max((index for index, _ in before.value.values()), default=-1) + 1
        known_ids, known_texts = [b""] * size, [b""] * size
        for piece, (index, raw) in before.value.items():
            known_ids[index], known_texts[index] = raw, piece
        for batch in batches:
            for packed, ids, decoded in zip(*batch.columns, strict=True):
                ids = ids.values
                ends = 4 * (ids.offsets.to_numpy() - ids.offsets[0].as_py())
                raw = ids.flatten().to_numpy().astype("<u4").tobytes()
                id_bytes = known_ids + [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
                texts = known_texts + decoded.as_py()
                rows = []
                for key, index in zip(*unpacked_columns(packed.as_py()).columns, strict=True):
                    index = array("i", index.as_py())
                    whole = b"".join(map(id_bytes.__getitem__, index))
                    rows.append((key.as_py(), len(whole) // 4, whole, b"".join(map(texts.__getitem__, index))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True
                    )], names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return coded.mapInArrow(released(joined), CODED)
