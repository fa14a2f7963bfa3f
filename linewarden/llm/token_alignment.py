"""Alignment of two tokenizers over a corpus, with counts of linked ids in a minimal perfect hash.

Both tokenizers encode a text with one space before it.  Where their tokens end at the same byte,
the tokens are cut into groups, and the two that end there are linked.  No token of either reaches
over a space or newline that stands between other characters, so texts are cut before them, and
the distinct units of a block that the task does not remember are encoded, many as one text.

The ids are stored in blocks of documents.  The first pass aligns them and counts linked id pairs
per block.  A minimal perfect hash is built over the distinct
pairs (hash and displace, shard by shard), each task's counts become dense vectors indexed by it,
and the vectors are summed as a tree.  The second pass aligns the documents again and looks the
counts up; a look-up compares the pair with the key stored at its index.

Of two tokens that end at one byte, one is a suffix of the other.  So the vocabularies bound the
number of pairs whatever the corpus (``pair_bound``); the bound is checked against ``MOST_PAIRS``
before the hash and its counts are collected and broadcast.

Defined cases: texts that are null, empty or not given back by the bytes of both encodings have no
tokens; rows that repeat a ``doc_id`` are aligned and counted each; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, packed_columns, released, text_or_empty, unpacked_columns, written
from .packing import gathered, in_bounds

#: Units that a task remembers; beyond it forgets those that it met in one block only.
REMEMBERED = 150_000
#: Units that are encoded at once, and those among them that are encoded as one text.
LEARNED, JOINED = 25_600, 256
#: White space but space and newline.
_OTHER_WHITE = WHITE.replace(r"\t-\r\x1C- ", r"\t\x0B-\r\x1C-\x1F")
#: White space that is no single space or newline between other characters, unless both tokenizers cut
#: it as the units do.
_ODD = (
    rf" [{WHITE}]| \z|\A[{WHITE}]|\n[{_OTHER_WHITE}]|[{_OTHER_WHITE}]\n|\n\n[{WHITE}]|\n\n\z"
)
#: Bytes of texts that are taken at once.
AT_ONCE = 600_000
#: Pairs in a shard of the hash, its pairs per bucket, and displacements that are tried at once.
SHARD_PAIRS, PER_BUCKET, TRIED = 20_000, 4, 64
#: Counts in a block of a dense vector, and vectors that are summed at a step of the tree.
BLOCK, FAN_IN, TREE_STEPS = 16_384, 64, 3
#: Pairs that may be broadcast: 24 bytes each.
MOST_PAIRS = 8_000_000

_MIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 30, 27, 31)))


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


@dataclass
class Vocabularies:
    """Both tokenizers as they are sent to the tasks, and the bytes of their tokens by id."""

    byte_level: str
    pieces: bytes
    tokens_a: list[bytes]
    tokens_b: list[bytes]


def read_vocabularies(byte_level_path: str, pieces_path: str) -> Vocabularies:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    with open(byte_level_path, encoding="utf-8") as file:
        byte_level = file.read()
    with open(pieces_path, "rb") as file:
        pieces = file.read()
    entries = Tokenizer.from_str(byte_level).get_vocab()
    alphabet = byte_alphabet()
    tokens_a = [b""] * (max(entries.values()) + 1)
    for entry, id_ in entries.items():
        tokens_a[id_] = bytes(alphabet[c] for c in entry if c in alphabet)
    model = SentencePieceProcessor(model_proto=pieces)
    tokens_b = [
        bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        for i, piece in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    ]
    return Vocabularies(byte_level, pieces, tokens_a, tokens_b)


def pair_bound(tokens_a: list[bytes], tokens_b: list[bytes]) -> int:
    """How many id pairs end alike: one of the tokens is a suffix of the other."""
    by_bytes_a, by_bytes_b = Counter(tokens_a), Counter(tokens_b)
    return sum(
        by_bytes_b[a[at:]] for a in tokens_a for at in range(len(a))
    ) + sum(by_bytes_a[b[at:]] for b in tokens_b for at in range(1, len(b)))


@dataclass
class Aligned:
    """Texts in both encodings: tokens and links as flat arrays, and where each text's end."""

    ids: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    closes: tuple[np.ndarray, np.ndarray]  # flags of the tokens that close a group
    pairs: np.ndarray
    pair_ends: np.ndarray

    def groups(self, shown: list[str]) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text; ``shown`` are the ids as ``shown_ids`` gives them."""
        closed = [np.flatnonzero(closes) + 1 for closes in self.closes]
        sizes_a, sizes_b = (np.diff(ends, prepend=0) for ends in closed)
        # all tokens in the order of the groups, those of the first side in front
        ends = np.cumsum(sizes_a + sizes_b)
        shift = ends - sizes_a - sizes_b
        at_a = np.arange(len(self.ids[0])) + np.repeat(shift - closed[0] + sizes_a, sizes_a)
        at_b = np.arange(len(self.ids[1])) + np.repeat(shift + sizes_a - closed[1] + sizes_b, sizes_b)
        ids = np.empty(len(at_a) + len(at_b), np.int64)
        ids[at_a], ids[at_b] = self.ids
        marks = np.zeros(len(ids), np.int64)
        marks[ends - sizes_b - 1], marks[ends - 1] = 1, 2
        last = np.unique(self.pair_ends[self.pair_ends > 0])
        marks[ends[last - 1] - 1] = 3
        said = iter("".join(map(shown.__getitem__, (4 * ids + marks).tolist())).split("\n"))
        return [next(said) if n else "" for n in np.diff(self.pair_ends, prepend=0).tolist()]


def shown_ids(n: int) -> list[str]:
    """Each id below ``n`` before each of the four marks that may follow it."""
    return [f"{i}{mark}" for i in range(n) for mark in ",|;\n"]


def aligned(ids: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray],
            sizes: tuple[np.ndarray, np.ndarray]) -> Aligned:
    """Texts given as the ids of both sides, ``counts`` of them each; ``sizes`` are bytes by id."""
    (a, b), (a_bytes, b_bytes) = ids, (np.cumsum(of[some]) for of, some in zip(sizes, ids))
    at = np.searchsorted(b_bytes, a_bytes)
    closes_a = b_bytes[at] == a_bytes if len(b_bytes) else np.zeros(0, bool)
    closes_b = np.zeros(len(b), bool)
    closes_b[at[closes_a]] = True
    linked = np.concatenate([[0], np.cumsum(closes_a)])
    a_ends, b_ends = map(np.cumsum, counts)
    return Aligned(
        ids, (a_ends, b_ends), (closes_a, closes_b), (a[closes_a] << 32) + b[at[closes_a]], linked[a_ends]
    )


class Encoder:
    """Both tokenizers inside a task, with the ids of the units that it has met."""

    def __init__(self, vocabularies: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_str(vocabularies.byte_level)
        self._a.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_proto=vocabularies.pieces)
        self._bytes = [_flat(tokens) for tokens in (vocabularies.tokens_a, vocabularies.tokens_b)]
        self._places: dict[str, int] = {}
        #: Blocks that a unit was met in since it was last kept, and whether both sides give it back.
        self._met, self._whole = np.zeros(0, np.int64), np.zeros(0, bool)
        #: Ids, and where each unit's begin and how many they are, of both sides.
        self._ids = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(2)]

    def _forget(self) -> None:
        """Keeps the units met in several blocks, at most half of those that may be remembered."""
        least = 2
        while np.count_nonzero(self._met >= least) > REMEMBERED // 2:
            least += 1
        kept = np.flatnonzero(self._met >= least)
        names = list(self._places)
        self._places = {names[at]: place for place, at in enumerate(kept.tolist())}
        self._met, self._whole = np.ones(len(kept), np.int64), self._whole[kept]
        for side, (flat, starts, sizes) in enumerate(self._ids):
            ids, _ = gathered(flat, starts, sizes, kept)
            self._ids[side] = (ids, np.cumsum(sizes[kept]) - sizes[kept], sizes[kept])

    def units(self, units: list[str]):
        """Encodings of units, with a space before each that does not begin with a newline."""
        spaced = [t if t[:1] == "\n" else " " + t for t in units]
        # the space that the second tokenizer adds is no part of what begins with a newline
        pieces = [
            ids[1:] if t[0] == "\n" else ids
            for t, ids in zip(spaced, self._b.encode(units, num_threads=1))
        ]
        return self._checked(spaced, pieces)

    def whole_text(self, text: str):
        """The encodings of a whole text, which always has a space before it."""
        return self._checked([" " + text], [self._b.encode(text)])

    def _checked(self, spaced: list[str], pieces: list[list[int]]):
        """Which texts both encodings give back, and ids and their counts, none where they do not."""
        coded = self._a.encode_batch_fast(spaced, add_special_tokens=False)
        raw = [t.encode() for t in spaced]
        sizes = np.array(list(map(len, raw)), np.int64)
        whole, flat = np.ones(len(raw), bool), []
        for (_, _, lengths), ids in zip(self._bytes, ([e.ids for e in coded], pieces)):
            counts = np.array(list(map(len, ids)), np.int64)
            ids_flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
            total = np.concatenate([[0], np.cumsum(lengths[ids_flat])])
            whole &= np.diff(total[np.cumsum(counts)], prepend=0) == sizes
            flat.append((ids_flat, counts))
        text_bytes = np.frombuffer(b"".join(raw), np.uint8)
        inside = np.repeat(whole, sizes)
        wrong = []
        for (token_bytes, starts, lengths), (ids_flat, counts) in zip(self._bytes, flat):
            some, _ = gathered(token_bytes, starts, lengths, ids_flat[np.repeat(whole, counts)])
            differs = np.zeros(len(text_bytes), bool)
            differs[inside] = some != text_bytes[inside]
            wrong.append(np.searchsorted(np.cumsum(sizes), np.flatnonzero(differs), "right"))
        whole[np.concatenate(wrong)] = False
        return whole, [(ids[np.repeat(whole, counts)], counts * whole) for ids, counts in flat]

    def joined(self, units: list[str]):
        """As ``units``, of units without white space: encoded as texts of several, which are cut again.

        Also gives the units in the order of the encodings; those of a text that does not come
        back whole, or that a token reaches out of, stand at the end, encoded one by one.
        """
        groups = [units[at:at + JOINED] for at in range(0, len(units), JOINED)]
        texts = list(map(" ".join, groups))
        fits = [text.split() == group for text, group in zip(texts, groups)]
        texts = [text for text, fit in zip(texts, fits) if fit]
        fitting, alone = [g for g, fit in zip(groups, fits) if fit], [g for g, fit in zip(groups, fits) if not fit]
        whole, sides = self._checked([" " + t for t in texts], self._b.encode(texts, num_threads=1))
        alone += [g for g, is_whole in zip(fitting, whole.tolist()) if not is_whole]
        fitting = [g for g, is_whole in zip(fitting, whole.tolist()) if is_whole]
        names = list(chain.from_iterable(fitting))
        ends = np.cumsum(pc.binary_length(pa.array(names, pa.string())).to_numpy().astype(np.int64) + 1)
        cut = []
        for (_, _, lengths), (ids, _) in zip(self._bytes, sides):
            token_ends = np.cumsum(lengths[ids])
            last = np.searchsorted(token_ends, ends)
            if not np.array_equal(token_ends[last], ends):
                return units, *self.units(units)
            cut.append((ids, np.diff(last, prepend=-1)))
        whole, rest = np.ones(len(names), bool), list(chain.from_iterable(alone))
        if rest:
            rest_whole, rest_sides = self.units(rest)
            whole = np.concatenate([whole, rest_whole])
            cut = [tuple(map(np.concatenate, zip(*both))) for both in zip(cut, rest_sides)]
        return names + rest, whole, cut

    def _learn(self, units: list[str], joined: bool) -> None:
        if joined:
            units, whole, sides = self.joined(units)
        else:
            whole, sides = self.units(units)
        first = len(self._places)
        self._places.update(zip(units, range(first, first + len(units))))
        self._whole = np.concatenate([self._whole, whole])
        self._met = np.concatenate([self._met, np.zeros(len(units), np.int64)])
        for side, (ids, counts) in enumerate(sides):
            flat, starts, sizes = self._ids[side]
            self._ids[side] = (
                np.concatenate([flat, ids]),
                np.concatenate([starts, len(flat) + np.cumsum(counts) - counts]),
                np.concatenate([sizes, counts]),
            )

    def block(self, keys: list, texts: list[str]) -> bytes:
        """Documents as numbers of their units, and the units' ids."""
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), _ODD).to_pylist()
        plain = [bool(t) and not is_odd for t, is_odd in zip(texts, odd)]
        given = pa.array([t for t, p in zip(texts, plain) if p], pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(given, "\n", " \n"), " ")
        units = cut.flatten().dictionary_encode()
        names = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._places) > REMEMBERED:
            self._forget()
        fresh = [c for c in names if c not in self._places]
        for joined in (True, False):
            some = [c for c in fresh if (c[0] != "\n") == joined]
            for at in range(0, len(some), LEARNED):
                self._learn(some[at:at + LEARNED], joined)
        known = np.fromiter(map(self._places.__getitem__, names), np.int64, len(names))
        self._met[known] += 1
        sides = []
        for flat, starts, sizes in self._ids:
            sides.append([[gathered(flat, starts, sizes, known)[0]], [sizes[known]]])
        indices, bounds = units.indices.to_numpy(), cut.offsets.to_numpy()
        whole = self._whole[known][indices]
        of_plain = iter(zip(bounds.tolist(), bounds[1:].tolist()))
        parts, counts, more = [], [], len(names)
        for text, is_plain in zip(texts, plain):
            part = np.zeros(0, np.int64)
            if is_plain:
                low, high = next(of_plain)
                part = indices[low:high]
                is_plain = whole[low:high].all()
            if text and not is_plain:  # a unit of its own
                _, alone = self.whole_text(text)
                part = np.array([more])
                more += 1
                for side, (ids, count) in zip(sides, alone):
                    side[0].append(ids)
                    side[1].append(count)
            parts.append(part)
            counts.append(len(part))
        columns = {"doc_id": pa.array(keys, pa.int64()), "sizes": np.array(counts, np.int32)}
        columns["units"] = np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)
        for name, (ids, sizes) in zip("ab", sides):
            columns[f"ids_{name}"] = np.concatenate(ids).astype(np.int32)
            columns[f"counts_{name}"] = np.concatenate(sizes).astype(np.int32)
        return packed_columns({
            name: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
            for name, values in columns.items()
        })


def _flat(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of tokens one after the other, where each begins and how many it has."""
    sizes = np.array(list(map(len, tokens)), np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


class Block:
    """The documents of a block, aligned."""

    def __init__(self, raw: bytes, sizes: tuple[np.ndarray, np.ndarray]):
        columns = {
            name: column[0].values for name, column in zip(
                ("doc_id", "sizes", "units", "ids_a", "counts_a", "ids_b", "counts_b"),
                unpacked_columns(raw).columns,
            )
        }
        self.doc_ids = columns.pop("doc_id")
        whole = {name: values.to_numpy().astype(np.int64) for name, values in columns.items()}
        self.units, self.bounds = whole["units"], np.concatenate([[0], np.cumsum(whole["sizes"])])
        self.units_aligned = aligned(
            (whole["ids_a"], whole["ids_b"]), (whole["counts_a"], whole["counts_b"]), sizes
        )

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs and their counts."""
        found = self.units_aligned
        met = np.bincount(self.units, minlength=len(found.pair_ends))
        times = np.repeat(met, np.diff(found.pair_ends, prepend=0))
        distinct, at = np.unique(found.pairs, return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        np.add.at(counts, at, times)
        return distinct, counts

    def sums(self, of_pairs: list[np.ndarray]) -> list[np.ndarray]:
        """Per document: tokens of both sides, links, and the sums of ``of_pairs`` over its links."""
        found = self.units_aligned
        per_unit = [np.diff(ends, prepend=0) for ends in (*found.ends, found.pair_ends)]
        for values in of_pairs:
            total = np.concatenate([[0], np.cumsum(values)])
            per_unit.append(np.diff(total[found.pair_ends], prepend=0))
        return [
            np.diff(np.concatenate([[0], np.cumsum(values[self.units])])[self.bounds]) for values in per_unit
        ]

    def digests(self, shown: list[str]) -> list[str]:
        """Digest of each document's groups; empty without tokens."""
        groups, found = self.units_aligned.groups(shown), []
        units, bounds = self.units.tolist(), self.bounds.tolist()
        for low, high in zip(bounds, bounds[1:]):
            said = ";".join(map(groups.__getitem__, units[low:high]))
            found.append(hashlib.sha256(said.encode()).hexdigest() if said else "")
        return found


def encoded_blocks(docs: DataFrame, shared) -> DataFrame:
    """``block``: documents in both encodings, packed."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for low, high in in_bounds(pc.binary_length(batch.column(1)).to_pylist(), AT_ONCE):
                keys, texts = (c.to_pylist() for c in batch.slice(low, high - low).columns)
                yield pa.RecordBatch.from_arrays([pa.array([encoder.block(keys, texts)])], names=["block"])

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return texts.mapInArrow(released(encode), "block binary")


def task_counts(blocks: DataFrame, shared) -> DataFrame:
    """First pass: linked pairs of each block with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = token_sizes(shared.value)
        for batch in batches:
            for raw in batch.column(0):  # one by one, since all of them are large
                counted = Block(raw.as_py(), sizes).pair_counts()
                yield pa.RecordBatch.from_arrays(list(map(pa.array, counted)), names=["pair", "n"])

    return blocks.mapInArrow(released(count), "pair long, n long")


def token_sizes(vocabularies: Vocabularies) -> tuple[np.ndarray, np.ndarray]:
    return tuple(
        np.array(list(map(len, tokens)), np.int64)
        for tokens in (vocabularies.tokens_a, vocabularies.tokens_b)
    )


def mixed(keys: np.ndarray, seeds) -> np.ndarray:
    """64 well-mixed bits of each key under a seed."""
    gold, one, two, *shifts = _MIX
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + (np.asarray(seeds, np.uint64) + np.uint64(1)) * gold
        x = (x ^ (x >> shifts[0])) * one
        x = (x ^ (x >> shifts[1])) * two
    return x ^ (x >> shifts[2])


def displacements(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys: displacements by bucket, and keys by their place.

    Large buckets go first, each to the first displacement under which its keys fall on free
    places.  Buckets of one key take what is left: their place is stored as a negative number.
    """
    n = len(keys)
    buckets = (mixed(keys, 1) % np.uint64(n // PER_BUCKET + 1)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    first, sizes = np.unique(buckets[order], return_index=True)[1], np.bincount(buckets)
    members = np.split(order, first[1:]) if n else []
    members.sort(key=len, reverse=True)
    taken = np.zeros(n, bool)
    moves, placed = np.zeros(n // PER_BUCKET + 1, np.int64), np.zeros(n, np.int64)
    singles = [m for m in members if len(m) == 1]
    for member in members[:len(members) - len(singles)]:
        some, start = keys[member], 2
        while True:
            places = mixed(some[None, :], np.arange(start, start + TRIED)[:, None]) % np.uint64(n)
            free = ~taken[places.astype(np.int64)].any(axis=1)
            for row in np.flatnonzero(free):
                if len(set(places[row].tolist())) == len(some):
                    break
            else:
                start += TRIED
                continue
            break
        at = places[row].astype(np.int64)
        taken[at] = True
        placed[at], moves[buckets[member[0]]] = some, start + row
    for member, place in zip(singles, np.flatnonzero(~taken).tolist()):
        placed[place], moves[buckets[member[0]]] = keys[member[0]], -1 - place
    assert sizes.sum() == n
    return moves, placed


@dataclass
class PairHash:
    """Index of each pair below the number of pairs, or -1 for what is no key."""

    keys: np.ndarray
    moves: np.ndarray
    key_starts: np.ndarray
    bucket_starts: np.ndarray

    @classmethod
    def of_shards(cls, shards: list[tuple[np.ndarray, np.ndarray]]) -> PairHash:
        """From the moves and keys of shards 0, 1, ..."""
        none = [np.zeros(0, np.int64)]
        return cls(
            np.concatenate(none + [keys for _, keys in shards]),
            np.concatenate(none + [moves for moves, _ in shards]),
            np.cumsum([0, *(len(keys) for _, keys in shards)]),
            np.cumsum([0, *(len(moves) for moves, _ in shards)]),
        )

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        shards = len(self.key_starts) - 1
        if not len(self.keys) or not len(pairs):
            return np.full(len(pairs), -1)
        shard = shard_of(pairs, shards)
        n = self.key_starts[shard + 1] - self.key_starts[shard]
        bucket = mixed(pairs, 1) % (n // PER_BUCKET + 1).astype(np.uint64)
        move = self.moves[self.bucket_starts[shard] + bucket.astype(np.int64)]
        place = mixed(pairs, np.maximum(move, 0)) % np.maximum(n, 1).astype(np.uint64)
        at = self.key_starts[shard] + np.where(move < 0, -1 - move, place.astype(np.int64))
        at = np.minimum(at, len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, at, -1)


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(pairs, 0) % np.uint64(shards)).astype(np.int64)


def build_hash(counts: DataFrame) -> PairHash:
    """The hash of the distinct pairs, built by shards; the vocabularies bound what is collected."""
    distinct = counts.select("pair").distinct()
    shards = -(-distinct.count() // SHARD_PAIRS) or 1

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = shard_of(batch.column(0).to_numpy(), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0)], names=["shard", "pair"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        moves, keys = displacements(table["pair"].to_numpy())
        return pa.table({
            "shard": [key[0].as_py()], "moves": [moves.tobytes()], "keys": [keys.tobytes()]
        }, schema=pa.schema([("shard", pa.int64()), ("moves", pa.binary()), ("keys", pa.binary())]))

    built = distinct.mapInArrow(sharded, "shard long, pair long").groupBy("shard").applyInArrow(
        build, "shard long, moves binary, keys binary"
    )
    empty = (np.zeros(1, np.int64), np.zeros(0, np.int64))
    parts = {
        row.shard: (np.frombuffer(row.moves, np.int64), np.frombuffer(row.keys, np.int64))
        for row in built.collect()
    }
    return PairHash.of_shards([parts.get(shard, empty) for shard in range(shards)])


def summed_counts(counts: DataFrame, index: PairHash) -> np.ndarray:
    """Each task's counts as a dense vector in blocks, summed as a tree."""
    shared = counts.sparkSession.sparkContext.broadcast(index)
    size = len(index.keys)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vector = np.zeros(-(-size // BLOCK) * BLOCK, np.int64)
        for batch in batches:
            np.add.at(vector, shared.value(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        blocks = vector.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        branch = TaskContext.get().partitionId() // FAN_IN
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(used), branch)), pa.array(used),
            pa.array([blocks[i].tobytes() for i in used], pa.binary()),
        ], names=["branch", "block", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(raw, np.int64) for raw in table["counts"].to_pylist())
        return pa.table({
            "branch": pa.array([key[0].as_py() // FAN_IN], pa.int64()),
            "block": pa.array([key[1].as_py()], pa.int64()),
            "counts": pa.array([total.tobytes()], pa.binary()),
        })

    schema = "branch long, block long, counts binary"
    vectors = counts.mapInArrow(dense, schema)
    for _ in range(TREE_STEPS):
        vectors = vectors.groupBy("branch", "block").applyInArrow(add, schema)
    total = np.zeros(-(-size // BLOCK) * BLOCK, np.int64).reshape(-1, BLOCK)
    for row in vectors.collect():  # a block for each branch that is left, one below FAN_IN ** 4 tasks
        total[row.block] += np.frombuffer(row.counts, np.int64)
    return total.ravel()[:size]


def best_flags(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its second id."""
    second = keys & 0xFFFFFFFF
    highest = np.zeros(int(second.max(initial=-1)) + 1, np.int64)
    np.maximum.at(highest, second, counts)
    return counts == highest[second]


def align_corpus(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """A row per document: tokens of both sides, links, their counts and the groups' digest."""
    if (bound := pair_bound(vocabularies.tokens_a, vocabularies.tokens_b)) > MOST_PAIRS:
        raise ValueError(f"the vocabularies allow {bound} pairs; at most {MOST_PAIRS} are broadcast")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(vocabularies)
    blocks = written(encoded_blocks(docs, shared), "token-blocks")
    counts = written(task_counts(blocks, shared), "pair-counts")
    index = build_hash(counts)
    totals = summed_counts(counts, index)
    looked_up = context.broadcast((index, totals, best_flags(index.keys, totals)))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, totals, best = looked_up.value
        sizes = token_sizes(shared.value)
        shown = shown_ids(max(map(len, sizes)))
        for batch in batches:
            for raw in batch.column(0):
                block = Block(raw.as_py(), sizes)
                at = index(block.units_aligned.pairs)
                assert (at >= 0).all(), "a pair that the first pass did not count"
                a, b, links, is_best, total = map(pa.array, block.sums([best[at].astype(np.int64), totals[at]]))
                yield pa.RecordBatch.from_arrays(
                    [block.doc_ids, a, b, links, links, is_best, total, pa.array(block.digests(shown), pa.string())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    return blocks.mapInArrow(
        released(second_pass), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
        "count_sum long, groups_sha256 string",
    )
