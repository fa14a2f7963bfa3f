"""Removal of repeated word windows, found by backward search in FM-indexes.

A window is ``WINDOW`` consecutive words.  Each window has a minimizer: the smallest hash of the
runs of ``CORE`` words in it.  Equal windows have equal minimizers, so a document is cut into
stretches of neighbouring windows with one minimizer, and a stretch goes to the shard that its
minimizer names.  Stretches whose minimizer nothing else has hold no repeated window and stay.

A shard builds an FM-index over its distinct stretches: suffixes sorted to the depth of a window,
their Burrows-Wheeler transform in a wavelet matrix, and the places of the suffixes.  The stretches
are streamed against it: backward search gives the matching statistic at every word, up to the
length of a window, and reports the intervals that reach it.  Of the occurrences in an interval
the earliest stays.  A stretch that many documents have is one text with many places, which count
as occurrences; tasks combine them before the shuffle.

A minimizer with more than ``HOT`` occurrences does not name one shard: its windows are dealt one
by one, by the hash of the whole window.

Documents are packed once into compressed chunks, a table in the shared folder; the joins move
chunks, hashes and spans, and a chunk is a few hundred kilobytes whatever one key holds.

Defined cases: a null text has no words; documents are ordered by ``doc_id``, null last, and rows
that repeat one are documents of their own in the order in which the table lists them; texts with
fewer words than a window are left as they are; further columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed_columns, text_or_empty, unpacked_columns, written
from .packing import in_bounds

#: Words of a window, and of the runs that minimizers are chosen from.
WINDOW, CORE = 20, 8
#: Occurrences above which the windows of a minimizer are dealt one by one.
HOT = 50_000
#: Rows in a chunk (a power of two) and bytes of its texts; one longer text stands alone.
CHUNK_ROWS, CHUNK_BYTES = 128, 1_000_000
#: Bytes of the corpus per bucket of minimizers and per shard.
BUCKET_BYTES, SHARD_BYTES = 32_000_000, 4_000_000
#: Stretches that a task combines before it sends them on.
COMBINED = 200_000

_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.iinfo(np.int64).max


def chunks_of(docs: DataFrame) -> DataFrame:
    """``chunk, bytes, docs``: documents in compressed chunks whose numbers rise with the rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                for low, high in in_bounds(sizes[start:start + CHUNK_ROWS], CHUNK_BYTES):
                    some = batch.slice(start + low, high - low)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number]), pa.array([sum(sizes[start + low:start + high])]),
                        pa.array([packed_columns({"doc_id": some.column(0), "text": some.column(1)})]),
                    ], names=["chunk", "bytes", "docs"])
                    number += 1

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return texts.mapInArrow(pack, "chunk long, bytes long, docs binary")


class Words:
    """Words of a chunk's texts as flat arrays, with the hashes of their runs."""

    def __init__(self, texts: pa.Array):
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten()
        real = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves empty words
        offsets = np.concatenate([[0], np.cumsum(real)])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        self.starts, self.sizes = offsets[:-1], np.diff(offsets)
        coded = words.filter(pa.array(real)).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
        hashes = pd.util.hash_array(distinct, categorize=False) if len(distinct) else distinct
        self.words = distinct[coded.indices.to_numpy()]
        self._hashes = hashes.astype(np.uint64)[coded.indices.to_numpy()]
        self._of = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def runs(self, size: int) -> np.ndarray:
        """Hashes of ``size`` words from each word on, across texts too."""
        n = max(len(self._hashes) - size + 1, 0)
        found = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(size):
                found = found * _FACTOR + self._hashes[i:n + i]
            found = (found ^ (found >> np.uint64(29))) * _MIX
        return found ^ (found >> np.uint64(32))

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First window, windows and minimizer of each stretch, and how often it starts there."""
        least, width = self.runs(CORE), 1
        at = np.arange(len(least))
        n = max(len(self._hashes) - WINDOW + 1, 0)
        while width < WINDOW - CORE + 1:  # the minimum over twice as many runs, then over all
            step = min(width, WINDOW - CORE + 1 - width)
            left, right = least[:len(least) - step], least[step:]
            at = np.where(right < left, at[step:], at[:len(left)])
            least = np.minimum(left, right)
            width += step
        least, at = least[:n], at[:n]
        inside = self._of[:n] == self._of[WINDOW - 1:WINDOW - 1 + n]
        changes = np.ones(n, bool)
        changes[1:] = ~inside[:-1] | (self._of[1:n] != self._of[:max(n - 1, 0)])
        begins = inside & changes
        begins[1:] |= inside[1:] & (least[1:] != least[:-1])
        moves = begins.copy()
        moves[1:] |= inside[1:] & (at[1:] != at[:-1])
        first = np.flatnonzero(begins)
        if not len(first):
            return first, first, least[first], first
        windows, times = (np.add.reduceat(flags.astype(np.int64), first) for flags in (inside, moves))
        return first, windows, least[first], times

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the text, and place in it, of flat places."""
        return self._of[at], at - self.starts[self._of[at]]


def _by_minimizer(minimizers: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct minimizers, which of them each one is, and how often they occur."""
    distinct, at = np.unique(minimizers, return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, at, times)
    return distinct, at, sums


def shared_minimizers(chunks: DataFrame, total_bytes: int) -> DataFrame:
    """Per chunk: minimizers that other chunks have too, and whether they are hot."""
    buckets = -(-total_bytes // BUCKET_BYTES) or 1

    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, _, counts = _by_minimizer(*Words(unpacked_columns(raw).column(1)).stretches()[2:])
                bucket = (hashes >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                used, first = np.unique(bucket[order], return_index=True)
                ends = [*first[1:].tolist(), len(order)]
                parts = [order[a:b] for a, b in zip(first.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(used.astype(np.int64)), pa.array(np.full(len(used), chunk)),
                    pa.array([hashes[p].tobytes() for p in parts], pa.binary()),
                    pa.array([counts[p].astype("<u4").tobytes() for p in parts], pa.binary()),
                ], names=["bucket", "chunk", "hashes", "counts"])

    def shared(table: pa.Table) -> pa.Table:
        sizes = pc.binary_length(table["hashes"]).to_numpy() // 8
        hashes, counts = (
            np.frombuffer(b"".join(table[name].to_pylist()), kind)
            for name, kind in (("hashes", np.uint64), ("counts", "<u4"))
        )
        _, at, chunks_with = np.unique(hashes, return_inverse=True, return_counts=True)
        times = np.zeros(len(chunks_with), np.int64)
        np.add.at(times, at, counts)
        kept = chunks_with[at] > 1
        hot = (times[at] > HOT).astype(np.uint8)
        ends = np.cumsum(sizes).tolist()
        rows = [(slice(a, b), kept[a:b]) for a, b in zip([0, *ends], ends)]
        return pa.table({
            "chunk": table["chunk"],
            "hashes": pa.array([hashes[of][k].tobytes() for of, k in rows], pa.binary()),
            "hot": pa.array([hot[of][k].tobytes() for of, k in rows], pa.binary()),
        })

    found = chunks.select("chunk", "docs").mapInArrow(
        minimizers, "bucket long, chunk long, hashes binary, counts binary"
    ).groupBy("bucket").applyInArrow(shared, "chunk long, hashes binary, hot binary")
    return found.where(F.octet_length("hashes") > 0)


class Stretches:
    """Texts of stretches, each once, with the places where they stand."""

    def __init__(self, shards: int):
        self._shards = shards
        self._places: list[dict[str, list]] = [{} for _ in range(shards)]
        self.held = 0

    def add(self, shard: int, text: str, place: tuple[int, int, int]) -> None:
        self._places[shard].setdefault(text, []).append(place)
        self.held += 1

    def taken(self) -> pa.RecordBatch:
        used = [i for i, texts in enumerate(self._places) if texts]
        blobs = []
        for texts in map(self._places.__getitem__, used):
            order, row, start = zip(*(p for places in texts.values() for p in places))
            blobs.append(packed_columns({
                "texts": pa.array([list(texts)], pa.list_(pa.string())),
                "times": pa.array([list(map(len, texts.values()))], pa.list_(pa.int64())),
                "order": pa.array([order], pa.list_(pa.int64())),
                "row": pa.array([row], pa.list_(pa.int64())),
                "start": pa.array([start], pa.list_(pa.int64())),
            }))
        self.__init__(self._shards)
        return pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "stretches"]
        )


def sharded_stretches(chunks: DataFrame, shared: DataFrame, shards: int) -> DataFrame:
    """``shard, stretches``: what may hold a repeated window, at the shard of its minimizer."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Stretches(shards)
        for batch in batches:
            for chunk, raw, found in zip(*(c.to_pylist() for c in batch.columns)):
                _send_chunk(chunk, unpacked_columns(raw), found or [], out, shards)
                if out.held > COMBINED:
                    yield out.taken()
        yield out.taken()

    # a chunk's list is bounded by the chunk's own minimizers
    listed = shared.groupBy("chunk").agg(F.collect_list(F.struct("hashes", "hot")).alias("found"))
    return chunks.select("chunk", "docs").join(listed, "chunk", "left").select(
        "chunk", "docs", "found"
    ).mapInArrow(send, "shard long, stretches binary")


def _send_chunk(chunk: int, docs: pa.RecordBatch, found: list[dict], out: Stretches, shards: int) -> None:
    words = Words(docs.column(1))
    first, windows, minimizers, starts = words.stretches()
    elsewhere = np.frombuffer(b"".join(f["hashes"] for f in found), np.uint64)
    hot = np.frombuffer(b"".join(f["hot"] for f in found), np.uint8).astype(bool)
    _, at, times = _by_minimizer(minimizers, starts)
    # what stands in one chunk only may be hot as well; others do not have it, so they agree
    repeated, many = times[at] > 1, times[at] > HOT
    many |= np.isin(minimizers, elsewhere[hot])
    kept = np.flatnonzero(repeated | np.isin(minimizers, elsewhere))
    if not len(kept):
        return
    whole = kept[~many[kept]]
    single = kept[many[kept]]
    shard = (minimizers[whole] >> np.uint64(8)) % np.uint64(shards)
    begins, sizes = first[whole], windows[whole] + WINDOW - 1
    if len(single):
        runs = np.repeat(first[single], windows[single])
        steps = np.arange(len(runs)) - np.repeat(np.cumsum(windows[single]) - windows[single], windows[single])
        one = runs + steps
        begins = np.concatenate([begins, one])
        sizes = np.concatenate([sizes, np.full(len(one), WINDOW)])
        shard = np.concatenate([shard, (words.runs(WINDOW)[one] >> np.uint64(8)) % np.uint64(shards)])
    text_words = words.words.tolist()
    number, start = words.place(begins)
    order = docs.column(0).fill_null(_LAST).to_numpy()[number]
    rows = zip(
        shard.tolist(), begins.tolist(), (begins + sizes).tolist(), order.tolist(),
        (chunk * CHUNK_ROWS + number).tolist(), start.tolist(),
    )
    for to, low, high, *place in rows:
        out.add(to, " ".join(text_words[low:high]), tuple(place))


class WaveletMatrix:
    """Rank queries on a sequence of symbols: a bit vector per bit of a symbol, highest first."""

    def __init__(self, symbols: np.ndarray, size: int):
        self._bits = max(int(size - 1).bit_length(), 1)
        self._levels = []
        for shift in reversed(range(self._bits)):
            ones = (symbols >> shift & 1).astype(bool)
            raw = np.packbits(ones, bitorder="little").tobytes()
            blocks = np.frombuffer(raw + bytes(16 - len(raw) % 8), np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)[:-1]])
            zeros = len(symbols) - int(ones.sum())
            self._levels.append((shift, blocks, before.astype(np.int32), zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self._first = self._moved(np.arange(size), np.zeros(size, np.int64))

    def _moved(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, blocks, before, zeros in self._levels:
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(blocks[block] & below)
            at = np.where(symbols >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._moved(symbols, at) - self._first[symbols]


class FMIndex:
    """Backward search over texts of symbols that are sorted to the depth of a pattern."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.text, depth, ranks = symbols, 1, symbols
        known = {1: symbols}
        while depth < WINDOW:
            more = max(d for d in known if d <= WINDOW - depth)
            keys = (known[depth] << 32) + np.concatenate([known[more][depth:], np.zeros(depth, np.int64)])[:len(symbols)]
            depth += more
            if depth < WINDOW:
                ranks = np.unique(keys, return_inverse=True)[1].astype(np.int64)
                known[depth] = ranks
        #: Places of the suffixes in their order; equal beginnings keep the order of the text.
        self.places = np.argsort(keys, kind="stable")
        self._matrix = WaveletMatrix(symbols[self.places - 1], size)
        self._starts = np.cumsum(np.bincount(symbols, minlength=size)) - np.bincount(symbols, minlength=size)
        self._ends = self._starts + np.bincount(symbols, minlength=size)

    def matches(self, starts: np.ndarray, weights: np.ndarray):
        """Matching statistics at the last words of windows, with the intervals of whole windows.

        ``weights`` says how often each place of the text occurs.  A search ends where what is
        matched occurs once.  Gives the windows that occur more often, and their intervals.
        """
        before = np.concatenate([[0], np.cumsum(weights[self.places])])
        last = self.text[starts + WINDOW - 1]
        low, high = self._starts[last], self._ends[last]
        statistics = np.zeros(len(starts), np.int64)
        live = np.arange(len(starts))
        for length in range(1, WINDOW + 1):
            more = before[high] - before[low] > 1
            live, low, high = live[more], low[more], high[more]
            statistics[live] = length
            if length == WINDOW:
                return statistics, live, low, high
            symbol = self.text[starts[live] + WINDOW - 1 - length]
            both = self._matrix.rank(np.tile(symbol, 2), np.concatenate([low, high]))
            low, high = self._starts[symbol] + both[:len(live)], self._starts[symbol] + both[len(live):]


def repeated_spans(texts: list[str], times: np.ndarray, order: np.ndarray, row: np.ndarray, start: np.ndarray):
    """``row, start, end`` of spans that stand earlier as well.

    ``times`` says how many of the places ``order, row, start`` each text has, in turn.
    """
    cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    words = cut.flatten().dictionary_encode()
    symbols = words.indices.to_numpy().astype(np.int64) + 1
    bounds = cut.offsets.to_numpy()
    sizes = np.diff(bounds)
    # a separator behind each text
    flat = np.insert(symbols, bounds[1:], 0)
    begins = bounds[:-1] + np.arange(len(texts))
    index = FMIndex(flat, len(words.dictionary) + 1)
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    # the earliest place of each text; the others repeat it whole
    by_place = np.lexsort((start, row, order))
    text_of = np.repeat(np.arange(len(texts)), times)
    _, at = np.unique(text_of[by_place], return_index=True)
    least = by_place[at]
    later = np.ones(len(text_of), bool)
    later[least] = False
    spans = [np.stack([row[later], start[later], start[later] + sizes[text_of[later]]])]
    counts = sizes - WINDOW + 1
    steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(begins, counts) + steps
    statistics, found, low, high = index.matches(starts, times[of])
    assert (statistics[found] == WINDOW).all()
    if len(found):
        # rank the starts of all occurrences, then take the least of each interval
        inside, first = np.unique(low, return_index=True)
        ends = high[first]
        lengths = ends - inside
        rows = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - inside, lengths)
        places = index.places[rows]
        text, offset = of[places], places - begins[of[places]]
        ranks = np.empty(len(places), np.int64)
        ranks[np.lexsort((start[least[text]] + offset, row[least[text]], order[least[text]]))] = np.arange(len(places))
        earliest = np.full(len(flat), -1)
        heads = np.cumsum(lengths) - lengths
        earliest_rank = np.minimum.reduceat(ranks, heads)
        is_first = ranks == np.repeat(earliest_rank, lengths)
        earliest[places[is_first]] = 1
        gone = np.sort(starts[found][earliest[starts[found]] < 0])
        if len(gone):
            new = np.flatnonzero(np.concatenate([[True], np.diff(gone) > 1]))
            a, b = gone[new], gone[np.append(new[1:], len(gone)) - 1]
            text = of[a]
            base = start[least[text]] - begins[text]
            spans.append(np.stack([row[least[text]], base + a, base + b + WINDOW]))
    return np.concatenate(spans, axis=1)


def removed_spans(stretches: DataFrame) -> DataFrame:
    """``chunk, spans``: spans as triples of the row in the chunk, first word and end."""
    schema = pa.schema([("chunk", pa.int64()), ("spans", pa.binary())])

    def search(table: pa.Table) -> pa.Table:
        known: dict[str, int] = {}
        texts, parts = [], []
        for raw in table["stretches"].to_pylist():
            batch = unpacked_columns(raw)
            some, times, *places = (c.values for c in batch.columns)
            numbers = [known.setdefault(t, len(known)) for t in some.to_pylist()]
            parts.append([np.repeat(numbers, times.to_numpy()), *(p.to_numpy() for p in places)])
        texts = list(known)
        text_of, *places = (np.concatenate(column) for column in zip(*parts))
        by_text = np.argsort(text_of, kind="stable")
        times = np.bincount(text_of, minlength=len(texts))
        row, low, high = repeated_spans(texts, times, *(p[by_text] for p in places))
        by_row = np.lexsort((low, row))
        spans = np.stack([row % CHUNK_ROWS, low, high]).T[by_row]
        chunk, first = np.unique((row // CHUNK_ROWS)[by_row], return_index=True)
        ends = [*first[1:].tolist(), len(spans)]
        return pa.Table.from_arrays([
            pa.array(chunk, pa.int64()),
            pa.array([spans[a:b].astype("<i4").tobytes() for a, b in zip(first.tolist(), ends)], pa.binary()),
        ], schema=schema)

    return stretches.groupBy("shard").applyInArrow(search, "chunk long, spans binary")


def without_spans(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: the words that stay, joined by one space."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, found in zip(*(c.to_pylist() for c in batch.columns)):
                keys, texts = (c.to_pylist() for c in unpacked_columns(raw).columns)
                by_row: dict[int, list] = {}
                triples = np.frombuffer(b"".join(found or []), "<i4").reshape(-1, 3)
                for number, low, high in triples.tolist():
                    by_row.setdefault(number, []).append((low, high))
                sizes, gone, kept = [], [], []
                for number, text in enumerate(texts):
                    words = text.encode().split()  # at ASCII white space
                    sizes.append(len(words))
                    if number in by_row:
                        stays = np.ones(len(words), bool)
                        for low, high in by_row[number]:
                            stays[low:high] = False
                        words = [words[i] for i in np.flatnonzero(stays).tolist()]
                    gone.append(sizes[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(kept, pa.string()),
                ], names=["doc_id", "n_words", "n_removed", "text"])

    listed = spans.groupBy("chunk").agg(F.collect_list("spans").alias("spans"))
    return chunks.select("chunk", "docs").join(listed, "chunk", "left").select("docs", "spans").mapInArrow(
        remove, "doc_id long, n_words long, n_removed long, text string"
    )


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Every document without the words of windows that stand earlier in the corpus."""
    chunks = written(chunks_of(docs), "text-chunks")
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    shared = shared_minimizers(chunks, total)
    stretches = sharded_stretches(chunks, shared, -(-total // SHARD_BYTES) or 1)
    spans = written(removed_spans(stretches), "removed-spans")
    return without_spans(chunks, spans)
