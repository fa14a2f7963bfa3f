"""Near-duplicate documents by the Jaccard similarity of word shingles, joined by signature trees.

Equal sets are one class, whatever the number of copies.  Two classes that reach the similarity
share a shingle among the first of each set, in any order of all shingles; the order here puts the
corpus's rare shingles first, so such a shared shingle is rare as well.  Classes that share one form
a group, groups with the same smallest class are one, and the groups are searched twice:

1. each class of a group against the group's first class, and in a few more turns against some
   classes drawn by a hash: linear passes whose links make components;
2. groups that still hold several components by signature trees: a node holds the OR of its
   classes' token bitmaps, their range of sizes and their component if it is one.  Pairs of nodes
   are followed from the roots down and dropped where the sizes exclude the similarity, where both
   lie in one component, or where the bitmaps have too few bits in common.

Every pair that is left is computed exactly from the whole texts.  Large groups are cut into parts,
and every pair of parts is searched, so no task holds a group and no pair is left out.  The
components of all links are found by alternating large-star and small-star steps.

Shingles are 64-bit hashes of words and sets are known by 128-bit hashes.

Defined cases: null and empty texts, and texts of white space, have no shingles and are linked with
nothing; rows that repeat an id are documents of their own that share a result; a row without id
belongs to the class of its text and is never the smallest id; further columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, text_or_empty, written
from .packing import in_bounds

#: Cells of the corpus counts of shingles: a table of fixed size.
COUNT_CELLS = 1 << 16
#: Bits of a bitmap; classes of a leaf, children of a node, classes of a part of a large group.
BITS, LEAF, FAN, PART = 4096, 8, 8, 512
#: Further passes of a group against some of its classes, and how many in each.
ROUNDS, PIVOTS = 2, 4
#: Words whose hashes a task remembers, and characters that are cut at once.
REMEMBERED, AT_ONCE = 100_000, 1_000_000

_MIX, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_SHIFT = np.uint64(29)


class Shingles:
    """Sorted hashes of the distinct shingles of whole texts."""

    def __init__(self, words: int):
        self._n, self._hashes = words, {}

    def _hashes_of(self, words: list[str]) -> np.ndarray:
        known = self._hashes
        if len(known) > REMEMBERED:
            known.clear()
        known.update((w, xxhash.xxh3_64_intdigest(w)) for w in words if w not in known)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def _mixed(hashes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n words; of n as well, so that shorter ones differ."""
        mixed = np.full(len(hashes) - n + 1, n, np.uint64)
        for i in range(n):
            mixed = (mixed ^ (mixed >> _SHIFT)) * _MIX + hashes[i:i + len(mixed)] * _ADD
        mixed ^= mixed >> _SHIFT
        return mixed * _MIX

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        for low, high in in_bounds([len(t) for t in texts], AT_ONCE):
            # both take ASCII alone: A-Z, and the six spaces
            cut = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts[low:high], pa.string())))
            coded = cut.flatten().dictionary_encode()
            hashes = self._hashes_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            # white space at an end of a text leaves an empty word there
            full = pc.not_equal(pc.binary_length(coded.dictionary), 0).to_numpy(
                zero_copy_only=False)[coded.indices.to_numpy()]
            ends = np.concatenate([[0], np.cumsum(full)])[cut.offsets.to_numpy()].tolist()
            hashes = hashes[full]
            runs = self._mixed(hashes, self._n) if len(hashes) >= self._n else hashes[:0]
            for start, end in zip(ends, ends[1:]):
                n = min(self._n, end - start)
                own = runs[start:end - n + 1] if n == self._n else self._mixed(hashes[start:end], n)
                yield _distinct(own) if n else hashes[:0]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def least_overlap(a: int, b: int, percent: int) -> int:
    """Smallest intersection at which 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(48)).astype(np.int64) % COUNT_CELLS


def _name(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def bitmap(shingles: np.ndarray) -> int:
    flags = np.zeros(BITS, bool)
    flags[(shingles % np.uint64(BITS)).astype(np.intp)] = True
    return int.from_bytes(np.packbits(flags).tobytes())


def most_overlap(a: int, size_a: int, b: int, size_b: int) -> int:
    """Largest intersection that two bitmaps allow: bits in common, and what shares a bit."""
    spare = min(size_a - a.bit_count(), size_b - b.bit_count())
    return (a & b).bit_count() + spare


class Node:
    """A node of a signature tree; a leaf has rows (class, size, bitmap, component)."""

    __slots__ = ("bits", "low", "high", "spare", "component", "children", "rows")

    def __init__(self, parts: list, is_leaf: bool):
        self.rows, self.children = (parts, []) if is_leaf else ([], parts)
        self.bits, self.spare, components = 0, 0, set()
        self.low, self.high = None, 0
        for part in parts:
            if is_leaf:
                _, size, bits, component = part
                low, high, spare = size, size, size - bits.bit_count()
            else:
                bits, low, high = part.bits, part.low, part.high
                spare, component = part.spare, part.component
            self.bits |= bits
            self.low = low if self.low is None else min(self.low, low)
            self.high, self.spare = max(self.high, high), max(self.spare, spare)
            components.add(component)
        # None stands for several components
        self.component = components.pop() if len(components) == 1 else None


def signature_tree(rows: list[tuple]) -> Node:
    """Rows of one component and of like sizes stand together."""
    rows = sorted(rows, key=lambda r: (r[3], r[1]))
    level = [Node(rows[i:i + LEAF], True) for i in range(0, len(rows), LEAF)]
    while len(level) > 1:
        level = [Node(level[i:i + FAN], False) for i in range(0, len(level), FAN)]
    return level[0]


def tree_pairs(first: Node, second: Node, percent: int) -> Iterator[tuple]:
    """Pairs of classes of different components that the bitmaps do not exclude.

    With the same tree twice, each pair comes once.
    """
    stack = [(first, second)]
    while stack:
        a, b = stack.pop()
        if a.component is not None and a.component == b.component:
            continue
        if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
            continue
        # a similar pair of these nodes has sizes in both ranges, or nearly
        small = max(a.low, -(-percent * b.low // 100))
        other = max(b.low, -(-percent * a.low // 100))
        if (a.bits & b.bits).bit_count() + min(a.spare, b.spare) < least_overlap(
                small, other, percent):
            continue
        if a.rows and b.rows:
            for i, (x, size_x, bits_x, in_x) in enumerate(a.rows):
                for y, size_y, bits_y, in_y in (a.rows[i + 1:] if a is b else b.rows):
                    if (in_x != in_y and 100 * min(size_x, size_y) >= percent * max(size_x, size_y)
                            and most_overlap(bits_x, size_x, bits_y, size_y)
                            >= least_overlap(size_x, size_y, percent)):
                        yield (x, y) if x < y else (y, x)
        elif a is b:
            stack.extend((p, q) for i, p in enumerate(a.children) for q in a.children[i:])
        elif a.children and (not b.children or len(a.children) >= len(b.children)):
            stack.extend((p, b) for p in a.children)
        else:
            stack.extend((a, q) for q in b.children)


# ---- the corpus ----

_CLASSES = ("doc_id long, text_hash long, n_shingles long, class binary, keys array<long>, bits binary")


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """Occurrences in the corpus of the shingles of each cell; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Shingles(words), np.zeros(COUNT_CELLS, np.int64)
        for batch in batches:
            found = list(shingles(batch.column(0).to_pylist()))
            total += np.bincount(_cells(np.concatenate(found)), minlength=COUNT_CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(total[cells])], names=["cell", "n"]
        )

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(released(count), "cell long, n long") \
        .groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNT_CELLS, np.int64)
    counts[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return counts


def classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Each document's set size and class; once per task also the class's keys and bitmap."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, words))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(words), set()
        for batch in batches:
            sizes, names, keys, bits = [], [], [], []
            for one in shingles(batch.column(2).to_pylist()):
                name = _name(one)
                sizes.append(len(one))
                names.append(name)
                if name is None or name in seen:
                    keys.append(None)
                    bits.append(None)
                    continue
                seen.add(name)
                rarest = np.argsort(counts.value[_cells(one)], kind="stable")  # ties by hash
                keys.append(one[rarest[:prefix_length(len(one), percent)]].view(np.int64))
                bits.append(bitmap(one).to_bytes(BITS // 8))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()),
            ], names=["doc_id", "text_hash", "n_shingles", "class", "keys", "bits"])

    return docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("text_hash"),
        text_or_empty().alias("text"),
    ).mapInArrow(released(found), _CLASSES)


def groups(members: DataFrame) -> DataFrame:
    """(first, class): what shares a key with other classes, under the first class of the key.

    Keys with the same first class make one group, so that classes which share many keys meet in
    few groups.
    """
    sorted_rows = members.where("keys is not null").select(
        F.explode("keys").alias("key"), "class"
    ).repartition("key").sortWithinPartitions("key", "class")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # key, class and first class of the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            key, name = batch.column(0), batch.column(1)
            firsts = name
            if carried is not None:
                key = pa.concat_arrays([carried[0], key])
                firsts = pa.concat_arrays([carried[2], name])
                name = pa.concat_arrays([carried[1], name])
            same_key = pc.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            same_name = pc.equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False)
            same_key = np.concatenate([[False], same_key])
            start = np.maximum.accumulate(np.where(same_key, 0, np.arange(len(same_key))))
            firsts = firsts.take(pa.array(start))
            chosen = pa.array(np.flatnonzero(same_key & ~np.concatenate([[False], same_name])))
            carried = [x[-1:] for x in (key, name, firsts)]
            if len(chosen):
                yield pa.RecordBatch.from_arrays(
                    [firsts.take(chosen), name.take(chosen)], names=["first", "class"]
                )

    return sorted_rows.mapInArrow(released(runs), "first binary, class binary").distinct()


def _bound_pairs(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and bitmaps do not exclude."""
    wide = pairs
    for side in ("a", "b"):
        named = signatures.select(
            F.col("class").alias(side), F.col("n_shingles").alias(f"size_{side}"),
            F.col("bits").alias(f"bits_{side}"),
        )
        wide = wide.join(named, side)
    wide = wide.where(F.expr(
        f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
    )).select("a", "b", "size_a", "bits_a", "size_b", "bits_b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[2:]]
            passed = [
                most_overlap(int.from_bytes(x), m, int.from_bytes(y), n)
                >= least_overlap(m, n, percent) for m, x, n, y in zip(*columns, strict=True)
            ]
            yield batch.filter(pa.array(passed, pa.bool_())).select(["a", "b"])

    return wide.mapInArrow(released(bounded), "a binary, b binary")


def exact_links(docs: DataFrame, members: DataFrame, pairs: DataFrame, words: int,
                percent: int) -> DataFrame:
    """The pairs whose sets, taken from the whole texts, reach the similarity."""
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    one = members.where("doc_id is not null and class is not null").join(needed, "class") \
        .groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).join(
        one, "doc_id"
    ).select("class", "text")
    texts = written(texts, "compared-texts")
    wide = pairs
    for side in ("a", "b"):
        wide = wide.join(
            texts.select(F.col("class").alias(side), F.col("text").alias(f"text_{side}")), side
        )

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.add(pc.binary_length(batch.column(1)), pc.binary_length(batch.column(3)))
            for low, high in in_bounds(sizes.to_pylist(), AT_ONCE):
                yield batch.slice(low, high - low)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in parts_of(batches):
            a, text_a, b, text_b = (c.to_pylist() for c in batch.columns)
            left, right = list(zip(a, text_a)), list(zip(b, text_b))
            named = list(dict.fromkeys([*left, *right]))
            sets = dict(zip(named, shingles([text for _, text in named])))
            # an id that repeats may have brought another text than the class's
            own = {key for key, found in sets.items() if _name(found) == key[0]}
            kept = []
            for x, y in zip(left, right):
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                union = len(sets[x]) + len(sets[y]) - common
                kept.append(x in own and y in own and 100 * common >= percent * union)
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    return wide.select("a", "text_a", "b", "text_b").mapInArrow(released(linked), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(class, component) of every class with a link; the component is its smallest class."""
    edges = written(
        links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
        .where("low != high").distinct(), "edges",
    )

    def size_of(edges: DataFrame) -> tuple:
        return tuple(edges.agg(
            F.count("*"), F.bit_xor(F.xxhash64("low", "high"))
        ).first())

    before = size_of(edges)
    while True:
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(
            edges.select("high", "low")
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(
            F.col("m").alias("low"), F.col("v").alias("high")
        ).where("low != high").distinct()
        # small star: smaller neighbours and the class itself go to the smallest of them
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high").select("m", "low", "high")
        edges = written(
            small.where("low != m").select(F.col("m").alias("low"), F.col("low").alias("high"))
            .union(small.select("m", "high")).distinct(), "edges",
        )
        after = size_of(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("low").alias("class")).distinct()
    return written(edges.select(F.col("high").alias("class"), F.col("low").alias("component")).union(
        roots.select("class", F.col("class").alias("component"))
    ), "components")


def _group_members(grouped: DataFrame, known: DataFrame) -> DataFrame:
    """(first, class, component) of the groups that hold several components."""
    members = grouped.union(grouped.select("first", F.col("first").alias("class")).distinct()).join(
        known, "class", "left"
    ).select("first", "class", F.coalesce("component", "class").alias("component"))
    members = written(members, "group-members")
    several = members.groupBy("first").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low != high").select("first", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    return members.join(several, "first")


def pivot_candidates(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of some classes of each group, drawn anew in each turn, with all others."""
    drawn = [
        F.min_by(F.struct("class", "component"), F.xxhash64("class", F.lit(turn * PIVOTS + i)))
        for i in range(PIVOTS)
    ]
    pivots = members.groupBy("first").agg(F.array_distinct(F.array(*drawn)).alias("pivots"))
    pairs = members.join(pivots, "first").select("class", "component", F.explode("pivots").alias("p"))
    return pairs.where(F.col("p.component") != F.col("component")).select(
        F.least("class", "p.class").alias("a"), F.greatest("class", "p.class").alias("b")
    ).distinct()


def tree_candidates(members: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components from the signature trees of the groups."""
    rows = members.join(signatures.select("class", "n_shingles", "bits"), "class")
    # part i of a large group goes to the cells of all pairs (i, j)
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    cells = rows.withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    ).select(
        "first", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        "part", "class", "n_shingles", "bits", "component",
    ).repartition("first", "i", "j").sortWithinPartitions("first", "i", "j")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def pairs_of(cell: tuple, rows: list[tuple]) -> Iterator[tuple]:
            _, i, j = cell
            sides = [[
                (name, size, int.from_bytes(bits), component)
                for *_, part, name, size, bits, component in rows if part == side
            ] for side in dict.fromkeys((i, j))]
            if all(sides):
                trees = [signature_tree(side) for side in sides]
                yield from tree_pairs(trees[0], trees[-1], percent)

        def every_pair() -> Iterator[tuple]:
            cell, held = None, []
            for row in rows_of():
                if row[:3] != cell:
                    if held:
                        yield from pairs_of(cell, held)
                    cell, held = row[:3], []
                held.append(row)
            if held:
                yield from pairs_of(cell, held)

        told, seen = [], set()
        for pair in every_pair():
            if pair not in seen:  # the same pair meets in many groups
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(pair)
                told.append(pair)
            if len(told) >= 10_000:
                yield _pairs(told)
                told = []
        if told:
            yield _pairs(told)

    return cells.mapInArrow(released(searched), "a binary, b binary").distinct()


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=["a", "b"]
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, with_hash: bool = False) -> DataFrame:
    """Per document: ``n_shingles``, the smallest id that links reach; ``text_hash`` if asked for."""
    members = written(classes(docs, words, percent), "classes")
    signatures = members.where("bits is not null").dropDuplicates(["class"]).select(
        "class", "n_shingles", "bits"
    )
    grouped = written(groups(members), "groups")
    pairs = grouped.select(F.col("first").alias("a"), F.col("class").alias("b"))
    near = written(_bound_pairs(pairs, signatures, percent), "pairs")
    tried, known = near, components(exact_links(docs, members, near, words, percent))
    for turn in range(1, ROUNDS + 2):
        parts = _group_members(grouped, known)
        if turn <= ROUNDS:
            pairs = pivot_candidates(parts, turn).join(tried, ["a", "b"], "left_anti")
            near = written(_bound_pairs(pairs, signatures, percent), "pairs")
        else:
            pairs = tree_candidates(parts, signatures, percent)
            near = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if near.isEmpty():
            continue
        tried = tried.union(near)
        found = exact_links(docs, members, near, words, percent)
        # components so far are stars: links that stand for all links before
        stars = known.select(F.col("component").alias("a"), F.col("class").alias("b"))
        known = components(found.union(stars))
    labelled = members.select("doc_id", "text_hash", "n_shingles", "class").join(
        known, "class", "left"
    ).select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("component", "class").alias("component")
    )
    least = labelled.where("component is not null").groupBy("component").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("n")
    ).where("n > 1")
    told = ["doc_id", "text_hash", "n_shingles"] if with_hash else ["doc_id", "n_shingles"]
    return labelled.join(least, "component", "left").select(
        *told, F.coalesce("least", "doc_id").alias("component_id")
    )
