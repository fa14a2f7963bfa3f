"""Shards cut from a Hilbert-curve order of several metadata dimensions.

Each dimension is quantised into ``2 ** bits`` cells by its own quantiles, so cells keep the
dimension's order and hold about as many rows each.  Rows are sorted by the index of their cell on
the Hilbert curve, and runs of equal row counts become the shards: rows close in every dimension
lie close together, so the minimum and maximum of a file are narrow in all of them.

Defined cases: a null dimension is the lowest cell; a null text has no bytes and the checksum of
the empty text; rows equal in the curve index are ordered by id and checksum, so a repeated row
takes a slot of its own; an empty table gives no rows; a column named like an output is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Accuracy of the quantiles: their rank error is the row count divided by it.
QUANTILE_ACCURACY = 2000


def curve_steps(dims: int) -> tuple[list[int], list[int]]:
    """The curve as a machine: per (state, cell of the octant) its digit and the next state.

    A state is an entry corner and a direction; both follow from the reflected Gray code
    (Hamilton's construction), so the table is a rule and not a list.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def rotated(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask

    def gray(x: int) -> int:
        return x ^ (x >> 1)

    number = {gray(i): i for i in range(size)}

    def trailing_ones(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1

    def entry(w: int) -> int:
        return gray(2 * ((w - 1) // 2)) if w else 0

    def direction(w: int) -> int:
        if w == 0:
            return 0
        return trailing_ones(w - 1 if w % 2 == 0 else w) % dims

    digits, following = [], []
    for state in range(size * dims):
        corner, axis = divmod(state, dims)
        for cell in range(size):
            w = number[rotated(cell ^ corner, -(axis + 1))]
            digits.append(w)
            turned = corner ^ rotated(entry(w), axis + 1)
            following.append(turned * dims + (axis + direction(w) + 1) % dims)
    return digits, following


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index on the curve through the grid of ``2 ** bits`` cells per dimension."""
    dims = len(cells)
    digits, following = (F.array(*map(F.lit, x)) for x in curve_steps(dims))

    def octant(bit: Column) -> Column:
        parts = [
            F.call_function("shiftright", c, bit).bitwiseAND(1) * (1 << k)
            for k, c in enumerate(cells)
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))

    def step(acc: Column, bit: Column) -> Column:
        at = acc["state"] * (1 << dims) + octant(bit)
        return F.struct(
            (acc["index"] * (1 << dims) + F.get(digits, at)).alias("index"),
            F.get(following, at).alias("state"),
        )

    return F.aggregate(
        F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["index"]
    )


def text_cuts(df: DataFrame, column: str, cells: int) -> list[str]:
    """Texts that cut the rows into ``cells`` nearly equal parts, compared as whole texts.

    Distinct values are sorted by range and their counts summed up; of them only those that a cut
    falls on are collected, fewer than ``cells``.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).count()
    spread = counts.repartitionByRange("value").sortWithinPartitions("value")
    placed = written(spread.withColumn("_part", F.spark_partition_id()), "text-values")
    sizes = placed.groupBy("_part").agg(F.sum("count").alias("_rows"))
    before = sizes.select(  # one row per partition
        "_part",
        (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias("_total"),
    )
    upto = F.col("_before") + F.sum("count").over(Window.partitionBy("_part").orderBy("value"))
    share = placed.join(F.broadcast(before), "_part").withColumn("_upto", upto)
    passed = F.expr(f"(_upto * {cells}) div _total") > F.expr(f"((_upto - count) * {cells}) div _total")
    return sorted(r["value"] for r in share.where(passed & (F.col("_upto") < F.col("_total"))).collect())


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """The cell of each dimension; there are fewer than ``2 ** bits`` cut points for each."""
    kinds = dict(df.dtypes)
    numbers = [d for d in dims if kinds[d] != "string"]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(F.lit(0), *[
        F.percentile_approx(F.col(d).cast("double"), shares, QUANTILE_ACCURACY).alias(f"cuts_{i}")
        for i, d in enumerate(numbers)
    ]).first()[1:]
    cuts = dict(zip(numbers, found, strict=True))
    cells = []
    for d in dims:
        if d in cuts:
            value, points = F.col(d).cast("double"), sorted(set(cuts[d] or []))
        else:
            value, points = F.col(d), text_cuts(df, d, 1 << bits)
        cells.append(_cuts_below(points, value))
    return cells


def _cuts_below(points: list, value: Column) -> Column:
    if not points:
        return F.lit(0)
    below = F.filter(F.array(*map(F.lit, points)), lambda cut: cut < value)
    return F.when(value.isNull(), 0).otherwise(F.size(below))


def ranked(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Every row with its place in the order, without a window over all rows.

    A range partitioning sorts; each partition's rows are counted, and the counts before a
    partition are added to the place inside it.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(spread.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = counts.select(  # one row per partition
        "_part",
        (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias("_total"),
    )
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(
        "_rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    ).drop("_part", "_at", "_before")


def hilbert_shards(docs: DataFrame, dims: list[str], shards: int = 8, bits: int = 5) -> DataFrame:
    """``docs`` without text, with size, checksum, curve index, shard and slot in the shard.

    Row counts of shards differ by one at most.
    """
    clash = {"size", "text_crc32", "curve", "shard", "slot"}
    kept = [c for c in docs.columns if c not in clash and c != "text"]
    rows = docs.select(
        *kept,
        (F.octet_length(text_or_empty()).cast("long") + 1).alias("size"),
        F.crc32(F.to_binary(text_or_empty(), F.lit("utf-8"))).alias("text_crc32"),
    )
    rows = written(rows, "shard-rows")
    curve = rows.withColumn("curve", hilbert_index(quantised(rows, dims, bits), bits))
    placed = ranked(curve, ["curve", "doc_id", "text_crc32"], "shard-order")
    # shard s takes the ranks from s * rows / shards, rounded up, on
    return placed.withColumn("shard", F.expr(f"_rank * {shards} div _total").cast("int")).withColumn(
        "slot", F.col("_rank") - F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    ).drop("_rank", "_total")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """One folder of files per shard, rows in curve order; ``doc_id`` joins text to place."""
    text = docs.select("doc_id", "text")
    placed.join(text, "doc_id").repartition("shard").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
