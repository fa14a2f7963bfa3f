"""Language identification by a blended-spectrum presence kernel.

A text is the set of its character n-grams of several orders, each order in a hashed table of fixed
size.  The kernel of two texts is the mean over the orders of ``|A & B| / sqrt(|A| |B|)``.  Nyström
landmarks turn it into features, ridge regression fits one output per language against the rest,
and landmarks, whitening and weights multiply to one matrix, so that a batch of texts is scored by
one matrix product with its presence rows.

Learning takes at most ``TRAINING_ROWS`` labelled rows, the same number of each language as far as
there are any, chosen by a hash of the id; prediction takes every text whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text
if nothing can be learnt; a row without id is not held out and not learnt from; repeated rows are
scored each; equal outputs go to the language that sorts first; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Labelled rows that a model learns from, at most; the first of them are the landmarks.
TRAINING_ROWS = 2400
LANDMARKS = 240
#: Parts that a language's labelled rows are drawn from.
SAMPLE_PARTS = 48
RIDGE = 1e-2
#: Orders of the n-grams, and cells of the table of each order.
ORDERS = (1, 2, 3)
CELLS = 1 << 14
#: Texts of one matrix product, and characters whose n-grams are found at once.
BATCH = 64
WINDOW = 1 << 20
UNKNOWN = "und"

_NO_LETTER = re.compile(r"[\W\d_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def presence(text: str) -> np.ndarray:
    """Flags of the n-grams of a text, the table of each order after the other.

    Letters are lower-cased; all that is no letter counts as one space.
    """
    flags = np.zeros(len(ORDERS) * CELLS, bool)
    letters = f" {_NO_LETTER.sub(' ', text.lower()).strip()} "
    if letters == "  ":
        return flags
    for start in range(0, len(letters), WINDOW):
        part = letters[start:start + WINDOW + max(ORDERS) - 1]
        codes = np.frombuffer(part.encode("utf-32-le"), "<u4").astype(np.uint64)
        mixed = np.zeros(len(codes), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            n = len(codes) - order + 1
            if n < 1:
                break
            mixed = (mixed[:n] + codes[order - 1:order - 1 + n] + np.uint64(1)) * _PRIME
            if order in ORDERS:
                cell = (mixed >> np.uint64(40)) % np.uint64(CELLS)
                flags[cell.astype(np.intp) + ORDERS.index(order) * CELLS] = True
    return flags


def kernel_rows(flags: np.ndarray) -> np.ndarray:
    """Rows whose products are the kernel."""
    rows = flags.astype(np.float32).reshape(len(flags), len(ORDERS), CELLS)
    counts = np.maximum(rows.sum(2, keepdims=True), 1)
    return (rows / np.sqrt(counts * len(ORDERS))).reshape(len(flags), -1)


@dataclass
class Model:
    """Languages, and the matrix that takes kernel rows to their outputs."""

    languages: list[str]
    weights: np.ndarray

    def outputs(self, flags: np.ndarray) -> np.ndarray:
        return kernel_rows(flags) @ self.weights


def fit(packed: list[bytes], labels: list[str]) -> Model:
    """Nyström features on the first rows, then one-versus-rest kernel ridge regression."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((len(ORDERS) * CELLS, 0), np.float32))

    def rows(some: list[bytes]) -> np.ndarray:
        return kernel_rows(np.stack([np.unpackbits(np.frombuffer(p, "u1")) for p in some]) > 0)

    landmarks = rows(packed[:LANDMARKS])
    to_landmarks = np.concatenate(
        [rows(packed[i:i + BATCH]) @ landmarks.T for i in range(0, len(packed), BATCH)]
    ).astype(np.float64)
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    kept = values > 1e-6 * values.max(initial=1e-6)
    whitening = vectors[:, kept] / np.sqrt(values[kept])
    features = to_landmarks @ whitening
    targets = np.where(np.asarray(labels)[:, None] == np.asarray(languages), 1.0, -1.0)
    # each language weighs the same, however many rows it has
    weight = (1 / np.maximum((targets > 0).sum(0), 1))[np.argmax(targets, 1)]
    weight = (weight / weight.mean())[:, None]
    ridge = RIDGE * len(labels) * np.eye(features.shape[1])
    solved = np.linalg.solve(features.T @ (weight * features) + ridge,
                             features.T @ (weight * targets))
    return Model(languages, (landmarks.T @ (whitening @ solved)).astype(np.float32))


def fold(doc_id: Column) -> Column:
    """Remainder by 3 of the CRC-32 of the id as text; remainder 1 is held out."""
    return F.crc32(F.to_binary(doc_id.cast("string"), F.lit("utf-8"))) % 3


def training_sample(docs: DataFrame) -> DataFrame:
    """Ids and languages of the rows to learn from: no more than ``TRAINING_ROWS``.

    A language's rows are drawn in parts by a hash of the id, an equal number from each part, so
    that no task ranks a whole language.
    """
    labelled = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 1)
    ).select("doc_id", "lang", F.xxhash64("text").alias("same"), F.xxhash64("doc_id").alias("draw"))
    part = F.pmod("draw", F.lit(SAMPLE_PARTS))
    in_part = Window.partitionBy("lang", part).orderBy("draw", "doc_id", "same")
    drawn = labelled.withColumn("in_part", F.row_number().over(in_part)).where(
        F.col("in_part") <= TRAINING_ROWS // SAMPLE_PARTS
    )
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", "same")
    return drawn.withColumn("turn", F.row_number().over(first)).orderBy("turn", "lang").limit(
        TRAINING_ROWS
    )


def _packed_presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags = [np.packbits(presence(t)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("turn"), batch.column("lang"), pa.array(flags, pa.binary())],
            names=["turn", "lang", "flags"],
        )


def learn(docs: DataFrame) -> Model:
    """A model of the labelled rows of ``docs`` that are not held out."""
    # a row may be drawn as often as it is repeated, but is learnt from once
    key = ["doc_id", "lang", "same"]
    chosen = training_sample(docs).groupBy(*key).agg(F.min("turn").alias("turn"))
    # at most TRAINING_ROWS keys, so the join may broadcast them
    texts = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "lang", "text", F.xxhash64("text").alias("same")
    ).join(F.broadcast(chosen), key)
    once = texts.groupBy("turn", "lang", "doc_id", "same").agg(F.min("text").alias("text"))
    rows = once.select("turn", "lang", "text").mapInArrow(
        _packed_presence, "turn int, lang string, flags binary"
    ).collect()
    rows.sort(key=lambda r: (r["turn"], r["lang"], r["flags"]))
    return fit([bytes(r["flags"]) for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, lettered: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    ``lettered`` names one more column: whether the text has a letter, also if nothing was learnt.
    """
    kept = docs.drop("lang_pred", "score", *([lettered] if lettered else []))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))
    names = kept.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            found = [(UNKNOWN, 0.0)] * batch.num_rows
            texts = batch.column("text").to_pylist()
            letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            asked = [i for i, has in enumerate(letters) if model.languages and has]
            for start in range(0, len(asked), BATCH):
                some = asked[start:start + BATCH]
                outputs = model.outputs(np.stack([presence(texts[i]) for i in some]))
                best = outputs.argmax(1)
                for i, b, row in zip(some, best, outputs, strict=True):
                    found[i] = (model.languages[b], float(np.clip((1 + row[b]) / 2, 0, 1)))
            pred, score = zip(*found) if found else ((), ())
            more = [pa.array(letters, pa.bool_())] if lettered else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), *more],
                names=[*names, "lang_pred", "score", *([lettered] if lettered else [])],
            )

    schema = StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double")
    if lettered:
        schema = schema.add(lettered, "boolean")
    return kept.mapInArrow(scored, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Per document: whether its id is held out, and its language as learnt from the others."""
    model = learn(docs)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "lang_pred", "score",
    )
