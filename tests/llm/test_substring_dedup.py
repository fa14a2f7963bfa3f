"""Removal of repeated windows against brute force, and the index's parts."""

import random
import re

import numpy as np
import pytest

from linewarden.llm import common, substring_dedup

DOCS = "doc_id long, text string, chunk int, spans string"


def brute_force(rows):
    """Results of (doc_id, text) rows that are in their order."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    first = {}
    gone = [set() for _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        for at in range(len(words[i]) - 19):
            window = tuple(words[i][at:at + 20])
            if first.setdefault(window, (i, at)) != (i, at):
                gone[i].update(range(at, at + 20))
    return sorted((
        (rows[i][0], len(words[i]), len(gone[i]), " ".join(w for n, w in enumerate(words[i]) if n not in gone[i]))
        for i in range(len(rows))
    ), key=str)


def check(spark, rows, parts=1):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)
    if parts > 1:
        frame = frame.repartition(parts, "doc_id")
    found = [tuple(r) for r in substring_dedup.substring_dedup(frame).collect()]
    assert sorted(found, key=str) == brute_force(rows)


def some_rows(seed, vocabulary, n=120):
    dice = random.Random(seed)
    names = [f"w{i}é" for i in range(vocabulary)]
    passages = [dice.choices(names, k=dice.choice([19, 20, 21, 45, 130])) for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(dice.randint(0, 5)):
            words += dice.choices(names, k=dice.randint(0, 30))
            words += dice.choice(passages)
        rows.append((i, dice.choice([" ", "\n", " \t "]).join(words)))
    dice.shuffle(rows)
    return rows


ODD = [
    (300, None), (301, ""), (302, " \n "), (303, "short text"), (304, "same " * 500), (305, "same " * 19),
    (306, " ".join("abc") + " " + " ".join(map(str, range(40)))), (307, " ".join(map(str, range(40)))),
    (None, " ".join(map(str, range(10, 35)))), (304, "other " * 50), (308, "a b " * 200), (308, "a b " * 200),
    (-5, "a b " * 11), (309, "\x0b\x0c".join(f"{i}\x85" for i in range(40))), (310, "w " * 20), (310, "w " * 20),
]


@pytest.mark.parametrize("seed, vocabulary", [(1, 500), (2, 2), (3, 5)])
def test_windows_equal_brute_force(spark, seed, vocabulary):
    check(spark, some_rows(seed, vocabulary) + ODD)


@pytest.mark.parametrize("name, value", [
    ("HOT", 3), ("CHUNK_ROWS", 4), ("CHUNK_BYTES", 500), ("COMBINED", 5), ("CORE", 19),
])
def test_bounds_do_not_change_the_result(spark, monkeypatch, name, value):
    monkeypatch.setattr(substring_dedup, name, value)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 50_000)
    check(spark, some_rows(4, 300) + ODD)


def test_documents(spark, sf_dir):
    rows = common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in rows], 5)


def test_empty_table(spark):
    check(spark, [])
    check(spark, [(1, None)])


def test_rank_and_statistics():
    dice = np.random.default_rng(2)
    symbols = dice.integers(0, 37, 3000)
    matrix = substring_dedup.WaveletMatrix(symbols, 37)
    of, at = dice.integers(0, 37, 500), dice.integers(0, 3001, 500)
    assert matrix.rank(of, at).tolist() == [int((symbols[:i] == s).sum()) for s, i in zip(of, at)]
    text = np.append(dice.integers(1, 4, 400), 0)
    index = substring_dedup.FMIndex(text, 4)
    starts = np.arange(len(text) - 20)
    found, _, _, _ = index.matches(starts, np.ones(len(text), np.int64))
    said = bytes(text.tolist())
    for start, length in zip(starts, found):
        end = start + 20
        longest = max((n for n in range(1, 21) if said.find(
            said[end - n:end], said.find(said[end - n:end]) + 1) >= 0), default=0)
        assert length == longest
