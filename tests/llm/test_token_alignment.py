"""Token alignment against a plain computation per document, and its hash."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewarden.llm import common, queries, token_alignment

ODD = [
    None, "", " ", "  ", "a  b", " lead", "trail ", "\n", "\n x\n\n y", "tab\t\tend\n", "a▁b", "日本語 テスト 😀😀",
    "x\x1c\x1dy \x0b\x0c z", "<|endoftext|> <s> </s> <0x41>", "a" * 3000, "é ́x", "'s don't 're", "12345 6 ٣٤",
    "word " * 3000 + "end", "Ünï code space", "def f(x):\n    return x\n", "a\x00b", "ﬁ ｆ", "﻿x y", "▁",
]
DOCS = "doc_id long, text string, pair long, n string"


@pytest.fixture(scope="module")
def vocabularies():
    return token_alignment.read_vocabularies(
        f"{queries.TOKENIZERS}/{queries.BYTE_LEVEL}", f"{queries.TOKENIZERS}/{queries.PIECES}"
    )


def brute_force(rows, vocabularies):
    """Results of plain (doc_id, text) rows, token by token."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_str(vocabularies.byte_level)
    a_side.encode_special_tokens = True
    b_side = SentencePieceProcessor(model_proto=vocabularies.pieces)
    groups_of, counts = [], Counter()
    for _, text in rows:
        raw = b" " + (text or "").encode()
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        sides = [[vocabularies.tokens_a[i] for i in a], [vocabularies.tokens_b[i] for i in b]]
        groups = []
        if text and all(b"".join(side) == raw for side in sides):
            ends = []
            for side in sides:
                at = [0]
                for token in side:
                    at.append(at[-1] + len(token))
                ends.append(at[1:])
            common_ends = sorted(set(ends[0]) & set(ends[1]))
            low = [0, 0]
            for end in common_ends:
                high = [ends[0].index(end, low[0]) + 1, ends[1].index(end, low[1]) + 1]
                groups.append((a[low[0]:high[0]], b[low[1]:high[1]]))
                low = high
        groups_of.append(groups)
        counts.update((x[-1], y[-1]) for x, y in groups)
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    found = []
    for (doc_id, _), groups in zip(rows, groups_of):
        links = [(x[-1], y[-1]) for x, y in groups]
        said = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        found.append((
            doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(said.encode()).hexdigest() if said else "",
        ))
    return sorted(found, key=str)


def check(spark, rows, vocabularies, parts=3):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(parts)
    found = [tuple(r) for r in token_alignment.align_corpus(frame, vocabularies).collect()]
    assert sorted(found, key=str) == brute_force(rows, vocabularies)


def test_odd_texts(spark, vocabularies, monkeypatch):
    rows = [*enumerate(ODD), (None, "x y"), (4, "a  b"), (4, "a b"), (4, "a b")]
    check(spark, rows, vocabularies)
    monkeypatch.setattr(token_alignment, "AT_ONCE", 50)
    check(spark, rows, vocabularies, 1)


def test_documents(spark, sf_dir, vocabularies, monkeypatch):
    monkeypatch.setattr(token_alignment, "SHARD_PAIRS", 500)
    monkeypatch.setattr(token_alignment, "BLOCK", 128)
    docs = common.table(spark, sf_dir, "documents").where(F.length("text") < 20_000).select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()], vocabularies)


def test_empty_table(spark, vocabularies):
    check(spark, [], vocabularies)
    check(spark, [(1, None)], vocabularies)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).choice(2**48, n, replace=False).astype(np.int64)
    shards = token_alignment.shard_of(keys, 3)
    index = token_alignment.PairHash.of_shards([token_alignment.displacements(keys[shards == s]) for s in range(3)])
    at = index(keys)
    assert sorted(at.tolist()) == list(range(n))
    assert (index(keys + 2**50) == -1).all()


def test_bound_on_pairs_holds(vocabularies):
    bound = token_alignment.pair_bound(vocabularies.tokens_a, vocabularies.tokens_b)
    assert bound < token_alignment.MOST_PAIRS / 4
    assert token_alignment.pair_bound([b"ab", b"b"], [b"b", b"ab", b"xab", b"b"]) == 8


def test_units_that_come_again_are_encoded_once(vocabularies, monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 4)
    encoder, learned = token_alignment.Encoder(vocabularies), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda units, *more: (learned.extend(units), learn(units, *more)))
    texts = ["often one two", "often three four five", "often one six", "often seven\neight"]
    for text in texts:
        encoder.block([1], [text])
    assert learned.count("often") == 1 and learned.count("one") == 2


def test_joined_units_have_the_ids_of_single_ones(vocabularies, monkeypatch):
    monkeypatch.setattr(token_alignment, "JOINED", 4)
    units = [u for text in ODD if text for u in text.replace("\n", " ").split(" ") if u]
    encoder = token_alignment.Encoder(vocabularies)
    for some in (units, units[:1], units[1:3], ["a▁b", "c"]):
        names, whole, sides = encoder.joined(some)
        whole_alone, sides_alone = encoder.units(names)
        assert sorted(names) == sorted(some) and whole.tolist() == whole_alone.tolist()
        for joined, alone in zip(sides, sides_alone):
            assert [x.tolist() for x in joined] == [x.tolist() for x in alone]
