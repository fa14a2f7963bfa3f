"""Exact deduplication, line deduplication and shards against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linewarden.llm import common, exact_dedup, hilbert, line_dedup, queries

DOCS = "doc_id long, text string, lang string, source string, group_size int, curve string, _part int"
ROWS = [
    (5, "a b", "en", "s", 1, "x", 1), (3, "ab", "en", "s", 1, "x", 1), (4, "a\tb ", None, "s", 1, "x", 1),
    (7, None, "en", None, 1, "x", 1), (8, "", "en", "s", 1, "x", 1), (9, " \n", "en", "s", None, "x", 1),
    (3, "ab", "en", "s", 1, "x", 1), (None, "ab", "en", "s", 1, "x", 1),
    (10, "ä b", "fr", "s", 1, "x", 1), (11, "äb", "fr", "s", 1, "x", 1),
    (12, "word " * 40_000, "fr", "t", 1, "x", 1), (13, "word" * 40_000, "fr", "t", 1, "x", 1),
]


def stored(spark, rows, schema=DOCS):
    path = common.new_path(spark, "test")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return path


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


@pytest.mark.parametrize("files", [None, 1])
def test_exact_dedup_matches_brute_force(spark, files):
    groups = defaultdict(list)
    for row in ROWS:
        groups[normal(row[1])].append(row)
    want = []
    for key, rows in groups.items():
        keep = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        digest = hashlib.sha256(key.encode()).hexdigest()
        want += [(r[0], keep, len(rows), r[0] == keep, digest) for r in rows]
    got = exact_dedup.dedup_table(spark, stored(spark, ROWS), files).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_state_goes_on_over_new_files(spark):
    path, state = stored(spark, ROWS[:2]), common.new_path(spark, "state")
    docs = spark.read.parquet(path)
    stream = spark.readStream.schema(docs.schema).parquet(path)
    exact_dedup.update_state(stream, state)
    spark.createDataFrame([(1, "a  b", "en", "s", 1, "x", 1)], DOCS).write.mode("append").parquet(path)
    stream = spark.readStream.schema(docs.schema).parquet(path)
    rows = exact_dedup.exact_dedup(spark.read.parquet(path), stream, state).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(1, 1, 3), (3, 1, 3), (5, 1, 3)}


def test_rows_of_one_digest_are_told_apart_by_their_bytes(spark):
    rows = spark.createDataFrame(
        [(1, 2, "x", "d"), (2, 2, "y", "d"), (3, 1, "x", "d"), (4, 1, "z", "e"), (5, 1, "z", "e")],
        "doc_id long, points int, norm string, text_sha256 string",
    ).withColumn("text_sha256", F.rpad("text_sha256", 64, "0"))
    state = rows.groupBy("text_sha256").agg(
        F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id")
    )
    mixed = exact_dedup.mixed_digests(rows, state)
    assert [r[0][0] for r in mixed.collect()] == ["d"]
    found = exact_dedup.resolved(rows, state, mixed).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == {
        (1, 1, 2), (3, 1, 2), (2, 2, 1), (4, 4, 2), (5, 4, 2)
    }


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.dedup_table(spark, stored(spark, [])).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    side = 1 << bits
    cells = [(F.col("id") / side**k).cast("long") % side for k in range(dims)]
    rows = spark.range(side**dims).select(
        F.array(cells).alias("cell"), hilbert.hilbert_index([c.cast("int") for c in cells], bits).alias("at")
    ).orderBy("at").collect()
    assert [r.at for r in rows] == list(range(side**dims))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(x - y) for x, y in zip(a.cell, b.cell)) == 1


def test_shards_have_equal_rows_and_gapless_slots(spark):
    docs = spark.createDataFrame(ROWS * 5, DOCS)
    rows = hilbert.hilbert_shards(docs, ["size", "lang", "source"]).collect()
    assert len(rows) == len(ROWS) * 5
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert set(shards) == set(range(8))
    counts = [len(s) for s in shards.values()]
    assert max(counts) - min(counts) <= 1
    order = []
    for shard in range(8):
        part = sorted(shards[shard], key=lambda r: r.slot)
        assert [r.slot for r in part] == list(range(len(part)))
        order += [r.curve for r in part]
    assert order == sorted(order)
    want = sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS * 5)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want


def test_shards_of_few_rows_and_of_none(spark):
    few = hilbert.hilbert_shards(spark.createDataFrame(ROWS[:3], DOCS), ["size", "lang"]).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3
    assert hilbert.hilbert_shards(spark.createDataFrame([], DOCS), ["size", "lang"]).count() == 0


def test_written_shards_can_be_pruned(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    placed, path = hilbert.hilbert_shards(docs, ["size", "lang"]), common.new_path(spark, "shards")
    hilbert.write_shards(docs, placed, path)
    back = spark.read.parquet(path)
    assert back.count() == docs.count()
    spans = back.groupBy("shard").agg(F.min("size").alias("a"), F.max("size").alias("b")).collect()
    largest = max(r.b for r in spans)
    assert any(r.b < largest / 2 for r in spans)  # a file of short documents alone


LINES = "doc_id long, text string, n_lines string, places int"


def chunks_by_hand(spark, rows):
    """Chunks of each text as the operator cuts them, and the whole brute-force removal."""
    cut = spark.createDataFrame(rows, LINES).select(
        "doc_id", "text", line_dedup.line_chunks(F.col("text")).alias("c")
    ).collect()
    seen, want = {}, []
    order = sorted(cut, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in order:
        if r.text is None:
            want.append((r.doc_id, None))
            continue
        lines, rest, own = r.text.split("\n"), [], {}
        assert [c.first for c in r.c] == [sum(x.lines for x in r.c[:k]) for k in range(len(r.c))]
        assert sum(c.lines for c in r.c) == len(lines)
        for c in r.c:
            part = lines[c.first:c.first + c.lines]
            key, holder = "\n".join(part), (r.doc_id, r.text)
            passage = any(len(x.split()) >= 50 for x in part)
            counts = passage or sum(any(ch.isalnum() for ch in x) for x in part) >= 2
            assert c.counts == counts and not (passage and len(part) > 1)
            if counts and (key in own or seen.get(key, holder) != holder):
                continue
            if counts:
                seen[key] = holder
                own[key] = True
            rest += part
        want.append((r.doc_id, "\n".join(rest)))
    return want


def test_repeated_passages_stay_once(spark):
    passage = "\n".join(f"this is line {i} of a passage that many share" for i in range(12))
    own = ["\n".join(f"document {d} has its own line {i}" for i in range(9)) for d in range(6)]
    rows = [(d, f"{own[d]}\n{passage}\nend {d}", "x", 1) for d in range(5)]
    rows += [(5, own[5], "x", 1), (6, None, "x", 1), (7, "", "x", 1), (8, "\n\n\n", "x", 1),
             (9, "\n\n\n", "x", 1), (2, rows[2][1], "x", 1), (None, passage, "x", 1),
             (10, passage + "\n" + passage, "x", 1), (11, "one long line " * 20_000, "x", 1),
             (12, f"own 12\n{'a b ' * 30}\nown line", "x", 1), (13, f"own 13\n{'a b ' * 30}\nline of 13", "x", 1)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, LINES)).collect()
    found = sorted(((r.doc_id, r.text) for r in got), key=str)
    assert found == sorted(chunks_by_hand(spark, rows), key=str)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].removed_lines == 0 and by_id[5].text == own[5]
    assert by_id[3].removed_lines >= 4 and own[3] in by_id[3].text  # own lines stay
    assert by_id[13].text == "own 13\nline of 13"  # a passage in one line
    assert by_id[6].text is None and by_id[6].removed_chunks == 0
    assert line_dedup.line_dedup(spark.createDataFrame([], LINES)).count() == 0


def test_chunks_of_one_hash_are_told_apart_by_their_bytes(spark):
    docs = spark.createDataFrame([(1, "a\nb", "", 0), (2, "c\nd", "", 0), (3, "a\nb", "", 0)], LINES)
    places = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.lit(0).alias("first"),
        F.lit(2).alias("lines"), F.lit(7).cast("long").alias("chunk_hash"),
        (F.col("doc_id") > 1).alias("later"),
    )
    found = line_dedup.compared(docs, places).collect()
    assert {(r.doc_id, r.later) for r in found} == {(1, False), (2, False), (3, True)}


def removed_by_hand(rows):
    """What stays when every line goes that lies in a pair of lines, or a long line, with an earlier place."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first, want = {}, {}
    for doc_id, text in rows:
        lines, gone = text.split("\n"), set()
        full = [i for i, x in enumerate(lines) if any(map(str.isalnum, x))]
        pairs = list(zip(full, full[1:])) + [(i, i) for i in full if len(lines[i].split()) >= 50]
        for a, b in pairs:
            place = first.setdefault(tuple(lines[a:b + 1]), (doc_id, a))
            if place != (doc_id, a):
                gone.update(range(a, b + 1))
        want[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return want


@pytest.mark.parametrize("length", [3, 4, 12])
def test_whole_passages_go(spark, length):
    rows, folder = [], common.new_path(spark, "test")
    for p in range(12):  # many passages, since cuts by a hash take some of them whole by chance
        shared = "\n".join(f"line {i} of passage {p} " + "word " * 26 for i in range(length))
        gaps = shared.replace("\n", "\n\n--\n")
        for d in range(3):
            rows.append((100 * p + d, f"own {p} {d} a\nown {p} {d} b\n{shared}\nown {p} {d} c\n{gaps}\n"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in queries.registered()["op6_line_dedup"](spark, folder).collect()}
    want = removed_by_hand(rows)
    for doc_id, text in rows:
        p, d = divmod(doc_id, 100)
        own = [f"own {p} {d} a", f"own {p} {d} b", f"own {p} {d} c", ""]
        assert want[doc_id] == (text if d == 0 else "\n".join(own))
        assert got[doc_id].text_sha256 == hashlib.sha256(want[doc_id].encode()).hexdigest()
        assert got[doc_id].removed_chunks == (0 if d == 0 else 2)
        assert got[doc_id].removed_lines == len(text.split("\n")) - len(want[doc_id].split("\n"))


def test_a_passage_stays_at_its_first_place(spark):
    rows = [(1, "a b\na b\na b\na b", "", 0), (2, "x 1\na b\na b\na b\ny 1", "", 0), (3, "k\nl\nm", "", 0),
            (4, "l\nm\nn", "", 0), (5, "n\nm\n", "", 0), (6, "k\nl\nm", "", 0), (6, "k\nl\nm", "", 0)]
    docs = spark.createDataFrame(rows, LINES)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, line_dedup.line_pairs).collect()}
    assert got == {1: "a b\na b", 2: "x 1\ny 1", 3: "k\nl\nm", 4: "n", 5: "n\nm\n", 6: ""}


def test_texts_that_begin_alike_lie_in_cells_of_their_own(spark):
    rows = [(i, "x", "en", f"https://example.org/{i % 40:02d}/", 1, "c", 1) for i in range(400)]
    docs = spark.createDataFrame([*rows, (401, "x", "en", None, 1, "c", 1)], DOCS)
    cuts = hilbert.text_cuts(docs, "source", 8)
    assert 6 <= len(cuts) <= 7 and cuts == sorted(cuts)
    cells = docs.select("source", hilbert.quantised(docs, ["source"], 3)[0].alias("cell")).collect()
    sizes = [sum(r.cell == c for r in cells) for c in range(8)]
    assert max(sizes) <= 70 and min(s for s in sizes if s) >= 40
    by_source = sorted({(r.source or "", r.cell) for r in cells})
    assert [c for _, c in by_source] == sorted(c for _, c in by_source)
