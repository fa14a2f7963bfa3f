"""Top-k search, the n-gram join and archives against brute force."""

import base64
import hashlib
import io
import random
import zipfile
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewarden.llm import common, ngram_join, topk, warc_zip

VECTORS = "vec_id long, embedding array<double>, rank int, score string"


def best_by_hand(rows, k):
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in {i: v for i, v in usable if i % 50 == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(a) == len(b))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(want)


@pytest.mark.parametrize("blocks", [None, (3, 16, 8)])
def test_top_k_matches_brute_force(spark, monkeypatch, blocks):
    if blocks:
        for name, n in zip(("QUERY_BLOCK", "VECTOR_BLOCK", "SLICE"), blocks):
            monkeypatch.setattr(topk, name, n)
    draw = random.Random(2)
    rows = [(i, [draw.gauss(0, 1) for _ in range(40)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 40), (404, [float("inf")] * 40),
             (450, [1.0, 2.0]), (451, [3.0, -4.0]), (452, [5.0, 6.0]), (None, rows[0][1]), (500, [1e5] * 40)]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    got = sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()))
    assert got == best_by_hand(rows, 5)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_exclude_pairs():
    draw = np.random.default_rng(1)
    # vectors of few shapes, as segments tell them apart
    shapes = np.repeat(draw.normal(size=(8, 8)) * 300, 8, 1)
    x = np.floor(shapes[draw.integers(0, 8, 4000)] + draw.normal(size=(4000, 64)) * 10).astype(np.int64)
    ids = np.arange(4000)
    _, found, scores, computed = topk.block_top(ids[:20], x[:20], ids, x, 5)
    want = []
    for q in range(20):
        s = x @ x[q]
        s[q] = np.iinfo(np.int64).min
        want += [s[j] for j in np.lexsort((ids, ~s))[:5]]
    assert scores.tolist() == want
    assert computed < 0.75 * 20 * 4000


def test_products_beyond_exact_floats():
    x = np.array([[2**40, 3], [2**40 + 1, 1], [2**20, 2**40 + 7], [5, 2**40]], np.int64)
    ids = np.arange(4)
    _, found, scores, _ = topk.block_top(ids[:1], x[:1], ids, x // 2**10, 2)
    assert scores.tolist() == sorted((int(v) for v in (x // 2**10 @ x[0])[1:]), reverse=True)[:2]


DOCS = "doc_id long, text string, n_shingles string, component string"


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def components_by_hand(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common_ = len(a & sets[j])
            if common_ and 100 * common_ >= percent * (len(a) + len(sets[j]) - common_):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)].append(doc)
    return sorted(
        ((doc, len(sets[i]), min(least[root(i)], default=None)) for i, (doc, _) in enumerate(rows)), key=str
    )


def corpus(seed, n=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        base = draw.choices(vocabulary, k=draw.choice([2, 3, 4, 5, 8, 40, 120]))
        for _ in range(draw.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(words) // 25))):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    shared = " ".join(draw.choices(vocabulary, k=30))  # a passage in many documents
    rows += [(1000 + i, shared + " " + " ".join(draw.choices(vocabulary, k=draw.randint(1, 12)))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "A b\x0bC d"), (2004, "a B c\td"), (None, "a b c d"),
             (2005, "a b c"), (2006, "a b c"), (5, rows[5][1]), (2007, "long " * 30_000), (2008, "é b c d e")]
    return rows


@pytest.mark.parametrize(("seed", "words", "percent", "part"), [(1, 4, 85, 512), (2, 5, 80, 7), (3, 2, 50, 16)])
def test_components_match_brute_force(spark, monkeypatch, seed, words, percent, part):
    monkeypatch.setattr(ngram_join, "PART", part)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    got = ngram_join.near_duplicates(docs, words, percent).collect()
    assert sorted(map(tuple, got), key=str) == components_by_hand(rows, words, percent)


def test_join_of_nothing_and_of_single_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "", ""), (2, None, "", "")], DOCS)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == [(1, 1, 1), (2, 0, 2)]
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_trees_lose_no_pair(seed):
    draw = random.Random(seed)
    rows, sets = [], {}
    for i in range(150):
        base = sets[draw.randrange(i)] if i and draw.random() < 0.5 else frozenset()
        one = frozenset(x for x in base if draw.random() < 0.97) | frozenset(
            draw.randrange(1 << 40) for _ in range(0 if len(base) > 5 else draw.randint(1, 300)))
        sets[i] = one
        hashes = np.array(sorted(one), np.uint64)
        rows.append((i, len(one), ngram_join.bitmap(hashes), draw.randrange(40)))
    tree = ngram_join.signature_tree(rows)
    found = list(ngram_join.tree_pairs(tree, tree, 80))
    assert len(found) == len(set(found))
    for x, _, _, in_x in rows:
        for y, _, _, in_y in rows[:x]:
            common_ = len(sets[x] & sets[y])
            if in_x != in_y and 100 * common_ >= 80 * len(sets[x] | sets[y]):
                assert (y, x) in found
    assert len(found) < 0.2 * 150 * 149 / 2


def test_long_chains_are_one_component(spark):
    names = [f"{i:04d}".encode() for i in range(300)]
    draw = random.Random(1)
    links = list(zip(names, names[1:])) + [(b"x", b"y")]
    draw.shuffle(links)
    rows = ngram_join.components(spark.createDataFrame(
        [(b, a) if draw.random() < 0.5 else (a, b) for a, b in links], "a binary, b binary"
    )).collect()
    got = {bytes(r["class"]): bytes(r["component"]) for r in rows}
    assert got == {**{n: b"0000" for n in names}, b"x": b"x", b"y": b"x"}


PAGES = "page_id long, url string, html string, payload string, digest int"


def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>é page {i % 7}", "x", 1) for i in range(40)]
    rows += [(50, None, None, "x", 1), (51, "a b\r\nX: y", "", "x", 1), (None, "u", "<p>é page 3", "x", 1),
             (3, "http://h/3", "<p>é page 3", "x", 1), (60, "u", "x" * 300_000 + "\r\n\r\n", "x", 1)]
    return rows, spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize("least", [0, 1, 10**6])
def test_archives_give_back_every_page(spark, monkeypatch, least):
    monkeypatch.setattr(warc_zip, "ARCHIVE_BYTES", 500)
    rows, table = pages(spark)
    first = {}
    for i, _, html, *_ in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, url, html, *_ in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        other = first[html or ""]
        revisit = i is not None and other != i and len(raw) >= least
        want.append((i, len(raw), digest, "revisit" if revisit else "response", other if revisit else None,
                     None if revisit else raw))
    archives = warc_zip.write_archives(table, common.new_path(spark, "warc"), least)
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    got = warc_zip.read_records(archives).collect()
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
              None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert {r.url for r in got if r.page_id == 51} == {"a%20b%0D%0AX:%20y"}


def test_archive_is_a_plain_zip_of_plain_gzip(spark):
    import gzip

    rows, table = pages(spark)
    archives = warc_zip.write_archives(table.where("page_id < 30"), common.new_path(spark, "warc"))
    for r in archives.collect():
        with zipfile.ZipFile(r.path.removeprefix("file://")) as archive:
            assert archive.testzip() is None
            assert gzip.decompress(archive.read(warc_zip.DATA)).count(b"WARC/1.1\r\n") == r.records


def test_no_pages_no_archives(spark):
    _, table = pages(spark)
    assert warc_zip.archive_and_read(table.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [None, 3])
def test_directory_with_and_without_zip64(monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.comment = b"PK not an end"
        for i in range(5):
            with archive.open(zipfile.ZipInfo(f"é{i}.warc"), "w", force_zip64=limit is not None or i % 2 == 0) as file:
                file.write(bytes([i]) * (i + 2))
        packed = zipfile.ZipInfo("packed")
        packed.compress_type = zipfile.ZIP_DEFLATED
        archive.writestr(packed, b"x" * 100)
    members = warc_zip.central_directory(out, len(out.getvalue()))
    assert [m.name for m in members] == [*(f"é{i}.warc" for i in range(5)), "packed"]
    for i, m in enumerate(members[:5]):
        at = warc_zip.data_offset(out, m)
        assert out.getvalue()[at:at + m.size] == bytes([i]) * (i + 2)
    with pytest.raises(ValueError, match="not stored"):
        warc_zip.data_offset(out, members[5])
    with pytest.raises(ValueError, match="no end"):
        warc_zip.central_directory(io.BytesIO(b"nothing"), 7)


def test_memory_is_given_back_after_the_last_row(monkeypatch):
    freed = []

    class Pool:
        def release_unused(self):
            freed.append(True)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    rows = common.released(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert (next(rows), next(rows), freed) == (2, 4, [])
    assert list(rows) == [] and freed == [True]
