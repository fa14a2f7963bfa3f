"""Language identification, tokenizing, packing and extraction against brute force."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewarden.llm import bpe, common, language, main_text, packing, queries

TOKENIZERS = queries.TOKENIZERS
DOCS = "doc_id long, text string, lang string, score int, length int"
ODD = [
    None, "", " ", "a  b", "\x1c\x85 x  y", "'s don't\n\n  x\n", "日本語 テスト 😀😀", "a" * 300,
    "x\x1c\x1dy \x0b\x0c z", "tab\t\tend \n", " lead", "12345 6 ٣٤", "é ñ   q", "<|endoftext|> a",
    "word " * 30_000, "Ünïcode space", "12 !! ..", "İstanbul ΣΑΣ", "é ́x",
]


def odd_docs(spark):
    rows = [(i, t, "en", 1, 2) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None, "x", None, None, None)], DOCS)


def test_language_of_held_out_rows(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    rows = language.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 30
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows} == {
        r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1
    }


def test_language_of_odd_rows(spark, sf_dir):
    model = language.learn(common.table(spark, sf_dir, "documents"))
    rows = language.predict(odd_docs(spark), model).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters)
        assert r.score == 0 or letters
    nothing = odd_docs(spark).where("lang is null")
    assert {r.lang_pred for r in language.identify(nothing).collect()} == {"und"}
    assert language.identify(odd_docs(spark).limit(0)).count() == 0


def test_held_out_labels_and_other_columns_are_not_learnt(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").drop("source", "n_chars")
    wrong = docs.withColumn("lang", F.when(language.fold(F.col("doc_id")) == 1, "xx").otherwise(F.col("lang")))
    a, b = (
        {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in language.identify(d).collect()} for d in (docs, wrong)
    )
    assert a == b


def test_presence_does_not_depend_on_the_window(monkeypatch):
    text = " ".join(random.Random(1).choices(["der", "und", "le", "la", "ções"], k=400))
    whole = language.presence(text)
    monkeypatch.setattr(language, "WINDOW", 100)
    assert (language.presence(text) == whole).all()


def test_byte_bpe_equals_tiktoken_and_decodes_to_the_text(spark, sf_dir):
    import tiktoken

    ranks = bpe.read_ranks(f"{TOKENIZERS}/{queries.BYTE_BPE}")
    other = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = common.table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select("doc_id", "text")
    docs = odd_docs(spark).select(F.col("doc_id") + 10**6, "text").union(some).toDF("doc_id", "text")
    rows = bpe.encode_and_decode(docs, ranks, queries.PATTERN).join(docs.distinct(), "doc_id", "left").collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            continue
        ids = other.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode_and_decode(docs.limit(0), ranks, queries.PATTERN).count() == 0


@pytest.mark.parametrize("drawn", [10**6, 0])
def test_words_of_many_blocks_are_encoded_once(spark, monkeypatch, drawn):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b" ab": 257}
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20)
    monkeypatch.setattr(bpe, "DRAWN_BYTES", drawn)
    lists, coded_words = [], bpe.coded_words

    def counted(words, literals):
        lists.append(words.select(F.explode("words")).count())
        return coded_words(words, literals)

    monkeypatch.setattr(bpe, "coded_words", counted)
    texts = ["abc abd", "abc abc", "", None, "abd", "ab ab"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = bpe.encode_and_decode(docs, ranks, queries.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in rows} == {i: t or "" for i, t in enumerate(texts)}
    assert {r.n_tokens for r in rows if texts[r.doc_id] == "abc abd"} == {4}
    first, blocks = lists
    assert (first, blocks) == (4, 0) if drawn else first == 0 and blocks > 4


def test_fold_joins_the_first_pair_of_the_lowest_rank(spark):
    rng = random.Random(5)
    pieces = [bytes(p) for n in (2, 3, 4) for p in itertools.product(b"ab", repeat=n)]
    rng.shuffle(pieces)  # ranks that do not grow with length, and pairs of one rank that overlap
    ranks = {bytes([b]): b for b in range(256)} | {p: 256 + i for i, p in enumerate(pieces[:20])}
    words = [bytes(rng.choices(b"abc", (5, 5, 1), k=rng.randrange(1, 40))) for _ in range(300)]
    words += [b"a" * 3000, bytes(range(256))]
    rank_map, texts, layout = bpe.rank_literal(spark, ranks)
    assert layout.place_bits >= 20 and max(ranks.values()) < layout.id_mask
    lists = spark.createDataFrame([([list(w) for w in words],)], "words array<array<long>>")
    row = bpe.coded_words(lists, (rank_map, texts, layout)).first()

    def by_hand(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            at = min(found)[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    assert row.ids == list(map(by_hand, words)) and list(map(bytes, row.decoded)) == words
    with pytest.raises(ValueError, match="bits"):
        bpe.Layout.of({b"a": 1 << 25})


def test_pattern_is_that_of_the_vocabularies():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    assert queries.PATTERN == public_tokenizers.PATTERN


def check_bins(rows, capacity):
    bins = defaultdict(list)
    for offset, length, bin_ in rows:
        bins[bin_].append((offset, length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_equals_the_tokenizer_and_is_gapless(spark, sf_dir):
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/{queries.WORD_BPE}"
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text").union(
        odd_docs(spark).where("doc_id is not null").select(F.col("doc_id") + 10**6, "text").distinct()
    )
    rows = packing.pack(docs, path).collect()
    tokenizer = Tokenizer.from_file(path)
    want = {}
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start:start + 2048]
            want[r.doc_id, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    used = check_bins([(r.offset, r.length, r.sequence_id) for r in rows], 2048)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(docs.limit(0), path).count() == 0


def fewest_bins(lengths, capacity):
    """Best-fit decreasing, item by item."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_piece_once(seed):
    draw = random.Random(seed)
    capacity = draw.choice([1, 7, 60, 300])
    lengths = [draw.randint(1, capacity) if draw.random() < 0.6 else 1 + capacity // draw.randint(1, 6) % capacity
               for _ in range(draw.randint(1, 400))]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    plan = sorted(packing.packing_plan(counts, capacity))
    placed, large = [], defaultdict(int)
    for i, (length, rank, bin_, per_bin, offset) in enumerate(plan):
        following = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == length else counts[length]
        for r in range(rank, following):
            full, rest = divmod(r - rank, per_bin)
            placed.append((offset + rest * length, length, bin_ + full))
            large[bin_ + full] += 3 * length > capacity
    assert sorted(n for _, n, _ in placed) == sorted(lengths)
    assert max(large.values()) <= 2
    assert check_bins(placed, capacity) <= 1.1 * fewest_bins(lengths, capacity) + 1


def test_equal_and_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "a b", "", 0, 0)] * 700 + [(2, "x " * 1500, "", 0, 0)] * 9, DOCS)
    rows = packing.packed(
        packing.token_pieces(docs, f"{TOKENIZERS}/{queries.WORD_BPE}", 2048, with_ids=False), 2048
    ).collect()
    assert len(rows) == 709
    assert check_bins([(r.offset, r.length, r.sequence_id) for r in rows], 2048) == 9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home, sweet, home</a></ul></nav>
<div class="sidebar">Read, more, of, this, and, that, and, more, and, more, still.</div>
<div class="cookie-notice">We use cookies, and, more, cookies, and, more, still, cookies.</div>
<article><h1>Fish &amp; chips</h1><p><b>One,  two<br>three.<p>Four &lt; five, and
 so on&nbsp;here.</p><ul><li><a href=a>x</a><li><a href=b>y</a></ul><form><input>Name</form>
<!-- no --><aside>aside</aside><div class="comments"><p>Nice, very, nice, article, indeed.</p></div>
</article><footer>&copy; all, rights, reserved</footer></body></html>"""


WORDS = ("Words, and more words, follow here, one after the other, until the line ends. " * 2).strip()
RUN = f"<p>{WORDS}</p>"


def test_page_is_cut_to_its_article():
    assert main_text.main_text(PAGE) == "Fish & chips\n\nOne, two three.\n\nFour < five, and so on here."


def test_parts_are_told_by_their_names():
    page = f"""<div class="has-sidebar"><div class="page-header">Site, of, all</div><div id="post">
    <div class="post-header"><h1>Title</h1></div><p>{"Text, and more. " * 9}</p></div>
    <div id="siteNav">a, b, c</div><div class="comment-list"><p>{"Nice, very nice. " * 9}</p></div></div>"""
    assert main_text.main_text(page) == "Title\n\n" + ("Text, and more. " * 9).strip()


def test_best_container_and_its_siblings_stay():
    run = "Words, and more words, follow here, one after the other, until the line ends. " * 2
    page = f"""<body><div id="top"><a href=1>one</a> <a href=2>two</a></div>
    <div><div class="post"><p>{run}</p><p>{run}</p></div><p>{run}</p><p>{run}</p>
    <div><a href=3>three links and</a> <a href=4>more of them</a></div></div></body>"""
    text = main_text.main_text(page).split("\n\n")
    assert text == [" ".join(run.split())] * 4


@pytest.mark.parametrize(("page", "want"), [
    (f"<div id=post><h1>Title</h1><div class=body>{RUN * 3}</div><p>Short end.</p></div>", ["Title", *3 * [WORDS], "Short end."]),
    (f"<div id=post><section>{RUN * 5}</section><section><h2>Note</h2><p>One short sentence, here.</p></section></div>",
     [*5 * [WORDS], "Note", "One short sentence, here."]),
    (f"<h1>Title</h1><div><div><div>{RUN * 4}</div></div><h3>Part</h3>bare <b>text</b><div>{RUN}</div></div>",
     ["Title", *4 * [WORDS], "Part", "bare text", WORDS]),
    (f"<a href=a>Home</a> | <a href=b>News</a><div><p><a href=a>one</a> <a href=b>two</a></p><h1><a href=c>A</a> <a href=d>B</a></h1>"
     f"<div>{RUN * 2}</div><p>See <a href=c>this</a>.</p><div class=comments><p>No.</p></div></div>", ["A B", WORDS, WORDS, "See this."]),
])
def test_short_parts_around_the_best_container_stay(page, want):
    assert main_text.main_text(f"<body>{page}</body>").split("\n\n") == want


NOTES = "<div><p>Copyright 2020 Acme. All rights reserved. Terms apply.</p></div><div>We use data files; click OK to accept.</div>"


@pytest.mark.parametrize(("page", "want"), [
    (f"<div>{RUN * 4}</div>{NOTES}", 4 * [WORDS]),
    (f"<div id=wrap><div>{RUN * 4}</div>{NOTES}</div>", 4 * [WORDS]),
    (f"<main><article><h2>One</h2><p>Short, first.</p></article><article><h2>Two</h2>{RUN * 3}</article></main>",
     ["One", "Short, first.", "Two", *3 * [WORDS]]),
    (f"<main><h1>All</h1>{RUN * 2}</main><article>Other, thing.</article>", ["All", *2 * [WORDS]]),
    (f"<article>{RUN * 2}<p class='ad-hoc note'>Kept, too.</p><h2 id=skip-the-line>Head</h2><div class=ad>No.</div></article>",
     [*2 * [WORDS], "Kept, too.", "Head"]),
    (f"<article><article class=part>{RUN}</article><p>After, it.</p></article>", [WORDS]),
])
def test_scores_and_articles_decide(page, want):
    assert main_text.main_text(f"<body>{page}</body>").split("\n\n") == want


def test_points_equal_a_plain_scorer():
    """Points of every container by brute force over the paragraphs below it."""
    page = f"<div id=a><div id=b>{RUN * 3}<p>x, <a href=1>y, z</a></p></div><div id=c><p>one, two</p></div><p>more, here</p></div>"
    builder = main_text.TreeBuilder()
    builder.feed(f"<body>{page}</body>")
    divs = [e for e in main_text._elements(builder.root) if e.tag == "div"]
    main_text._content(builder.root)

    def worth(text, linked=0):
        return (min(len(text) / 25, 1) + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / sum(map(len, text.split(", "))) if linked else 1)

    b = 3 * worth(WORDS) + (min(7 / 25, 1) + 2 + 0.07) * (1 - 4 / 6)
    c, more = worth("one, two"), worth("more, here")
    got = [e.points - main_text.START["div"] for e in divs]
    assert got == pytest.approx([b / 2 + c / 2 + more, b, c])


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<script>x", ""),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), ("</p></div>x", "x"), ("a &amp b &#233;", "a & b é"),
    ("<table><tr><td>a<td>b</table>", "a\n\nb"), ("<nav>menu</nav>", ""), ("<p>é " * 3, "é\n\né\n\né"),
])
def test_odd_pages(html, text):
    assert main_text.main_text(html) == text


def test_pages_keep_their_rows(spark):
    rows = [(1, "u", PAGE, "x", 5), (1, "u", PAGE, "x", 5), (2, None, None, None, None), (None, "v", "<p>a", "y", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got, size = main_text.extract(pages).collect(), len(main_text.main_text(PAGE))
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", size), ("1", size), ("2", 0), ("None", 1)]
    assert main_text.extract(pages.limit(0)).count() == 0
