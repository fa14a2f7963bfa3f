"""Line rules: planted lines, an independent matcher, the prefilter and long lines."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linewarden.catalog import planted
from linewarden.functions.dialect import fold_case, java_pattern
from linewarden.functions.paths import LANGUAGES
from linewarden.operators.matching import match_all
from linewarden.plans.registry import Analyzer, AnalyzerRegistry
from linewarden.plans.scan import Corpus, scan
from linewarden.rules import ALL_RULES, Rule, prefilter

SCHEMA = "repo STRING, path STRING, line INT, text STRING, url_skipped BOOLEAN, language STRING"


def matches(spark, rows):
    """(line, code, byte offset, text) of lines given as (text, language)."""
    data = [("r", "p", i, text, False, lang) for i, (text, lang) in enumerate(rows)]
    found = match_all(spark.createDataFrame(data, SCHEMA), ALL_RULES, ["repo"])
    return Counter((r["line"], ALL_RULES[r["rule"]].code, r["column"], r["evidence"]) for r in found.collect())


def by_python(rows):
    out = Counter()
    for i, (text, lang) in enumerate(rows):
        for rule in ALL_RULES:
            if rule.language and rule.language != lang:
                continue
            for m in re.finditer(rule.pattern, text, re.I if rule.ci else 0):
                out[(i, rule.code, len(text[: m.start()].encode()), m.group())] += 1
    return out


def test_planted_lines_hit_their_rules(spark):
    rows = [(line, LANGUAGES.get(ext)) for ext, _, line in planted.LINES]
    found = matches(spark, rows)
    for i, (_, expected, line) in enumerate(planted.LINES):
        codes = sorted(code for (n, code, _, _), k in found.items() for _ in range(k) if n == i)
        assert codes == sorted(c for c in expected.split(",") if c != "-"), line


def test_every_rule_has_a_planted_line():
    planted_codes = {c for _, codes, _ in planted.LINES for c in codes.split(",")}
    assert {r.code for r in ALL_RULES} <= planted_codes


def random_lines(n, seed):
    rng = random.Random(seed)
    pieces = [line for _, _, line in planted.LINES] + [
        "localhost", "127.0.0.1:8", "://", "http://", "https://a.com/", "redis://", "x:y@z", "é", "ü ", "\u00a0",
        " ", "  ", "\t", "(", " (", "  (", ")", "+", ",", ".", "..", "/", "\\", "test", "\u212a", "\u017f", "日本",
        "eval", "exec", "system", "popen", "spawn", "include", "require", "open", "chmod", "0777", "777", "0x1ff",
        "fs.unlink", "yaml.load", "pickle.load", "un", "$_GET[", "]", ");", "'", '"', "=", ": ", "password", "token",
        "secret", "api_key", "AKIA", "ABCDEFGHIJKLMNOP", "ghp_", "eyJ", "a1B2c3D4e5F6g7H8i9J0", "xoxb-", "AIza",
        "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "\r", "%2e", "/tmp/", "%temp%", "\\Temp\\", "subprocess.call", "shell=True",
    ]
    langs = [None, "python", "javascript", "php", "java", "go"]
    out = []
    for _ in range(n):
        text = "".join(
            p if rng.random() < 0.7 else p[: rng.randint(0, len(p))]
            for p in rng.choices(pieces, k=rng.randint(1, 9))
        )
        out.append((text.swapcase() if rng.random() < 0.2 else text, rng.choice(langs)))
    return out


def test_matches_equal_an_independent_matcher(spark):
    rows = random_lines(4000, 7)
    assert matches(spark, rows) == by_python(rows)


def test_prefilter_holds_wherever_a_rule_matches(spark):
    rows = random_lines(6000, 11)
    hit = sorted({n for n, _, _, _ in by_python(rows)})
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "line INT, text STRING")
    passed = {r["line"] for r in frame.where(prefilter(ALL_RULES)(F.col("text"))).collect()}
    assert not [rows[n][0] for n in hit if n not in passed]


def test_scan_is_the_same_without_prefilter(spark):
    rows = random_lines(1500, 3)
    files = spark.createDataFrame(
        [(f"r{i % 3}", f"f{i}.py", rows[i][0] + "\n" + rows[i + 1][0]) for i in range(0, 1498, 2)],
        "repo STRING, path STRING, content STRING",
    )
    names = ["url", "secrets", "file-ops"]
    with_it = Counter(r["id"] for r in scan(Corpus(files), names).collect())
    without = Counter(r["id"] for r in scan(Corpus(files), names, use_prefilter=False).collect())
    assert with_it == without and len(with_it) > 500


def test_case_folding_is_simple_unicode_folding(spark):
    assert fold_case(r"\bk[a-c\-]\d(?:S)") == "\\b[kK\u212a][A-Ca-c\\-]\\d(?:[sS\u017f])"
    assert fold_case("[^x-]") == "[^Xx-]"
    frame = spark.createDataFrame([("\u017fK\u212a",), ("\u0131",), ("\u0130",)], "t STRING")
    hits = [r[0] for r in frame.select(F.col("t").rlike(java_pattern("^[a-z]+$", True))).collect()]
    assert hits == [True, False, False]


def test_very_many_matches_in_one_line(spark):
    n = 100_000
    start = time.time()
    found = match_all(
        spark.createDataFrame([("r", "p", 0, "é test" * n, False, None)], SCHEMA),
        [r for r in ALL_RULES if r.code == "D04"],
        ["repo"],
    )
    row = found.agg(F.count("*"), F.sum("column"), F.min("column"), F.max("column")).first()
    assert tuple(row) == (n, sum(3 + 7 * i for i in range(n)), 3, 3 + 7 * (n - 1))
    assert time.time() - start < 60


@pytest.mark.parametrize(
    "text",
    [
        "fs.readFile(" + " " * 50_000,
        "require(" + " " * 50_000,
        "eval" + " " * 50_000,
        "-----BEGIN " + "A " * 50_000,
        "https://a.s3.amazonaws.com/" + "!" * 50_000,
        "$_GET[" + "x" * 50_000,
        "a." * 20_000 + " redis://",
    ],
)
def test_long_lines_are_linear(spark, text):
    start = time.time()
    matches(spark, [(text, lang) for lang in ("javascript", "php", "python")])
    assert time.time() - start < 30


@pytest.mark.parametrize(
    ("code", "start"),
    [
        ("U01", "https://a.s3.amazonaws.com/."), ("U03", "mongodb+srv://a:"), ("U04", "redis://a:"),
        ("U05", "postgresql://a:"), ("U06", "postgres://a:"), ("U07", "mysql://a:"), ("U13", "http://"),
        ("F12", "yaml.load("), ("F14", "chmod("), ("L03", "fs.unlink("), ("L04", "require("),
        ("L06", "$_GET["), ("L10", "exec.Command("), ("S04", "redis://a:"), ("S06", "-eyJ"), ("S09", "-----BEGIN A "),
    ],
)
def test_many_starts_in_one_line_are_linear(spark, code, start):
    """What the far end asks for stands in front of the starts, so the gates let the line pass."""
    rule = next(r for r in ALL_RULES if r.code == code)
    text = "@ 0777 + ) .eyJ " + start * (1_000_000 // len(start))
    frame = spark.createDataFrame([("r", "p", 0, text, False, rule.language)], SCHEMA)
    begun = time.time()
    assert match_all(frame, [rule], ["repo"]).count() == 0
    assert time.time() - begun < 10


def test_linear_forms_find_what_the_plain_ones_find(spark):
    draw = random.Random(5)
    parts = ["chmod(", "0777", ")", "yaml.load(", "http://", ".amazonaws.com", "x", " ", "redis://", "a:", "@", "/",
             ":", "fs.unlink (", "+", ",", "require(", "exec.Command(", "$_GET[", "]", "]));", "eyJ", ".eyJ", ".", "-",
             "https://b.s3.amazonaws.com/", "A" * 21, "mysql://", '"', "-----BEGIN ", "AB ", "PRIVATE KEY-----"]
    rows = [("".join(draw.choices(parts, k=draw.randint(2, 14))), draw.choice(["javascript", "php", "go"]))
            for _ in range(6000)]
    assert matches(spark, rows) == by_python(rows)


def test_user_rules_and_analyzers(spark):
    rule = Rule("T1", "todo", "TODO-001", "LOW", "Open task", r"\bTODO\b", ci=True)
    registry = AnalyzerRegistry().register(Analyzer("todo", "Open tasks", rules=(rule,)))
    files = spark.createDataFrame([("r", "a.txt", "x\n todo: y"), ("r", "b.txt", "étodo")], "repo STRING, path STRING, content STRING")
    rows = scan(Corpus(files), registry=registry).collect()
    assert [(r["file"], r["line"], r["column"], r["evidence"], r["analyzer"]) for r in rows] == [("a.txt", 1, 1, "todo", "todo")]
