from pyspark.sql import functions as F

from linewarden.functions import paths, repo_urls, severity, text
from linewarden.operators.lines import file_stats, lines


def evaluate(spark, values, expression, sql_type="STRING"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {sql_type}")
    return [r["x"] for r in frame.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_lines(spark):
    contents = [b"", b"a", b"a\n", b"a\r\nb", b"a\r", b"\n\n", b"a\r\r\n", b"\r\n", b"\xff\n", "é\n\u2028x".encode()]
    expected = [[], ["a"], ["a"], ["a", "b"], ["a\r"], ["", ""], ["a\r"], [""], [], ["é", "\u2028x"]]
    files = spark.createDataFrame([("r", str(i), c) for i, c in enumerate(contents)], "repo STRING, path STRING, content BINARY")
    got = [[] for _ in contents]
    for r in lines(files).orderBy("path", "line").collect():
        assert r["line"] == len(got[int(r["path"])])
        got[int(r["path"])].append(r["text"])
    assert got == expected
    stats = {int(r["path"]): (r["n_bytes"], r["n_lines"]) for r in file_stats(files).collect()}
    assert stats == {i: (len(c), len(expected[i])) for i, c in enumerate(contents) if i != 8}


def test_extensions(spark):
    given = [".env", "a/.hidden", "README", "x.", "a.tar.gz", "IMG.PNG", "d.x/file", "..", "a/b.Py"]
    assert evaluate(spark, given, paths.extension) == [None, None, None, "", "gz", "png", None, None, "py"]


def test_path_predicates(spark):
    given = ["lib.so", "LIB.SO", "x.jar", "Makefile", "a.py", "a.PY", "a.bin2"]
    assert evaluate(spark, given, paths.is_binary_file) == [True, True, True, False, False, False, False]
    assert evaluate(spark, given, paths.is_text_file) == [False, False, False, True, True, True, False]
    assert evaluate(spark, given, paths.is_listed) == [False, True, True, True, True, True, True]
    assert evaluate(spark, given, paths.detect_language) == [None, None, "java", None, "python", None, None]
    ignored = ["node_modules/a.js", "a/node_modules/b", "node_modules", "anode_modules/x", "a/.git/config"]
    assert evaluate(spark, ignored, paths.below_ignored_dir) == [True, True, False, False, True]
    assert evaluate(spark, ["Go.Sum", "a/yarn.lock", "yarn.lockx"], paths.is_dependency_file) == [True, True, False]
    skipped = ["a/yarn.lock", "x-Cargo.lock.bak", "cargo.lock", "pnpm-lock.yaml"]
    assert evaluate(spark, skipped, paths.is_url_skipped) == [True, True, False, False]


def test_manifests(spark):
    given = ["package.json", "PACKAGE.JSON", "sub/package.json", "sub/App.CSPROJ", "mypackages.config", "pac\u212aage.json", "x"]
    plain = evaluate(spark, given, lambda p: paths.manifest(p)["description"])
    assert plain == ["npm/Node.js", "npm/Node.js", None, "NuGet / .NET project", "NuGet packages", "npm/Node.js", None]
    nested = evaluate(spark, given, lambda p: paths.manifest(p, nested=True)["language"])
    assert nested[2] == "javascript"


def test_console_evidence_cuts_whole_characters(spark):
    given = ["a" * 80, "a" * 81, "a" * 76 + "é" * 5, "a" * 75 + "日" * 5, "a" * 74 + "😀" * 5, "é" * 41]
    expected = ["a" * 80, "a" * 77 + "...", "a" * 76 + "...", "a" * 75 + "...", "a" * 74 + "...", "é" * 38 + "..."]
    assert evaluate(spark, given, text.console_evidence) == expected


def test_locations_and_escapes(spark):
    frame = spark.createDataFrame([("f", None, None), ("f", 0, None), ("f", 2, 5)], "f STRING, l INT, c INT")
    shown = frame.select(text.display_location(F.col("f"), F.col("l"), F.col("c")))
    assert [r[0] for r in shown.collect()] == ["f", "f:1", "f:3:6"]
    assert evaluate(spark, ["<a href=\"x\">&'</a>"], text.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&amp;&apos;&lt;/a&gt;"]
    assert evaluate(spark, ["\u00a0 x y \u2003\n"], text.trim_unicode) == ["x y"]


def test_severity(spark):
    import pytest

    assert severity.parse_severity("High") == 4
    with pytest.raises(ValueError):
        severity.parse_severity("severe")
    assert evaluate(spark, ["low", "CRITICAL", None], severity.severity_rank) == [2, 5, None]
    with pytest.raises(Exception, match="Invalid severity"):
        evaluate(spark, ["bad"], severity.severity_rank)
    assert evaluate(spark, ["MEDIUM", "INFO"], severity.sarif_level) == ["warning", "note"]
    assert evaluate(spark, ["MEDIUM", "INFO"], severity.sarif_rank) == [50.0, 0.0]


def test_repository_urls(spark):
    given = [
        "https://github.com/u/r", " git@host:u/r ", "ssh://h/r", "https://h.example/r.git", "https://h.example/r",
        "git://h/r.git", "ftp://github.com/u/r", "", "HTTPS://github.com/u",
    ]
    assert evaluate(spark, given, repo_urls.is_repo_url) == [True, True, True, True, False, True, False, False, False]
    assert evaluate(spark, ["a/b.git", "a/x.git.git", "a/"], repo_urls.repo_name_from_url) == ["b", "x", ""]
    assert evaluate(spark, ["/srv/a/", "/", "b"], paths.repo_name) == ["a", "unknown", "b"]
    assert evaluate(spark, ["my-répo.v2"], repo_urls.report_file_part) == ["my_répo_v2"]
