import pytest

from linewarden.functions.severity import RANKS
from linewarden.operators import dependencies as deps
from linewarden.plans.scan import Corpus, scan
from linewarden.session import configure

FILES = "repo STRING, path STRING, content STRING"


def npm(spark, content, path="package.json"):
    configure(spark)
    rows = deps.npm_dependencies(spark.createDataFrame([("r", path, content)], FILES)).collect()
    return [(r["section"], r["package"], r["version"]) for r in sorted(rows, key=lambda r: (r["section_ord"], r["package_ord"]))]


@pytest.mark.parametrize(
    "content",
    [
        '{"dependencies":{"a":"1"}} x', '{"dependencies":{"a":"1"}}]', '{"dependencies":{"a":"1"}},{}', "", "[1]", "null",
        "{'dependencies':{'a':'1'}}", '{"dependencies":{"a":"1"},"n":NaN}', '{"dependencies":{"a":"1"},}', '{"dependencies":["a"]}',
        '{dependencies:{"a":"1"}}', '// c\n{"dependencies":{"a":"1"}}',
    ],
)
def test_only_strict_objects_are_read(spark, content):
    assert npm(spark, content) == []


def test_versions_and_order(spark):
    content = (
        '{"devDependencies":{"z":">=^1"},"dependencies":{"b":"^^~>=>==2","a":7,"c":{"v":"1"},"b":"~^3","é/x":"=1"}}'
    )
    assert npm(spark, content) == [
        ("dependencies", "a", "*"), ("dependencies", "b", "^3"), ("dependencies", "c", "*"),
        ("dependencies", "é/x", "1"), ("devDependencies", "z", "^1"),
    ]


def test_advisories_are_parameters(spark):
    files = spark.createDataFrame(
        [("r", "package.json", '{"dependencies":{"left-pad":"1.0.0.5","Vue":"1.9","lodash":"4.17.15"}}'),
         ("r", "requirements.txt", "Foo-Bar==2.0\nother==2.0")], FILES,
    )
    npm_table = spark.createDataFrame([("left-pad", "1.0.0", "CVE-1", "gone", "low")], "package STRING, version STRING, cve STRING, text STRING, severity STRING")
    outdated = spark.createDataFrame([("vue", 2, "use 3")], "package STRING, min_major INT, advice STRING")
    python = spark.createDataFrame([("foo", "2.0", "CVE-2", "CRITICAL")], "package STRING, version STRING, cve STRING, severity STRING")
    corpus = Corpus(files, npm_advisories=npm_table, outdated=outdated, python_advisories=python)
    rows = scan(corpus, ["dependencies"]).where("rule_id <> 'DEP-FILE-001'").orderBy("ord").collect()
    assert [(r["rule_id"], r["severity"], r["title"], r["evidence"], r["remediation"]) for r in rows] == [
        ("DEP-OUTDATED-001", "LOW", "Outdated major version of Vue", "Vue@1.9", "use 3"),
        ("DEP-VULN-001", "LOW", "Vulnerable dependency: CVE-1: gone", "left-pad@1.0.0.5", "Upgrade left-pad to a patched version"),
        ("DEP-VULN-001", "CRITICAL", "Vulnerable Python package: CVE-2", "foo-bar==2.0", "Upgrade foo-bar to a patched version"),
    ]


def test_default_join_is_a_broadcast_and_reads_manifests_once(spark):
    files = spark.createDataFrame([("r", "package.json", "{}")], FILES)
    plan = deps.advisory_findings(deps.dependencies(files), deps.npm_advisories(spark), True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_python_requirements_by_brute_force(spark):
    content = "a==1\r\n # b==2\n\u00a0C-d ==\t3 \nx=>1\n==5\ne==f==g\n"
    rows = deps.python_requirements(spark.createDataFrame([("r", "setup.py", content)], FILES)).orderBy("line").collect()
    assert [(r["line"], r["package"], r["version"]) for r in rows] == [
        (0, "a", "1"), (2, "c-d", "3"), (4, "", "5"), (5, "e", "f==g"),
    ]


def test_rust_notes_only_when_asked(spark):
    files = spark.createDataFrame([("r", "Cargo.toml", "[dependencies]\n"), ("s", "Cargo.toml", "[package]")], FILES)
    ids = lambda **o: sorted(r["rule_id"] + r["repo"] for r in scan(Corpus(files, **o), ["dependencies"]).collect())
    assert ids() == ["DEP-FILE-001r", "DEP-FILE-001s"]
    assert ids(rust_notes=True) == ["DEP-FILE-001r", "DEP-FILE-001s", "DEP-INFO-001r"]
    assert RANKS["INFO"] == 1
