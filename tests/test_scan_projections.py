"""Work on manifests in the scan: few lines reach the rules, and JSON is read in generated code."""

import json

from pyspark.sql import functions as F

from linewarden.operators import dependencies as deps
from linewarden.plans.scan import Corpus, scan
from linewarden.rules import ALL_RULES, prefilter
from linewarden.session import configure

FILES = "repo STRING, path STRING, content STRING"


def test_versions_are_not_taken_for_addresses(spark):
    rows = [('{"a":"5.0.0"}', False), ("16.0.0.2", False), ("at 0.0.0.0", True), ("at 127.0.0.1:80", True)]
    frame = spark.createDataFrame(rows, "text STRING, expected BOOLEAN")
    assert frame.where(prefilter(ALL_RULES)(F.col("text")) != F.col("expected")).count() == 0


def test_known_packages_keep_their_places_among_all(spark):
    configure(spark)
    members = {"zlib": "1", "Lodash": "^4.17.15", "axios": 3, "chalk": "2", "webpacK": "~5.0.0"}
    text = json.dumps({"dependencies": members}, ensure_ascii=False)
    texts = [text, text + " x", text + ',"' + deps._MARK + '"]', "[]", "{}", None, '{"dependencies":{"axi\\u006fs":"1"}}',
             text + ',"end o\\u0066 document"]']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
    items = frame.withColumn("items", deps.npm_items(F.col("text")))
    known = deps.npm_known_packages(deps.npm_members(F.col("items"), F.col("text"), "dependencies"), 0)
    rows = items.select("i", F.inline(known)).orderBy("i", "package_ord").collect()
    assert [(r["i"], r["package_ord"], r["package"], r["raw_version"], r["version"]) for r in rows] == [
        (0, 0, "Lodash", "^4.17.15", "4.17.15"), (0, 1, "axios", None, "*"),
        (0, 3, "webpacK", "~5.0.0", "5.0.0"), (6, 0, "axios", "1", "1"),
    ]
    every = items.select("i", F.inline(deps.npm_packages(F.col("text")))).where("i = 0")
    assert [r["package"] for r in every.orderBy("package_ord").collect()] == sorted(members)


def test_json_is_read_once_and_not_inside_a_higher_order_function(spark):
    files = spark.createDataFrame([("r", "package.json", '{"dependencies":{"lodash":"4.17.15"}}')], FILES)
    found = scan(Corpus(files))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and "from_json" not in plan
    assert [line for line in plan.split("\n") if "parseJson" in line and "lambda" not in line]
    assert {r["rule_id"] for r in found.collect()} == {"DEP-FILE-001", "DEP-VULN-001"}
