"""Corpora derived from the driver's tables with DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.catalog import planted
from linewarden.functions.dialect import sql_literal
from linewarden.plans.scan import Corpus

#: Share of documents whose planted file lies below a lock-file name.
LOCKED_EVERY, LOCKED_AT = 7, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slot(values, key: Column) -> Column:
    """Value number ``key mod len(values)`` of a fixed list of strings or tuples."""

    def item(value) -> str:
        if isinstance(value, str):
            return sql_literal(value)
        return "struct(" + ", ".join(f"{sql_literal(v)} AS v{i}" for i, v in enumerate(value)) + ")"

    items = F.expr(f"array({', '.join(map(item, values))})")
    return F.get(items, F.pmod(key, F.lit(len(values))).cast("int"))


def spread(frame: DataFrame) -> DataFrame:
    """In as many partitions as the caller's setting ``linewarden.partitions`` says, if it is set.

    For tables that are one row group, and so one task, on a machine with several cores.
    """
    partitions = frame.sparkSession.conf.get("linewarden.partitions", None)
    return frame.repartition(int(partitions)) if partitions else frame


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _parts(spark, sf_dir, *columns: str) -> DataFrame:
    """Columns of the parts over all cores, whose manifests take far longer to read than the parts.

    A table of short rows is few row groups, and so few tasks.
    """
    parts = spark.conf.get("linewarden.partitions", None) or spark.sparkContext.defaultParallelism
    return table(spark, sf_dir, "part").select(*columns).repartition(int(parts))


def _file(repo: Column, path: Column, content: Column) -> list[Column]:
    return [repo.alias("repo"), path.alias("path"), content.cast("string").alias("content")]


def _of(table_name: str, *files, content: bool = True):
    """The files that each row of a table stands for, from one read of the table."""

    def read(spark, sf_dir) -> DataFrame:
        found = [F.struct(*(f() if content else f()[:2])) for f in files]
        return table(spark, sf_dir, table_name).select(F.inline(F.array(*found)))

    return read


def _name(prefix: str, key: str, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(suffix))


def _document_file() -> list[Column]:
    return _file(F.col("source"), _name("docs/", "doc_id", ".txt"), F.col("text"))


def _planted_file() -> list[Column]:
    line = _slot(planted.LINES, F.col("doc_id"))
    locked = F.pmod("doc_id", F.lit(LOCKED_EVERY)) == LOCKED_AT
    folder = F.when(locked, "yarn.lock.d/f").otherwise("src/f")
    path = F.concat(folder, F.col("doc_id").cast("string"), F.lit("."), line["v0"])
    return _file(F.col("source"), path, F.concat("text", F.lit("\n"), line["v2"]))


def _tree_file() -> list[Column]:
    return _file(_name("tree-", "doc_id"), _slot(planted.PATHS, F.col("doc_id")), F.lit(None))


def _manifest_file() -> list[Column]:
    given = _slot(planted.MANIFESTS, F.col("doc_id"))
    return _file(_name("app-", "doc_id"), given["v0"], given["v1"])


def _page_file() -> list[Column]:
    host = F.regexp_extract("url", "://([^/:]+)", 1)
    return _file(host, _name("pages/", "page_id", ".html"), F.concat("html", F.lit("\n"), "url"))


def _url_path() -> Column:
    return F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")


def _url_file() -> list[Column]:
    return _file(_name("web-", "page_id"), _url_path(), F.lit(None))


def _below_url_file() -> list[Column]:
    path = F.concat(_url_path(), F.lit("/"), _slot(planted.PATHS, F.col("page_id")))
    return _file(_name("web-", "page_id"), path, F.lit(None))


def _config_file() -> list[Column]:
    around = _slot([tuple(config.split("{url}")) for config in planted.CONFIGS], F.col("page_id"))
    content = F.concat(around["v0"], "url", around["v1"])
    return _file(_name("site-", "page_id"), F.lit(".git/config"), content)


#: Documents as files of the repository named by their source.
document_files = _of("documents", _document_file)
#: Documents with one planted line at the end, and the file extension that goes with it.
planted_files = _of("documents", _planted_file)
#: Pages as HTML files of their host, with the page's URL as last line.
page_files = _of("pages", _page_file)
planted_manifests = _of("documents", _manifest_file)
#: One ``.git/config`` per page, with the page's URL as origin, in one of several spellings.
config_files = _of("pages", _config_file)


def chat_files(spark, sf_dir) -> DataFrame:
    """One repository per conversation, one file per turn."""
    return table(spark, sf_dir, "conversations").select(
        _name("chat-", "conv_id").alias("repo"), _name("turns/", "turn", ".txt").alias("path"),
        F.col("text").alias("content"),
    )


def byte_files(spark, sf_dir) -> DataFrame:
    """Documents as binary content; every third one is no valid UTF-8."""
    raw = F.to_binary("text", F.lit("utf-8"))
    broken = F.concat(F.unhex(F.lit("C328")), raw)
    return documents(spark, sf_dir).select(
        F.col("source").alias("repo"),
        F.concat(F.lit("raw/"), F.col("doc_id").cast("string")).alias("path"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, broken).otherwise(raw).alias("content"),
    )


def part_requirements(spark, sf_dir) -> DataFrame:
    """One requirements.txt per part: its name and its brand as packages, its size as version."""
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    version = F.concat(F.col("p_size").cast("string"), F.lit(".0"))
    return _parts(spark, sf_dir, "p_partkey", "p_name", "p_brand", "p_size").select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("repo"),
        F.lit("requirements.txt").alias("path"),
        F.concat(
            name, F.lit("=="), version, F.lit("\n# pinned\n"), F.lower(F.replace("p_brand", F.lit("#"))),
            F.lit(" == "), version, F.lit("\n"),
        ).alias("content"),
    )


def part_advisories(spark, sf_dir) -> DataFrame:
    """Python advisories of a caller: the first word of each tenth part's name, at its size."""
    return _parts(spark, sf_dir, "p_partkey", "p_name", "p_size").where("p_partkey % 10 = 0").select(
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("package"),
        F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("version"),
        F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("cve"),
        F.lit("high").alias("severity"),
    )


def order_manifests(spark, sf_dir) -> DataFrame:
    """One package.json per order, with a dependency per distinct package of its lines."""
    versions = (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_orderkey",
            _slot(planted.PACKAGES, F.col("l_partkey")).alias("package"),
            _slot(planted.VERSIONS, F.col("l_suppkey")).alias("version"),
        )
        .groupBy("l_orderkey", "package")
        .agg(F.max("version").alias("version"))
    )
    member = F.concat(F.lit('"'), "package", F.lit('":"'), "version", F.lit('"'))
    # At most one member per package name, so the list is bounded by the fixed list of names.
    listed = versions.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(member)).alias("m"))
    return listed.select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("repo"),
        F.lit("package.json").alias("path"),
        F.concat(F.lit('{"dependencies":{'), F.array_join("m", ","), F.lit("}}")).alias("content"),
    )


def manifest_files(spark, sf_dir) -> DataFrame:
    return planted_manifests(spark, sf_dir).unionByName(order_manifests(spark, sf_dir))


def _union(*parts):
    def files(spark, sf_dir) -> DataFrame:
        first, *others = (part(spark, sf_dir) for part in parts)
        return spread(reduce(DataFrame.unionByName, others, first))

    return files


#: Files without readable content, for the path operators: one repository per document with a planted
#: path, and one per page with the path of its URL, alone and above a planted path.
path_files = _union(_of("documents", _tree_file), _of("pages", _url_file, _below_url_file))
planted_and_pages = _union(planted_files, page_files)
planted_pages_configs = _union(planted_files, _of("pages", _page_file, _config_file))
planted_pages_paths = _union(
    _of("documents", _planted_file, _tree_file), _of("pages", _page_file, _url_file, _below_url_file)
)
_OF_DOCUMENT = (_planted_file, _tree_file, _manifest_file)
_OF_PAGE = (_page_file, _url_file, _below_url_file, _config_file)
#: Everything a scan takes, as one files table; each source is read once.
all_files = _union(
    _of("documents", *_OF_DOCUMENT), _of("pages", *_OF_PAGE), chat_files, order_manifests
)


def all_paths(spark, sf_dir) -> DataFrame:
    """``(repo, path)`` of all files, without reading any text."""
    orders = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    parts = [
        _of("documents", *_OF_DOCUMENT, content=False)(spark, sf_dir),
        _of("pages", *_OF_PAGE, content=False)(spark, sf_dir),
        chat_files(spark, sf_dir).drop("content"),
        orders.select(_name("order-", "l_orderkey").alias("repo"), F.lit("package.json").alias("path")),
    ]
    return reduce(DataFrame.unionByName, parts)


#: All texts, as files.
text_files = _union(planted_files, page_files, chat_files)


def corpus(spark, sf_dir) -> Corpus:
    return Corpus(all_files(spark, sf_dir))


def commits(spark, sf_dir) -> DataFrame:
    """Orders as commits of a hundred repositories; the parent is the repository's previous key."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.pmod(key, F.lit(100)).cast("string")).alias("repo"),
        key.cast("string").alias("hash"),
        F.when(key >= 100, F.array((key - 100).cast("string"))).otherwise(
            F.array().cast("array<string>")
        ).alias("parents"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("author"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("order "), "o_orderstatus")).alias("message"),
        F.col("o_orderdate").alias("commit_time"),
    )


def branched_commits(spark, sf_dir) -> DataFrame:
    """The commits, and a branch of two off every fifth of a repository, every other one merged.

    A merged branch is the second parent of the repository's next commit; no head leads to others.
    """
    base = commits(spark, sf_dir)
    place = F.floor(F.col("hash").cast("long") / 100)
    merged = (F.col("hash").cast("long") >= 100) & (place % 10 == 1)
    second = F.concat(F.lit("c"), (F.col("hash").cast("long") - 100).cast("string"))
    base = base.withColumn("parents", F.when(
        merged, F.concat("parents", F.array(second))
    ).otherwise(F.col("parents")))
    off = base.where(place % 5 == 0)

    def branch(letter: str, parent: Column) -> DataFrame:
        return off.select(
            "repo", F.concat(F.lit(letter), "hash").alias("hash"), F.array(parent).alias("parents"),
            F.lit(letter).alias("author"), "message", "commit_time",
        )

    return base.unionByName(branch("b", F.col("hash"))).unionByName(
        branch("c", F.concat(F.lit("b"), "hash"))
    )


def heads(spark, sf_dir) -> DataFrame:
    """The last commit of each repository on its first branch."""
    key = F.col("o_orderkey")
    repo = F.concat(F.lit("r"), F.pmod(key, F.lit(100)).cast("string")).alias("repo")
    return table(spark, sf_dir, "orders").groupBy(repo).agg(F.max(key).cast("string").alias("hash"))


def _part_version(last: Column) -> Column:
    """A version from a part's key and size, with or without its last number."""
    return F.concat_ws(
        ".", F.pmod("p_partkey", F.lit(6)).cast("string"), F.pmod("p_size", F.lit(25)).cast("string"), last
    )


def part_manifests(spark, sf_dir) -> DataFrame:
    """One package.json per part, with one of three packages at a version of the part's own."""
    version = _part_version(F.pmod("p_partkey", F.lit(50)).cast("string"))
    package = _slot(planted.PACKAGES[:3], F.col("p_partkey"))
    return _parts(spark, sf_dir, "p_partkey", "p_size").select(
        _name("npm-", "p_partkey").alias("repo"), F.lit("package.json").alias("path"),
        F.concat(F.lit('{"dependencies":{"'), package, F.lit('":"^'), version, F.lit('"}}')).alias("content"),
    )


def part_npm_advisories(spark, sf_dir) -> DataFrame:
    """npm advisories of a caller, all on three packages: one per part, some for all below a version."""
    key = F.col("p_partkey")
    version = _part_version(F.when(F.pmod(key, F.lit(7)) != 0, F.pmod(key, F.lit(50)).cast("string")))
    return _parts(spark, sf_dir, "p_partkey", "p_name", "p_size").select(
        _slot(planted.PACKAGES[:3], key).alias("package"), version.alias("version"),
        F.concat(F.lit("CVE-"), key.cast("string")).alias("cve"),
        F.col("p_name").alias("text"), F.lit("medium").alias("severity"),
    )


def tree_entries(spark, sf_dir) -> DataFrame:
    """Order lines as tree entries of the order's commit."""
    key = F.col("l_orderkey")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat(F.lit("r"), F.pmod(key, F.lit(100)).cast("string")).alias("repo"),
            key.cast("string").alias("commit"),
            F.concat(
                F.lit("src/p"), F.pmod("l_partkey", F.lit(20)).cast("string"), F.lit(".py")
            ).alias("path"),
        )
        .agg(
            F.min(F.pmod("l_suppkey", F.lit(3))).cast("string").alias("blob"),
            F.when(F.max("l_linenumber") > 4, "100755").otherwise("100644").alias("mode"),
        )
    )


def indicator_texts(spark, sf_dir) -> DataFrame:
    """``(origin, row_id, text)`` of documents (planted), chats, pages and page URLs."""
    docs = planted_files(spark, sf_dir).select(
        F.lit("documents").alias("origin"), F.col("path").alias("row_id"), F.col("content").alias("text")
    )
    chats = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("origin"),
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"),
        "text",
    )
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.inline(F.array(
            F.struct(F.lit("pages").alias("origin"), F.col("html").alias("text")),
            F.struct(F.lit("page_urls").alias("origin"), F.col("url").alias("text")),
        ))
    ).select("origin", F.col("page_id").cast("string").alias("row_id"), "text")
    return spread(docs.unionByName(chats).unionByName(pages))
