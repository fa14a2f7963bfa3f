"""Git metadata tables: remotes, recent commits, changed files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from linewarden.functions.arrays import let
from linewarden.functions.text import decode_utf8
from linewarden.operators.findings import ANALYZER_ORDER, to_findings
from linewarden.session import shared_dir

CONFIG_PATH = ".git/config"

# A new section starts at a line whose first visible character is "[".
_SECTION_START = r"(?dm)(?=^[ \t]*\[)"
_REMOTE_HEADER = r'(?i)\A[ \t]*\[[ \t]*remote[ \t]+"([^"\n]*)"[ \t]*\]'
# A value is quoted, or ends at a comment; the header may stand on the same line.
_URL_LINE = r'(?dim)^(?:[ \t]*\[[^\]\n]*\])?[ \t]*url[ \t]*=[ \t]*("[^"\n]*"|[^"#;\r\n]*)'


def remotes_from_config(files: DataFrame) -> DataFrame:
    """``(repo, remote, url)`` from the ``.git/config`` rows of a files table.

    A config is cut at its section headers inside the row, so a ``url`` belongs to the header
    above it and no ordering across rows is needed.  When a remote is set more than once, the
    last setting counts.
    """
    if "kind" in files.columns:
        files = files.where("kind = 'git-config'")
    text = decode_utf8(F.col("content"))
    configs = files.where(F.col("path") == CONFIG_PATH).select("repo", text.alias("content"))
    return configs.select("repo", F.inline(remotes_of(F.col("content"))))


def remotes_of(config: Column) -> Column:
    """Array of (remote, url) of one config; of settings of one remote the last counts."""

    def remote(section: Column) -> Column:
        values = F.regexp_extract_all(section, F.lit(_URL_LINE), F.lit(1))
        return F.struct(
            F.regexp_extract(section, _REMOTE_HEADER, 1).alias("remote"),
            F.trim(F.translate(F.get(F.reverse(values), F.lit(0)), '"\t', " ")).alias("url"),
        )

    sections = F.filter(F.split(config, _SECTION_START, -1), lambda s: s.rlike(_REMOTE_HEADER))
    found = F.filter(F.transform(sections, remote), lambda r: r["url"] != "")

    def last_of_each(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda r: r["remote"]))
        return F.transform(
            names, lambda n: F.element_at(F.filter(found, lambda r: r["remote"] == n), -1)
        )

    return let(found, "array<struct<remote:string,url:string>>", last_of_each)


def origin_urls(remotes: DataFrame) -> DataFrame:
    return remotes.where("remote = 'origin'").select("repo", "url")


def insecure_remotes(remotes: DataFrame) -> DataFrame:
    """Remotes over plain HTTP, local ones left out."""
    url = F.col("url")
    return to_findings(
        remotes.where(url.contains("http://") & ~url.contains("localhost")),
        analyzer="url",
        rule_id="GIT-INSECURE-REMOTE",
        severity="MEDIUM",
        title="Git remote uses insecure HTTP protocol",
        file=CONFIG_PATH,
        evidence=url,
        remediation="Change remote URL to use HTTPS with SSH or HTTPS protocol",
        order=(ANALYZER_ORDER["url"], 1, 0, 0, 0),
        same_place_key=F.col("remote"),
    )


def is_git(files: DataFrame) -> DataFrame:
    """``(repo, is_git)``: whether the root holds ``.git``."""
    below = (F.col("path") == ".git") | F.col("path").startswith(".git/")
    return files.groupBy("repo").agg(F.bool_or(below).alias("is_git"))


def reachable(commits: DataFrame, heads: DataFrame, folder: str) -> DataFrame:
    """``(repo, hash)`` of the commits that a head leads to over all parents.

    A commit is reached if it is a head or one of its children is.  A commit with one child is
    reached when that child is, so chains are followed by pointer doubling: each round halves
    them, whatever their length; commits that no other is below take no part in it.  What is left are commits with several children; branches that
    end in the same commit fall together, and each round passes on what has been reached.  It ends
    with a round that reaches nothing new.  Steps are tables below ``folder``.
    """
    spark = commits.sparkSession
    key = ["repo", "hash"]

    def kept(frame: DataFrame, **counts: Column) -> DataFrame:
        """The rows as a table, with counts taken while it is written."""
        path, seen = f"{folder}/{uuid.uuid4().hex}", Observation()
        counts["rows"] = F.count(F.lit(1))
        frame.observe(seen, *[c.alias(name) for name, c in counts.items()]).write.parquet(path)
        table = spark.read.schema(frame.schema).parquet(path)
        tallies[table] = seen.get
        return table

    def followed(edges: DataFrame, pointers: DataFrame) -> DataFrame:
        """Edges with what their commit above points to, if it does; ``moved`` says so."""
        beyond = pointers.select("repo", F.col("hash").alias("above"), F.col("above").alias("next"))
        moved = edges.join(beyond, ["repo", "above"], "left")
        return moved.select(*key, F.coalesce("next", "above").alias("above"), F.col("next").isNotNull().alias("moved"))

    tallies: dict[DataFrame, dict] = {}
    known = kept(commits.select(*key).distinct())
    new = reached = kept(known.join(heads.select(*key).distinct(), key, "left_semi"))
    # a row for each commit and the commit above it that decides on it
    edges = commits.select("repo", F.explode("parents").alias("hash"), F.col("hash").alias("above"))
    edges = kept(edges.distinct().join(reached, key, "left_anti"))
    while tallies[new]["rows"] and tallies[edges]["rows"]:
        alone = edges.groupBy(*key).agg(F.count("*").alias("n"), F.first("above").alias("above"))
        # only what stands above another commit is ever looked up
        asked = edges.select("repo", F.col("above").alias("hash")).distinct()
        pointers = kept(alone.where("n = 1").drop("n").join(asked, key, "left_semi"))
        moving = True
        while moving:
            # a table for each doubling: both sides of a further join would work it out again
            pointers = kept(followed(pointers, pointers), moving=F.count_if("moved"))
            moving, pointers = tallies[pointers]["moving"], pointers.drop("moved")
        moved = kept(followed(edges, pointers).drop("moved").distinct())
        decided = reached.select("repo", F.col("hash").alias("above"))
        new = kept(moved.join(decided, ["repo", "above"], "left_semi").select(*key).distinct())
        reached = reached.unionByName(new)
        # what nothing leads to any more decides nothing
        open_ = moved.join(new, key, "left_anti")
        above = open_.select(*key).unionByName(reached).distinct().withColumnRenamed("hash", "above")
        edges = kept(open_.join(above, ["repo", "above"], "left_semi"))
    return reached.join(known, key, "left_semi").distinct()


def recent_commits(
    commits: DataFrame, max_count: int = 100, heads: DataFrame | None = None, folder: str | None = None
) -> DataFrame:
    """The newest ``max_count`` commits of each repository, newest first by ``position``.

    With ``heads``, ``(repo, hash)``, only commits that are reachable from them count; steps of
    that are tables below ``folder``, by default in the shared folder.  Spark pushes the rank limit
    below the shuffle, so of a very large repository each task sends at most ``max_count`` rows.
    """
    if heads is not None:
        folder = folder or f"{shared_dir(commits.sparkSession)}/reachable-{uuid.uuid4().hex}"
        commits = commits.join(reachable(commits, heads, folder), ["repo", "hash"], "left_semi")
    newest = Window.partitionBy("repo").orderBy(F.desc("commit_time"), "hash")
    ranked = commits.withColumn("position", F.row_number().over(newest))
    return ranked.where(F.col("position") <= max_count).select(
        "repo",
        "hash",
        F.coalesce("author", F.lit("Unknown")).alias("author"),
        F.coalesce("message", F.lit("")).alias("message"),
        "parents",
        "commit_time",
        "position",
    )


def files_changed(commits: DataFrame, tree_entries: DataFrame) -> DataFrame:
    """``(repo, commit, path)`` of each path whose content or mode differs from the first parent's tree.

    Every tree entry is sent to the commit it belongs to and to the commits it is the first
    parent of; one aggregation on (repo, commit, path) then sees both sides, which is a full
    outer join of the trees on a key without hot values.  The entries are shuffled twice: for
    the look-up of the children, an inner join whose skewed partitions (a commit with very many
    entries) adaptive execution splits, and for the aggregation.  The first commit lists all its paths.
    """
    parent = F.get("parents", F.lit(0))
    entry = F.concat_ws(" ", "blob", "mode") if "mode" in tree_entries.columns else F.col("blob")
    # A commit is listed with itself (its own side) and with its parent (the other side).
    sides = F.array(
        F.struct(F.col("hash").alias("commit"), F.lit(True).alias("own")),
        F.struct(parent.alias("commit"), F.lit(False).alias("own")),
    )
    links = commits.select("repo", F.col("hash").alias("child"), F.inline(sides))
    both = tree_entries.join(links.where("commit IS NOT NULL"), ["repo", "commit"]).select(
        "repo",
        F.col("child").alias("commit"),
        "path",
        F.when(F.col("own"), entry).alias("new_entry"),
        F.when(~F.col("own"), entry).alias("old_entry"),
    )
    compared = both.groupBy("repo", "commit", "path").agg(
        F.max("new_entry").alias("new_entry"), F.max("old_entry").alias("old_entry")
    )
    changed = ~F.col("new_entry").eqNullSafe(F.col("old_entry"))
    return compared.where(changed).select("repo", "commit", "path")
