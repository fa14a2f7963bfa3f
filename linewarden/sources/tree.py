"""Directory trees as a files table, read by a data source of their own.

Spark's binary file source leaves out names that start with a dot or underscore and empty
files, which a scan for secrets must see.  This source lists everything below a folder that all
executors can reach (a shared file system mount).  Its partitions are planned from the upper
folders; tasks list and read what is below.  What the path says (``kind``, ``ignored``) is decided
before a file is opened, so files that are not asked for never are, nor is any without ``content``
among the columns.

What is asked for goes into the source as options.  Spark 4.1 can push filters into such sources,
but keeps them with the relation: a frame that two queries filter gives both the filters of one.
So a :class:`Tree` makes a relation of its own for each request, and pushes nothing otherwise.

A file above ``chunk_bytes`` that is no manifest comes as several rows, cut at line ends; see
:mod:`linewarden.sources.chunks` for its line numbers.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linewarden.functions.paths import (
    LISTING_BINARY_EXTENSIONS,
    LISTING_IGNORED_DIRS,
    MANIFEST_NAMES,
    MANIFEST_SUFFIXES,
)
from linewarden.schema import TREE_FILES

# tasks get this module's classes by value, so executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "linewarden_tree"
CHUNK_BYTES = 64 << 20


def _folded(name: str) -> str:
    return name.replace("ſ", "s").replace("K", "k").lower()


def kind_of(path: str) -> str:
    """The kind of :func:`linewarden.sources.files.file_kind`, from a plain path."""
    if path == ".git/config":
        return "git-config"
    name = path.rsplit("/", 1)[-1]
    stem, dot, extension = name.rpartition(".")
    if dot and stem and name != ".." and extension in LISTING_BINARY_EXTENSIONS:
        return "binary"
    folded = _folded(path)
    named = {known.lower() for known, *_ in MANIFEST_NAMES}
    if _folded(name) in named or folded.endswith(tuple(suffix for suffix, *_ in MANIFEST_SUFFIXES)):
        return "manifest"
    return "other"


def is_ignored(path: str) -> bool:
    return any(folder in LISTING_IGNORED_DIRS for folder in path.split("/")[:-1])


def _children(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as entries:
            return sorted(entries, key=lambda e: e.name)
    except OSError:
        return []


class Starts(InputPartition):
    """Places that one task lists from: (repo, root, start)."""

    def __init__(self, starts: list[tuple[str, str, str]]):
        super().__init__(None)
        self.starts = starts


class TreeReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.root = os.path.abspath(options["path"].removeprefix("file://"))
        self.layout = options.get("layout", "repo")
        self.depth = int(options.get("splitdepth", 1))
        self.tasks = int(options.get("tasks", 32))
        self.chunk_bytes = int(options.get("chunkbytes", CHUNK_BYTES))
        self.repos = set(filter(None, options.get("repos", "").split("/")))
        self.kinds = set(filter(None, options.get("kinds", "").split(",")))
        self.prune = options.get("prune", "false") == "true"
        self.pieces = options.get("pieces", "all")
        self.columns = columns

    def partitions(self) -> list[Starts]:
        if self.layout == "repo":
            starts = [(os.path.basename(self.root) or "unknown", self.root, self.root)]
        else:
            starts = [(e.name, e.path, e.path) for e in _children(self.root) if e.is_dir(follow_symlinks=False)]
        starts = [s for s in starts if not self.repos or s[0] in self.repos]
        for _ in range(self.depth):
            below = []
            for repo, root, start in starts:
                is_folder = os.path.isdir(start) and (start == root or not os.path.islink(start))
                below += [(repo, root, e.path) for e in _children(start)] if is_folder else [(repo, root, start)]
            starts = below
        tasks = min(self.tasks, len(starts)) or 1
        return [Starts(starts[i::tasks]) for i in range(tasks)]

    def read(self, partition: Starts) -> Iterator[tuple]:
        for repo, root, start in partition.starts:
            for full in self._files(start):
                path = os.path.relpath(full, root).replace(os.sep, "/")
                kind, ignored = kind_of(path), is_ignored(path)
                if (self.kinds and kind not in self.kinds) or (self.prune and ignored):
                    continue
                try:
                    size = os.path.getsize(full)
                except OSError:
                    size = 0
                chunks = max(-(-size // self.chunk_bytes), 1) if kind == "other" else 1
                if self.pieces != "all" and (chunks > 1) != (self.pieces == "large"):
                    continue
                row = {
                    "repo": repo, "path": path, "kind": kind, "ignored": ignored, "size": size,
                    "chunks": chunks, "chunk": 0,
                }
                contents = self._contents(full, chunks) if "content" in self.columns else [None]
                for row["chunk"], row["content"] in enumerate(contents):
                    yield tuple(row[c] for c in self.columns)

    def _files(self, start: str) -> Iterator[str]:
        pending = [start]
        while pending:
            path = pending.pop()
            if os.path.islink(path):
                continue
            if os.path.isdir(path):
                pending.extend(e.path for e in _children(path))
            elif os.path.isfile(path):
                yield path

    def _contents(self, path: str, chunks: int) -> Iterator[bytes | None]:
        try:
            with open(path, "rb") as file:
                if chunks == 1:
                    yield file.read()
                    return
                # on to the end of a line; an empty piece ends the file
                while piece := file.read(self.chunk_bytes):
                    yield piece if piece.endswith(b"\n") else piece + file.readline()
        except OSError:
            yield None


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return TREE_FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options), schema.names)


@dataclass(frozen=True)
class Tree:
    """A folder of one repository (``layout="repo"``) or of several (``"repos"``).

    ``split_depth``: folder depth at which it is dealt out; ``tasks``: to how many partitions;
    ``chunk_bytes``: the size above which a file comes in pieces.
    """

    spark: SparkSession
    path: str
    layout: str = "repo"
    split_depth: int = 1
    tasks: int | None = None
    chunk_bytes: int = CHUNK_BYTES

    def files(
        self,
        kinds: Iterable[str] = (),
        prune: bool = False,
        pieces: str = "all",
        columns: Iterable[str] = (),
        repos: Iterable[str] = (),
    ) -> DataFrame:
        """A row for every file, or several for one above ``chunk_bytes``.

        ``kinds``: of :func:`linewarden.sources.files.file_kind`; ``prune`` leaves out what lies
        below ignored folders; ``pieces``: ``whole`` files, those in pieces (``large``) or ``all``;
        ``columns``: without ``content`` no file is opened; ``repos``: names, none for all.
        """
        self.spark.dataSource.register(TreeSource)
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
        types = dict(column.split(" ") for column in TREE_FILES.split(", "))
        options = {
            "layout": self.layout, "splitDepth": self.split_depth, "chunkBytes": self.chunk_bytes,
            "tasks": self.tasks or 4 * self.spark.sparkContext.defaultParallelism,
            "kinds": ",".join(kinds), "prune": prune, "pieces": pieces, "repos": "/".join(repos),
        }
        schema = ", ".join(f"{c} {types[c]}" for c in columns or types)
        return self.spark.read.format(NAME).schema(schema).options(**options).load(os.path.abspath(self.path))


def read_tree(
    spark, path: str, layout: str = "repo", content="true", splitDepth="1", tasks: int | None = None
) -> DataFrame:
    """``(repo, path, content)`` of every file below a folder, each as one row.

    ``content``: ``false`` leaves the content null for jobs that need paths only.  A scan that is
    given the :class:`Tree` itself opens only what it needs.
    """
    tree = Tree(spark, path, layout, int(splitDepth), tasks, chunk_bytes=1 << 62)
    if str(content).lower() == "false":
        return tree.files(columns=("repo", "path")).selectExpr("*", "CAST(NULL AS BINARY) AS content")
    return tree.files(columns=("repo", "path", "content"))
