"""Scans of source trees, with the rules of a .gitignore file."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..extract import base, braces, config_yaml, markdown, python

#: Always ignored, and the extensions that are scanned.
ALWAYS_IGNORED = (".git/", "__pycache__/", "*.pyc", ".venv/", "venv/", "node_modules/", ".eggs/", "*.egg-info/")
EXTRACTORS = {".py": python.extract, ".md": markdown.extract, ".yaml": config_yaml.extract, ".yml": config_yaml.extract, ".js": braces.javascript, ".ts": braces.javascript, ".java": braces.java}

FOLDERS = 256  # that the driver walks down to before tasks go on
CONTENT_BYTES = 8 << 20  # of files in one Arrow batch, about; a larger file is one by itself


def ignore_regex(pattern: str) -> tuple[bool, str] | None:
    """(negated, regular expression over the relative path) of a gitignore line; None for blanks and comments."""
    pattern = pattern.strip()
    if not pattern or pattern.startswith("#"):
        return None
    negated = pattern.startswith("!")
    pattern = pattern.lstrip("!")
    folder = pattern.endswith("/")
    body = pattern.strip("/")
    anchored = pattern.startswith("/") or "/" in body
    out, k = "", 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        elif body[k] == "[" and "]" in body[k + 1 :]:
            end = body.index("]", k + 1)
            out, k = out + "[" + body[k + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, k = out + re.escape(body[k]), k + 1
    return negated, ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


class Rules:
    """Ignore patterns in order: the last one that matches a relative path decides, ``!`` lets it through again."""

    def __init__(self, lines: Iterable[str]):
        self.rules = [(negated, re.compile(pattern, re.DOTALL)) for negated, pattern in filter(None, map(ignore_regex, lines))]
        self.prunes = not any(negated for negated, _ in self.rules)

    def ignored(self, relative: str) -> bool:
        return next((not negated for negated, pattern in reversed(self.rules) if pattern.match(relative)), False)

    def skipped(self, folder: str) -> bool:
        """Whether nothing below a folder can be let through, so that it need not be entered."""
        return self.prunes and self.ignored(folder + "/")


def _children(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What a folder holds; a linked folder is not entered, as links can lead back."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    local = isinstance(system, fs.LocalFileSystem)
    return [x for x in found if not (local and x.type == fs.FileType.Directory and os.path.islink(x.path))]


_LISTED = pa.schema([("path", pa.string()), ("relative_path", pa.string()), ("extension", pa.string()), ("size_bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


def listing(spark: SparkSession, root: str, gitignore: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """path, relative_path, extension, size_bytes, modified of the files that are not ignored.

    Names that begin with a dot or an underscore count like others, which Spark's own
    listings leave out. The driver walks down until there are ``FOLDERS`` folders; what is
    below them is walked in tasks. Ignored folders are not entered. ``gitignore`` is the
    text of the root's ignore file, which is read where none is given. Raises if the root
    is missing.
    """
    system, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
    top = top.rstrip("/")
    prefix = root[: root.index("://") + 3] if "://" in root and not root.startswith("file:") else ""
    if system.get_file_info(top).type != fs.FileType.Directory:
        raise ValueError(f"not a directory: {root}")
    if gitignore is None:
        own = system.get_file_info(f"{top}/.gitignore")
        gitignore = system.open_input_stream(own.path).read().decode("utf-8", "replace") if own.type == fs.FileType.File else ""
    rules = Rules((*ALWAYS_IGNORED, *more, *gitignore.splitlines()))
    shown, level = [], [top]  # folders whose own files are listed; folders that are walked
    while level and len(level) < FOLDERS:
        shown += level
        level = [x.path for f in level for x in _children(system, f) if x.type == fs.FileType.Directory and not rules.skipped(x.path[len(top) + 1 :])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            while todo:
                folder, deep = todo.pop()
                rows = []
                for x in _children(system, folder):
                    relative = x.path[len(top) + 1 :]
                    extension = os.path.splitext(relative)[1].lower()
                    if x.type == fs.FileType.Directory:
                        if deep and not rules.skipped(relative):
                            todo.append((x.path, True))
                    elif extension in EXTRACTORS and not rules.ignored(relative):
                        rows.append((prefix + x.path, relative, extension, x.size, x.mtime))
                columns = list(zip(*rows, strict=True)) or [[]] * len(_LISTED)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _LISTED, strict=True)], schema=_LISTED)

    folders = spark.createDataFrame([(f, False) for f in shown] + [(f, True) for f in level], "folder string, deep boolean")
    parts = min(len(shown) + len(level), 4 * spark.sparkContext.defaultParallelism)
    return folders.repartition(parts).mapInArrow(run, "path string, relative_path string, extension string, size_bytes long, modified timestamp")


def with_content(found: DataFrame) -> DataFrame:
    """A listing with each file's ``content``; null where it cannot be read, as it is gone or not allowed.

    Names are dealt to tasks before files are opened, as one folder may hold most of them.
    """

    def read(path: str) -> bytes | None:
        try:
            system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            with system.open_input_stream(where) as f:
                return f.read()
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, first = [], 0
            for k, (path, size) in enumerate(zip(batch["path"].to_pylist(), batch["size_bytes"].to_pylist(), strict=True)):
                held.append(read(path))
                if k + 1 == batch.num_rows or sum(len(x or b"") for x in held[-64:]) + size > CONTENT_BYTES or len(held) >= 64:
                    part = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*part.schema.names, "content"])
                    held, first = [], k + 1

    dealt = found.repartition(2 * found.sparkSession.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("content", T.BinaryType())]))


def scan(spark: SparkSession, root: str, gitignore: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """The ``listing`` of a tree with the files' content."""
    return with_content(listing(spark, root, gitignore, more))


def extracted(files: DataFrame) -> DataFrame:
    """Rows of entities, relationships and errors of all scanned files."""
    return base.extract(files, EXTRACTORS)
