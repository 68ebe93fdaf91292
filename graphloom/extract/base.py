"""What all extractors share: a collector of rows, and the table function over a scan of files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EXTERNAL, REFERENCE

OUT = (
    "path string, seq int, row string, id string, kind string, name string, qualified_name string, line_start int, line_end int, "
    "docstring string, signature string, source_code string, source_id string, target_id string, metadata map<string,string>, error string"
)


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


@dataclass
class Collector:
    """Rows of one file, in the order they are found."""

    path: str
    rows: list[dict] = field(default_factory=list)

    def entity(self, kind: str, name: str, qualified: str, start: int, end: int, suffix: str | None = None, **more) -> str:
        found = f"{self.path}::{qualified if suffix is None else suffix}"
        self.rows.append({"row": "entity", "id": found, "kind": kind, "name": name, "qualified_name": qualified, "line_start": start, "line_end": end, **more})
        return found

    def edge(self, kind: str, source: str, target: str, **metadata: str) -> None:
        self.rows.append({"row": "relationship", "kind": kind, "source_id": source, "target_id": target, "metadata": metadata})

    def reference(self, kind: str, source: str, name: str) -> None:
        self.edge(kind, source, REFERENCE + name)

    def external(self, source: str, module: str) -> None:
        self.edge("imports", source, EXTERNAL + module)

    def error(self, text: str) -> None:
        self.rows.append({"row": "error", "error": text})


def lines_between(lines: list[str], start: int, end: int) -> str:
    return "\n".join(lines[start - 1 : end])


Extractor = Callable[[str, str], Collector]


def extract(files: DataFrame, by_extension: dict[str, Extractor]) -> DataFrame:
    """Rows of all files (path, content binary) by the extractor of their extension.

    A file without an extractor, or one that cannot be read or parsed, makes an error row
    and never fails the job. ``ord`` follows the order of paths, then of rows.
    """

    def one(path: str, content: bytes | None) -> Collector:
        f = by_extension.get(os.path.splitext(path)[1].lower())
        out = Collector(path)
        if f is None:
            out.error(f"unsupported file type: {path}")
            return out
        if content is None:
            out.error(f"{path}: cannot be read")
            return out
        try:
            return f(path, bytes(content).decode("utf-8"))
        except Exception as e:  # noqa: BLE001  errors are data
            out.error(f"{path}: {type(e).__name__}: {e}")
            return out

    types = {"string": pa.string(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    columns = [(c.split()[0], types[c.split()[1]]) for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"path": path, "seq": k, "metadata": {}, **r} for k, r in enumerate(one(path, content).rows)]
                made = [pa.array([list(r["metadata"].items()) if name == "metadata" else r.get(name) for r in rows], t) for name, t in columns]
                yield pa.RecordBatch.from_arrays(made, [name for name, _ in columns])

    return files.select("path", "content").mapInArrow(run, OUT)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (with ``file``, ``line``), relationships and errors of extracted rows, each with ``ord``.

    ``ord`` is a struct that sorts by path and place in the file, so no numbering pass over
    all rows is needed.
    """
    order = F.struct("path", "seq").alias("ord")
    e = rows.filter("row = 'entity'").select("id", "kind", "name", "qualified_name", F.col("path").alias("file"), F.col("line_start").cast("long").alias("line"), "line_start", "line_end", "docstring", "signature", "source_code", "metadata", order)
    r = rows.filter("row = 'relationship'").select("source_id", "target_id", "kind", "metadata", order)
    return e, r, rows.filter("row = 'error'").select("path", "error")
