"""File sets: how tasks read and write binary formats.

A data source path is one file, or a folder that holds complete files of the format
and `manifest.json`, which lists them in row order. A reader deals row ranges of all
files to tasks; a task seeks to its range and reads it in steps, so no file passes
through one task. A writer gets rows by ascending id; every task writes files of a
bounded number of rows, and the manifest is written once all tasks have committed:
files of failed attempts are in no manifest, so nobody reads them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

STEP = 4096
FILE_ROWS = 65_536
MANIFEST = "manifest.json"


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_input(path: str):
    store, inner = _store(path)
    return store.open_input_file(inner)


def put(path: str, data: bytes) -> str:
    store, inner = _store(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inner, compression=None) as f:
        f.write(data)
    return path


def listed(path: str) -> list[str] | None:
    """Files of a folder by its manifest; None where the path is a file."""
    from pyarrow import fs

    store, inner = _store(path)
    if store.get_file_info(inner).type == fs.FileType.File:
        return None
    with store.open_input_file(f"{inner}/{MANIFEST}") as f:
        return [f"{path.rstrip('/')}/{x['file']}" for x in json.loads(f.read())["files"]]


def lists(m: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))


class Format:
    """name; columns: DDL of what a row holds besides its number `row`; whole: a file
    is one task's work."""

    name, columns, whole = "", "", False

    def __init__(self, options):
        self.options = dict(options)

    def count(self, f) -> int:
        raise NotImplementedError

    def read(self, f, lo: int, hi: int) -> list[pa.Array]:
        raise NotImplementedError

    def file(self, cols: list[pa.Array]) -> bytes:
        raise NotImplementedError

    @staticmethod
    def matrix(col: pa.Array, kind) -> np.ndarray:
        flat = col.flatten().to_numpy(zero_copy_only=False)
        if len(col) and len(flat) % len(col):
            raise ValueError("vectors differ in length")
        return np.ascontiguousarray(flat.reshape(len(col), -1).astype(kind)) if len(col) else np.zeros((0, 1), kind)


class Span(InputPartition):
    def __init__(self, path: str, first: int, lo: int, hi: int):
        self.path, self.first, self.lo, self.hi = path, first, lo, hi


class Reader(DataSourceReader):
    """Options: path, start and count (rows, over all files), partitions."""

    def __init__(self, form: Format):
        self.form = form

    def partitions(self):
        o = self.form.options
        files = listed(o["path"])
        at, parts = 0, []
        for path in files if files is not None else [o["path"]]:
            with open_input(path) as f:
                n = self.form.count(f)
            parts.append((path, at, n))
            at += n
        lo = int(o.get("start", 0))
        hi = lo + int(o["count"]) if "count" in o else at
        if lo < 0 or hi > at:
            raise ValueError(f"rows {lo}..{hi} of {at}")
        out, step = [], max(1, -(-(hi - lo) // int(o.get("partitions", 8))))
        for path, first, n in parts:
            a, b = max(0, lo - first), min(n, hi - first)
            for x in range(a, b, b - a if self.form.whole else step):
                out.append(Span(path, first, x, b if self.form.whole else min(b, x + step)))
        return out or [Span("", 0, 0, 0)]

    def read(self, span) -> Iterator[pa.RecordBatch]:
        if span.lo >= span.hi:
            return
        names = ["row", *_names(self.form)]
        with open_input(span.path) as f:
            for lo in range(span.lo, span.hi, STEP):
                hi = min(span.hi, lo + STEP)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(span.first + lo, span.first + hi), pa.int64()), *self.form.read(f, lo, hi)], names=names)


def _names(form: Format) -> list[str]:
    return [c.split()[0] for c in form.columns.split(", ")]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class Writer(DataSourceArrowWriter):
    """Rows (id, the format's columns) arrive by ascending id in every task."""

    def __init__(self, form: Format, overwrite: bool):
        self.form, self.overwrite, self.path = form, overwrite, form.options["path"].rstrip("/")

    def write(self, iterator) -> Written:
        held: list[pa.RecordBatch] = []
        files: list[dict] = []
        most = 1 << 62 if self.form.whole else int(self.form.options.get("file_rows", FILE_ROWS))

        def flush(t: pa.Table) -> None:
            name = f"{uuid.uuid4().hex}.{self.form.name}"
            t = t.combine_chunks()
            cols = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns]
            put(f"{self.path}/{name}", self.form.file(cols[1:]))
            files.append({"file": name, "rows": len(t), "first": int(cols[0][0].as_py()), "last": int(cols[0][-1].as_py())})

        for b in iterator:
            held.append(b)
            if sum(map(len, held)) >= most:
                t = pa.Table.from_batches(held)
                while len(t) >= most:
                    flush(t.slice(0, most))
                    t = t.slice(most)
                held = t.to_batches()
        if sum(map(len, held)):
            flush(pa.Table.from_batches(held))
        return Written(files)

    def commit(self, messages) -> None:
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["first"])
        if any(a["last"] > b["first"] for a, b in zip(files, files[1:], strict=False)):
            raise ValueError("rows were not dealt by ascending id")
        old = [] if self.overwrite else self._old()
        put(f"{self.path}/{MANIFEST}", json.dumps({"format": self.form.name, "rows": sum(f["rows"] for f in [*old, *files]), "files": [*old, *files]}).encode())

    def _old(self) -> list[dict]:
        try:
            with open_input(f"{self.path}/{MANIFEST}") as f:
                return json.loads(f.read())["files"]
        except FileNotFoundError:
            return []


def source(form: type[Format]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return form.name

        def schema(self):
            return f"row long, {form.columns}"

        def reader(self, schema):
            return Reader(form(self.options))

        def writer(self, schema, overwrite):
            return Writer(form(self.options), overwrite)

    Source.__name__ = form.__name__
    return Source


def write(df: DataFrame, form: str, path: str, id_col: str = "vec_id", mode: str = "overwrite", partitions: int | None = None, **options) -> None:
    """Write rows (id and the format's columns, in order) as a file set by ascending id."""
    d = df.repartitionByRange(partitions, id_col) if partitions else df.repartitionByRange(id_col)
    w = d.sortWithinPartitions(id_col).select(F.col(id_col).cast("long").alias("row"), *[F.col(f"`{c}`") for c in df.columns if c != id_col]).write.format(form).mode(mode).option("path", path)
    for k, v in options.items():
        w = w.option(k, v)
    w.save()


def register(spark: SparkSession) -> None:
    """Make every format of binary.py and pages.py known to the session."""
    from sparkvane.session import ship
    from sparkvane.sources import binary, pages

    ship(spark)
    for form in (binary.Bvecs, binary.Fbin, binary.RawFloat, binary.Truth, binary.PageTrace, binary.PqCodes, binary.ErrorBounds, binary.Selectors, binary.Pivots,
                 pages.VectorStore, pages.Topology, pages.DiskGraph, pages.CombinedNodes, pages.StopTrace):
        spark.dataSource.register(source(form))
