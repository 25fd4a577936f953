"""Shared folders, lineage cuts and worker paths."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import ExitStack, contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Bytes of an Arrow batch that goes to a Python worker. A task may hold four such
#: batches outside the heap (two workers in a chain, each with input and output).
ARROW_BYTES = "8m"
#: Bytes of a row group in the files of cut().
GROUP_BYTES = 16 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from its source
    folder, and keep Arrow batches small for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def give_back() -> None:
    """Return freed memory to the machine: a worker that is reused would keep the
    largest size it ever had, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a mapInArrow that gives memory back when its task ends."""

    def run_and_give_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return run_and_give_back


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a
    local session without that setting (tests) a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    at = sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "sparkvane-checkpoints")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    _made.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all that operators called inside have written to the shared
    folder. Whatever is to stay must have been written elsewhere by then."""
    first = len(_made)
    try:
        yield
    finally:
        for path in _made[first:]:
            drop_path(spark, path)
        del _made[first:]


def arrow_map(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow, tidied; cut() of the result writes from the same Python worker."""
    out = df.mapInArrow(tidy(run), schema)
    out._mapped = (df, run)
    return out


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _python_writes(folder: str) -> bool:
    """Whether Python workers know the kind of store that the folder is in."""
    try:
        return "://" not in folder or fs.FileSystem.from_uri(folder) is not None
    except (pa.ArrowInvalid, OSError):
        return False


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: the lineage ends in
    files that survive lost executors.

    Python workers write the files, beside the executor's heap; the driver learns the
    name of each file from the task that has finished it and deletes all others, so
    files of failed attempts are never read. Columns must be of types that Arrow has.
    In a store that only Spark can open its own writer is used."""
    spark = df.sparkSession
    ship(spark)
    if not _python_writes(shared_dir(spark)):
        return cut_native(df, what)
    path = new_path(spark, what)
    names, (src, run) = df.columns, getattr(df, "_mapped", (df, iter))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, file, rows = None, [], "", 0
        with ExitStack() as closing:
            def flush() -> None:
                nonlocal out, file
                t = pa.Table.from_batches(held)
                if out is None:
                    file = f"{uuid.uuid4().hex}.parquet"
                    out = closing.enter_context(pq.ParquetWriter(closing.enter_context(open_path(f"{path}/{file}", True)), t.schema, compression="zstd"))
                out.write_table(t)
                held.clear()

            for b in run(batches):
                if len(b):
                    held.append(pa.RecordBatch.from_arrays(b.columns, names=names))
                    rows += len(b)
                    if sum(x.nbytes for x in held) > GROUP_BYTES:
                        flush()
            if held:
                flush()
        yield pa.RecordBatch.from_pydict({"file": [file] if file else [], "rows": [rows] if file else []}, schema=pa.schema([("file", pa.string()), ("rows", pa.int64())]))

    with _shuffles_end(spark):
        done = {r["file"] for r in src.mapInArrow(tidy(write), "file string, rows long").collect()}
    for f in list_files(path):
        if f.rsplit("/", 1)[1] not in done:
            drop_path(spark, f)
    out = spark.read.schema(df.schema).parquet(path) if done else spark.createDataFrame([], df.schema)
    if done and {f.rsplit("/", 1)[1] for f in out.inputFiles()} != done:
        out = spark.read.schema(df.schema).parquet(*(f"{path}/{f}" for f in done))
    out._cut_path = path
    return out


def cut_native(df: DataFrame, what: str = "cut") -> DataFrame:
    """The same by Spark's own writer, for columns of any type and where no Python worker is wanted."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Delete the files of tables that cut() has made and nothing reads any more."""
    for df in cuts:
        drop_path(df.sparkSession, df._cut_path)
        _made.remove(df._cut_path)


def open_path(path: str, write: bool = False):
    """A binary stream of a file in the shared folder, for tasks."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if write:
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(inner, compression=None)
    return store.open_input_stream(inner, compression=None)


def list_files(folder: str) -> list[str]:
    """Data files of a folder that Spark has written, for tasks; none where it does not exist."""
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[5:]
    store, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return [f"{folder.rstrip('/')}/{f.base_name}" for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"]


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free(docs: DataFrame, *names: str) -> DataFrame:
    """docs without columns that would clash with an operator's own (their names
    start with two underscores; an input column of such a name is left out)."""
    own = {n.lower() for n in names}
    return docs.drop(*[c for c in docs.columns if c.lower() in own])
