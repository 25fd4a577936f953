"""Product quantization: codebooks, codes, lookup tables, residual and hybrid codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.functions.expr import l2, near, ranked, top
from sparkvane.operators.vectors import packed
from sparkvane.session import ship

CHUNKS, DIMS = 8, 8
ROWS = 256


def best_center(sub: Column, book: Column) -> Column:
    """struct(d, center) of the nearest center, ties to the lower center."""
    return F.array_min(F.transform(book, lambda b: F.struct(near(l2(sub, b["pivot"])).alias("d"), b["center"].alias("center"))))


def subvectors(df: DataFrame, id_col: str = "vec_id", vec: str = "v", chunks: int = CHUNKS, dims: int = DIMS) -> DataFrame:
    """id, chunk, sub: one row for each chunk of each vector."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: F.struct(c.cast("long").alias("chunk"), F.slice(F.col(vec), c * dims + 1, dims).alias("sub")))
    return df.select(id_col, F.explode(parts).alias("p")).select(id_col, "p.chunk", "p.sub")


def first_centers(subs: DataFrame, lo: int, hi: int, id_col: str = "vec_id") -> DataFrame:
    """chunk, center, pivot: first-rows initialisation from ids lo..hi-1 (the untrained codebook)."""
    return subs.where(F.col(id_col).between(lo, hi - 1)).select("chunk", (F.col(id_col) - lo).cast("long").alias("center"), F.col("sub").alias("pivot"))


@dataclass(frozen=True)
class Book:
    """A codebook as arrays: center ids ascending, pivots (chunk, center, dim). It is
    bounded (at most 256 centers a chunk) and goes to every task."""

    centers: np.ndarray
    pivots: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the nearest centers of x (row, chunk, dim), ties to the lower
        center, and the squared errors, rounded as all distances that order rows."""
        at, err = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2])
        for lo in range(0, len(x), ROWS):
            part = x[lo : lo + ROWS]
            for c in range(x.shape[1]):
                d = np.round(((part[:, c, None, :] - self.pivots[c][None]) ** 2).sum(axis=2), 9)
                i = d.argmin(axis=1)
                at[lo : lo + ROWS, c], err[lo : lo + ROWS, c] = i, d[np.arange(len(part)), i]
        return at, err

    def decode(self, at: np.ndarray) -> np.ndarray:
        return self.pivots[np.arange(at.shape[1])[None, :], at]


def load(book: DataFrame, most: int = 1 << 18) -> Book:
    """book (chunk, center, pivot), the same centers in every chunk, as arrays."""
    t = book.select("chunk", "center", "pivot").limit(most + 1).toArrow().sort_by([("chunk", "ascending"), ("center", "ascending")])
    if not 0 < len(t) <= most:
        raise ValueError(f"a codebook has 1 to {most} pivots")
    centers = np.unique(t.column("center").to_numpy())
    pivots = np.array(t.column("pivot").to_pylist(), np.float64)
    return Book(centers, pivots.reshape(-1, len(centers), pivots.shape[1]))


def _rows(col: pa.ListArray, chunks: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), chunks, -1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    x = x.reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def encode(vectors: DataFrame, book: Book, residual: Book | None = None, outlier: Book | None = None, id_col: str = "vec_id", vec: str = "v") -> DataFrame:
    """One row per vector, made in the task that reads it: id, code (centers by
    chunk), err (squared error by chunk). With a residual book also approx, res_code
    and bound (norm of what the residual code leaves); with an outlier book also
    out_code and use_outlier (where its error is strictly smaller). No shuffle."""
    ship(vectors.sparkSession)
    chunks = len(book.pivots)
    fields = [(id_col, "long", pa.int64()), ("code", "array<int>", pa.list_(pa.int32())), ("err", "array<double>", pa.list_(pa.float64()))]
    if residual is not None:
        fields += [("approx", "array<double>", pa.list_(pa.float64())), ("res_code", "array<int>", pa.list_(pa.int32())), ("bound", "double", pa.float64())]
    if outlier is not None:
        fields += [("out_code", "array<int>", pa.list_(pa.int32())), ("use_outlier", "array<boolean>", pa.list_(pa.bool_()))]
    schema = pa.schema([(n, t) for n, _, t in fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _rows(b.column(1), chunks)
            at, err = book.nearest(x)
            out = [b.column(0).cast(pa.int64()), _lists(book.centers[at], pa.int32()), _lists(err, pa.float64())]
            if residual is not None:
                approx = book.decode(at)
                rest = x - approx
                r_at, _ = residual.nearest(rest)
                left = ((rest - residual.decode(r_at)) ** 2).sum(axis=2).sum(axis=1)
                out += [_lists(approx, pa.float64()), _lists(residual.centers[r_at], pa.int32()), pa.array(np.sqrt(left))]
            if outlier is not None:
                o_at, o_err = outlier.nearest(x)
                out += [_lists(outlier.centers[o_at], pa.int32()), _lists(o_err < err, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return vectors.select(id_col, vec).mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in fields))


def by_chunk(coded: DataFrame, id_col: str = "vec_id", **columns: str) -> DataFrame:
    """id, chunk and one column for each of `columns` (name: array column by chunk)."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in columns.items()])
    return coded.select(id_col, F.posexplode(zipped).alias("chunk", "p")).select(id_col, F.col("chunk").cast("long").alias("chunk"), *[F.col(f"p.{n}").alias(n) for n in columns])


def lut(queries: DataFrame, book: DataFrame, chunks: int = CHUNKS, dims: int = DIMS) -> DataFrame:
    """qid, chunk, center, d: partial squared distances of each query."""
    q = subvectors(queries, "qid", "qv", chunks, dims)
    return q.join(F.broadcast(book), "chunk").select("qid", "chunk", "center", l2(F.col("sub"), F.col("pivot")).alias("d"))


def wide_lut(table: DataFrame, name: str = "lut") -> DataFrame:
    """qid, lut: array of chunk * K + center order."""
    return table.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "center", "d"))), lambda x: x["d"]).alias(name))


def table_sum(lut: Column, code: Column, centers: int) -> Column:
    """Sum over chunks of the table entry of each code: asymmetric distance."""
    at = F.transform(code, lambda c, i: F.element_at(lut, i * centers + c + 1))
    return F.aggregate(at, F.lit(0.0), lambda s, x: s + x)


def adc_topk(codes: DataFrame, luts: DataFrame, centers: int, k: int, block: int = 8192) -> DataFrame:
    """qid, rank, vec_id, dist: the k smallest asymmetric distances of each query over
    all codes. Blocks of query tables meet blocks of codes; a meeting keeps k rows a
    query, so no row of a pair leaves its task. codes: vec_id, code (positions);
    luts: qid, lut (chunk by chunk)."""
    ship(codes.sparkSession)
    q = packed(luts.select("qid", "lut"), 128).withColumn("qb", F.monotonically_increasing_id())
    v = packed(codes.select("vec_id", "code"), block, np.int32)
    pairs = v.join(q.select("qb", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("vecs").alias("tables")), how="cross")
    schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("dist", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                ids, vecs, qids, tables = (b.column(i)[r].as_py() for i in (0, 1, 2, 3))
                ids, qids = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                code = np.frombuffer(vecs, np.int32).reshape(len(ids), -1)
                lut = np.frombuffer(tables).reshape(len(qids), -1, centers)
                out = []
                for i in range(len(qids)):
                    d = lut[i, np.arange(code.shape[1])[None, :], code].sum(axis=1)
                    near_d = np.round(d, 9)
                    few = np.flatnonzero(near_d <= np.partition(near_d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                    few = few[np.lexsort((ids[few], near_d[few]))[:k]]
                    out.append((np.full(len(few), qids[i]), ids[few], d[few]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    found = pairs.select("ids", "vecs", "qids", "tables").mapInArrow(run, "qid long, vec_id long, dist double")
    return top(found, ["qid"], k).select("qid", "rank", "vec_id", "dist")


def cross_terms(base: DataFrame, residual: DataFrame) -> DataFrame:
    """chunk, base_center, res_center, x = 2 * dot."""
    b = base.select("chunk", F.col("center").alias("base_center"), F.col("pivot").alias("pb"))
    r = residual.select("chunk", F.col("center").alias("res_center"), F.col("pivot").alias("pr"))
    dot = F.aggregate(F.zip_with("pb", "pr", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return b.join(r, "chunk").select("chunk", "base_center", "res_center", (2 * dot).alias("x"))


def outlier_rows(codes: DataFrame, least: int, fraction: float, most: int = 256_000) -> DataFrame:
    """chunk, vec_id, err of the rows of largest error per chunk: n = min(rows, most, max(least, floor(rows * fraction)))."""
    n = codes.groupBy("chunk").agg(F.count("*").alias("rows"))
    n = n.withColumn("n", F.least("rows", F.lit(most), F.greatest(F.lit(least), F.floor(F.col("rows") * fraction))))
    d = ranked(codes.withColumn("neg", -F.col("err")), ["chunk"], "neg")
    return d.join(F.broadcast(n.select("chunk", "n")), "chunk").where("rank <= n").select("chunk", "vec_id", "err")


def lloyd(points: DataFrame, centers: DataFrame) -> DataFrame:
    """center, pivot, members: one Lloyd round over points (vec_id, v); empty centers keep their place."""
    book = centers.agg(F.array_sort(F.collect_list(F.struct("center", "pivot"))).alias("book"))
    d = points.join(F.broadcast(book), how="cross").withColumn("center", best_center(F.col("v"), F.col("book"))["center"])
    mean = d.select("center", "vec_id", F.posexplode("v").alias("dim", "x")).groupBy("center", "dim").agg(F.avg("x").alias("m"), F.count("*").alias("members"))
    new = mean.groupBy("center").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("new"), F.first("members").alias("members"))
    return centers.select("center", "pivot").join(new, "center", "left").select("center", F.coalesce("new", "pivot").alias("pivot"), F.coalesce("members", F.lit(0)).cast("long").alias("members"))
