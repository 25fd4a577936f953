"""Base vectors, queries and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.functions.expr import doubles, top
from sparkvane.session import ship

BLOCK = 4096


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v (array<double>); vectors that are null are left out."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null").select("vec_id", doubles("embedding").alias("v"))


def queries(vectors: DataFrame, step: int = 50) -> DataFrame:
    """qid, qv: the stated query set, ids divisible by `step`."""
    return vectors.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))


def packed(df: DataFrame, rows: int, kind: type = np.float64) -> DataFrame:
    """Blocks of at most `rows` vectors (id, array): n, ids, vecs (bytes of `kind`)."""
    schema = pa.schema([("n", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), rows):
                s = b.slice(i, rows)
                ids = s.column(0).to_numpy().astype(np.int64)
                x = s.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], schema=schema)

    return df.mapInArrow(run, "n long, ids binary, vecs binary")


def rough(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of y and x by one matrix product, good to some ten digits."""
    return (y * y).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (y @ x.T)


def nearest(one: np.ndarray, qid: int, x: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, ids, distances) of the k nearest rows of x, exact: rough distances leave
    out only rows beyond the kth by more than their error, differences decide the rest."""
    if exclude_self:
        far = np.where(ids == qid, np.inf, far)
    if len(far) > k:
        margin = 1e-6 + 1e-10 * (np.abs(far[np.isfinite(far)]).max(initial=0.0) + (one * one).sum())
        few = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1] + margin)
    else:
        few = np.arange(len(far))
    few = few[np.isfinite(far[few])]
    diff = x[few] - one
    d = np.einsum("ij,ij->i", diff, diff)
    order = np.lexsort((ids[few], np.round(d, 9)))[:k]
    return np.full(len(order), qid), ids[few][order], d[order]


def pair_topk(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """qid, rank, vec_id, dist: the k nearest vectors of each query by (squared
    distance, id), exact. Blocks of queries meet blocks of vectors; each meeting
    keeps k rows a query, a window merges them."""
    spark = queries.sparkSession
    ship(spark)
    q = packed(queries.select("qid", "qv"), 512).withColumn("qb", F.monotonically_increasing_id())
    v = packed(vectors.select("vec_id", "v"), block)
    pairs = v.join(q.select("qb", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("vecs").alias("qvecs")), how="cross")
    schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("dist", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                ids, vecs, qids, qvecs = (b.column(i)[r].as_py() for i in (1, 2, 5, 6))
                ids, qids = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                x, y = np.frombuffer(vecs).reshape(len(ids), -1), np.frombuffer(qvecs).reshape(len(qids), -1)
                out = [nearest(one, q, x, ids, far, k, exclude_self) for one, q, far in zip(y, qids, rough(y, x), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    near = pairs.select("n", "ids", "vecs", "qb", "qn", "qids", "qvecs").mapInArrow(run, "qid long, vec_id long, dist double")
    return top(near, ["qid"], k).select("qid", "rank", "vec_id", "dist")


def knn_graph(vectors: DataFrame, degree: int) -> DataFrame:
    """src, slot (from 1), dst: the exact nearest-neighbour graph."""
    q = vectors.select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    g = pair_topk(q, vectors, degree, exclude_self=True)
    return g.select(F.col("qid").alias("src"), F.col("rank").alias("slot"), F.col("vec_id").alias("dst"))
