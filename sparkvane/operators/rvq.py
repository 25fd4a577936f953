"""Two-level residual quantizer: assignment, postings, entry points, training."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkvane.operators.pq import best_center
from sparkvane.session import ship

POSTINGS = 256
ROWS = 256
COARSE_PROBES = 32


def packed(centers: DataFrame, name: str) -> DataFrame:
    """One row with all centers (a codebook is bounded)."""
    return centers.agg(F.array_sort(F.collect_list(F.struct("center", "pivot"))).alias(name))


def minus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def pivot_of(book: Column, center: Column) -> Column:
    return F.element_at(F.filter(book, lambda b: b["center"] == center), 1)["pivot"]


def coarse_assign(points: DataFrame, coarse: DataFrame) -> DataFrame:
    d = points.join(F.broadcast(packed(coarse, "cb")), how="cross").withColumn("b", best_center(F.col("v"), F.col("cb")))
    return d.select("vec_id", F.col("b.center").alias("coarse_id"), F.col("b.d").alias("dist"))


def _arrays(centers: DataFrame, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Ids ascending and pivots of a level (bounded)."""
    t = centers.select("center", "pivot").limit(most + 1).toArrow().sort_by("center")
    if not 0 < len(t) <= most:
        raise ValueError(f"a level has 1 to {most} centers")
    return t.column("center").to_numpy(), np.array(t.column("pivot").to_pylist(), np.float64)


def _far(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)


def build(points: DataFrame, coarse: DataFrame, fine: DataFrame, probes: int = COARSE_PROBES) -> DataFrame:
    """vec_id, cluster_id, score: over the nearest coarse centers, least sum of
    unsquared norms |x - c| + |(x - c) - f|; cluster_id = coarse * fine count + fine.
    Both levels are arrays that go to every task; no shuffle."""
    ship(points.sparkSession)
    (c_ids, c), (f_ids, f) = _arrays(coarse), _arrays(fine)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), ROWS):
                part = b.slice(lo, ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                dc = _far(x, c)
                order = np.argsort(np.round(dc, 9), axis=1, kind="stable")[:, :probes]
                row = np.arange(len(x))
                best, cluster = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int64).max)
                for near_c in order.T:
                    score = np.round(np.sqrt(dc[row, near_c])[:, None] + np.sqrt(_far(x - c[near_c], f)), 9)
                    at = score.argmin(axis=1)
                    s, k = score[row, at], c_ids[near_c] * len(f_ids) + f_ids[at]
                    less = (s < best) | (s == best) & (k < cluster)
                    best[less], cluster[less] = s[less], k[less]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(cluster), pa.array(best)], schema=schema)

    return points.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster_id long, score double")


def cluster_sizes(assigned: DataFrame, clusters: int) -> DataFrame:
    """cluster_id, n; empty clusters included."""
    ids = assigned.sparkSession.range(clusters).withColumnRenamed("id", "cluster_id")
    n = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return ids.join(n, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def search(queries: DataFrame, coarse: DataFrame, fine: DataFrame, sizes: DataFrame) -> DataFrame:
    """qid, cluster_id: nearest coarse center, then the nearest fine center whose
    cluster is not empty (fine 0 where all are). The fine centers that a coarse one
    has members in come by an equi join, one row a coarse center."""
    n_fine = fine.count()
    full = sizes.where("n > 0").select(F.floor(F.col("cluster_id") / n_fine).cast("long").alias("c"), (F.col("cluster_id") % n_fine).alias("center"))
    full = full.join(F.broadcast(fine), "center").groupBy("c").agg(F.collect_list(F.struct("center", "pivot")).alias("live"))
    d = queries.join(F.broadcast(packed(coarse, "cb")), how="cross")
    d = d.withColumn("c", best_center(F.col("qv"), F.col("cb"))["center"].cast("long"))
    d = d.withColumn("r", minus("qv", pivot_of(F.col("cb"), F.col("c")))).drop("cb").join(full, "c", "left")
    return d.select("qid", (F.col("c") * n_fine + F.coalesce(best_center(F.col("r"), F.col("live"))["center"], F.lit(0))).cast("long").alias("cluster_id"))


def postings(assigned: DataFrame, most: int = POSTINGS) -> DataFrame:
    """cluster_id, pos (from 1), vec_id; the first ids of each cluster."""
    w = Window.partitionBy("cluster_id").orderBy("vec_id")
    return assigned.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= most).select("cluster_id", "pos", "vec_id")


def entry_points(found: DataFrame, lists: DataFrame, count: int, fallback: int = 0) -> DataFrame:
    """qid, pos, vec_id: first postings of the query's cluster, or the fallback id."""
    d = found.join(lists.where(F.col("pos") <= count), "cluster_id", "left")
    return d.select("qid", F.coalesce("pos", F.lit(1)).cast("long").alias("pos"), F.coalesce("vec_id", F.lit(fallback)).cast("long").alias("vec_id"))


def save(levels: DataFrame, path: str) -> str:
    """Write a model (level, center, pivot), one folder a level."""
    levels.select("level", F.col("center").cast("long").alias("center"), "pivot").write.mode("overwrite").partitionBy("level").parquet(path)
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    """level, center, pivot; a model needs both levels and centers numbered from 0."""
    d = spark.read.schema("center long, pivot array<double>, level string").parquet(path)
    n = {r["level"]: (r["n"], r["top"]) for r in d.groupBy("level").agg(F.count("*").alias("n"), F.max("center").alias("top")).collect()}
    if set(n) != {"coarse", "fine"} or any(top != k - 1 for k, top in n.values()):
        raise ValueError(f"not a two-level model: {n}")
    return d.select("level", "center", "pivot")
