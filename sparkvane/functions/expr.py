"""Column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def l2(a, b) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm_sq(v) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def near(d) -> Column:
    """The value that orders distances: noise of summation order cannot flip ties."""
    return F.round(d, 9)


def r6(d) -> Column:
    return F.round(d, 6)


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def ranked(df: DataFrame, by: list[str], dist: str = "dist", node: str = "vec_id", rank: str = "rank") -> DataFrame:
    """Rank (from 1) by (distance, id) within groups: the order used everywhere."""
    w = Window.partitionBy(*by).orderBy(near(F.col(dist)), F.col(node))
    return df.withColumn(rank, F.row_number().over(w).cast("long"))


def top(df: DataFrame, by: list[str], k: int, dist: str = "dist", node: str = "vec_id", rank: str = "rank") -> DataFrame:
    return ranked(df, by, dist, node, rank).where(F.col(rank) <= k)


def logit(bias: float, weights: dict[str, float], means: dict[str, float] | None = None, inv_stds: dict[str, float] | None = None) -> Column:
    """Linear score with standardisation folded into weights and bias."""
    means, inv_stds = means or {}, inv_stds or {}
    w = {k: v * inv_stds.get(k, 1.0) for k, v in weights.items()}
    out = F.lit(bias - sum(means.get(k, 0.0) * x for k, x in w.items()))
    for k, x in w.items():
        out = out + F.col(k) * F.lit(x)
    return out


def lower_bound(approx, err) -> Column:
    """Lower bound of a squared distance from its approximation and an error radius."""
    r = F.greatest(F.lit(0.0), F.sqrt(F.greatest(F.lit(0.0), approx)) - err)
    return r * r


def page_address(node, per_page: int, page_size: int = 4096, header: int = 4096, vector_bytes: int = 256) -> list[Column]:
    node = F.col(node) if isinstance(node, str) else node
    page, slot = F.floor(node / per_page).cast("long"), (node % per_page).cast("long")
    return [page.alias("page_id"), slot.alias("slot_id"), (F.lit(header) + page * page_size + slot * vector_bytes).cast("long").alias("byte_offset")]


def nearest_rank(p: float, col: str) -> Column:
    """Nearest-rank percentile."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})")
