"""Learned stops: features of checkpoints, labels, datasets, fitting."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvane.functions.expr import near
from sparkvane.operators.models import RERANK, StopModel
from sparkvane.operators.rerank import windows

PROBE = 8


def rerank_features(pool: DataFrame, stages: list[int], k: int, budget: int, tile: int) -> DataFrame:
    """qid, stage, prefix and the 13 rerank features (models.RERANK) at each stage
    prefix, for queries that have a kth exact distance there. pool: qid, vec_id, rank,
    lb, exact. Windows run from stage to stage; the probe looks at the next ranks up
    to the next stage, or one tile after the last."""
    d = windows(pool, stages, k, budget)
    nexts = F.array(*[F.lit(x) for x in [*stages[1:], min(budget, stages[-1] + tile)]])
    zero = F.lit(0.0)

    def features(t, i):
        before = lambda n: F.get("tiles", i - n)["kth"]
        probe = F.slice("rows", t["hi"] + 1, F.greatest(F.lit(0), F.least(F.lit(PROBE), F.get(nexts, i) - t["hi"])))
        live = F.filter(probe, lambda r: near(r["lb"]) <= near(t["kth"]))
        size = F.size(t["rows"])
        done = F.aggregate(F.slice("tiles", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x["exact_n"])
        vals = [F.lit(math.log2(max(1, budget))), t["hi"] / budget, t["kth"], F.coalesce(before(1) - t["kth"], zero), F.coalesce(before(2) - before(1), zero),
                (t["entered"] > 0).cast("double"), t["entered"] / k, t["kth"] - t["best"], F.coalesce(F.try_divide(F.size(live).cast("double"), F.size(probe).cast("double")), zero),
                F.coalesce(F.array_min(F.transform(live, lambda r: r["lb"])) - t["kth"], zero), t["exact_n"] / size, (size - t["exact_n"]) / size, done / t["hi"]]
        return F.struct(i.cast("long").alias("stage"), t["hi"].cast("long").alias("prefix"), *[v.alias(n) for v, n in zip(vals, RERANK, strict=True)])

    d = d.select("qid", F.explode(F.transform("tiles", features)).alias("f")).where("f.kth is not null")
    return d.select("qid", "f.*")


def rerank_ladder(first: int, last: int) -> list[int]:
    """Prefixes from `first`, with steps that grow by magnitude."""
    out, p = [], first
    while p <= last:
        out.append(p)
        step = 2
        for edge in (32, 64, 128, 256, 512, 1024):
            if p >= edge:
                step *= 2
        p += step
    return out


def traversal_ladder(top_l: int) -> list[int]:
    """Prefixes below top_l: powers of two from 16, and between them points in equal
    parts, rounded to multiples of 16 (one in each of 32..256, then 2, 4 and 8)."""
    out = set()
    for left, parts in zip((16, 32, 64, 128, 256, 512, 1024), (1, 2, 2, 2, 3, 5, 9), strict=True):
        if left >= top_l:
            break
        out |= {left} | {x for i in range(1, parts) if left < (x := (math.floor(left + left * i / parts + 0.5) + 7) // 16 * 16) < min(2 * left, top_l)}
    return sorted(out)


def rerank_labels(features: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """features + label: 0 exactly if the current top-k set equals that of the whole pool."""
    w = Window.partitionBy("qid").orderBy(near(F.col("exact")), "vec_id")
    want = pool.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("qid", "vec_id", "rank")
    need = want.groupBy("qid").agg(F.max("rank").alias("deepest"))
    return features.join(need, "qid").withColumn("label", (F.col("prefix") < F.col("deepest")).cast("long")).drop("deepest")


def fit(dataset: DataFrame, features: list[str], prefixes: list[int], reg: float = 0.01) -> StopModel:
    """Logistic regression over a stop dataset, as a text model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stats = dataset.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    means, stds = [stats[f"m_{f}"] or 0.0 for f in features], [stats[f"s_{f}"] or 0.0 for f in features]
    inv = [1 / s if s > 0 else 0.0 for s in stds]
    d = dataset.select(*[((F.col(f) - m) * s).alias(f) for f, m, s in zip(features, means, inv, strict=True)], F.col("label").cast("double").alias("label"))
    m = LogisticRegression(regParam=reg).fit(VectorAssembler(inputCols=features, outputCol="features").transform(d))
    return StopModel(prefixes, means, inv, list(map(float, m.coefficients)), float(m.intercept))
