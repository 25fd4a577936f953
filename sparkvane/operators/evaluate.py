"""Evaluation: recall, overlap, histograms, reuse, hot sets, Pareto, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """recall = matches / (queries * k); ids that a result repeats count each."""
    hits = result.join(truth.select("qid", "vec_id").distinct(), ["qid", "vec_id"], "left_semi").agg(F.count("*").alias("m"))
    n = truth.agg(F.count_distinct("qid").alias("q"))
    return hits.join(n, how="cross").select((F.col("m") / (F.col("q") * k)).alias("recall"))


def overlap(pool: DataFrame, truth: DataFrame, thresholds: list[int]) -> DataFrame:
    """threshold, matched, total: truth ids among the first T candidates."""
    hit = truth.select("qid", "vec_id").join(pool.select("qid", "vec_id", F.col("rank").alias("at")), ["qid", "vec_id"], "left")
    t = F.explode(F.array(*[F.lit(x).cast("long") for x in thresholds])).alias("threshold")
    d = hit.select("at", t)
    return d.groupBy("threshold").agg(F.count_if(F.col("at") <= F.col("threshold")).alias("matched"), F.count("*").alias("total"))


def truth_ranks(pool: DataFrame, truth: DataFrame) -> DataFrame:
    """rank (0: not found), n."""
    d = truth.select("qid", "vec_id").join(pool.select("qid", "vec_id", "rank"), ["qid", "vec_id"], "left")
    return d.groupBy(F.coalesce("rank", F.lit(0)).cast("long").alias("rank")).agg(F.count("*").alias("n"))


def running(df: DataFrame, metric: str, col: str) -> DataFrame:
    """metric, count, min, max, avg; empty: zeros."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(F.lit(metric).alias("metric"), F.count(col).alias("count"), z(F.min(col).cast("double")).alias("min"), z(F.max(col).cast("double")).alias("max"), z(F.avg(col)).alias("avg"))


def hist_quantile(values: DataFrame, qs: list[float], col: str = "depth") -> DataFrame:
    """q, depth: smallest depth whose cumulative count exceeds floor(q * (n - 1)).
    Only the histogram (distinct depths) passes through the ordered window."""
    h = values.groupBy(col).agg(F.count("*").alias("c"))
    n = h.agg(F.sum("c").alias("n"))
    h = h.withColumn("cum", F.sum("c").over(Window.orderBy(col)))
    q = F.explode(F.array(*[F.lit(x) for x in qs])).alias("q")
    d = h.join(F.broadcast(n), how="cross").select(col, "cum", "n", q)
    return d.where(F.col("cum") > F.floor(F.col("q") * (F.col("n") - 1))).groupBy("q").agg(F.min(col).cast("long").alias("depth"))


def hotset(counts: DataFrame, percents: list[int], id_col: str = "vec_id") -> DataFrame:
    """pct, cumulative_pct: share of accesses covered by the hottest pct percent
    of ids (ceil), ordered by count descending, id ascending.

    Ids of one count are alike, so the order runs over distinct counts only."""
    h = counts.groupBy("n").agg(F.count("*").alias("ids"))
    h = h.withColumn("upto", F.sum("ids").over(Window.orderBy(F.desc("n"))))
    h = h.withColumn("from", F.col("upto") - F.col("ids"))
    t = h.agg(F.sum("ids").alias("all_ids"), F.sum(F.col("ids") * F.col("n")).alias("all_n"))
    p = F.explode(F.array(*[F.lit(x).cast("long") for x in percents])).alias("pct")
    d = h.join(F.broadcast(t), how="cross").select("*", p).withColumn("take", F.ceil(F.col("pct") * F.col("all_ids") / 100))
    got = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("take")) - F.col("from"))
    return d.groupBy("pct").agg((100.0 * F.sum(got * F.col("n")) / F.first("all_n")).alias("cumulative_pct"))


def pareto(points: DataFrame) -> DataFrame:
    """recall, qps of the frontier: walking from high recall, keep what beats the best qps so far."""
    w = Window.orderBy(F.desc("recall"), F.asc("qps")).rowsBetween(Window.unboundedPreceding, -1)
    d = points.withColumn("best", F.max("qps").over(w))
    return d.where(F.col("best").isNull() | (F.col("qps") > F.col("best"))).select("recall", "qps")


def reuse_profile(pool: DataFrame, ratios: list[float], prefixes: list[int], points: int) -> DataFrame:
    """ratio, prefix, valid, expanded, reusable (expanded and outside the cached prefix of ids)."""
    r = F.explode(F.array(*[F.lit(x) for x in ratios])).alias("ratio")
    d = pool.select("rank", "vec_id", "expanded", r)
    d = d.select("*", F.explode(F.array(*[F.lit(x).cast("long") for x in prefixes])).alias("prefix")).where("rank <= prefix")
    cached = F.floor(F.col("ratio") * points)
    return d.groupBy("ratio", "prefix").agg(F.count("*").alias("valid"), F.count_if("expanded").alias("expanded"), F.count_if(F.col("expanded") & (F.col("vec_id") >= cached)).alias("reusable"))


def cache_sweep(requests: DataFrame, ratios: list[float], points: int) -> DataFrame:
    """ratio, cached_nodes, hits, misses over requests(vec_id)."""
    d = requests.select("vec_id", F.explode(F.array(*[F.lit(x) for x in ratios])).alias("ratio"))
    d = d.withColumn("cached_nodes", F.least(F.lit(points), F.floor(F.col("ratio") * points)).cast("long"))
    return d.groupBy("ratio", "cached_nodes").agg(F.count_if(F.col("vec_id") < F.col("cached_nodes")).alias("hits"), F.count_if(F.col("vec_id") >= F.col("cached_nodes")).alias("misses"))


def batch_plan(queries: int, microbatch: int) -> list[tuple[int, int, int]]:
    """(batch_id, query_offset, num_queries); a tail joins the last full batch."""
    if microbatch <= 0:
        raise ValueError("microbatch must be positive")
    full, rest = divmod(queries, microbatch)
    sizes = [microbatch] * full
    if rest and full:
        sizes[-1] += rest
    elif rest:
        sizes = [rest]
    return [(i, i * microbatch, n) for i, n in enumerate(sizes)]


def rank_report(pool: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: truth ids found and not found in the pool, and the least, greatest and summed rank of those found."""
    d = truth.select("qid", "vec_id").join(pool.select("qid", "vec_id", "rank"), ["qid", "vec_id"], "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return d.agg(F.count("rank").alias("found"), F.count_if(F.col("rank").isNull()).alias("not_found"), z(F.min("rank")).alias("min"), z(F.max("rank")).alias("max"), z(F.sum("rank")).alias("sum"))


def trace_depths(trace: DataFrame, col: str = "page") -> DataFrame:
    """depth, pages: how many pages come `depth` times in a trace."""
    return trace.groupBy(col).agg(F.count("*").alias("depth")).groupBy("depth").agg(F.count("*").alias("pages"))


def rates(runs: DataFrame, page_bytes: int = 4096) -> DataFrame:
    """runs(n queries, pages, ms) + qps and gb_s."""
    s = F.col("ms") / 1000
    return runs.withColumns({"qps": F.col("n") / s, "gb_s": F.col("pages") * page_bytes / s / 1e9})


def cached_by_size(points: int, gib: list[float], node_bytes: int) -> list[tuple[float, int]]:
    """(GiB, nodes that a cache of so many GiB holds)."""
    return [(g, max(0, min(points, int(g * (1 << 30) // node_bytes)))) for g in gib]


def cache_hits(requests: DataFrame, caches: DataFrame) -> DataFrame:
    """caches(gib, cached_nodes), a few rows, + hits and misses of requests(vec_id) on caches of the lowest ids."""
    d = requests.select("vec_id").join(F.broadcast(caches), how="cross")
    return d.groupBy("gib", "cached_nodes").agg(F.count_if(F.col("vec_id") < F.col("cached_nodes")).alias("hits"), F.count_if(F.col("vec_id") >= F.col("cached_nodes")).alias("misses"))
