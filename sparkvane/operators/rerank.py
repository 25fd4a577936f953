"""Refinement and exact reranking of candidate pools."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvane.functions.expr import l2, lower_bound, near, ranked, top
from sparkvane.operators.models import Decision
from sparkvane.session import ship


def with_vectors(pool: DataFrame, vectors: DataFrame, queries: DataFrame, out: str = "exact") -> DataFrame:
    """Candidates with their exact distance: equi join on the id."""
    d = pool.join(vectors.select("vec_id", "v"), "vec_id").join(queries, "qid")
    return d.withColumn(out, l2(F.col("v"), F.col("qv"))).drop("v", "qv")


def exact(pool: DataFrame, vectors: DataFrame, queries: DataFrame, n: int, k: int) -> DataFrame:
    """qid, rank, vec_id, dist: exact top-k of the first n candidates."""
    d = with_vectors(pool.where(F.col("rank") <= n).select("qid", "vec_id"), vectors, queries, "dist")
    return top(d, ["qid"], k).select("qid", "rank", "vec_id", "dist")


def reused(pool: DataFrame, known: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, vec_id, dist, reused: known(qid, vec_id, dist) distances are taken over, the rest computed."""
    k = known.select("qid", "vec_id", F.col("dist").alias("have"))
    d = pool.select("qid", "vec_id").join(k, ["qid", "vec_id"], "left")
    hit = d.where("have is not null").select("qid", "vec_id", F.col("have").alias("dist"), F.lit(True).alias("reused"))
    miss = with_vectors(d.where("have is null").select("qid", "vec_id"), vectors, queries, "dist").select("qid", "vec_id", "dist", F.lit(False).alias("reused"))
    return hit.unionByName(miss)


def kth_after(pool: DataFrame, by: list[str], upto: int, k: int) -> DataFrame:
    """kth exact distance within the first `upto` ranks (null with fewer than k)."""
    w = Window.partitionBy(*by).orderBy(near(F.col("exact")), "vec_id")
    d = pool.where(F.col("rank") <= upto).withColumn("r", F.row_number().over(w)).where(F.col("r") == k)
    return d.select(*by, F.col("exact").alias("kth"))


def bound_filter(pool: DataFrame, tile: int, k: int) -> DataFrame:
    """pool(qid, vec_id, rank, lb, exact) + kept: rows after the first `tile`
    ranks go if their bound exceeds the kth exact distance of that tile."""
    t = kth_after(pool, ["qid"], tile, k)
    d = pool.join(t, "qid", "left")
    return d.withColumn("kept", (F.col("rank") <= tile) | F.col("kth").isNull() | (near(F.col("lb")) <= near(F.col("kth"))))


_BEST = "array<struct<x:double,vec_id:bigint,exact:double>>"
_ROW = "struct<rank:bigint,vec_id:bigint,lb:double,exact:double,kept:boolean>"
_TILES = f"array<struct<lo:int,hi:int,threshold:double,kth:double,best:double,entered:bigint,exact_n:bigint,rows:array<{_ROW}>>>"


def queues(pool: DataFrame, n: int) -> DataFrame:
    """qid, rows: the first n candidates of each query in rank order (bounded by the
    pool limit). pool: qid, vec_id, rank, exact and optionally lb (else the exact
    distance, which is always a bound)."""
    lb = F.col("lb") if "lb" in pool.columns else F.col("exact").alias("lb")
    d = pool.where(F.col("rank") <= n).select("qid", F.struct(F.col("rank").cast("long").alias("rank"), "vec_id", lb, "exact").alias("r"))
    return d.groupBy("qid").agg(F.array_sort(F.collect_list("r")).alias("rows"))


def windows(pool: DataFrame, ends: list[int], k: int, n: int | None = None) -> DataFrame:
    """qid, rows, tiles: one fold per query (over its first n candidates) and the
    windows of ranks (0, ends[0]], (ends[0], ends[1]], ... A window's threshold is the kth exact distance kept so
    far, frozen while the window lasts and absent before k rows are kept; rows whose
    bound exceeds it are not kept. Per window: lo, hi, threshold, kth and best exact
    distance after it, how many of the k best entered in it, how many rows were kept."""
    spans = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in zip([0, *ends], ends, strict=False)])
    d = queues(pool, n or ends[-1])

    def step(s, w):
        own = F.slice("rows", w["lo"] + 1, w["hi"] - w["lo"])
        kth = F.get(s["best"], F.lit(k - 1))["exact"]
        fits = lambda r: kth.isNull() | (near(r["lb"]) <= near(kth))
        rows = F.transform(own, lambda r: F.struct(r["rank"], r["vec_id"], r["lb"], r["exact"], fits(r).alias("kept")))
        new = F.transform(F.filter(own, fits), lambda r: F.struct(near(r["exact"]).alias("x"), r["vec_id"].alias("vec_id"), r["exact"].alias("exact")))
        best = F.slice(F.array_sort(F.concat(s["best"], new)), 1, k)
        tile = F.struct(w["lo"], w["hi"], kth.alias("threshold"), F.get(best, F.lit(k - 1))["exact"].alias("kth"), F.get(best, F.lit(0))["exact"].alias("best"),
                        F.size(F.array_except(F.transform(best, lambda x: x["vec_id"]), F.transform(s["best"], lambda x: x["vec_id"]))).cast("long").alias("entered"),
                        F.size(new).cast("long").alias("exact_n"), rows.alias("rows"))
        return F.struct(best.alias("best"), F.concat(s["tiles"], F.array(tile)).alias("tiles"))

    zero = F.struct(F.array().cast(_BEST).alias("best"), F.array().cast(_TILES).alias("tiles"))
    d = d.withColumn("tiles", F.aggregate(spans, zero, step, lambda s: s["tiles"]))
    return d.withColumn("tiles", F.filter("tiles", lambda t: F.size(t["rows"]) > 0))


def tile_ends(n: int, tile: int) -> list[int]:
    return [min(n, a + tile) for a in range(0, n, tile)]


def bound_filter_tiled(pool: DataFrame, n: int, tile: int, k: int) -> DataFrame:
    """pool(qid, vec_id, rank, lb, exact) + kept, threshold: tile by tile, the
    threshold is the kth exact distance among rows kept so far; it is frozen
    within a tile and absent before k rows are kept. One shuffle by query; the plan
    is the same for any number of tiles."""
    d = windows(pool, tile_ends(n, tile), k).select("qid", F.explode("tiles").alias("t")).select("qid", "t.threshold", F.explode("t.rows").alias("r"))
    return d.select("qid", "r.vec_id", "r.rank", "r.lb", "r.exact", "threshold", "r.kept")


def tile_kth(pool: DataFrame, n: int, tile: int, k: int) -> DataFrame:
    """qid, processed, kth at the end of each tile (no row before k candidates)."""
    d = windows(pool, tile_ends(n, tile), k).select("qid", F.explode("tiles").alias("t"))
    return d.where("t.kth is not null").select("qid", F.col("t.hi").cast("long").alias("processed"), "t.kth")


def early_stop(kth: DataFrame, n: int, min_prefix: int, patience: int) -> DataFrame:
    """qid, stop_prefix: after each tile of at least min_prefix rows count tiles
    without improvement of the kth distance; stop when `patience` in a row."""
    w = Window.partitionBy("qid").orderBy("processed")
    d = kth.withColumn("stale", (near(F.lag("kth").over(w)) <= near(F.col("kth"))) & (F.col("processed") >= min_prefix))
    d = d.withColumn("stale", F.coalesce("stale", F.lit(False)))
    d = d.withColumn("island", F.sum(F.when(F.col("stale"), 0).otherwise(1)).over(w))
    run = Window.partitionBy("qid", "island").orderBy("processed")
    d = d.withColumn("streak", F.sum(F.when(F.col("stale"), 1).otherwise(0)).over(run))
    return d.groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("streak") >= patience, F.col("processed"))), F.lit(n)).cast("long").alias("stop_prefix"))


def replay(pool: DataFrame, stops: DataFrame, k: int) -> DataFrame:
    """Top-k of the first stop_prefix candidates. pool: qid, vec_id, rank, exact."""
    d = pool.join(stops, "qid").where("rank <= stop_prefix").select("qid", "vec_id", F.col("exact").alias("dist"))
    return top(d, ["qid"], k).select("qid", "rank", "vec_id", "dist")


@dataclass(frozen=True)
class Plan:
    """How a persistent rerank runs: budget n, tiles, k; an early stop after
    `patience` stale tiles beyond min_prefix; or a learned stop, whose windows run
    from `bootstrap` through the model's stages and then by tiles (no bootstrap or no
    stages: no learned stop)."""

    n: int
    tile: int
    k: int
    patience: int = 0
    min_prefix: int = 0
    decision: Decision | None = None
    bootstrap: int = 0

    def __post_init__(self):
        if not 1 <= self.tile <= 128 or self.k > self.n:
            raise ValueError("tile must lie in 1..128 and k must not exceed n")

    @property
    def stages(self) -> list[int]:
        on = self.decision is not None and self.bootstrap > 0
        return [p for p in self.decision.stages if self.bootstrap < p < self.n] if on else []

    def ends(self) -> list[int]:
        """Ends of the windows."""
        if not self.stages:
            return tile_ends(self.n, self.tile)
        out = [min(self.bootstrap, self.n), *self.stages]
        return [*out, *range(out[-1] + self.tile, self.n, self.tile), self.n]


def fold(rows: list[tuple], plan: Plan) -> tuple[list[tuple], int, int, int]:
    """One query: rows (vec_id, lb, exact, reused) in rank order. Returns the best
    (rounded distance, id, distance), the processed prefix, exact and reused counts."""
    best: list[tuple] = []
    kth, stale, exact_n, reused_n, lo = None, 0, 0, 0, 0
    stages, at, before, last_delta = plan.stages, 0, None, 0.0
    rows = rows[: plan.n]
    for hi in plan.ends():
        own = [r for r in rows[lo:hi] if kth is None or round(r[1], 9) <= round(kth, 9)]
        window, lo = len(rows[lo:hi]), hi
        if not window:
            break
        exact_n += len(own)
        reused_n += sum(bool(r[3]) for r in own)
        old = {b[1] for b in best}
        best = sorted([*best, *((round(x, 9), i, x) for i, _, x, _ in own)])[: plan.k]
        new = best[plan.k - 1][2] if len(best) == plan.k else None
        if plan.patience and hi >= plan.min_prefix:
            stale = stale + 1 if kth is not None and new is not None and round(new, 9) >= round(kth, 9) else 0
            if stale >= plan.patience:
                break
        kth = new
        if at < len(stages) and hi >= stages[at] and kth is not None:
            entered = len({b[1] for b in best} - old)
            end = stages[at + 1] if at + 1 < len(stages) else hi + plan.tile
            probe = rows[hi : min(end, hi + 8, plan.n)]
            live = [r[1] for r in probe if round(r[1], 9) <= round(kth, 9)]
            delta = before - kth if before is not None else 0.0
            f = [math.log2(max(1, plan.n)), hi / plan.n, kth, delta, last_delta, float(entered > 0), entered / plan.k, kth - best[0][2], len(live) / len(probe) if probe else 0.0,
                 min(live) - kth if live else 0.0, len(own) / window, 1 - len(own) / window, exact_n / hi]
            before, last_delta, at = kth, delta, at + 1
            if plan.decision.stops(f):
                break
    return best, min(lo, len(rows)), exact_n, reused_n


RUN = "qid long, prefix long, exact_n long, reused_n long, best array<struct<vec_id:long,dist:double>>"


def persistent_runs(pool: DataFrame, plan: Plan, stops: DataFrame | None = None) -> DataFrame:
    """One row per query of the fold: qid, prefix (candidates processed), exact_n,
    reused_n, best. pool: qid, rank, vec_id, lb, exact and optionally reused (distance
    taken over from the traversal); its rows of a query are bounded by the pool limit.
    stops(qid, stop_prefix) replays recorded prefixes instead of the plan's own stop."""
    ship(pool.sparkSession)
    cols = ["qid", "rank", "vec_id", "lb", "exact", F.col("reused") if "reused" in pool.columns else F.lit(False).alias("reused")]
    d = pool.select(*cols)
    d = d.join(stops.select("qid", F.col("stop_prefix").cast("long").alias("upto")), "qid") if stops is not None else d.withColumn("upto", F.lit(None).cast("long"))
    schema = pa.schema([("qid", pa.int64()), ("prefix", pa.int64()), ("exact_n", pa.int64()), ("reused_n", pa.int64()), ("best", pa.list_(pa.struct([("vec_id", pa.int64()), ("dist", pa.float64())])))])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        upto = t.column("upto")[0].as_py()
        own = plan if upto is None else replace(plan, n=max(upto, plan.k), patience=0, decision=None)
        rows = list(zip(*(t.column(c).to_pylist() for c in ("vec_id", "lb", "exact", "reused")), strict=True))
        best, prefix, exact_n, reused_n = fold(rows if upto is None else rows[:upto], own)
        return pa.Table.from_pylist([{"qid": t.column("qid")[0].as_py(), "prefix": prefix, "exact_n": exact_n, "reused_n": reused_n, "best": [{"vec_id": b[1], "dist": b[2]} for b in best]}], schema=schema)

    return d.groupBy("qid").applyInArrow(run, RUN)


def ranked_best(runs: DataFrame) -> DataFrame:
    """qid, rank, vec_id, dist of persistent runs."""
    return runs.select("qid", F.posexplode("best").alias("at", "b")).select("qid", (F.col("at") + 1).cast("long").alias("rank"), "b.vec_id", "b.dist")


def persistent(pool: DataFrame, n: int, tile: int, k: int, patience: int = 0, min_prefix: int = 0) -> DataFrame:
    """qid, rank, vec_id, dist: the tiled, bound-filtered rerank as one fold per query."""
    return ranked_best(persistent_runs(pool, Plan(n, tile, k, patience, min_prefix)))


def linear(pool: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact rerank of the whole pool in its given order, no bounds and no tiles."""
    return top(with_vectors(pool.select("qid", "vec_id"), vectors, queries, "dist"), ["qid"], k).select("qid", "rank", "vec_id", "dist")


def resort(pool: DataFrame, distances: DataFrame) -> DataFrame:
    """Candidates re-ranked by another distance(qid, vec_id, dist); expanded is reset."""
    d = pool.select("qid", "vec_id").join(distances, ["qid", "vec_id"])
    return ranked(d, ["qid"]).select("qid", "rank", "vec_id", "dist")


def bounds(pool: DataFrame, errors: DataFrame, norms: DataFrame) -> DataFrame:
    """pool(qid, vec_id, refined distance dist) + lb; approx = dist - |q|^2."""
    d = pool.join(errors, "vec_id").join(norms, "qid")
    return d.withColumn("lb", lower_bound(F.col("dist") - F.col("norm_sq"), F.col("err")))
