"""Entry providers, scalar kinds, and the rules by which a rerank is dispatched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvane.operators import rerank
from sparkvane.operators.models import Decision

MODES = ("host", "linear", "tiled", "page_by_page", "persistent")
MOST_TOP_K = 128


# -- entries -----------------------------------------------------------------------
def fixed_entries(queries: DataFrame, ids: list[int], count: int) -> DataFrame:
    """qid, pos, vec_id: the first `count` of the same ids for every query."""
    own = F.array(*[F.lit(x).cast("long") for x in ids[:count]])
    return queries.select("qid", F.posexplode(own).alias("p", "vec_id")).select("qid", (F.col("p") + 1).cast("long").alias("pos"), "vec_id")


def query_entries(queries: DataFrame, table: DataFrame, count: int) -> DataFrame:
    """The first `count` entries (qid, pos, vec_id) of each query; a query that the table lacks is an error."""
    w = Window.partitionBy("qid").orderBy("pos")
    few = table.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= count).select("qid", "pos", "vec_id")
    d = queries.select("qid").join(few, "qid", "left")
    missing = F.raise_error(F.concat(F.lit("no entries for query "), F.col("qid").cast("string"))).cast("long")
    return d.select("qid", "pos", F.when(F.col("pos").isNull(), missing).otherwise(F.col("vec_id")).alias("vec_id"))


# -- scalar kinds --------------------------------------------------------------------
def as_scalar(v: str, kind: str) -> Column:
    """A unit vector's components as f32, u8 or i8 values, as doubles: what a store of
    that kind holds, so distances are those of the stored scalars."""
    lo, hi, f = {"f32": (None, None, lambda x: x.cast("float").cast("double")), "u8": (0.0, 255.0, lambda x: F.floor((x + 1) * 127.5).cast("double")), "i8": (-128.0, 127.0, lambda x: F.floor(x * 127).cast("double"))}[kind]
    return F.transform(v, (lambda x: f(x)) if lo is None else (lambda x: F.greatest(F.lit(lo), F.least(F.lit(hi), f(x)))))


# -- rerank ------------------------------------------------------------------------
@dataclass(frozen=True)
class RerankParams:
    """top_n candidates of each pool give top_k results. bound_filter leaves out rows
    whose lower bound (from residual refinement) exceeds the kth distance."""

    top_n: int
    top_k: int
    mode: str = "host"
    tile: int = 8
    refine: bool = False
    bound_filter: bool = False
    hybrid: bool = False
    patience: int = 0
    min_prefix: int = 0
    decision: Decision | None = None
    bootstrap: int = 0
    replay: bool = False
    record: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if not 0 < self.top_k <= self.top_n:
            raise ValueError("top_k must lie in 1..top_n")
        if self.tile < 1 or self.tile & (self.tile - 1):
            raise ValueError("tile must be a power of two")
        if self.bound_filter:
            if not self.refine or self.mode in ("linear", "host") or self.top_k > MOST_TOP_K:
                raise ValueError(f"the bound filter needs refinement, a mode by tiles and top_k of at most {MOST_TOP_K}")
            if self.hybrid:
                raise ValueError("hybrid codes have no error bounds")
        if self.decision is not None and not (self.mode == "persistent" and self.bound_filter):
            raise ValueError("a learned stop needs the persistent mode and the bound filter")
        if (self.patience or self.replay or self.record) and self.mode != "persistent":
            raise ValueError("early stop, record and replay need the persistent mode")
        if self.replay and (self.record or self.patience or self.decision is not None):
            raise ValueError("replay excludes record and other stops")


def run(pool: DataFrame, vectors: DataFrame, queries: DataFrame, p: RerankParams, stops: DataFrame | None = None) -> DataFrame:
    """qid, rank, vec_id, dist by the mode of p. pool: qid, rank, vec_id and, for the
    bound filter, lb. stops(qid, stop_prefix): recorded prefixes, each in top_k..top_n."""
    if p.bound_filter and "lb" not in pool.columns:
        raise ValueError("the bound filter needs error bounds: column lb")
    if p.replay != (stops is not None):
        raise ValueError("replay needs recorded stops, and nothing else does")
    few = pool.where(F.col("rank") <= p.top_n)
    if p.mode in ("host", "linear"):
        return rerank.linear(few, vectors, queries, p.top_k) if p.mode == "linear" else rerank.exact(few, vectors, queries, p.top_n, p.top_k)
    cols = ["qid", "rank", "vec_id", *["lb"] * p.bound_filter]
    scored = rerank.with_vectors(few.select(*cols), vectors, queries)
    scored = scored if p.bound_filter else scored.withColumn("lb", F.lit(float("-inf")))
    if p.mode == "persistent":
        plan = rerank.Plan(p.top_n, p.tile, p.top_k, p.patience, p.min_prefix, p.decision, p.bootstrap)
        if stops is not None:
            ok = F.col("stop_prefix").between(p.top_k, p.top_n)
            stops = stops.select("qid", F.when(ok, F.col("stop_prefix")).otherwise(F.raise_error(F.lit("a stop prefix lies outside top_k..top_n")).cast("long")).alias("stop_prefix"))
        return rerank.ranked_best(rerank.persistent_runs(scored, plan, stops))
    tile = 1 if p.mode == "page_by_page" else p.tile
    d = rerank.bound_filter_tiled(scored, p.top_n, tile, p.top_k).where("kept").select("qid", "vec_id", F.col("exact").alias("dist"))
    return rerank.top(d, ["qid"], p.top_k).select("qid", "rank", "vec_id", "dist")


def stage_of(rank: Column, stages: list[int]) -> Column:
    """Number of the stage whose range holds the rank: (stages[n - 1], stages[n]]; null after the last."""
    out = F.lit(None).cast("long")
    for n, hi in reversed(list(enumerate(stages))):
        out = F.when(rank <= hi, F.lit(n).cast("long")).otherwise(out)
    return out
