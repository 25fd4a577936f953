"""Best-first graph traversal.

State: pool(qid, vec_id, dist, expanded, rank) and visited(qid, vec_id). The set
form advances all queries by one round with joins and windows; to the end it keeps
one row a query, with pool and visited nodes as arrays, and writes it once a round.
The kernel form runs each query to its end inside an Arrow task over a broadcast
graph whose size is checked. Contract: exact visited set, distinct frontier, pool cut to
`limit`, only ranks below top_l are expanded, never more than max_expansions,
stop tested before an iteration counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.functions.expr import near, ranked
from sparkvane.operators.models import TRAVERSAL, Decision, TraversalWatch
from sparkvane.operators.pq import table_sum
from sparkvane.session import delete, kept, ship, shuffles_end

GRAPH_BYTES = 512 << 20
#: Nodes chosen in a round that are sent to all tasks; more of them meet the graph in a shuffle.
ASKED = 1 << 18


@dataclass(frozen=True)
class Params:
    top_k: int = 10
    top_l: int = 32
    width: int = 4
    max_expansions: int = 4096
    queue: int = 0

    def __post_init__(self):
        if min(self.top_k, self.top_l, self.width) <= 0:
            raise ValueError("top_k, top_l and width must be positive")
        if self.queue and self.queue < self.top_l:
            raise ValueError("queue must be 0 or at least top_l")
        if self.width > 32:
            raise ValueError("width must be at most 32")

    @property
    def limit(self) -> int:
        return max(self.top_l, self.queue)


class Scorer:
    """ADC distance of (qid, vec_id) pairs: codes(vec_id, code), luts(qid, lut)."""

    def __init__(self, codes: DataFrame, luts: DataFrame, centers: int):
        self.codes, self.luts, self.centers = codes, luts, centers

    def __call__(self, pairs: DataFrame) -> DataFrame:
        d = pairs.join(self.codes, "vec_id").join(self.luts, "qid")
        return d.select("qid", "vec_id", table_sum(F.col("lut"), F.col("code"), self.centers).alias("dist"))


def merge(pool: DataFrame, new: DataFrame, limit: int) -> DataFrame:
    """Union of two candidate lists, ranked, cut to the limit."""
    both = pool.select("qid", "vec_id", "dist", "expanded").unionByName(new.select("qid", "vec_id", "dist", "expanded"))
    return ranked(both, ["qid"]).where(F.col("rank") <= limit)


def seed(entries: DataFrame, score: Scorer, limit: int) -> DataFrame:
    start = score(entries.select("qid", "vec_id").distinct()).withColumn("expanded", F.lit(False))
    return ranked(start, ["qid"]).where(F.col("rank") <= limit)


def select(pool: DataFrame, top_l: int, width: int) -> DataFrame:
    """Up to `width` best unexpanded candidates of rank up to top_l."""
    return ranked(pool.where((F.col("rank") <= top_l) & ~F.col("expanded")), ["qid"], rank="turn").where(F.col("turn") <= width).select("qid", "vec_id")


def expand(chosen: DataFrame, graph: DataFrame) -> DataFrame:
    """Distinct neighbours of the chosen candidates. graph: src, dst."""
    return chosen.join(graph, chosen["vec_id"] == graph["src"]).select("qid", F.col("dst").alias("vec_id")).distinct()


def unvisited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    return frontier.join(visited, ["qid", "vec_id"], "left_anti")


def round_once(pool: DataFrame, visited: DataFrame, graph: DataFrame, score: Scorer, p: Params) -> tuple[DataFrame, DataFrame]:
    """(pool, visited) after one round of all queries."""
    chosen = select(pool, p.top_l, p.width)
    fresh = unvisited(expand(chosen, graph), visited)
    marked = pool.join(chosen.withColumn("now", F.lit(True)), ["qid", "vec_id"], "left").withColumn("expanded", F.col("expanded") | F.coalesce("now", F.lit(False)))
    new = score(fresh).withColumn("expanded", F.lit(False))
    return merge(marked, new, p.limit), visited.unionByName(fresh)


def rounds(entries: DataFrame, graph: DataFrame, score: Scorer, p: Params, n: int) -> DataFrame:
    """A fixed number of rounds as one plan."""
    pool = seed(entries, score, p.limit)
    visited = entries.select("qid", "vec_id").distinct()
    for _ in range(n):
        pool, visited = round_once(pool, visited, graph, score, p)
    return pool.select("qid", "rank", "vec_id", "dist", "expanded")


def _keeper(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Cuts lineage by a table in the shared folder; the table kept before is deleted."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        # A union has the partitions of both sides: without a bound every round adds to them, and to what the driver holds of each.
        with shuffles_end(spark):
            out, path = kept(df.coalesce(parts), "traversal")
        while before:
            delete(spark, before.pop())
        before.append(path)
        return out

    return keep


@dataclass(frozen=True)
class Prefix:
    """A stop at a prefix below top_l (0: none). on='expanded': a full pool and so
    many expanded nodes; on='candidates': no unexpanded candidate among the first so
    many, once the pool holds them."""

    size: int = 0
    on: str = "expanded"

    def __post_init__(self):
        if self.size < 0 or self.on not in ("expanded", "candidates"):
            raise ValueError("a prefix stop needs a size of at least 0, on 'expanded' or 'candidates'")


def _chosen(p: Params, prefix: Prefix) -> Column:
    """The nodes that a query expands next; none when it is done."""
    is_open = lambda c: ~c["expanded"]
    left = F.greatest(F.lit(0), F.least(F.lit(p.width), p.max_expansions - F.col("n_expanded"))).cast("int")
    chosen = F.slice(F.transform(F.filter(F.slice("pool", 1, p.top_l), is_open), lambda c: c["vec_id"]), F.lit(1), left)
    if not 0 < prefix.size < p.top_l:
        return chosen
    if prefix.on == "expanded":
        on = (F.size("pool") < p.top_l) | (F.col("n_expanded") < prefix.size)
    else:
        on = (F.size("pool") < prefix.size) | F.exists(F.slice("pool", 1, prefix.size), is_open)
    return F.when(on, chosen).otherwise(F.array().cast("array<long>"))


def _step(state: DataFrame, near_by: DataFrame, centers: int, p: Params, trace: bool) -> DataFrame:
    """The state after one round: near_by (qid, nbrs) has the neighbours of the chosen."""
    d = state.join(near_by.hint("merge"), "qid", "left").withColumn("nbrs", F.coalesce("nbrs", F.array()))
    d = d.withColumn("fresh", F.array_except(F.transform("nbrs", lambda n: n["vec_id"]), "visited"))
    coded = F.filter("nbrs", lambda n: F.array_contains("fresh", n["vec_id"]) & n["code"].isNotNull() & F.col("lut").isNotNull())
    scored = F.transform(coded, lambda n: F.struct(n["vec_id"].alias("vec_id"), table_sum(F.col("lut"), n["code"], centers).alias("dist")))
    new = F.transform(scored, lambda n: F.struct(near(n["dist"]).alias("near"), n["vec_id"].alias("vec_id"), n["dist"].alias("dist"), F.lit(False).alias("expanded")))
    marked = F.transform("pool", lambda c: F.struct(c["near"].alias("near"), c["vec_id"].alias("vec_id"), c["dist"].alias("dist"), (c["expanded"] | F.array_contains("chosen", c["vec_id"])).alias("expanded")))
    steps = F.concat("steps", F.transform("chosen", lambda v: F.struct(F.col("iterations").alias("step"), v.alias("vec_id")))) if trace else F.col("steps")
    return d.select("qid", "lut", F.slice(F.array_sort(F.concat(marked, F.array_distinct(new))), 1, p.limit).alias("pool"), F.concat("visited", "fresh").alias("visited"),
                    (F.col("n_expanded") + F.size("chosen")).alias("n_expanded"), (F.col("iterations") + (F.size("chosen") > 0).cast("long")).alias("iterations"), steps.alias("steps"))


def _advance(start: DataFrame, graph: DataFrame, score: Scorer, p: Params, prefix: Prefix = Prefix(), trace: bool = False) -> DataFrame:
    """qid, pool, visited, n_expanded, iterations, steps after all rounds of all queries,
    a row a query: pool has (near, vec_id, dist, expanded) by rank, steps (step, vec_id) of
    every expansion if traced. A query expands no more than max_expansions nodes, whatever
    the others do.

    A round is one plan, and only the state is written: plans, jobs and broadcasts of every
    round add to what the driver holds. The graph with its codes is scanned, not shuffled."""
    spark = start.sparkSession
    keep = _keeper(spark)
    codes = score.codes.select(F.col("vec_id").alias("dst"), "code")
    with shuffles_end(spark):
        graph, path = kept(graph.select("src", "dst").join(codes, "dst", "left").groupBy("src").agg(F.collect_list(F.struct(F.col("dst").alias("vec_id"), "code")).alias("nbrs")), "neighbours")
    member = F.struct(near(F.col("dist")).alias("near"), "vec_id", "dist", "expanded")
    pools = seed(start, score, p.limit).groupBy("qid").agg(F.array_sort(F.collect_list(member)).alias("pool"))
    none = F.lit(0).cast("long")
    state = start.groupBy("qid").agg(F.collect_list("vec_id").alias("visited")).join(pools, "qid", "left").join(score.luts.select("qid", "lut"), "qid", "left")
    state = state.select("qid", "lut", F.coalesce("pool", F.array()).alias("pool"), "visited", none.alias("n_expanded"), none.alias("iterations"), F.array().cast("array<struct<step:long,vec_id:long>>").alias("steps"))
    while True:
        state = keep(state.withColumn("chosen", _chosen(p, prefix)))
        n = state.agg(F.sum(F.size("chosen"))).first()[0]
        if not n:
            delete(spark, path)
            return state
        asked = state.select("qid", F.explode("chosen").alias("src"))
        near_by = graph.join(F.broadcast(asked) if n <= ASKED else asked.hint("merge"), "src").groupBy("qid").agg(F.flatten(F.collect_list("nbrs")).alias("nbrs"))
        state = _step(state, near_by, score.centers, p, trace)


def _pool_rows(state: DataFrame, *more: Column | str) -> DataFrame:
    d = state.select("qid", F.posexplode("pool").alias("at", "c"), *more)
    return d.select("qid", (F.col("at") + 1).cast("long").alias("rank"), "c.vec_id", "c.dist", "c.expanded", *d.columns[3:])


def traverse(entries: DataFrame, graph: DataFrame, score: Scorer, p: Params, trace: bool = False, prefix: Prefix = Prefix()) -> tuple[DataFrame, DataFrame]:
    """(pool, stats) when no query may expand another candidate. stats: qid, visited,
    n_expanded, iterations; with trace one row per (qid, step, vec_id) expanded."""
    state = _advance(entries.select("qid", "vec_id").distinct(), graph, score, p, prefix, trace)
    if trace:
        return _pool_rows(state), state.select("qid", F.explode("steps").alias("s")).select("qid", "s.step", "s.vec_id")
    return _pool_rows(state), state.select("qid", F.size("visited").cast("long").alias("visited"), "n_expanded", "iterations")


@dataclass
class Csr:
    """Graph and codes as arrays, nodes numbered by ascending id; neighbours of node
    i are nbr[at[i]:at[i + 1]]. Neighbours without codes are left out."""

    ids: np.ndarray
    codes: np.ndarray
    at: np.ndarray
    nbr: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, codes: np.ndarray, src: np.ndarray, dst: np.ndarray) -> Csr:
        order = np.argsort(ids, kind="stable")
        ids, codes = ids[order], codes[order]
        a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        last = len(ids) - 1
        real = (ids[np.minimum(a, last)] == src) & (ids[np.minimum(b, last)] == dst) if len(ids) else np.zeros(len(src), bool)
        a, b = a[real], b[real]
        order = np.lexsort((b, a))
        return cls(ids, codes, np.searchsorted(a[order], np.arange(len(ids) + 1)), b[order].astype(np.int32))

    def nodes(self, ids) -> list[int]:
        ids = np.array(sorted(set(ids)), np.int64)
        i = np.searchsorted(self.ids, ids)
        return i[(i < len(self.ids)) & (self.ids[np.minimum(i, len(self.ids) - 1)] == ids)].tolist() if len(self.ids) else []


def search_one(lut: np.ndarray, start: list[int], g: Csr, p: Params, prefix: Prefix = Prefix(), watch: TraversalWatch | None = None):
    """One query to its end: (pool of (rounded distance, node, distance, expanded), visited, expanded, rounds)."""
    rows = np.arange(lut.shape[0])

    def scored(nodes: list[int]) -> list[tuple]:
        d = lut[rows, g.codes[nodes]].sum(axis=1).tolist()
        return sorted((round(x, 9), i, x, False) for x, i in zip(d, nodes, strict=True))

    seen = set(start)
    pool = scored(start)[: p.limit] if start else []
    n, rounds_ = 0, 0
    stop_at = prefix.size if 0 < prefix.size < p.top_l else 0
    while n < p.max_expansions:
        if watch is not None and watch.stop(pool, n, len(seen)):
            break
        if stop_at and prefix.on == "expanded" and len(pool) >= p.top_l and n >= stop_at:
            break
        if stop_at and prefix.on == "candidates" and len(pool) >= stop_at and all(c[3] for c in pool[:stop_at]):
            break
        turn = [j for j, c in enumerate(pool[: p.top_l]) if not c[3]][: min(p.width, p.max_expansions - n)]
        if not turn:
            break
        rounds_ += 1
        fresh: set[int] = set()
        for j in turn:
            i = pool[j][1]
            pool[j] = (*pool[j][:3], True)
            fresh.update(g.nbr[g.at[i] : g.at[i + 1]].tolist())
        n += len(turn)
        fresh -= seen
        seen |= fresh
        if fresh:
            pool = list(heapq.merge(pool, scored(sorted(fresh))))[: p.limit]
    return pool, len(seen), n, rounds_


def _starts(luts: DataFrame, entries: DataFrame, codes: DataFrame) -> DataFrame:
    start = entries.select("qid", "vec_id").distinct().join(luts.select("qid"), "qid", "left_semi")
    return start.join(codes.select("vec_id"), "vec_id", "left_semi").select("qid", "vec_id")


def search_rounds(luts: DataFrame, entries: DataFrame, graph: DataFrame, codes: DataFrame, centers: int, p: Params, prefix: Prefix = Prefix()) -> DataFrame:
    """The rows of search_kernel() for a graph of any size, by rounds of joins."""
    known = graph.join(codes.select(F.col("vec_id").alias("dst")), "dst", "left_semi").select("src", "dst")
    state = _advance(_starts(luts, entries, codes), known, Scorer(codes, luts, centers), p, prefix)
    return _pool_rows(state, F.size("visited").cast("long").alias("visited"), "n_expanded", "iterations")


def fits(graph: DataFrame, codes: DataFrame, limit_bytes: int = GRAPH_BYTES) -> bool:
    """Whether graph and codes as arrays stay under the limit that a task may hold."""
    n = codes.agg(F.count("*").alias("n"), F.max(F.size("code")).alias("chunks")).first()
    return graph.count() * 4 + n["n"] * (16 + (n["chunks"] or 0) * 2) <= limit_bytes


def _kernel(luts: DataFrame, entries: DataFrame, graph: DataFrame, codes: DataFrame, centers: int, schema: pa.Schema, ddl: str, one: Callable) -> DataFrame:
    """one(qid, lut, start nodes, graph) -> rows, for each query, over a broadcast graph."""
    spark = luts.sparkSession
    ship(spark)
    g = graph.select("src", "dst").toArrow()
    c = codes.select("vec_id", "code").toArrow()
    flat = pc.list_flatten(c.column("code")).to_numpy().astype(np.uint8 if centers <= 256 else np.int32)
    flat = flat.reshape(len(c), -1) if len(c) else flat.reshape(0, 1)
    sent = spark.sparkContext.broadcast(Csr.of(c.column("vec_id").to_numpy(), flat, g.column("src").to_numpy(), g.column("dst").to_numpy()))
    starts = entries.groupBy("qid").agg(F.collect_set("vec_id").alias("start"))
    work = luts.join(starts, "qid").select("qid", "lut", "start").repartition(max(1, spark.sparkContext.defaultParallelism))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for b in batches:
            out: list[tuple] = []
            for q, lut, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                out += one(q, np.array(lut).reshape(-1, centers), g.nodes(start), g)
            cols = list(zip(*out, strict=True)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(cols, schema, strict=True)], schema=schema)

    return work.mapInArrow(run, ddl)


def search_kernel(luts: DataFrame, entries: DataFrame, graph: DataFrame, codes: DataFrame, centers: int, p: Params, prefix: Prefix = Prefix(), limit_bytes: int = GRAPH_BYTES, decision: Decision | None = None) -> DataFrame:
    """qid, rank, vec_id, dist, expanded, visited, n_expanded, iterations per pool
    row, from the query-at-a-time kernel, ended early by a prefix stop or a learned
    stop. The graph (src, dst) and codes go to every task, so their size is checked
    first; beyond the limit search_rounds() gives the same rows, without learned stops."""
    if not fits(graph, codes, limit_bytes):
        if decision is not None:
            raise ValueError("learned stops need graph and codes within limit_bytes")
        return search_rounds(luts, entries, graph, codes, centers, p, prefix)
    schema = pa.schema([("qid", pa.int64()), ("rank", pa.int64()), ("vec_id", pa.int64()), ("dist", pa.float64()), ("expanded", pa.bool_()), ("visited", pa.int64()), ("n_expanded", pa.int64()), ("iterations", pa.int64())])

    def one(q: int, lut: np.ndarray, start: list[int], g: Csr) -> list[tuple]:
        watch = TraversalWatch(decision, p.top_k, p.top_l) if decision is not None else None
        pool, seen, n, r = search_one(lut, start, g, p, prefix, watch)
        return [(q, k + 1, int(g.ids[c[1]]), c[2], c[3], seen, n, r) for k, c in enumerate(pool)]

    return _kernel(luts, entries, graph, codes, centers, schema, "qid long, rank long, vec_id long, dist double, expanded boolean, visited long, n_expanded long, iterations long", one)


def search_checkpoints(luts: DataFrame, entries: DataFrame, graph: DataFrame, codes: DataFrame, centers: int, p: Params, stages: list[int], limit_bytes: int = GRAPH_BYTES) -> DataFrame:
    """qid, stage, prefix, the traversal features and label of every checkpoint of a
    full run: 1 exactly if the ordered top-k there differs from that of the end."""
    if not fits(graph, codes, limit_bytes):
        raise ValueError("checkpoints need graph and codes within limit_bytes")
    schema = pa.schema([("qid", pa.int64()), ("stage", pa.int64()), ("prefix", pa.int64()), *[(f, pa.float64()) for f in TRAVERSAL], ("label", pa.int64())])

    def one(q: int, lut: np.ndarray, start: list[int], g: Csr) -> list[tuple]:
        watch = TraversalWatch(Decision(tuple(stages)), p.top_k, p.top_l)
        pool = search_one(lut, start, g, p, Prefix(), watch)[0]
        end = [c[1] for c in pool[: p.top_k]]
        return [(q, n, x, *f, int(now != end)) for n, x, f, now in watch.rows]

    return _kernel(luts, entries, graph, codes, centers, schema, f"qid long, stage long, prefix long, {', '.join(f'{f} double' for f in TRAVERSAL)}, label long", one)


def stop_predicate(pool: DataFrame, top_l: int) -> DataFrame:
    """qid, valid, best_unexpanded_rank (from 0; null if none), done."""
    inside = F.col("rank") <= top_l
    d = pool.groupBy("qid").agg(F.count("*").alias("valid"), F.min(F.when(~F.col("expanded"), F.col("rank") - 1)).alias("best_unexpanded_rank"), F.count_if(inside & ~F.col("expanded")).alias("open"))
    return d.select("qid", "valid", "best_unexpanded_rank", ((F.col("valid") >= top_l) & (F.col("open") == 0)).alias("done"))
