"""One query for each operator: its result over the whole embeddings table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkvane.functions.expr import logit, near, nearest_rank, norm_sq, page_address, r6, top
from sparkvane.operators import engine, evaluate, pq, rerank, rvq, stops, train, traverse
from sparkvane.operators.models import RERANK, TRAVERSAL, Decision, StopModel
from sparkvane.plans.index import ANN_CENTERS, COARSE, FINE, K, L, N, TILE, TOP, WIDTH, Index
from sparkvane.session import new_path

PER_PAGE = 16
SWEEP = [(0.90, 1000.0), (0.95, 800.0), (0.95, 700.0), (0.97, 800.0), (0.99, 300.0), (0.99, 350.0), (1.0, 100.0)]
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Index(spark, sf_dir))

    Q[f.__name__] = run
    return f


def dist_out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("qid", "rank", "vec_id", r6(F.col("dist")).alias("dist"), *more)


# -- vectors ---------------------------------------------------------------
@query
def topk_exact(i):
    return dist_out(i.truth)


@query
def topk_limit(i):
    return dist_out(i.adc.where(F.col("rank") <= TOP))


@query
def exact_l2(i):
    """Exact distances of the candidates of every query."""
    return rerank.with_vectors(i.pool.select("qid", "vec_id"), i.base, i.queries, "dist").select("qid", "vec_id", r6(F.col("dist")).alias("dist"))


@query
def query_norm(i):
    return i.queries.select("qid", r6(norm_sq("qv")).alias("norm_sq"))


@query
def vector_lookup(i):
    return i.base.where(F.col("vec_id").isin(3, 77, 421)).select("vec_id", F.posexplode("v").alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("v"))


@query
def page_address_(i):
    return i.base.select("vec_id", *page_address("vec_id", PER_PAGE))


Q["page_address"] = Q.pop("page_address_")


@query
def page_fetch(i):
    pages = i.pool.select(page_address("vec_id", PER_PAGE)[0]).distinct()
    d = i.base.select(page_address("vec_id", PER_PAGE)[0], F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("s"))
    return d.join(pages, "page_id", "left_semi").groupBy("page_id").agg(F.count("*").alias("n_vectors"), r6(F.sum("s")).alias("sum_v"))


@query
def combined_node_lookup(i):
    g = i.graph.withColumn("degree", F.count("*").over(Window.partitionBy("src")))
    return i.base.select("vec_id").join(g, F.col("vec_id") == F.col("src")).select("vec_id", "degree", F.col("dst").alias("neighbor"), "slot")


@query
def scan_graph(i):
    return i.graph.select("src", "slot", "dst")


@query
def graph_subset_filter(i):
    keep = F.col("dst") < F.lit(i.points // 2)
    return i.graph.groupBy("src").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


@query
def verify_sample(i):
    d = i.base.where("vec_id % 37 = 0").select("vec_id", "v")
    back = d.select("vec_id", F.posexplode("v").alias("p", "x")).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("w"))
    return d.join(back, "vec_id").select("vec_id", (F.col("v") == F.col("w")).alias("ok"))


# -- product quantization ------------------------------------------------------
@query
def pq_encode(i):
    return i.codes.select("vec_id", "chunk", "center", r6(F.col("err")).alias("err"))


@query
def pq_lut(i):
    return i.lut.select("qid", "chunk", "center", r6(F.col("d")).alias("d"))


@query
def pq_adc(i):
    return i.adc.select("qid", "vec_id", r6(F.col("dist")).alias("dist"))


def _dims(df: DataFrame, col) -> DataFrame:
    return df.select("vec_id", F.posexplode(col).alias("p", "x")).select("vec_id", F.col("p").cast("long").alias("dim"), r6(F.col("x")).alias("v"))


@query
def pq_reconstruct(i):
    return _dims(i.coded, "approx")


@query
def pq_residual(i):
    return _dims(i.base.join(i.coded.select("vec_id", "approx"), "vec_id"), F.zip_with("v", "approx", lambda a, b: a - b))


@query
def residual_pq_encode(i):
    return pq.by_chunk(i.coded, center="res_code").withColumn("center", F.col("center").cast("long"))


@query
def residual_error(i):
    return i.errors.select("vec_id", r6(F.col("err")).alias("err"))


@query
def pq_cross_terms(i):
    return i.cross.select("chunk", "base_center", "res_center", r6(F.col("x")).alias("x"))


@query
def lower_bound(i):
    return i.refined_pool.select("qid", "vec_id", r6(F.col("lb")).alias("lb"), r6(F.col("exact")).alias("exact"), (F.col("lb") <= F.col("exact") + 1e-9).alias("safe"))


@query
def hpq_outlier_select(i):
    return pq.outlier_rows(i.codes, K, 0.2).select("chunk", "vec_id", r6(F.col("err")).alias("err"))


@query
def hpq_encode(i):
    d = pq.by_chunk(i.coded, base="code", out="out_code", use_outlier="use_outlier")
    return d.select("vec_id", "chunk", F.when(F.col("use_outlier"), F.col("out")).otherwise(F.col("base")).cast("long").alias("code"), "use_outlier")


def _centers(df: DataFrame) -> DataFrame:
    d = df.select("center", "members", F.posexplode("pivot").alias("dim", "x"))
    return d.select("center", F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("v"), "members")


def _start(i: Index) -> DataFrame:
    return i.base.where(F.col("vec_id") < K).select(F.col("vec_id").alias("center"), F.col("v").alias("pivot"))


@query
def kmeans_step(i):
    return _centers(pq.lloyd(i.base, _start(i)))


@query
def kmeans_fit(i):
    """25 rounds from the first rows, the centers of least error."""
    return _centers(train.fit_kmeans(i.base, K))


@query
def kmeans_converged(i):
    """Rounds until no vector changes its center."""
    return _centers(train.fit_kmeans(i.base, K, None))


def _book(df: DataFrame) -> DataFrame:
    d = df.select("chunk", "center", F.posexplode("pivot").alias("dim", "x"))
    return d.select("chunk", "center", F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("v"))


@query
def pq_train(i):
    """15 rounds per chunk from the first rows, the centers of least error."""
    return _book(train.fit_chunks(pq.subvectors(train.sample(i.base)), K))


@query
def hpq_train(i):
    """The outlier codebook, trained on the rows of largest error per chunk."""
    return _book(train.fit_outliers(pq.subvectors(i.base), i.codes, K, 0.2, K))


@query
def residual_train(i):
    """The residual codebook, trained on the residuals of the base codes."""
    rest = i.base.join(i.coded.select("vec_id", "approx"), "vec_id").select("vec_id", F.zip_with("v", "approx", lambda a, b: a - b).alias("v"))
    return _book(train.fit_chunks(pq.subvectors(train.sample(rest)), K))


# -- two-level quantizer ---------------------------------------------------------
@query
def coarse_assign(i):
    return rvq.coarse_assign(i.base, i.coarse).select("vec_id", "coarse_id", r6(F.col("dist")).alias("dist"))


@query
def rvq_search(i):
    return i.found_clusters


@query
def rvq_build(i):
    return i.assigned.select("vec_id", "cluster_id", r6(F.col("score")).alias("score"))


@query
def cluster_sizes(i):
    return i.sizes


@query
def entry_postings(i):
    return rvq.postings(i.assigned)


@query
def entry_points(i):
    return rvq.entry_points(i.found_clusters, rvq.postings(i.assigned), 8)


@query
def rvq_train(i):
    """10 alternations of 25 rounds, the codebooks of least fine error."""
    return train.fit_rvq(i.base, COARSE, FINE).select("level", "center", F.posexplode("pivot").alias("dim", "v"))


# -- traversal -----------------------------------------------------------------
@query
def search_seed(i):
    return dist_out(i.seeded)


def _first(i: Index):
    chosen = traverse.select(i.seeded, L, WIDTH)
    return chosen, traverse.expand(chosen, i.graph)


@query
def expand_neighbors(i):
    return _first(i)[1]


@query
def frontier_unvisited(i):
    return traverse.unvisited(_first(i)[1], i.entries)


@query
def pool_merge(i):
    new = i.scorer(traverse.unvisited(_first(i)[1], i.entries)).withColumn("expanded", F.lit(False))
    return dist_out(traverse.merge(i.seeded, new, L), "expanded")


@query
def beam_round(i):
    return dist_out(traverse.rounds(i.entries, i.graph, i.scorer, i.params, 1), "expanded")


@query
def beam_search(i):
    return dist_out(traverse.rounds(i.entries, i.graph, i.scorer, i.params, 2), "expanded")


@query
def beam_search_full(i):
    pool, _ = traverse.traverse(i.entries, i.graph, i.scorer, i.params)
    return dist_out(pool, "expanded")


@query
def beam_search_kernel(i):
    return dist_out(i.searched, "expanded")


@query
def uncached_requests(i):
    chosen = traverse.select(i.seeded, L, WIDTH)
    return chosen.select("qid", "vec_id", (F.col("vec_id") < F.lit(i.points // 2)).alias("cached"))


@query
def stop_predicate(i):
    return traverse.stop_predicate(traverse.rounds(i.entries, i.graph, i.scorer, i.params, 1), L)


@query
def gt_visited(i):
    visited = i.entries.select("qid", "vec_id").unionByName(_first(i)[1]).distinct().withColumn("hit", F.lit(True))
    d = i.truth.select("qid", F.col("rank").alias("gt_rank"), "vec_id").join(visited, ["qid", "vec_id"], "left")
    return d.select("qid", "gt_rank", F.coalesce("hit", F.lit(False)).alias("visited"))


# -- refinement and reranking ----------------------------------------------------
@query
def pq2_refine(i):
    codes = pq.encode(i.base, pq.load(i.outlier_book)).select("vec_id", "code")
    d = traverse.Scorer(codes, pq.wide_lut(pq.lut(i.queries, i.outlier_book)), K)(i.pool.select("qid", "vec_id"))
    return dist_out(rerank.resort(i.pool, d))


@query
def residual_refine(i):
    return dist_out(rerank.resort(i.pool, i.refined))


@query
def hpq_refine(i):
    return dist_out(rerank.resort(i.pool, i.hybrid))


@query
def refine_input_stats(i):
    n = i.pool.groupBy("qid").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("total"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


@query
def rerank_exact(i):
    return dist_out(rerank.exact(i.pool, i.base, i.queries, N, TOP))


@query
def rerank_io_pages(i):
    d = i.pool.where(F.col("rank") <= N).select(page_address("vec_id", PER_PAGE)[0])
    return d.agg(F.count_distinct("page_id").alias("unique_pages"), F.count("*").alias("exact_count"))


@query
def bound_filter(i):
    d = rerank.bound_filter(i.refined_pool.where(F.col("rank") <= N), 12, TOP)
    return d.select("qid", "vec_id", r6(F.col("lb")).alias("lb"), "kept")


def _tiled(i: Index) -> DataFrame:
    return rerank.bound_filter_tiled(i.refined_pool, L, 8, TOP)


@query
def bound_filter_tiled(i):
    return _tiled(i).groupBy("qid").agg(F.count_if("kept").alias("exact_count"), F.count_if(~F.col("kept")).alias("filtered_count"))


@query
def bound_safety(i):
    gone = ~F.col("kept")
    return _tiled(i).groupBy("qid").agg(F.count_if("kept").alias("exact_count"), F.count_if(gone).alias("filtered_count"), F.coalesce(F.min(F.when(gone, F.col("rank"))), F.lit(0)).alias("first_filtered_rank"),
                                         F.count_if(gone & (near(F.col("exact")) < near(F.col("threshold")))).alias("violations"))


@query
def bound_stats(i):
    d = i.refined_pool.withColumn("gap", F.col("exact") - F.col("lb"))
    out = evaluate.running(d, "lb", "lb").unionByName(evaluate.running(d, "gap", "gap"))
    return out.select("metric", "count", *[r6(F.col(c)).alias(c) for c in ("min", "max", "avg")])


@query
def exact_reuse(i):
    known = rerank.with_vectors(i.pool.where("rank % 2 = 1").select("qid", "vec_id"), i.base, i.queries, "dist")
    return rerank.reused(i.pool.where(F.col("rank") <= N), known, i.base, i.queries).select("qid", "vec_id", r6(F.col("dist")).alias("dist"), "reused")


@query
def reuse_profile(i):
    pool = traverse.rounds(i.entries, i.graph, i.scorer, i.params, 1)
    return evaluate.reuse_profile(pool, [0.25, 0.5], [8, 16, 32], i.points)


def _exact_pool(i: Index) -> DataFrame:
    return rerank.with_vectors(i.pool.select("qid", "vec_id", "rank"), i.base, i.queries)


def _stops(i: Index, pool: DataFrame) -> DataFrame:
    return rerank.early_stop(rerank.tile_kth(pool, L, TILE, 4), L, 8, 1)


@query
def rerank_early_stop(i):
    return _stops(i, _exact_pool(i))


@query
def rerank_replay(i):
    pool = _exact_pool(i)
    return dist_out(rerank.replay(pool, _stops(i, pool), TOP))


@query
def rerank_persistent(i):
    return dist_out(rerank.persistent(i.refined_pool, L, 8, TOP))


@query
def rerank_linear(i):
    return dist_out(rerank.linear(i.pool, i.base, i.queries, TOP))


@query
def rerank_sweep(i):
    sizes = F.explode(F.array(*[F.lit(n).cast("long") for n in (8, 16, 32)])).alias("top_n")
    d = _exact_pool(i).select("*", sizes).where("rank <= top_n").select("top_n", "qid", "vec_id", F.col("exact").alias("dist"))
    return top(d, ["top_n", "qid"], TOP).select("top_n", "qid", "rank", "vec_id", r6(F.col("dist")).alias("dist"))


@query
def rerank_modes(i):
    """Every mode of the rerank over the refined pool; bounds are safe, so all give the exact top."""
    out = []
    for mode in ("host", "linear", "tiled", "page_by_page", "persistent"):
        filtered = mode not in ("host", "linear")
        p = engine.RerankParams(L, TOP, mode, refine=filtered, bound_filter=filtered)
        out.append(engine.run(i.refined_pool.select("qid", "rank", "vec_id", "lb"), i.base, i.queries, p).withColumn("mode", F.lit(mode)))
    return dist_out(reduce(DataFrame.unionByName, out), "mode")


@query
def rerank_replay_persistent(i):
    """Recorded stop prefixes replayed by the persistent rerank."""
    pool = _exact_pool(i).withColumn("lb", F.col("exact"))
    p = engine.RerankParams(L, TOP, "persistent", refine=True, bound_filter=True, replay=True)
    stops_ = _stops(i, pool.drop("lb")).select("qid", F.greatest(F.col("stop_prefix"), F.lit(TOP)).alias("stop_prefix"))
    return dist_out(engine.run(pool.select("qid", "rank", "vec_id", "lb"), i.base, i.queries, p, stops_))


def _scalar_distances(i: Index, kind: str) -> DataFrame:
    base = i.base.select("vec_id", engine.as_scalar("v", kind).alias("v"))
    q = i.queries.select("qid", engine.as_scalar("qv", kind).alias("qv"))
    return rerank.exact(i.pool, base, q, N, TOP).withColumn("kind", F.lit(kind))


@query
def rerank_exact_scalars(i):
    """Exact rerank on vectors and queries of unsigned and of signed bytes."""
    return dist_out(_scalar_distances(i, "u8").unionByName(_scalar_distances(i, "i8")), "kind")


@query
def entry_providers(i):
    """Entries of every kind of provider: fixed, per query, from the quantizer."""
    per_query = i.truth.select("qid", F.col("rank").alias("pos"), "vec_id")
    kinds = (("fixed", engine.fixed_entries(i.queries, [300, 100, 200], 2)), ("per_query", engine.query_entries(i.queries, per_query, 3)), ("quantizer", rvq.entry_points(i.found_clusters, rvq.postings(i.assigned), 4)))
    return reduce(DataFrame.unionByName, [d.select("qid", "pos", "vec_id", F.lit(k).alias("provider")) for k, d in kinds])


@query
def snapshot_diff(i):
    """What the second round of a traversal changes: rows of one snapshot that the other lacks, both ways."""
    one, two = (traverse.rounds(i.entries, i.graph, i.scorer, i.params, n).select("qid", "rank", "vec_id", "expanded") for n in (1, 2))
    diff = one.exceptAll(two).withColumn("side", F.lit("only_before")).unionByName(two.exceptAll(one).withColumn("side", F.lit("only_after")))
    return diff.groupBy("qid", "side").agg(F.count("*").alias("n"))


@query
def stage_lookup(i):
    """The stage whose range of ranks holds a candidate."""
    return i.pool.groupBy("qid", engine.stage_of(F.col("rank"), STAGES).alias("stage")).agg(F.count("*").alias("n"))


@query
def rvq_model(i):
    """Both levels of the quantizer saved by level, loaded again."""
    both = i.coarse.withColumn("level", F.lit("coarse")).unionByName(i.fine.withColumn("level", F.lit("fine")))
    return rvq.load(i.spark, rvq.save(both, new_path(i.spark, "rvq-model"))).select("level", "center", F.posexplode("pivot").alias("dim", "x")).select("level", "center", F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("v"))


@query
def cache_sizes(i):
    """Nodes that topology caches of some sizes in GiB hold, and the requests they answer."""
    sizes = evaluate.cached_by_size(i.points, [0.00001, 0.00005, 1.0], 256)
    return evaluate.cache_hits(i.pool, i.spark.createDataFrame(sizes, "gib double, cached_nodes long"))


# -- learned stops ---------------------------------------------------------------
STAGES = [10, 12, 14, 16]
#: A stop model over all 13 rerank features, in their order: weights, bias.
RERANK_W = dict(zip(RERANK, (0.05, -1.0, -6.0, 2.0, 1.0, 0.5, 1.5, 1.5, 1.0, -0.5, 0.25, -0.25, 0.5), strict=True))
RERANK_BIAS = 0.6
BOOTSTRAP = 10
TRAVERSAL_STAGES = [10, 16, 24]


def _rerank_features(i: Index, stages: list[int]) -> DataFrame:
    return stops.rerank_features(i.refined_pool, stages, TOP, L, TILE)


def _rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


@query
def stop_features(i):
    return _rounded(_rerank_features(i, STAGES), RERANK)


@query
def rerank_stop_logit(i):
    x = logit(RERANK_BIAS, RERANK_W)
    return _rerank_features(i, STAGES).select("qid", "stage", r6(x).alias("logit"), (r6(x) < 0).alias("stop"))


@query
def rerank_learned_stop(i):
    """The persistent rerank ended by the model: windows up to the bootstrap prefix, then from stage to stage."""
    decision = Decision(tuple(STAGES), tuple(RERANK_W.values()), RERANK_BIAS)
    runs = rerank.persistent_runs(i.refined_pool, rerank.Plan(L, TILE, TOP, decision=decision, bootstrap=BOOTSTRAP))
    return runs.select("qid", F.col("prefix").alias("stop_prefix"))


@query
def rerank_stop_dataset(i):
    d = _rerank_features(i, stops.rerank_ladder(TOP, L))
    return _rounded(stops.rerank_labels(d, i.refined_pool, TOP), RERANK)


@query
def stop_dataset(i):
    """Every checkpoint of a full traversal: the 12 features, and whether the top must still change."""
    d = traverse.search_checkpoints(i.wide_lut, i.entries, i.graph, i.wide_codes, K, i.params, TRAVERSAL_STAGES)
    return _rounded(d, TRAVERSAL)


@query
def stop_logit(i):
    """A model is fitted on the checkpoints, written as text, read back and applied."""
    d = traverse.search_checkpoints(i.wide_lut, i.entries, i.graph, i.wide_codes, K, i.params, TRAVERSAL_STAGES)
    m = StopModel.parse(_fitted(i, d).text())
    w, b = m.folded()
    x = logit(b, dict(zip(TRAVERSAL, w, strict=True)))
    return d.select("qid", "stage", "label", r6(x).alias("logit"), (x < m.threshold(L)).alias("stop"))


def _fitted(i: Index, dataset: DataFrame) -> StopModel:
    return stops.fit(dataset, list(TRAVERSAL), TRAVERSAL_STAGES)


@query
def beam_search_learned_stop(i):
    """The traversal ended by a model fitted on its own checkpoints."""
    d = traverse.search_checkpoints(i.wide_lut, i.entries, i.graph, i.wide_codes, K, i.params, TRAVERSAL_STAGES)
    pool = traverse.search_kernel(i.wide_lut, i.entries, i.graph, i.wide_codes, K, i.params, decision=Decision.of(_fitted(i, d), L))
    return dist_out(pool, "expanded", "n_expanded")


@query
def beam_search_prefix(i):
    """The traversal ended once its first 16 candidates are all expanded."""
    return dist_out(traverse.search_kernel(i.wide_lut, i.entries, i.graph, i.wide_codes, K, i.params, traverse.Prefix(16, "candidates")), "expanded")


# -- evaluation ------------------------------------------------------------------
@query
def recall_at_k(i):
    return evaluate.recall(i.adc.where(F.col("rank") <= TOP), i.truth, TOP).select(r6(F.col("recall")).alias("recall"))


@query
def overlap_thresholds(i):
    return evaluate.overlap(i.adc, i.truth, [10, 20, 50, 100])


@query
def pq_rerank_overlap(i):
    return evaluate.overlap(rerank.resort(i.pool, i.hybrid), i.truth, [10, 20, 32]).select("threshold", "matched")


@query
def gt_rank_hist(i):
    a = evaluate.truth_ranks(i.pool, i.truth).withColumn("stage", F.lit("before"))
    b = evaluate.truth_ranks(rerank.resort(i.pool, i.refined), i.truth).withColumn("stage", F.lit("after"))
    return a.unionByName(b).select("stage", "rank", "n")


def _found(i: Index) -> DataFrame:
    """qid, n: truth ids within the pool."""
    d = i.truth.select("qid", "vec_id").join(i.pool.select("qid", "vec_id", "rank"), ["qid", "vec_id"], "left")
    return d.groupBy("qid").agg(F.count("rank").alias("n"), F.max("rank").alias("deepest"))


@query
def iteration_summary(i):
    return _found(i).agg(r6(F.avg("n")).alias("avg"), nearest_rank(0.5, "n").cast("long").alias("p50"), nearest_rank(0.95, "n").cast("long").alias("p95"), F.max("n").alias("max"))


@query
def hist_quantile(i):
    d = i.pool.groupBy("vec_id").agg(F.count("*").alias("depth"))
    return evaluate.hist_quantile(d, [0.5, 0.9, 0.99, 1.0])


@query
def hotset_coverage(i):
    n = i.pool.groupBy("vec_id").agg(F.count("*").alias("n"))
    return evaluate.hotset(n, [1, 5, 10, 20, 30, 50]).select("pct", r6(F.col("cumulative_pct")).alias("cumulative_pct"))


@query
def hotset_events(i):
    n = i.spark.read.parquet(f"{i.sf_dir}/events.parquet").where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n"))
    return evaluate.hotset(n, [1, 5, 10, 20, 30, 50]).select("pct", r6(F.col("cumulative_pct")).alias("cumulative_pct"))


@query
def pareto_frontier(i):
    return evaluate.pareto(i.spark.createDataFrame(SWEEP, "recall double, qps double"))


@query
def batch_plan(i):
    return i.spark.createDataFrame(evaluate.batch_plan(103, 20), "batch_id long, query_offset long, num_queries long")


@query
def cache_sweep(i):
    return evaluate.cache_sweep(i.pool, [0.1, 0.25, 0.5, 0.75, 1.0], i.points)


@query
def run_metrics(i):
    pool = traverse.rounds(i.entries, i.graph, i.scorer, i.params, 1)
    visited = i.entries.select("qid", "vec_id").unionByName(_first(i)[1]).distinct().groupBy("qid").agg(F.count("*").alias("visited"))
    d = pool.groupBy("qid").agg(F.count_if("expanded").alias("expanded"), F.count_if(F.col("rank") <= N).alias("exact"),
                                F.count_distinct(F.when(F.col("rank") <= N, F.floor(F.col("vec_id") / PER_PAGE))).alias("pages")).join(visited, "qid")
    return d.agg(*[r6(F.avg(c)).alias(f"avg_{c}") for c in ("visited", "expanded", "exact", "pages")])


@query
def result_checksum(i):
    """FNV-1a over each query's ids in order, queries combined in any order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"])
    h = F.aggregate(ids, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619) % 4294967296)
    return i.truth.groupBy("qid").agg(h.alias("h")).agg(F.bit_xor("h").alias("checksum"))


@query
def ann_search(i):
    """Entries from the trained two-level quantizer, kernel traversal over the trained
    256-center codes, exact rerank of the whole pool. Recall@10 against brute force is
    a test (at least 0.9)."""
    p = traverse.Params(TOP, 512, WIDTH)
    pool = traverse.search_kernel(i.ann_lut, i.trained_entries, i.graph, i.ann_codes, ANN_CENTERS, p)
    return dist_out(rerank.exact(pool, i.base, i.queries, p.top_l, TOP))
