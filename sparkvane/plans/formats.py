"""Queries that write tables as file sets of the binary formats, in tasks, into the
shared folder, and scan them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.functions.expr import r6
from sparkvane.operators import evaluate, pq, rerank, stops, traverse
from sparkvane.operators.models import RERANK
from sparkvane.plans.catalog import Q as Q_CATALOG
from sparkvane.plans.catalog import STAGES, _rerank_features
from sparkvane.plans.index import K, L, TILE, TOP, Index
from sparkvane.session import new_path
from sparkvane.sources import binary, files, pages

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Index(spark, sf_dir))

    Q[f.__name__] = run
    return f


def _through(i: Index, df: DataFrame, form: str, read: dict | None = None, **options) -> DataFrame:
    """df (vec_id and the format's columns) written and read back by the format."""
    files.register(i.spark)
    path = new_path(i.spark, form)
    files.write(df, form, path, partitions=8, **options)
    r = i.spark.read.format(form).option("path", path)
    for k, v in {**options, **(read or {})}.items():
        r = r.option(k, v)
    return r.load()


def _long(df: DataFrame, value, col: str = "vec") -> DataFrame:
    d = df.select("row", F.posexplode(col).alias("dim", "x"))
    return d.select(F.col("row").alias("vec_id"), F.col("dim").cast("long").alias("dim"), value(F.col("x")).alias("v"))


def _floats(i: Index) -> DataFrame:
    return i.base.select("vec_id", F.col("v").cast("array<float>").alias("vec"))


def _bytes(i: Index) -> DataFrame:
    """Vectors as unsigned bytes."""
    return i.base.select("vec_id", F.transform("v", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((x + 1) * 127.5).cast("double"))).cast("float")).alias("vec"))


def _rounded(x):
    return F.round(x.cast("double"), 6)


@query
def scan_fbin(i):
    return _long(_through(i, _floats(i), "fbin"), _rounded)


@query
def scan_bvecs(i):
    return _long(_through(i, _bytes(i), "bvecs"), lambda x: x.cast("long"))


@query
def scan_rawfloat(i):
    """The second half of the rows of a headerless file set."""
    half = i.points // 2
    d = _through(i, _floats(i), "rawfloat", {"start": half, "count": i.points - half}, dim=64)
    return _long(d, _rounded)


@query
def scan_vector_store(i):
    """bvecs read, packed into a page-aligned store of bytes, read back."""
    bytes_ = _through(i, _bytes(i), "bvecs").withColumnRenamed("row", "vec_id")
    return _long(_through(i, bytes_, "vector_store", kind="u8"), lambda x: x.cast("long"))


@query
def bvecs_to_fbin(i):
    bytes_ = _through(i, _bytes(i), "bvecs").withColumnRenamed("row", "vec_id")
    return _long(_through(i, bytes_, "fbin"), lambda x: x.cast("long"))


def _adjacency(i: Index) -> DataFrame:
    lists = i.graph.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "dst"))), lambda x: x["dst"]).alias("neighbors"))
    return i.base.select("vec_id").join(lists, F.col("vec_id") == F.col("src"), "left").select("vec_id", "neighbors")


def _edges(df: DataFrame) -> DataFrame:
    d = df.select(F.col("row").alias("src"), F.posexplode("neighbors").alias("slot", "dst"))
    return d.select("src", (F.col("slot") + 1).cast("long").alias("slot"), "dst")


@query
def scan_topology(i):
    return _edges(_through(i, _adjacency(i), "topology"))


@query
def scan_topology_subset(i):
    """Neighbours of the first half of the nodes, without ids of the other half."""
    half = i.points // 2
    return _edges(_through(i, _adjacency(i), "topology", {"start": 0, "count": half, "points": half}))


@query
def scan_disk_graph(i):
    """Vectors and neighbours out of the sectors of a disk graph index."""
    nodes = _floats(i).join(_adjacency(i), "vec_id").select("vec_id", "vec", "neighbors")
    d = _through(i, nodes, "disk_graph")
    return d.select(F.col("row").alias("vec_id"), F.size("neighbors").cast("long").alias("degree"), F.element_at("neighbors", 1).alias("nearest"), _rounded(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)).alias("sum_v"))


@query
def scan_combined_nodes(i):
    nodes = _floats(i).join(_adjacency(i), "vec_id").select("vec_id", "vec", "neighbors")
    d = _through(i, nodes, "combined_nodes", dim=64)
    return d.select(F.col("row").alias("vec_id"), F.explode("neighbors").alias("neighbor"), _rounded(F.element_at("vec", 1)).alias("first_v"))


@query
def scan_pq(i):
    """Pivots of 256 centers (the first 256 vectors) written as a codebook file and read back."""
    book = pq.first_centers(pq.subvectors(i.base), 0, 256).select((F.col("chunk") * 256 + F.col("center")).alias("vec_id"), "chunk", "center", F.col("pivot").cast("array<float>").alias("pivot"))
    files.register(i.spark)
    path = new_path(i.spark, "pq_pivots")
    files.write(book, "pq_pivots", path, partitions=1)
    d = i.spark.read.format("pq_pivots").option("path", path).load()
    return d.select("chunk", "center", F.posexplode("pivot").alias("p", "x")).select("chunk", "center", F.col("p").cast("long").alias("dim"), _rounded(F.col("x")).alias("v"))


def _codes(df: DataFrame, value: str, name: str) -> DataFrame:
    d = df.select(F.col("row").alias("vec_id"), F.posexplode(value).alias("chunk", name))
    return d.select("vec_id", F.col("chunk").cast("long").alias("chunk"), F.col(name).cast("long").alias(name) if name == "center" else name)


@query
def scan_pq_codes(i):
    return _codes(_through(i, i.coded.select("vec_id", "code"), "pq_codes"), "code", "center")


@query
def pq_code_slice(i):
    """The codes of the first half of the rows."""
    return _codes(_through(i, i.coded.select("vec_id", "code"), "pq_codes", {"start": 0, "count": i.points // 2}), "code", "center")


@query
def scan_residual_pq(i):
    """Residual codes and their error bounds, loaded together; both must have a row for each vector."""
    codes = _through(i, i.coded.select("vec_id", F.col("res_code").alias("code")), "pq_codes")
    bounds = _through(i, i.coded.select("vec_id", F.array(F.col("bound").cast("float")).alias("bound")), "error_bounds")
    return load_residual(codes, bounds).select(F.col("row").alias("vec_id"), F.element_at("code", 1).cast("long").alias("first_center"), r6(F.col("err")).alias("err"))


def load_residual(codes: DataFrame, bounds: DataFrame) -> DataFrame:
    """row, code, err: codes with their bounds; a row that one side lacks is an error."""
    d = codes.withColumnRenamed("row", "a").join(bounds.withColumnRenamed("row", "b"), F.col("a") == F.col("b"), "full")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    row = F.when(ok, F.col("a")).otherwise(F.raise_error(F.lit("codes and error bounds differ in rows")).cast("long"))
    return d.select(row.alias("row"), "code", F.element_at("bound", 1).cast("double").alias("err"))


@query
def scan_hpq(i):
    """Hybrid codes with their selector bits, as file sets."""
    codes = _through(i, i.coded.select("vec_id", F.zip_with(F.zip_with("code", "out_code", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), "use_outlier", lambda c, o: F.when(o, c["b"]).otherwise(c["a"])).alias("code")), "pq_codes")
    sel = _through(i, i.coded.select("vec_id", "use_outlier"), "selectors", chunks=8)
    both = codes.join(sel, "row").select(F.col("row").alias("vec_id"), F.arrays_zip("code", "use_outlier").alias("z"))
    return both.select("vec_id", F.posexplode("z").alias("chunk", "c")).select("vec_id", F.col("chunk").cast("long").alias("chunk"), F.col("c.code").cast("long").alias("code"), F.col("c.use_outlier").alias("use_outlier"))


@query
def scan_truth(i):
    """Ground truth with distances, as a file set."""
    rows = i.truth.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "dist"))).alias("r"))
    rows = rows.select(F.col("qid").alias("vec_id"), F.transform("r", lambda x: x["vec_id"].cast("int")).alias("vec"), F.transform("r", lambda x: x["dist"].cast("float")).alias("dists"))
    d = _through(i, rows, "ann_truth")
    d = d.select("row", F.posexplode(F.arrays_zip("vec", "dists")).alias("p", "x"))
    return d.select(F.col("row").alias("query_no"), (F.col("p") + 1).cast("long").alias("rank"), F.col("x.vec").cast("long").alias("vec_id"), _rounded(F.col("x.dists")).alias("dist"))


@query
def page_trace_depths(i):
    """The pages that reranking asks for, as a trace file set, replayed into a histogram of how often a page comes."""
    at = F.row_number().over(evaluate.Window.partitionBy("qid").orderBy("rank"))
    trace = i.pool.select((F.col("qid") * L + at).alias("vec_id"), F.floor(F.col("vec_id") / 16).cast("long").alias("page"))
    return evaluate.trace_depths(_through(i, trace, "page_trace"))


@query
def stop_trace(i):
    """Stop prefixes recorded in a trace, read back and replayed."""
    pool = rerank.with_vectors(i.pool.select("qid", "vec_id", "rank"), i.base, i.queries)
    plan = rerank.Plan(L, TILE, 4, patience=1, min_prefix=8)
    runs = rerank.persistent_runs(pool.withColumn("lb", F.col("exact")), plan)
    d = _through(i, runs.select(F.col("qid").alias("vec_id"), F.col("prefix").alias("stop_prefix")), "stop_trace")
    order = i.queries.select("qid", (F.row_number().over(evaluate.Window.orderBy("qid")) - 1).cast("long").alias("row"))
    return d.join(order, "row").select("qid", "stop_prefix")


# -- reports -------------------------------------------------------------------------
def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _csv_back(i: Index, df: DataFrame, what: str) -> DataFrame:
    path = new_path(i.spark, what)
    csv(df, path)
    return i.spark.read.schema(df.schema).option("header", True).csv(path)


@query
def rerank_stop_csv(i):
    """The rerank features of each checkpoint as CSV, and back."""
    d = _rerank_features(i, STAGES)
    d = stops.rerank_labels(d, i.refined_pool, TOP)
    return _csv_back(i, d.withColumns({f: r6(F.col(f)) for f in RERANK}), "rerank-stop-csv")


@query
def traversal_stop_csv(i):
    """The traversal checkpoints as CSV, and back."""
    return _csv_back(i, Q_CATALOG["stop_dataset"](i.spark, i.sf_dir), "traversal-stop-csv")


@query
def expanded_frequency_csv(i):
    """How often each node is expanded, over all queries, as CSV and back."""
    pool = traverse.search_kernel(i.wide_lut, i.entries, i.graph, i.wide_codes, K, i.params)
    return _csv_back(i, pool.where("expanded").groupBy("vec_id").agg(F.count("*").alias("n")), "frequency-csv")


@query
def truth_rank_report(i):
    """found, not found, least, greatest and average rank of the truth, before and after refinement, as JSON."""
    a = evaluate.rank_report(i.pool, i.truth).withColumn("stage", F.lit("before"))
    b = evaluate.rank_report(rerank.resort(i.pool, i.refined), i.truth).withColumn("stage", F.lit("after"))
    return a.unionByName(b).select("stage", F.to_json(F.struct("found", "not_found", "min", "max", "sum")).alias("report"))


@query
def subset_manifest(i):
    """Builds the subset of the first half of all nodes (vectors, codes, filtered
    topology, each a file set) and returns its manifest as JSON."""
    half = i.points // 2
    few = F.col("vec_id") < half
    store = _through(i, _floats(i).where(few), "vector_store")
    codes = _through(i, i.coded.select("vec_id", "code").where(few), "pq_codes")
    topo = _through(i, _adjacency(i).where(few), "topology", {"points": half})
    n = store.agg(F.count("*").alias("vectors"), F.max(F.size("vec")).cast("long").alias("dim"))
    c = codes.agg(F.count("*").alias("codes"), F.max(F.size("code")).cast("long").alias("chunks"))
    e = topo.agg(F.sum(F.size("neighbors")).cast("long").alias("edges"))
    return n.join(c, how="cross").join(e, how="cross").select(F.to_json(F.struct("vectors", "dim", "codes", "chunks", "edges")).alias("manifest"))


@query
def run_rates(i):
    """Rates of a rerank run over a stated time (250 ms): queries a second, GB of 4 KB pages a second."""
    asked = i.pool.where("rank <= 16").agg(F.count_distinct("qid").alias("n"), F.count("*").alias("pages"))
    return evaluate.rates(asked.withColumn("ms", F.lit(250.0))).select(r6(F.col("qps")).alias("qps"), r6(F.col("gb_s")).alias("gb_s"))
