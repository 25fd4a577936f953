"""The index that all search queries share, built lazily from the embeddings."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.functions.expr import norm_sq, ranked
from sparkvane.operators import pq, rerank, rvq, train, traverse, vectors
from sparkvane.session import delete, kept, stamp

K, R, L, N, TOP, WIDTH, TILE = 16, 16, 32, 16, 10, 4, 4
COARSE, FINE = 4, 4
ENTRY_IDS = (100, 200, 300)
#: ADC candidates kept per query; everything downstream reads no deeper.
DEEPEST = 100
#: Of the search that trains its own codebooks.
ANN_CENTERS, ANN_COARSE, ANN_FINE = 256, 16, 16

_built: dict[tuple[str, str, str], tuple[str, DataFrame, str]] = {}
_held: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """Pools (at most DEEPEST rows a query) that one query reads several times."""
    _held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


class Index:
    """Pools hold at most L rows a query and are kept once computed.

    Codebooks of the single-operator queries come from the first rows, so that SQL can
    follow every table: base centers ids 0..15, residual centers ids 16..31, outlier
    centers ids 32..47, coarse centers ids 0..3, fine centers the residuals of ids
    4..7. The whole search trains its own (train.py)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def built(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table of the offline index, written to the shared folder once for each
        state of the embeddings; an older state's table is deleted."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        now = stamp(self.spark, f"{self.sf_dir}/embeddings.parquet")
        if key not in _built or _built[key][0] != now:
            if key in _built:
                delete(self.spark, _built.pop(key)[2])
            _built[key] = (now, *kept(make(), name))
        return _built[key][1]

    @staticmethod
    def release(spark: SparkSession) -> None:
        """Delete all tables built in this session and let go of all pools held."""
        while _held:
            _held.pop().unpersist()
        for key in [k for k in _built if k[0] == spark.sparkContext.applicationId]:
            delete(spark, _built.pop(key)[2])

    @cached_property
    def base(self) -> DataFrame:
        return vectors.base(self.spark, self.sf_dir)

    @cached_property
    def queries(self) -> DataFrame:
        return vectors.queries(self.base)

    @cached_property
    def points(self) -> int:
        return self.base.count()

    @cached_property
    def subs(self) -> DataFrame:
        return pq.subvectors(self.base)

    @cached_property
    def book(self) -> DataFrame:
        return pq.first_centers(self.subs, 0, K)

    @cached_property
    def arrays(self) -> pq.Book:
        return pq.load(self.book)

    @cached_property
    def coded(self) -> DataFrame:
        """vec_id, code, err, approx, res_code, bound, out_code, use_outlier."""
        return self.built("coded", lambda: pq.encode(self.base, self.arrays, pq.load(self.res_book), pq.load(self.outlier_book)))

    @cached_property
    def codes(self) -> DataFrame:
        return pq.by_chunk(self.coded, center="code", err="err").withColumn("center", F.col("center").cast("long"))

    @cached_property
    def wide_codes(self) -> DataFrame:
        return self.coded.select("vec_id", "code")

    @cached_property
    def lut(self) -> DataFrame:
        return pq.lut(self.queries, self.book)

    @cached_property
    def wide_lut(self) -> DataFrame:
        return pq.wide_lut(self.lut)

    @cached_property
    def adc(self) -> DataFrame:
        """The DEEPEST nearest codes of every query."""
        return held(pq.adc_topk(self.wide_codes, self.wide_lut, K, DEEPEST))

    @cached_property
    def pool(self) -> DataFrame:
        """ADC top-L of every query."""
        return self.adc.where(F.col("rank") <= L)

    @cached_property
    def truth(self) -> DataFrame:
        return vectors.pair_topk(self.queries, self.base, TOP)

    @cached_property
    def res_subs(self) -> DataFrame:
        """Residuals of the vectors whose ids the residual codebook takes."""
        few = pq.encode(self.base.where(F.col("vec_id").between(16, 31)), self.arrays, self.arrays).select("vec_id", "approx")
        rest = self.base.join(few, "vec_id").select("vec_id", F.zip_with("v", "approx", lambda a, b: a - b).alias("v"))
        return pq.subvectors(rest)

    @cached_property
    def res_book(self) -> DataFrame:
        return pq.first_centers(self.res_subs, 16, 32)

    @cached_property
    def errors(self) -> DataFrame:
        """vec_id, err: norm of what the residual code leaves."""
        return self.coded.select("vec_id", F.col("bound").alias("err"))

    @cached_property
    def cross(self) -> DataFrame:
        return pq.cross_terms(self.book, self.res_book)

    @cached_property
    def norms(self) -> DataFrame:
        return self.queries.select("qid", norm_sq("qv").alias("norm_sq"))

    @cached_property
    def refined(self) -> DataFrame:
        """qid, vec_id, dist: residual refinement of the pool, base ADC plus residual
        table entries plus cross terms. One join by vector, one by query; the cross
        terms are one bounded row."""
        x = self.cross.agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "base_center", "res_center", "x"))), lambda r: r["x"]).alias("cross"))
        tables = pq.wide_lut(pq.lut(self.queries, self.res_book), "rlut")
        p = self.pool.select("qid", "vec_id", F.col("dist").alias("adc")).join(self.coded.select("vec_id", "code", "res_code"), "vec_id").join(tables, "qid").join(F.broadcast(x), how="cross")
        terms = F.transform(F.sequence(F.lit(0), F.size("code") - 1), lambda c: F.get("rlut", c * K + F.get("res_code", c)) + F.get("cross", (c * K + F.get("code", c)) * K + F.get("res_code", c)))
        return p.select("qid", "vec_id", (F.col("adc") + F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)).alias("dist"))

    @cached_property
    def refined_pool(self) -> DataFrame:
        """The pool re-ranked by refined distance, with bounds and exact distances."""
        p = rerank.bounds(ranked(self.refined, ["qid"]), self.errors, self.norms)
        return held(rerank.with_vectors(p.select("qid", "vec_id", "rank", "dist", "lb"), self.base, self.queries))

    @cached_property
    def outlier_book(self) -> DataFrame:
        return pq.first_centers(self.subs, 32, 48)

    @cached_property
    def hybrid(self) -> DataFrame:
        """qid, vec_id, dist of the pool: each chunk from the table that its code belongs to."""
        both = self.wide_lut.join(pq.wide_lut(pq.lut(self.queries, self.outlier_book), "olut"), "qid")
        p = self.pool.select("qid", "vec_id").join(self.coded.select("vec_id", "code", "out_code", "use_outlier"), "vec_id").join(both, "qid")
        terms = F.transform(F.sequence(F.lit(0), F.size("code") - 1), lambda c: F.when(F.get("use_outlier", c), F.get("olut", c * K + F.get("out_code", c))).otherwise(F.get("lut", c * K + F.get("code", c))))
        return p.select("qid", "vec_id", F.aggregate(terms, F.lit(0.0), lambda s, t: s + t).alias("dist"))

    @cached_property
    def coarse(self) -> DataFrame:
        return self.base.where(F.col("vec_id") < COARSE).select(F.col("vec_id").alias("center"), F.col("v").alias("pivot"))

    @cached_property
    def fine(self) -> DataFrame:
        own = self.base.where(F.col("vec_id").between(COARSE, COARSE + FINE - 1))
        d = own.join(F.broadcast(rvq.packed(self.coarse, "cb")), how="cross")
        c = pq.best_center(F.col("v"), F.col("cb"))["center"]
        return d.select((F.col("vec_id") - COARSE).alias("center"), rvq.minus("v", rvq.pivot_of(F.col("cb"), c)).alias("pivot"))

    @cached_property
    def assigned(self) -> DataFrame:
        return self.built("assigned", lambda: rvq.build(self.base, self.coarse, self.fine))

    @cached_property
    def sizes(self) -> DataFrame:
        return rvq.cluster_sizes(self.assigned, COARSE * FINE)

    @cached_property
    def found_clusters(self) -> DataFrame:
        return rvq.search(self.queries, self.coarse, self.fine, self.sizes)

    @cached_property
    def graph(self) -> DataFrame:
        """src, slot, dst."""
        return self.built("graph", lambda: vectors.knn_graph(self.base, R))

    @cached_property
    def entries(self) -> DataFrame:
        return self.queries.select("qid", F.explode(F.array(*[F.lit(x).cast("long") for x in ENTRY_IDS])).alias("vec_id"))

    @cached_property
    def scorer(self) -> traverse.Scorer:
        return traverse.Scorer(self.wide_codes, self.wide_lut, K)

    @cached_property
    def params(self) -> traverse.Params:
        return traverse.Params(TOP, L, WIDTH)

    @cached_property
    def trained_book(self) -> DataFrame:
        """chunk, center, pivot: ANN_CENTERS centers a chunk, trained on a bounded sample."""
        return self.built("trained_book", lambda: train.fit_chunks(pq.subvectors(train.sample(self.base)), ANN_CENTERS))

    @cached_property
    def trained_levels(self) -> DataFrame:
        """level, center, pivot of the trained two-level quantizer."""
        return self.built("trained_levels", lambda: train.fit_rvq(self.base, ANN_COARSE, ANN_FINE))

    def level(self, name: str) -> DataFrame:
        return self.trained_levels.where(F.col("level") == name).select("center", "pivot")

    @cached_property
    def trained_assigned(self) -> DataFrame:
        return self.built("trained_assigned", lambda: rvq.build(self.base, self.level("coarse"), self.level("fine")))

    @cached_property
    def trained_entries(self) -> DataFrame:
        """qid, vec_id: up to 8 postings of each query's cluster."""
        sizes = self.trained_assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
        found = rvq.search(self.queries, self.level("coarse"), self.level("fine"), sizes)
        return rvq.entry_points(found, rvq.postings(self.trained_assigned), 8).select("qid", "vec_id")

    @cached_property
    def ann_codes(self) -> DataFrame:
        """Codes by the trained codebook."""
        return self.built("ann_codes", lambda: pq.encode(self.base, pq.load(self.trained_book)).select("vec_id", "code"))

    @cached_property
    def ann_lut(self) -> DataFrame:
        return pq.wide_lut(pq.lut(self.queries, self.trained_book))

    @cached_property
    def seeded(self) -> DataFrame:
        return held(traverse.seed(self.entries, self.scorer, L))

    @cached_property
    def searched(self) -> DataFrame:
        """Pools of the query-at-a-time kernel, run to the end."""
        return traverse.search_kernel(self.wide_lut, self.entries, self.graph, self.wide_codes, K, self.params)
