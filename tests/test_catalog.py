"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
FAST = ("topk_exact", "pq_encode", "pq_adc", "residual_refine", "hpq_encode", "rvq_build", "entry_points", "beam_round", "beam_search_kernel", "bound_safety", "rerank_early_stop", "reuse_profile", "hotset_events", "scan_fbin", "overlap_thresholds",
        "kmeans_fit", "pq_train", "hpq_train", "stop_dataset", "rerank_stop_dataset", "rerank_learned_stop", "result_checksum")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    import duckdb

    from sparkvane.plans import catalog, formats, oracle

    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = {**catalog.Q, **formats.Q}[name](spark, DATA)
    cols = sorted(df.columns)
    cur = c.execute(oracle.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(k) for k in cols]
    norm = lambda v: round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    want = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    got = sorted(tuple(norm(r[k]) for k in cols) for r in df.collect())
    assert len(got) == len(want)
    assert got == [pytest.approx(w, abs=2e-5) if all(isinstance(x, float) for x in w) else w for w in want]


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_search_recall(spark):
    from sparkvane.operators import evaluate
    from sparkvane.plans import catalog

    got = evaluate.recall(catalog.Q["ann_search"](spark, DATA), catalog.Q["topk_exact"](spark, DATA), 10)
    assert got.first()["recall"] >= 0.9


def test_stream_runs_the_batch_search(spark, tmp_path):
    from sparkvane.operators import vectors
    from sparkvane.streaming.search import search_stream

    base = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "vec_id long, v array<double>")
    for n in range(2):
        spark.createDataFrame([(n, [n * 10.0, 0.0])], "qid long, qv array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = search_stream(spark, str(tmp_path / "in"), "qid long, qv array<double>", lambda b: vectors.pair_topk(b, base, 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = sorted((r["qid"], r["rank"], r["vec_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 1, 0), (0, 2, 1), (1, 1, 10), (1, 2, 9)]
