"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

The session and the Python workers are warmed up first. Tables of the offline index
(graph, codes, trained codebooks) are built apart, under `builds`, so the time of a
query does not depend on its place in the list. `value` is the sum of both."""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time

QUERIES = ["topk_exact", "scan_graph", "pq_encode", "pq_lut", "pq_adc", "residual_pq_encode", "hpq_encode", "kmeans_step", "rvq_build", "rvq_search", "beam_search_kernel", "residual_refine", "rerank_exact", "bound_safety", "rerank_persistent", "recall_at_k", "hotset_events", "ann_search"]
CORPUS = ["op1_topk", "op2_bpe", "op3_chat_format", "op4_decontamination", "op5_warc", "op6_jaccard_join", "op7_url_filter", "op8_toxicity", "op9_suffix_array", "op10_suffix_automaton"]
BUILDS = ["coded", "graph", "assigned", "trained_book", "trained_levels", "trained_assigned", "ann_codes"]


def timed(make) -> float:
    began = time.time()
    make()
    return round(time.time() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from sparkvane.plans import catalog
    from sparkvane.plans.index import Index
    from sparkvane.session import session

    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).mapInArrow(lambda b: b, "id long").selectExpr("sum(id)").collect()
    run = lambda q: q(spark, sf_dir).write.format("noop").mode("overwrite").save()
    index = Index(spark, sf_dir)
    builds = {b: timed(lambda b=b: getattr(index, b)) for b in BUILDS}
    times = {q: timed(lambda q=q: run(catalog.Q[q])) for q in QUERIES}
    if importlib.util.find_spec("sparkvane.llm") and importlib.util.find_spec("sparkvane.llm.queries"):
        corpus = importlib.import_module("sparkvane.llm.queries").queries()
        times |= {q: timed(lambda q=q: run(corpus[q])) for q in CORPUS}
    Index.release(spark)
    spark.stop()
    total = round(sum(times.values()) + sum(builds.values()), 3)
    print(json.dumps({"metric": "total wall time of headline queries and index builds", "value": total, "unit": "sec", "queries": times, "builds": builds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
