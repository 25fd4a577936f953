"""Small graphs and codebooks with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvane.functions.expr import lower_bound, norm_sq
from sparkvane.operators import evaluate, pq, rerank, stops, traverse, vectors
from sparkvane.operators.models import TRAVERSAL, Decision, StopModel

GRAPH = {0: [1, 2], 1: [3], 2: [4], 3: [5], 4: [5], 5: []}
CODES = [9, 6, 7, 2, 3, 1]


def tables(spark, queries, dim=1):
    graph = spark.createDataFrame([(s, d) for s, ds in GRAPH.items() for d in ds], "src long, dst long")
    codes = spark.createDataFrame([(i, [c]) for i, c in enumerate(CODES)], "vec_id long, code array<int>")
    luts = spark.createDataFrame([(q, [float((c - x) ** 2 * dim) for c in range(256)]) for q, x in queries.items()], "qid long, lut array<double>")
    entries = spark.createDataFrame([(q, 0) for q in queries], "qid long, vec_id long")
    return graph, codes, luts, entries


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_traversal_set_form_and_kernel_agree_with_the_known_result(spark):
    graph, codes, luts, entries = tables(spark, {0: 0.0, 1: 8.0})
    p = traverse.Params(2, 2, 1, 16)
    pool, stats = traverse.traverse(entries, graph, traverse.Scorer(codes, luts, 256), p)
    got = rows(pool, "qid", "rank", "vec_id", "dist")
    assert [g for g in got if g[0] == 0] == [(0, 1, 5, 1.0), (0, 2, 3, 4.0)]
    assert [g for g in got if g[0] == 1] == [(1, 1, 0, 1.0), (1, 2, 2, 1.0)]
    kernel = traverse.search_kernel(luts, entries, graph, codes, 256, p)
    assert rows(kernel, "qid", "rank", "vec_id", "dist") == got
    assert {r["qid"] for r in stats.collect()} == {0, 1}


@pytest.mark.parametrize("p,prefix", [((3, 8, 2, 4096), (0,)), ((3, 8, 3, 7), (0,)), ((3, 6, 2, 4096, 12), (4,)), ((3, 6, 2, 4096, 12), (3, "candidates"))])
def test_search_beyond_the_size_limit_equals_the_kernel(spark, p, prefix):
    rng = np.random.default_rng(3)
    graph = spark.createDataFrame([(i, int(j)) for i in range(40) for j in rng.integers(0, 45, 4)], "src long, dst long")
    codes = spark.createDataFrame([(i, rng.integers(0, 16, 2).tolist()) for i in range(42)], "vec_id long, code array<int>")
    luts = spark.createDataFrame([(q, rng.integers(0, 9, 32).astype(float).tolist()) for q in range(5)], "qid long, lut array<double>")
    entries = spark.createDataFrame([(q, v) for q in range(6) for v in (0, q, 44)], "qid long, vec_id long")
    got, want = (traverse.search_kernel(luts, entries, graph, codes, 16, traverse.Params(*p), traverse.Prefix(*prefix), b) for b in (0, 1 << 20))
    assert got.columns == want.columns
    assert rows(got, *want.columns) == rows(want, *want.columns) != []


@pytest.mark.parametrize("most", [1, 2, 4, 5])
def test_no_form_expands_more_than_it_may(spark, most):
    rng = np.random.default_rng(5)
    graph = spark.createDataFrame([(i, int(j)) for i in range(30) for j in rng.integers(0, 30, 3)], "src long, dst long").distinct()
    codes = spark.createDataFrame([(i, rng.integers(0, 16, 2).tolist()) for i in range(30)], "vec_id long, code array<int>")
    luts = spark.createDataFrame([(q, rng.integers(0, 9, 32).astype(float).tolist()) for q in range(4)], "qid long, lut array<double>")
    # queries of one and of several entries run out of choices at different rounds
    entries = spark.createDataFrame([(q, v) for q in range(4) for v in range(1 + 3 * (q % 2))], "qid long, vec_id long")
    p = traverse.Params(3, 8, 2, most)
    pool, stats = traverse.traverse(entries, graph, traverse.Scorer(codes, luts, 16), p)
    kernel = traverse.search_kernel(luts, entries, graph, codes, 16, p)
    cols = ("qid", "rank", "vec_id", "dist", "expanded")
    assert rows(pool, *cols) == rows(kernel, *cols)
    per_query = ("qid", "visited", "n_expanded", "iterations")
    assert rows(stats, *per_query) == sorted(set(rows(kernel, *per_query)))
    assert max(r[2] for r in rows(stats, *per_query)) <= most
    _, steps = traverse.traverse(entries, graph, traverse.Scorer(codes, luts, 16), p, trace=True)
    n = {}
    for q, _, _ in rows(steps, "qid", "step", "vec_id"):
        n[q] = n.get(q, 0) + 1
    assert n == {r[0]: r[2] for r in rows(stats, *per_query)}


def brute_features(pool, p, k, l, expanded, visited, before):
    d, ids, is_open = [c[0] for c in pool], [c[1] for c in pool], [not c[2] for c in pool]
    first = next((i for i in range(l) if is_open[i]), l)
    part = lambda n: np.mean(is_open[p : min(p + n, l)])
    dk, edge = d[k - 1], d[p - 1]
    was = before or (dk, edge, [])
    return [p / l, expanded / l, visited / l, first / l, part(64), part(256), dk, edge - dk, d[min(max(k - 1, 31), p - 1)] - dk, was[0] - dk, was[1] - edge,
            len([i for i in ids[:k] if i not in was[2]]) / k], (dk, edge, ids[:k])


def test_checkpoints_and_learned_stops_of_the_traversal(spark):
    rng = np.random.default_rng(11)
    k, l, n = 3, 10, 60
    adj = {i: sorted({int(j) for j in rng.integers(0, n, 4)}) for i in range(n)}
    code = rng.integers(0, 16, (n, 2))
    table = rng.random((4, 2, 16)).round(3)
    graph = spark.createDataFrame([(i, j) for i in adj for j in adj[i]], "src long, dst long")
    codes = spark.createDataFrame([(i, code[i].tolist()) for i in range(n)], "vec_id long, code array<int>")
    luts = spark.createDataFrame([(q, table[q].ravel().tolist()) for q in range(4)], "qid long, lut array<double>")
    entries = spark.createDataFrame([(q, q) for q in range(4)], "qid long, vec_id long")
    p, stages = traverse.Params(k, l, 2), [2, 4, 6, 8, 10]
    dist = lambda q, i: float(table[q, 0, code[i, 0]] + table[q, 1, code[i, 1]])

    def run(q, weights=None, bias=0.0):
        pool, seen, expanded, before, at, out = [(dist(q, q), q, False)], {q}, 0, None, [(j, s) for j, s in enumerate(stages[:4]) if s >= k], []
        while True:
            while at and len(pool) >= l and expanded >= at[0][1]:
                f, before = brute_features(pool, at[0][1], k, l, expanded, len(seen), before)
                out.append((q, *at.pop(0), f, [c[1] for c in pool[:k]]))
                if weights and bias + float(np.dot(weights, f)) < 0:
                    return pool, out
            turn = [j for j, c in enumerate(pool[:l]) if not c[2]][:2]
            if not turn:
                return pool, out
            new = set()
            for j in turn:
                pool[j] = (*pool[j][:2], True)
                new |= set(adj[pool[j][1]]) - seen
            seen |= new
            expanded += len(turn)
            pool = sorted([*pool, *((dist(q, i), i, False) for i in new)], key=lambda c: (round(c[0], 9), c[1]))[:l]

    got = {(r["qid"], r["stage"]): r for r in traverse.search_checkpoints(luts, entries, graph, codes, 16, p, stages).collect()}
    want = [x for q in range(4) for x in run(q)[1]]
    ends = {q: [c[1] for c in run(q)[0][:k]] for q in range(4)}
    assert len(got) == len(want) > 4
    for q, stage, prefix, f, ids in want:
        r = got[q, stage]
        assert r["prefix"] == prefix and r["label"] == int(ids != ends[q])
        assert [r[c] for c in TRAVERSAL] == pytest.approx(f)
    weights = [0.0] * 11 + [1.0]
    model = StopModel(stages, [0.0] * 12, [1.0] * 12, weights, -0.5)
    learned = rows(traverse.search_kernel(luts, entries, graph, codes, 16, p, decision=Decision.of(model, l)), "qid", "vec_id", "expanded")
    brute = sorted((q, c[1], c[2]) for q in range(4) for c in run(q, weights, -0.5)[0])
    assert learned == brute != sorted((q, c[1], c[2]) for q in range(4) for c in run(q)[0])


def test_persistent_rerank_stops_replays_and_reuses(spark):
    rng = np.random.default_rng(2)
    pool = [(q, i + 1, int(j), float(x) * 0.9, float(x), bool(i % 3 == 0)) for q in range(5) for i, (j, x) in enumerate(zip(rng.permutation(40), np.sort(rng.random(40)) + rng.random(40) * 0.3, strict=True))]
    d = spark.createDataFrame(pool, "qid long, rank long, vec_id long, lb double, exact double, reused boolean")
    k, n, stages = 4, 40, [8, 12, 20]
    model = StopModel(stages, [0.0] * 13, [1.0] * 13, [0.0] * 6 + [1.0] + [0.0] * 6, -0.3)  # stop where under 30 % of the top entered
    plan = rerank.Plan(n, 8, k, decision=Decision.of(model, n), bootstrap=6)
    assert plan.ends() == [6, 8, 12, 20, 28, 36, 40]
    runs = {r["qid"]: r for r in rerank.persistent_runs(d, plan).collect()}
    feats = {(r["qid"], r["prefix"]): r for r in stops.rerank_features(d.drop("reused"), [6, *stages], k, n, 8).collect()}
    for q, r in runs.items():
        at = [p for p in stages if feats[q, p]["entered_ratio"] < 0.3]
        want = at[0] if at else n
        mine = [x for x in pool if x[0] == q and x[1] <= want]
        assert r["prefix"] == want
        assert [b["vec_id"] for b in r["best"]] == [x[2] for x in sorted(mine, key=lambda x: x[4])[:k]]
        assert 0 < r["reused_n"] <= r["exact_n"] <= want
    assert any(r["prefix"] < n for r in runs.values())
    recorded = spark.createDataFrame([(q, 10 + q) for q in range(5)], "qid long, stop_prefix long")
    for r in rerank.persistent_runs(d, plan, recorded).collect():
        mine = [x for x in pool if x[0] == r["qid"] and x[1] <= 10 + r["qid"]]
        assert r["prefix"] == 10 + r["qid"] and [b["vec_id"] for b in r["best"]] == [x[2] for x in sorted(mine, key=lambda x: x[4])[:k]]
    full = rows(rerank.persistent(d, n, 8, k), "qid", "rank", "vec_id")
    assert full == sorted((q, i + 1, x[2]) for q in range(5) for i, x in enumerate(sorted((x for x in pool if x[0] == q), key=lambda x: x[4])[:k]))


def test_full_width_traversal_equals_brute_force(spark):
    graph, codes, luts, entries = tables(spark, {0: 0.0, 1: 8.0, 2: 4.0})
    p = traverse.Params(6, 6, 2, 100)
    got = rows(traverse.search_kernel(luts, entries, graph, codes, 256, p), "qid", "rank", "vec_id")
    want = []
    for q, x in {0: 0.0, 1: 8.0, 2: 4.0}.items():
        order = sorted(range(6), key=lambda i: ((CODES[i] - x) ** 2, i))
        want += [(q, r + 1, i) for r, i in enumerate(order)]
    assert got == sorted(want)


def test_exact_rerank_and_ties(spark):
    pool = spark.createDataFrame([(q, i, i + 1) for q in (0, 1) for i in range(6)], "qid long, vec_id long, rank long")
    base = spark.createDataFrame([(i, [float(c)] * 300) for i, c in enumerate(CODES)], "vec_id long, v array<double>")
    qs = spark.createDataFrame([(0, [0.0] * 300), (1, [8.0] * 300)], "qid long, qv array<double>")
    assert rows(rerank.exact(pool, base, qs, 6, 2), "qid", "rank", "vec_id", "dist") == [(0, 1, 5, 300.0), (0, 2, 3, 1200.0), (1, 1, 0, 300.0), (1, 2, 2, 300.0)]


def test_lookup_table_of_two_dimensions(spark):
    book = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.0, 2.0]), (0, 3, [1.0, 2.0])], "chunk long, center long, pivot array<double>")
    q = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 0.0])], "qid long, qv array<double>")
    lut = pq.lut(q, book, 1, 2)
    assert [r[3] for r in sorted(lut.collect())] == [5, 4, 1, 0, 0, 1, 4, 5]
    codes = spark.createDataFrame([(0, [1]), (1, [2]), (2, [3])], "vec_id long, code array<int>")
    d = pq.adc_topk(codes, pq.wide_lut(lut), 4, 3)
    assert rows(d.where("qid = 0"), "vec_id", "dist") == [(0, 4.0), (1, 1.0), (2, 0.0)]
    assert rows(pq.adc_topk(codes, pq.wide_lut(lut), 4, 2, block=1), "qid", "rank", "vec_id") == [(0, 1, 2), (0, 2, 1), (1, 1, 0), (1, 2, 1)]


def test_residual_refinement_identity(spark):
    rng = np.random.default_rng(1)
    b, r, q = rng.normal(size=(3, 8))
    refined = ((b - q) ** 2).sum() + ((r - q) ** 2).sum() + 2 * (b * r).sum()
    assert refined == pytest.approx(((q - b - r) ** 2).sum() + (q ** 2).sum())
    d = spark.createDataFrame([(q.tolist(), float(((q - b - r) ** 2).sum()), 0.3)], "v array<double>, a double, e double")
    got = d.select(lower_bound(F.col("a"), F.col("e")).alias("lb"), norm_sq("v").alias("n")).first()
    assert got["lb"] <= ((q - b - r) ** 2).sum() and got["n"] == pytest.approx((q ** 2).sum())


def test_bound_filter_keeps_the_top(spark):
    rng = np.random.default_rng(2)
    data = []
    for qid in range(5):
        exact = rng.random(32)
        lb = exact * rng.random(32)
        order = np.argsort(lb)
        data += [(qid, int(i), rank + 1, float(lb[i]), float(exact[i])) for rank, i in enumerate(order)]
    pool = spark.createDataFrame(data, "qid long, vec_id long, rank long, lb double, exact double")
    want = {q: [x[1] for x in sorted((d for d in data if d[0] == q), key=lambda d: (d[4], d[1]))[:4]] for q in range(5)}
    tiled = rerank.bound_filter_tiled(pool, 32, 8, 4).where("kept")
    fold = rerank.persistent(pool, 32, 8, 4)
    for q in range(5):
        kept = sorted((r["exact"], r["vec_id"]) for r in tiled.where(F.col("qid") == q).collect())[:4]
        assert [i for _, i in kept] == want[q]
        assert [r["vec_id"] for r in fold.where(F.col("qid") == q).orderBy("rank").collect()] == want[q]
    full = rerank.replay(pool, spark.createDataFrame([(q, 32) for q in range(5)], "qid long, stop_prefix long"), 4)
    assert rows(full, "qid", "rank", "vec_id") == rows(fold, "qid", "rank", "vec_id")


def test_knn_is_exact(spark):
    x = np.random.default_rng(3).normal(size=(60, 4))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = vectors.pair_topk(base.selectExpr("vec_id qid", "v qv"), base, 3, exclude_self=True, block=7)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = sorted((i, r + 1, int(j)) for i in range(60) for r, j in enumerate(np.argsort(d[i])[:3]))
    assert rows(got, "qid", "rank", "vec_id") == want


def test_evaluation(spark):
    assert evaluate.batch_plan(103, 20) == [(0, 0, 20), (1, 20, 20), (2, 40, 20), (3, 60, 20), (4, 80, 23)]
    assert evaluate.batch_plan(7, 20) == [(0, 0, 7)] and evaluate.batch_plan(0, 5) == []
    p = spark.createDataFrame([(0.9, 10.0), (0.9, 8.0), (0.95, 9.0), (0.99, 1.0)], "recall double, qps double")
    assert rows(evaluate.pareto(p), "recall", "qps") == [(0.9, 10.0), (0.95, 9.0), (0.99, 1.0)]
    n = spark.createDataFrame([(i, 10 - i) for i in range(10)], "vec_id long, n long")
    assert rows(evaluate.hotset(n, [10, 50]), "pct", "cumulative_pct")[0] == (10, pytest.approx(100 * 10 / 55))


def test_parameters_are_checked():
    for bad in (dict(top_l=0), dict(queue=4), dict(width=33)):
        with pytest.raises(ValueError):
            traverse.Params(**bad)


def test_stop_model_text_round_trip():
    m = StopModel([10, 20], [1.0, 2.0], [0.5, 0.25], [3.0, 4.0], 0.5, 0.1, {64: 0.2})
    assert StopModel.parse(m.text()) == m
    w, b = m.folded()
    assert w == [1.5, 1.0] and b == pytest.approx(0.5 - 1.5 - 2.0) and m.threshold(64) == 0.2 and m.threshold(8) == 0.1


def test_rerank_rules_are_checked(spark):
    from sparkvane.operators.engine import RerankParams, run

    good = {"refine": True, "bound_filter": True, "mode": "persistent"}
    assert RerankParams(16, 8, **good).tile == 8
    decision = Decision((8,))
    for bad in ({"mode": "other"}, {"tile": 6}, {"bound_filter": True, "mode": "tiled"}, {**good, "mode": "linear"}, {**good, "hybrid": True}, {"decision": decision, "mode": "persistent"},
                {**good, "mode": "tiled", "decision": decision}, {"patience": 1}, {**good, "replay": True, "record": True}, {**good, "replay": True, "patience": 2}):
        with pytest.raises(ValueError):
            RerankParams(16, 8, **bad)
    with pytest.raises(ValueError):
        RerankParams(4, 8)
    with pytest.raises(ValueError):
        RerankParams(400, 200, **good)
    pool = spark.createDataFrame([(0, 1, 5)], "qid long, rank long, vec_id long")
    with pytest.raises(ValueError, match="lb"):
        run(pool, pool, pool, RerankParams(1, 1, **good))
    with pytest.raises(ValueError, match="replay"):
        run(pool, pool, pool, RerankParams(1, 1, mode="persistent", replay=True))


def test_entries_and_ladders(spark):
    from sparkvane.operators import engine

    q = spark.createDataFrame([(0,), (7,)], "qid long")
    assert rows(engine.fixed_entries(q, [9, 4, 5], 2), "qid", "pos", "vec_id") == [(0, 1, 9), (0, 2, 4), (7, 1, 9), (7, 2, 4)]
    table = spark.createDataFrame([(0, 1, 3), (0, 5, 8), (0, 9, 2), (1, 1, 1)], "qid long, pos long, vec_id long")
    assert rows(engine.query_entries(q.where("qid = 0"), table, 2), "pos", "vec_id") == [(1, 3), (2, 8)]
    with pytest.raises(Exception, match="no entries for query 7"):
        engine.query_entries(q, table, 2).collect()
    assert stops.traversal_ladder(16) == [] and stops.traversal_ladder(100) == [16, 32, 48, 64, 96]
    full = stops.traversal_ladder(4096)
    assert full[:9] == [16, 32, 48, 64, 96, 128, 192, 256, 336] and all(x % 16 == 0 for x in full) and len([x for x in full if x > 1024]) == 8
    assert stops.rerank_ladder(10, 40) == [10, 12, 14, 16, 18, 20, 22, 24, 26, 28, 30, 32, 36, 40]


def test_training_against_plain_loops():
    from sparkvane.operators import train

    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (60, 3)).astype(float)

    def plain(points, centers, rounds):
        seen = []
        for _ in range(rounds):
            groups, error = {}, 0.0
            for p in points:
                d = [float(((p - c) ** 2).sum()) for c in centers]
                groups.setdefault(d.index(min(d)), []).append(p)
                error += min(d)
            seen.append((error, [c.copy() for c in centers], [len(groups.get(i, ())) for i in range(len(centers))]))
            centers = [np.mean(groups[i], axis=0) if i in groups else c for i, c in enumerate(centers)]
        best = min(range(rounds), key=lambda r: seen[r][0])
        return seen[best][1], seen[-1][2], seen[best][0]

    for k, rounds in ((4, 1), (4, 3), (7, 25)):
        c, n, e = train.kmeans(x, x[:k].copy(), rounds)
        want, members, error = plain(list(x), [r.copy() for r in x[:k]], rounds)
        assert np.allclose(c, want) and n.tolist() == members and e == pytest.approx(error)
    c, n, e = train.kmeans(x, x[:5].copy(), None)
    at, _ = train.assign(x, c)
    assert all(np.allclose(c[j], x[at == j].mean(axis=0)) for j in range(5) if (at == j).any()) and n.sum() == 60
    near = lambda p, cs: min(range(len(cs)), key=lambda j: (round(float(((p - cs[j]) ** 2).sum()), 9), j))
    for alternations, rounds in ((1, 2), (3, 4), (10, 25)):
        coarse, fine, part, best = [r.copy() for r in x[:3]], None, [np.zeros(3)] * 60, None
        for _ in range(alternations):
            coarse = plain([p - q for p, q in zip(x, part, strict=True)], coarse, rounds)[0]
            rest = [p - coarse[near(p - q, coarse)] for p, q in zip(x, part, strict=True)]
            fine, _, error = plain(rest, [r.copy() for r in rest[:4]] if fine is None else fine, rounds)
            part = [fine[near(r, fine)] for r in rest]
            if best is None or best[2] - error >= train.LEAST_GAIN:
                best = coarse, fine, error
        got = train.alternate(x, 3, 4, alternations, rounds)
        assert np.allclose(got[0], best[0]) and np.allclose(got[1], best[1]) and got[2] == pytest.approx(best[2])


def test_rounds_add_no_partitions(spark):
    from sparkvane.operators import traverse

    keep, d = traverse._keeper(spark), spark.range(0, 12, 1, 3)
    for _ in range(3):
        d = keep(d.unionByName(spark.range(0, 12, 1, 3)))
    assert d.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions")) and d.count() == 48


def test_a_round_is_few_jobs_and_one_table(spark):
    from pathlib import Path

    from sparkvane.session import shared_dir

    folder = Path("/" + shared_dir(spark).removeprefix("file:").lstrip("/"))
    before = set(folder.iterdir())
    graph = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    codes = spark.createDataFrame([(i, [i]) for i in range(10)], "vec_id long, code array<int>")
    luts = spark.createDataFrame([(0, [float(9 - i) for i in range(16)])], "qid long, lut array<double>")
    sc, entries = spark.sparkContext, spark.createDataFrame([(0, 0)], "qid long, vec_id long")
    sc.setJobGroup("rounds", "rounds")
    try:
        pool, stats = traverse.traverse(entries, graph, traverse.Scorer(codes, luts, 16), traverse.Params(2, 16, 1))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(sc.statusTracker().getJobIdsForGroup("rounds"))
    assert rows(stats, "visited", "n_expanded", "iterations") == [(10, 10, 10)]
    assert rows(pool, "rank", "vec_id", "dist") == [(i + 1, 9 - i, float(i)) for i in range(10)]
    assert jobs <= 10 * 12 and len(set(folder.iterdir()) - before) == 1


def test_many_chosen_nodes_meet_the_graph_in_a_shuffle(spark, monkeypatch):
    graph, codes, luts, entries = tables(spark, {0: 0.0, 1: 8.0})
    p, cols = traverse.Params(2, 4, 2, 16), ("qid", "rank", "vec_id", "dist", "expanded")
    want = rows(traverse.search_kernel(luts, entries, graph, codes, 256, p), *cols)
    monkeypatch.setattr(traverse, "ASKED", 0)
    pool, _ = traverse.traverse(entries, graph, traverse.Scorer(codes, luts, 256), p)
    assert rows(pool, *cols) == want != []


def test_kmeans_reads_rows_beyond_the_sample(spark):
    from pyspark.sql import functions as F

    from sparkvane.operators import train

    n = train.SAMPLE + 4000
    d = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[(F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 100 + F.when(F.col("id") >= train.SAMPLE, 50).otherwise(0)).cast("double") for j in range(3)]).alias("v"))
    x = np.array([r["v"] for r in d.orderBy("vec_id").collect()])
    for rounds in (3, None):
        want, members, _ = train.kmeans(x, x[:4].copy(), rounds)
        got = train.fit_kmeans(d, 4, rounds).orderBy("center").collect()
        assert [r["members"] for r in got] == members.tolist() and sum(members) == n
        assert np.allclose([r["pivot"] for r in got], want)
    assert train.fit_kmeans(d.where("false"), 4).count() == 0


def test_converged_centers_are_the_last_where_errors_round_to_the_same(spark):
    from sparkvane.operators import train

    x = np.random.default_rng(6).integers(0, 9, (40, 3)) * 1e-6  # all squared distances round to 0: every row goes to the first center
    c, n, _ = train.kmeans(x, x[:2].copy(), None)
    got = train.fit_kmeans(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, v array<double>"), 2, None).orderBy("center").collect()
    want = [x.mean(axis=0), x[1]]
    assert n.tolist() == [r["members"] for r in got] == [40, 0]
    for centers in (c, [r["pivot"] for r in got]):
        assert np.allclose(centers, want, rtol=1e-9, atol=0)


def test_quantizer_models_are_checked(spark, tmp_path):
    from sparkvane.operators import rvq

    good = [("coarse", 0, [1.0]), ("coarse", 1, [2.0]), ("fine", 0, [0.5])]
    d = spark.createDataFrame(good, "level string, center long, pivot array<double>")
    assert sorted(map(tuple, rvq.load(spark, rvq.save(d, str(tmp_path / "m"))).collect())) == good
    with pytest.raises(ValueError):
        rvq.load(spark, rvq.save(d.where("level = 'coarse'"), str(tmp_path / "n")))
    with pytest.raises(ValueError):
        rvq.load(spark, rvq.save(d.where("center <> 0 or level = 'fine'"), str(tmp_path / "o")))
