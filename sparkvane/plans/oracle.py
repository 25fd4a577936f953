"""DuckDB SQL for the catalog: named steps, included where a query needs them."""

from __future__ import annotations

import re

from sparkvane.operators.models import RERANK
from sparkvane.operators.stops import rerank_ladder
from sparkvane.plans.catalog import RERANK_BIAS, RERANK_W, SWEEP
from sparkvane.plans.index import ENTRY_IDS


def d2(a: str, b: str) -> str:
    return f"pow(list_distance({a}, {b}), 2)"


def rank(part: str, dist: str = "dist", node: str = "vec_id") -> str:
    return f"row_number() OVER (PARTITION BY {part} ORDER BY round({dist}, 9), {node})"


def minus(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"


def tiles(n: int, tile: int, k: int) -> str:
    """Rows kept tile by tile against the kth exact distance of the rows kept before."""
    out = f"t0 AS (SELECT qid, vec_id, rank, lb, exact, NULL::DOUBLE AS threshold, TRUE AS kept FROM rpool WHERE rank <= {tile})"
    done = "SELECT * FROM t0"
    for i, at in enumerate(range(tile, n, tile), 1):
        out += f""",
k{i} AS (SELECT qid, exact AS threshold FROM (SELECT qid, exact, {rank('qid', 'exact')} AS r FROM ({done}) WHERE kept) WHERE r = {k}),
t{i} AS (SELECT p.qid, p.vec_id, p.rank, p.lb, p.exact, k.threshold, (k.threshold IS NULL OR round(p.lb, 9) <= round(k.threshold, 9)) AS kept
  FROM rpool p LEFT JOIN k{i} k ON k.qid = p.qid WHERE p.rank > {at} AND p.rank <= {at + tile})"""
        done += f" UNION ALL SELECT * FROM t{i}"
    return out + f",\ntiled AS ({done})"


def a_round(n: int) -> str:
    """Round n of the traversal: from pool{n-1}, seen{n-1} to pool{n}, seen{n}."""
    p, s = f"pool{n - 1}", f"seen{n - 1}"
    return f"""chosen{n} AS (SELECT qid, vec_id FROM (SELECT qid, vec_id, {rank('qid')} AS t FROM {p} WHERE rank <= 32 AND NOT expanded) WHERE t <= 4),
front{n} AS (SELECT DISTINCT c.qid, g.dst AS vec_id FROM chosen{n} c JOIN graph g ON g.src = c.vec_id),
fresh{n} AS (SELECT f.* FROM front{n} f ANTI JOIN {s} s USING (qid, vec_id)),
both{n} AS (SELECT p.qid, p.vec_id, p.dist, p.expanded OR c.vec_id IS NOT NULL AS expanded FROM {p} p LEFT JOIN chosen{n} c ON c.qid = p.qid AND c.vec_id = p.vec_id
  UNION ALL SELECT f.qid, f.vec_id, a.dist, FALSE FROM fresh{n} f JOIN adc a USING (qid, vec_id)),
pool{n} AS (SELECT * FROM (SELECT *, {rank('qid')} AS rank FROM both{n}) WHERE rank <= 32),
seen{n} AS (SELECT * FROM {s} UNION ALL SELECT * FROM fresh{n})"""


def all_rounds(n: int) -> str:
    """The whole traversal: r0 .. rn (pools), v0 .. vn (visited), c1 .. cn (chosen),
    and `walk`, `went`, `knew` with all of them by round."""
    out = "r0 AS MATERIALIZED (SELECT qid, vec_id, dist, expanded, rank FROM pool0),\nv0 AS MATERIALIZED (SELECT qid, vec_id FROM ent)"
    for i in range(1, n + 1):
        out += f""",
c{i} AS MATERIALIZED (SELECT qid, vec_id FROM (SELECT qid, vec_id, {rank('qid')} AS t FROM r{i - 1} WHERE rank <= 32 AND NOT expanded) WHERE t <= 4),
n{i} AS MATERIALIZED (SELECT DISTINCT c.qid, g.dst AS vec_id FROM c{i} c JOIN graph g ON g.src = c.vec_id ANTI JOIN v{i - 1} v ON v.qid = c.qid AND v.vec_id = g.dst),
r{i} AS MATERIALIZED (SELECT * FROM (SELECT *, {rank('qid')} AS rank FROM (SELECT p.qid, p.vec_id, p.dist, p.expanded OR c.vec_id IS NOT NULL AS expanded FROM r{i - 1} p LEFT JOIN c{i} c USING (qid, vec_id)
  UNION ALL SELECT f.qid, f.vec_id, a.dist, FALSE FROM n{i} f JOIN adc a USING (qid, vec_id))) WHERE rank <= 32),
v{i} AS MATERIALIZED (SELECT * FROM v{i - 1} UNION ALL SELECT * FROM n{i})"""
    both = lambda t, lo: " UNION ALL ".join(f"SELECT {i} AS n, * FROM {t}{i}" for i in range(lo, n + 1))
    return out + f""",
walk AS MATERIALIZED ({both('r', 0)}),
went AS MATERIALIZED ({both('c', 1)}),
knew AS MATERIALIZED ({both('v', 0)}),
final AS (SELECT qid, rank, vec_id, dist, expanded FROM walk WHERE n = {n})"""


def argmin(subs: str, book: str) -> str:
    return f"""SELECT vec_id, chunk, center, err, sub FROM (SELECT s.vec_id, s.chunk, b.center, round({d2('s.sub', 'b.pvt')}, 9) AS err, s.sub,
  row_number() OVER (PARTITION BY s.vec_id, s.chunk ORDER BY round({d2('s.sub', 'b.pvt')}, 9), b.center) AS rn FROM {subs} s JOIN {book} b USING (chunk)) WHERE rn = 1"""


def lloyd(name: str, book: str) -> str:
    return f"""{name}_a AS (SELECT vec_id, v, center FROM (SELECT e.vec_id, e.v, b.center, row_number() OVER (PARTITION BY e.vec_id ORDER BY round({d2('e.v', 'b.pvt')}, 9), b.center) AS rn FROM emb e, {book} b) WHERE rn = 1),
{name}_m AS (SELECT center, list(m ORDER BY dim) AS pvt, any_value(n) AS members FROM (SELECT center, dim, avg(x) AS m, count(*) AS n FROM (SELECT center, unnest(v) AS x, unnest(range(len(v))) AS dim FROM {name}_a) GROUP BY center, dim) GROUP BY center),
{name} AS (SELECT b.center, coalesce(m.pvt, b.pvt) AS pvt, coalesce(m.members, 0) AS members FROM {book} b LEFT JOIN {name}_m m ON m.center = b.center)"""


def fit(name: str, src: str, first: str, updates: int) -> str:
    """`updates` Lloyd rounds unrolled, from the first 16 rows of src (vec_id, v or
    chunk, vec_id, sub); `name` has the centers then and their members."""
    by, x = ("chunk, ", "sub") if "chunk" in first else ("", "v")
    on = "b.chunk = e.chunk" if by else "TRUE"
    at = "pos" if "pos" in first else "vec_id"
    out = f"{name}_0 AS MATERIALIZED (SELECT {first} FROM {src} WHERE {at} < 16)"
    for r in range(updates + 1):
        own = ", ".join(f"b.{c}" for c in ([by[:-2]] if by else []) + ["center"])
        near = f"round({d2(f'e.{x}', 'b.pvt')}, 9)"
        out += f""",
{name}_a{r} AS MATERIALIZED (SELECT {by}vec_id, x, center FROM (SELECT {own}, e.vec_id, e.{x} AS x, row_number() OVER (PARTITION BY {'e.chunk, ' if by else ''}e.vec_id ORDER BY {near}, b.center) AS rn FROM {src} e JOIN {name}_{r} b ON {on}) WHERE rn = 1)"""
        if r < updates:
            keys = f"{by}center"
            out += f""",
{name}_m{r} AS MATERIALIZED (SELECT {keys}, list(m ORDER BY dim) AS pvt FROM (SELECT {keys}, dim, avg(y) AS m FROM (SELECT {keys}, unnest(x) AS y, unnest(range(len(x))) AS dim FROM {name}_a{r}) GROUP BY {keys}, dim) GROUP BY {keys}),
{name}_{r + 1} AS MATERIALIZED (SELECT {own}, coalesce(m.pvt, b.pvt) AS pvt FROM {name}_{r} b LEFT JOIN {name}_m{r} m USING ({keys}))"""
    return out + f""",
{name} AS (SELECT b.*, coalesce(n.members, 0) AS members FROM {name}_{updates} b LEFT JOIN (SELECT {by}center, count(*) AS members FROM {name}_a{updates} GROUP BY ALL) n USING ({by}center))"""


def features(stages: list[int], k: int, budget: int, tile: int, name: str, first: int = 0) -> str:
    """The rerank features window by window, each window's threshold from the rows
    kept before it. Windows before the `first` are no checkpoints."""
    out, done, rows = "", "", []
    for i, (lo, hi) in enumerate(zip([0, *stages], stages, strict=False)):
        w = f"{name}_w{i}"
        kth = f"LEFT JOIN (SELECT qid, exact AS t FROM {name}_b{i - 1} WHERE r = {k}) USING (qid)" if i else ""
        out += f"""{w} AS MATERIALIZED (SELECT qid, vec_id, rank, lb, exact, {'(t IS NULL OR round(lb, 9) <= round(t, 9))' if i else 'TRUE'} AS kept FROM rpool {kth} WHERE rank > {lo} AND rank <= {hi}),
"""
        done += (" UNION ALL " if i else "") + f"SELECT * FROM {w}"
        out += f"""{name}_b{i} AS MATERIALIZED (SELECT * FROM (SELECT qid, vec_id, exact, {rank('qid', 'exact')} AS r FROM ({done}) WHERE kept) WHERE r <= {k}),
"""
        end = min(hi + 8, stages[i + 1] if i + 1 < len(stages) else min(budget, hi + tile))
        fresh = f"ANTI JOIN {name}_b{i - 1} o USING (qid, vec_id)" if i else ""
        if i < first:
            continue
        rows.append(f"""SELECT b.qid, {i} AS stage, {hi} AS prefix, b.kth, b.best, coalesce(e.entered, 0) AS entered, x.n AS window_n, x.kept AS exact_n, d.done, count(p.lb) AS probe,
  count(*) FILTER (round(p.lb, 9) <= round(b.kth, 9)) AS live, min(p.lb) FILTER (round(p.lb, 9) <= round(b.kth, 9)) AS low FROM
  (SELECT qid, max(exact) FILTER (r = {k}) AS kth, min(exact) AS best FROM {name}_b{i} GROUP BY qid) b JOIN (SELECT qid, count(*) AS n, count(*) FILTER (kept) AS kept FROM {w} GROUP BY qid) x USING (qid)
  JOIN (SELECT qid, count(*) FILTER (kept) AS done FROM ({done}) GROUP BY qid) d USING (qid) LEFT JOIN (SELECT qid, count(*) AS entered FROM {name}_b{i} {fresh} GROUP BY qid) e USING (qid)
  LEFT JOIN (SELECT qid, lb FROM rpool WHERE rank > {hi} AND rank <= {end}) p USING (qid) GROUP BY ALL""")
    lag = "lag(kth) OVER (PARTITION BY qid ORDER BY stage)"
    return out + f"""{name}_f AS MATERIALIZED (SELECT *, coalesce({lag} - kth, 0) AS delta_kth FROM ({' UNION ALL '.join(rows)})),
{name} AS (SELECT qid, stage, prefix, log2({budget}) AS budget_log2, prefix / {budget}.0 AS prefix_frac, kth, delta_kth, coalesce(lag(delta_kth) OVER (PARTITION BY qid ORDER BY stage), 0) AS delta_kth_prev,
  CASE WHEN entered > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS topk_changed, entered / {k}.0 AS entered_ratio, kth - best AS spread, CASE WHEN probe = 0 THEN 0 ELSE live / probe END AS live_ratio, coalesce(low - kth, 0) AS best_gap,
  exact_n / window_n AS window_exact, (window_n - exact_n) / window_n AS window_filtered, done / prefix AS exact_frac FROM {name}_f WHERE kth IS NOT NULL)"""


STEPS: dict[str, str] = {
    "emb": "emb AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL)",
    "qry": "qry AS (SELECT vec_id AS qid, v AS qv FROM emb WHERE vec_id % 50 = 0)",
    "points": "points AS (SELECT count(*) AS n FROM emb)",
    "truth": f"truth AS (SELECT * FROM (SELECT qid, vec_id, dist, {rank('qid')} AS rank FROM (SELECT qid, vec_id, {d2('v', 'qv')} AS dist FROM emb, qry)) WHERE rank <= 10)",
    "graph": f"graph AS (SELECT src, slot, dst FROM (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({d2('a.v', 'b.v')}, 9), b.vec_id) AS slot FROM emb a JOIN emb b ON a.vec_id <> b.vec_id) WHERE slot <= 16)",
    "sub": "sub AS (SELECT vec_id, c AS chunk, v[c * 8 + 1:c * 8 + 8] AS sub FROM emb, (SELECT unnest(range(8)) AS c))",
    "qsub": "qsub AS (SELECT qid, c AS chunk, qv[c * 8 + 1:c * 8 + 8] AS sub FROM qry, (SELECT unnest(range(8)) AS c))",
    "book": "book AS (SELECT chunk, vec_id AS center, sub AS pvt FROM sub WHERE vec_id < 16)",
    "obook": "obook AS (SELECT chunk, vec_id - 32 AS center, sub AS pvt FROM sub WHERE vec_id BETWEEN 32 AND 47)",
    "code": f"code AS ({argmin('sub', 'book')})",
    "ocode": f"ocode AS ({argmin('sub', 'obook')})",
    "lut": f"lut AS (SELECT qid, chunk, center, {d2('sub', 'pvt')} AS d FROM qsub JOIN book USING (chunk))",
    "olut": f"olut AS (SELECT qid, chunk, center, {d2('sub', 'pvt')} AS d FROM qsub JOIN obook USING (chunk))",
    "adc": "adc AS (SELECT qid, vec_id, sum(d) AS dist FROM code JOIN lut USING (chunk, center) GROUP BY qid, vec_id)",
    "ranked": f"ranked AS (SELECT *, {rank('qid')} AS rank FROM adc)",
    "pool": "pool AS (SELECT * FROM ranked WHERE rank <= 32)",
    "dec": "dec AS (SELECT vec_id, chunk, sub, pvt AS approx FROM code JOIN book USING (chunk, center))",
    "res": f"res AS (SELECT vec_id, chunk, {minus('sub', 'approx')} AS sub FROM dec)",
    "rbook": "rbook AS (SELECT chunk, vec_id - 16 AS center, sub AS pvt FROM res WHERE vec_id BETWEEN 16 AND 31)",
    "rcode": f"rcode AS ({argmin('res', 'rbook')})",
    "errs": f"errs AS (SELECT vec_id, sqrt(sum({d2('sub', 'pvt')})) AS err FROM rcode JOIN rbook USING (chunk, center) GROUP BY vec_id)",
    "cross_t": "cross_t AS (SELECT b.chunk, b.center AS base_center, r.center AS res_center, 2 * list_dot_product(b.pvt, r.pvt) AS x FROM book b JOIN rbook r USING (chunk))",
    "rlut": f"rlut AS (SELECT qid, chunk, center AS res_center, {d2('sub', 'pvt')} AS d FROM qsub JOIN rbook USING (chunk))",
    "refined": """refined AS (SELECT p.qid, p.vec_id, any_value(p.dist) + sum(l.d + x.x) AS dist FROM pool p JOIN code b USING (vec_id) JOIN rcode r ON r.vec_id = p.vec_id AND r.chunk = b.chunk
  JOIN cross_t x ON x.chunk = b.chunk AND x.base_center = b.center AND x.res_center = r.center JOIN rlut l ON l.qid = p.qid AND l.chunk = b.chunk AND l.res_center = r.center GROUP BY p.qid, p.vec_id)""",
    "rpool": f"""rpool AS (SELECT f.qid, f.vec_id, {rank('f.qid', 'f.dist', 'f.vec_id')} AS rank, f.dist,
  pow(greatest(0.0, sqrt(greatest(0.0, f.dist - list_dot_product(q.qv, q.qv))) - e.err), 2) AS lb, {d2('v.v', 'q.qv')} AS exact
  FROM refined f JOIN errs e USING (vec_id) JOIN qry q USING (qid) JOIN emb v ON v.vec_id = f.vec_id)""",
    "expool": f"expool AS (SELECT p.qid, p.vec_id, p.rank, {d2('v', 'qv')} AS exact FROM pool p JOIN emb USING (vec_id) JOIN qry USING (qid))",
    "hcode": f"""hcode AS (SELECT c.vec_id, c.chunk, CASE WHEN o.err < c.err THEN o.center ELSE c.center END AS code, o.err < c.err AS use_outlier FROM code c JOIN ocode o USING (vec_id, chunk))""",
    "hdist": """hdist AS (SELECT p.qid, p.vec_id, sum(l.d) AS dist FROM pool p JOIN hcode h USING (vec_id)
  JOIN (SELECT *, FALSE AS o FROM lut UNION ALL SELECT *, TRUE FROM olut) l ON l.qid = p.qid AND l.chunk = h.chunk AND l.center = h.code AND l.o = h.use_outlier GROUP BY p.qid, p.vec_id)""",
    "coarse": "coarse AS (SELECT vec_id AS center, v AS pvt FROM emb WHERE vec_id < 4)",
    "fine": f"fine AS (SELECT vec_id - 4 AS center, {minus('v', 'pvt')} AS pvt FROM (SELECT e.vec_id, e.v, c.pvt, row_number() OVER (PARTITION BY e.vec_id ORDER BY round({d2('e.v', 'c.pvt')}, 9), c.center) AS rn FROM emb e, coarse c WHERE e.vec_id BETWEEN 4 AND 7) WHERE rn = 1)",
    "assigned": f"""assigned AS (SELECT vec_id, cluster_id, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, cluster_id) AS rn FROM
  (SELECT e.vec_id, c.center * 4 + f.center AS cluster_id, round(sqrt({d2('e.v', 'c.pvt')}) + sqrt({d2(minus('e.v', 'c.pvt'), 'f.pvt')}), 9) AS score FROM emb e, coarse c, fine f)) WHERE rn = 1)""",
    "sizes": "sizes AS (SELECT i.cluster_id, count(a.vec_id) AS n FROM (SELECT unnest(range(16)) AS cluster_id) i LEFT JOIN assigned a USING (cluster_id) GROUP BY i.cluster_id)",
    "found": f"""qc AS (SELECT qid, center AS c, {minus('qv', 'pvt')} AS r FROM (SELECT q.qid, q.qv, k.center, k.pvt, row_number() OVER (PARTITION BY q.qid ORDER BY round({d2('q.qv', 'k.pvt')}, 9), k.center) AS rn FROM qry q, coarse k) WHERE rn = 1),
qf AS (SELECT q.qid, f.center, row_number() OVER (PARTITION BY q.qid ORDER BY round({d2('q.r', 'f.pvt')}, 9), f.center) AS rn FROM qc q, fine f JOIN sizes s ON TRUE WHERE s.cluster_id = q.c * 4 + f.center AND s.n > 0),
found AS (SELECT q.qid, q.c * 4 + coalesce(f.center, 0) AS cluster_id FROM qc q LEFT JOIN qf f ON f.qid = q.qid AND f.rn = 1)""",
    "lists": "lists AS (SELECT * FROM (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) AS pos, vec_id FROM assigned) WHERE pos <= 256)",
    "ent": f"ent AS (SELECT qid, unnest([{', '.join(map(str, ENTRY_IDS))}]::BIGINT[]) AS vec_id FROM qry)",
    "pool0": f"pool0 AS (SELECT e.qid, e.vec_id, a.dist, FALSE AS expanded, {rank('e.qid', 'a.dist', 'e.vec_id')} AS rank FROM ent e JOIN adc a USING (qid, vec_id))",
    "seen0": "seen0 AS (SELECT qid, vec_id FROM ent)",
    "pool1": a_round(1),
    "pool2": a_round(2),
    "final": all_rounds(40),
    "checks": """state AS (SELECT p.n, p.qid, p.valid, v.visited, (SELECT count(*) FROM went w WHERE w.qid = p.qid AND w.n <= p.n) AS x FROM (SELECT n, qid, count(*) AS valid FROM walk GROUP BY n, qid) p JOIN (SELECT n, qid, count(*) AS visited FROM knew GROUP BY n, qid) v USING (n, qid)),
due AS (SELECT stage, prefix, qid, min(n) AS n FROM state, (VALUES (0, 10), (1, 16), (2, 24)) t(stage, prefix) WHERE valid >= 32 AND x >= prefix GROUP BY ALL),
one AS (SELECT d.stage, d.prefix, d.qid, any_value(s.x) AS x, any_value(s.visited) AS visited, coalesce(min(p.rank - 1) FILTER (NOT p.expanded), 32) AS first_open, count(*) FILTER (NOT p.expanded AND p.rank > d.prefix) AS open,
  max(p.dist) FILTER (p.rank = 10) AS dk, max(p.dist) FILTER (p.rank = d.prefix) AS edge, max(p.dist) FILTER (p.rank = least(32, d.prefix)) AS g32, list(p.vec_id ORDER BY p.rank) FILTER (p.rank <= 10) AS top
  FROM due d JOIN walk p USING (n, qid) JOIN state s USING (n, qid) GROUP BY d.stage, d.prefix, d.qid),
checks AS (SELECT *, lag(dk) OVER w AS dk0, lag(edge) OVER w AS edge0, lag(top) OVER w AS top0 FROM one WINDOW w AS (PARTITION BY qid ORDER BY stage))""",
    "tiled": tiles(32, 8, 10),
    "first_kth": f"first_kth AS (SELECT qid, exact AS kth FROM (SELECT qid, exact, {rank('qid', 'exact')} AS r FROM rpool WHERE rank <= 12) WHERE r = 10)",
    "stops": "tk AS (" + " UNION ALL ".join(f"SELECT qid, {p} AS processed, exact AS kth FROM (SELECT qid, exact, {rank('qid', 'exact')} AS r FROM expool WHERE rank <= {p}) WHERE r = 4" for p in range(4, 33, 4)) + """),
st AS (SELECT qid, processed, CASE WHEN round(lag(kth) OVER (PARTITION BY qid ORDER BY processed), 9) <= round(kth, 9) AND processed >= 8 THEN processed END AS s FROM tk),
stops AS (SELECT qid, coalesce(min(s), 32) AS stop_prefix FROM st GROUP BY qid)""",
    "feat": features([10, 12, 14, 16], 10, 32, 4, "feat"),
    "learned": features([10, 12, 14, 16], 10, 32, 4, "learned", 1),
    "ladder": features(rerank_ladder(10, 32), 10, 32, 4, "ladder"),
    "need": f"need AS (SELECT qid, max(rank) AS deepest FROM (SELECT qid, rank, {rank('qid', 'exact')} AS r FROM rpool) WHERE r <= 10 GROUP BY qid)",
    "km0": "km0 AS (SELECT vec_id AS center, v AS pvt FROM emb WHERE vec_id < 16)",
    "km1": lloyd("km1", "km0"),
    "km24": fit("km24", "emb", "vec_id AS center, v AS pvt", 24),
    "kmc": fit("kmc", "emb", "vec_id AS center, v AS pvt", 80),
    "pqt": fit("pqt", "sub", "chunk, vec_id AS center, sub AS pvt", 14),
    "rest": fit("rest", "res", "chunk, vec_id AS center, sub AS pvt", 14),
    "worst": f"worst AS (SELECT s.*, row_number() OVER (PARTITION BY s.chunk ORDER BY s.vec_id) - 1 AS pos FROM sub s JOIN (SELECT chunk, vec_id, row_number() OVER (PARTITION BY chunk ORDER BY round(-err, 9), vec_id) AS r FROM code) USING (chunk, vec_id), points WHERE r <= least(n, greatest(16, floor(0.2 * n))))",
    "hpqt": fit("hpqt", "worst", "chunk, pos AS center, sub AS pvt", 14),
}
#: Names that a step of several tables defines besides its own.
INSIDE = {"chosen1": "pool1", "front1": "pool1", "fresh1": "pool1", "both1": "pool1", "seen1": "pool1", "seen2": "pool2", "walk": "final", "went": "final", "knew": "final"}


def sql(body: str) -> str:
    """The body behind WITH and all the steps it needs, in order."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\b[a-z_]+[0-9]*\b", text)):
            step = INSIDE.get(name, name)
            if step in STEPS and step not in need:
                need.add(step)
                visit(STEPS[step])

    visit(body)
    steps = ",\n".join(STEPS[k] for k in STEPS if k in need)
    return f"WITH {steps}\n{body}" if steps else body


def ranks(src: str, more: str = "") -> str:
    return f"SELECT qid, rank, vec_id, round(dist, 6) AS dist{more} FROM {src}"


def resorted(src: str) -> str:
    return f"SELECT qid, {rank('qid')} AS rank, vec_id, round(dist, 6) AS dist FROM {src}"


def topk(src: str, k: int, part: str = "qid") -> str:
    return f"SELECT {part}, rank, vec_id, round(dist, 6) AS dist FROM (SELECT {part}, vec_id, dist, {rank(part)} AS rank FROM ({src})) WHERE rank <= {k}"


def dims(src: str, col: str) -> str:
    return f"SELECT vec_id, chunk * 8 + p AS dim, round(x, 6) AS v FROM (SELECT vec_id, chunk, unnest({col}) AS x, unnest(range(8)) AS p FROM {src})"


def centers(src: str) -> str:
    return f"SELECT center, dim, round(x, 6) AS v, members FROM (SELECT center, members, unnest(pvt) AS x, unnest(range(64)) AS dim FROM {src})"


def book(src: str) -> str:
    return f"SELECT chunk, center, dim, round(x, 6) AS v FROM (SELECT chunk, center, unnest(pvt) AS x, unnest(range(8)) AS dim FROM {src})"


def hot(src: str) -> str:
    return f"""SELECT pct, round(100.0 * sum(n) FILTER (pos <= ceil(pct * m / 100)) / sum(n), 6) AS cumulative_pct FROM
(SELECT n, row_number() OVER (ORDER BY n DESC, id) AS pos, count(*) OVER () AS m FROM ({src})), (SELECT unnest([1, 5, 10, 20, 30, 50]) AS pct) GROUP BY pct"""


def linear(bias: float, w: dict[str, float]) -> str:
    return " + ".join([repr(bias), *(f"{k} * {v!r}" for k, v in w.items())])


_ROUNDED = ", ".join(f"round({f}, 6) AS {f}" for f in RERANK)
_HIST = "SELECT '{}' AS stage, coalesce(p.rank, 0) AS rank, count(*) AS n FROM truth t LEFT JOIN {} p USING (qid, vec_id) GROUP BY ALL"
_RES = f"(SELECT qid, vec_id, {rank('qid')} AS rank FROM refined)"
_RUN = "SELECT '{0}' AS metric, count({1}) AS count, round(coalesce(min({1}), 0), 6) AS min, round(coalesce(max({1}), 0), 6) AS max, round(coalesce(avg({1}), 0), 6) AS avg FROM rpool"

BODIES: dict[str, str] = {
    "topk_exact": ranks("truth"),
    "topk_limit": ranks("ranked WHERE rank <= 10"),
    "exact_l2": "SELECT qid, vec_id, round(exact, 6) AS dist FROM expool",
    "query_norm": "SELECT qid, round(list_dot_product(qv, qv), 6) AS norm_sq FROM qry",
    "vector_lookup": "SELECT vec_id, dim, round(x, 6) AS v FROM (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM emb WHERE vec_id IN (3, 77, 421))",
    "page_address": "SELECT vec_id, vec_id // 16 AS page_id, vec_id % 16 AS slot_id, 4096 + (vec_id // 16) * 4096 + (vec_id % 16) * 256 AS byte_offset FROM emb",
    "page_fetch": "SELECT vec_id // 16 AS page_id, count(*) AS n_vectors, round(sum(list_sum(v)), 6) AS sum_v FROM emb WHERE vec_id // 16 IN (SELECT vec_id // 16 FROM pool) GROUP BY 1",
    "combined_node_lookup": "SELECT vec_id, count(*) OVER (PARTITION BY src) AS degree, dst AS neighbor, slot FROM emb JOIN graph ON src = vec_id",
    "scan_graph": "SELECT src, slot, dst FROM graph",
    "graph_subset_filter": "SELECT src, count(*) FILTER (dst < n // 2) AS kept, count(*) FILTER (dst >= n // 2) AS dropped FROM graph, points GROUP BY src",
    "verify_sample": "SELECT vec_id, TRUE AS ok FROM emb WHERE vec_id % 37 = 0",
    "pq_encode": "SELECT vec_id, chunk, center, round(err, 6) AS err FROM code",
    "pq_lut": "SELECT qid, chunk, center, round(d, 6) AS d FROM lut",
    "pq_adc": "SELECT qid, vec_id, round(dist, 6) AS dist FROM ranked WHERE rank <= 100",
    "pq_reconstruct": dims("dec", "approx"),
    "pq_residual": dims("res", "sub"),
    "residual_pq_encode": "SELECT vec_id, chunk, center FROM rcode",
    "residual_error": "SELECT vec_id, round(err, 6) AS err FROM errs",
    "pq_cross_terms": "SELECT chunk, base_center, res_center, round(x, 6) AS x FROM cross_t",
    "lower_bound": "SELECT qid, vec_id, round(lb, 6) AS lb, round(exact, 6) AS exact, lb <= exact + 1e-9 AS safe FROM rpool",
    "hpq_outlier_select": f"SELECT chunk, vec_id, round(err, 6) AS err FROM (SELECT chunk, vec_id, err, row_number() OVER (PARTITION BY chunk ORDER BY round(-err, 9), vec_id) AS r FROM code), points WHERE r <= least(n, greatest(16, floor(0.2 * n)))",
    "hpq_encode": "SELECT vec_id, chunk, code, use_outlier FROM hcode",
    "kmeans_step": centers("km1"),
    "kmeans_fit": centers("km24"),
    "kmeans_converged": centers("kmc"),
    "pq_train": book("pqt"),
    "hpq_train": book("hpqt"),
    "residual_train": book("rest"),
    "coarse_assign": f"SELECT vec_id, center AS coarse_id, round(round(d, 9), 6) AS dist FROM (SELECT e.vec_id, c.center, {d2('e.v', 'c.pvt')} AS d, row_number() OVER (PARTITION BY e.vec_id ORDER BY round({d2('e.v', 'c.pvt')}, 9), c.center) AS rn FROM emb e, coarse c) WHERE rn = 1",
    "rvq_search": "SELECT qid, cluster_id FROM found",
    "rvq_build": "SELECT vec_id, cluster_id, round(score, 6) AS score FROM assigned",
    "cluster_sizes": "SELECT cluster_id, n FROM sizes",
    "entry_postings": "SELECT cluster_id, pos, vec_id FROM lists",
    "entry_points": "SELECT qid, coalesce(pos, 1) AS pos, coalesce(vec_id, 0) AS vec_id FROM found LEFT JOIN (SELECT * FROM lists WHERE pos <= 8) USING (cluster_id)",
    "search_seed": ranks("pool0"),
    "expand_neighbors": "SELECT qid, vec_id FROM front1",
    "frontier_unvisited": "SELECT qid, vec_id FROM fresh1",
    "pool_merge": f"SELECT qid, rank, vec_id, round(dist, 6) AS dist, expanded FROM (SELECT *, {rank('qid')} AS rank FROM (SELECT qid, vec_id, dist, expanded FROM pool0 UNION ALL SELECT f.qid, f.vec_id, a.dist, FALSE FROM fresh1 f JOIN adc a USING (qid, vec_id))) WHERE rank <= 32",
    "beam_round": ranks("pool1", ", expanded"),
    "beam_search": ranks("pool2", ", expanded"),
    "uncached_requests": "SELECT qid, vec_id, vec_id < n // 2 AS cached FROM chosen1, points",
    "stop_predicate": "SELECT qid, count(*) AS valid, min(rank - 1) FILTER (NOT expanded) AS best_unexpanded_rank, count(*) >= 32 AND count(*) FILTER (rank <= 32 AND NOT expanded) = 0 AS done FROM pool1 GROUP BY qid",
    "gt_visited": "SELECT t.qid, t.rank AS gt_rank, s.vec_id IS NOT NULL AS visited FROM truth t LEFT JOIN (SELECT * FROM seen0 UNION SELECT * FROM front1) s USING (qid, vec_id)",
    "pq2_refine": resorted("(SELECT p.qid, p.vec_id, sum(l.d) AS dist FROM pool p JOIN ocode c USING (vec_id) JOIN olut l ON l.qid = p.qid AND l.chunk = c.chunk AND l.center = c.center GROUP BY p.qid, p.vec_id)"),
    "residual_refine": resorted("refined"),
    "hpq_refine": resorted("hdist"),
    "refine_input_stats": "SELECT sum(n)::BIGINT AS total, min(n) AS min_n, max(n) AS max_n FROM (SELECT count(*) AS n FROM pool GROUP BY qid)",
    "rerank_exact": topk("SELECT qid, vec_id, exact AS dist FROM expool WHERE rank <= 16", 10),
    "rerank_io_pages": "SELECT count(DISTINCT vec_id // 16) AS unique_pages, count(*) AS exact_count FROM pool WHERE rank <= 16",
    "bound_filter": "SELECT qid, vec_id, round(lb, 6) AS lb, rank <= 12 OR kth IS NULL OR round(lb, 9) <= round(kth, 9) AS kept FROM rpool LEFT JOIN first_kth USING (qid) WHERE rank <= 16",
    "bound_filter_tiled": "SELECT qid, count(*) FILTER (kept) AS exact_count, count(*) FILTER (NOT kept) AS filtered_count FROM tiled GROUP BY qid",
    "bound_safety": "SELECT qid, count(*) FILTER (kept) AS exact_count, count(*) FILTER (NOT kept) AS filtered_count, coalesce(min(rank) FILTER (NOT kept), 0) AS first_filtered_rank, count(*) FILTER (NOT kept AND round(exact, 9) < round(threshold, 9)) AS violations FROM tiled GROUP BY qid",
    "bound_stats": _RUN.format("lb", "lb") + " UNION ALL " + _RUN.format("gap", "(exact - lb)"),
    "exact_reuse": "SELECT qid, vec_id, round(exact, 6) AS dist, rank % 2 = 1 AS reused FROM expool WHERE rank <= 16",
    "reuse_profile": "SELECT ratio, prefix, count(*) AS valid, count(*) FILTER (expanded) AS expanded, count(*) FILTER (expanded AND vec_id >= floor(ratio * n)) AS reusable FROM pool1, points, (SELECT unnest([0.25, 0.5]::DOUBLE[]) AS ratio), (SELECT unnest([8, 16, 32]) AS prefix) WHERE rank <= prefix GROUP BY ALL",
    "rerank_early_stop": "SELECT qid, stop_prefix FROM stops",
    "rerank_replay": topk("SELECT qid, vec_id, exact AS dist FROM expool JOIN stops USING (qid) WHERE rank <= stop_prefix", 10),
    "rerank_persistent": topk("SELECT qid, vec_id, exact AS dist FROM tiled WHERE kept", 10),
    "rerank_sweep": topk("SELECT top_n, qid, vec_id, exact AS dist FROM expool, (SELECT unnest([8, 16, 32]) AS top_n) WHERE rank <= top_n", 10, "top_n, qid"),
    "stop_features": f"SELECT qid, stage, prefix, {_ROUNDED} FROM feat",
    "rerank_stop_logit": f"SELECT qid, stage, round(x, 6) AS logit, round(x, 6) < 0 AS stop FROM (SELECT qid, stage, {linear(RERANK_BIAS, RERANK_W)} AS x FROM feat)",
    "rerank_stop_dataset": f"SELECT qid, stage, prefix, {_ROUNDED}, CASE WHEN prefix < deepest THEN 1 ELSE 0 END AS label FROM ladder JOIN need USING (qid)",
    "rerank_learned_stop": f"SELECT qid, coalesce(min(prefix) FILTER (x < 0), 32) AS stop_prefix FROM (SELECT qid, prefix, {linear(RERANK_BIAS, RERANK_W)} AS x FROM learned) GROUP BY qid",
    "beam_search_full": ranks("final", ", expanded"),
    "beam_search_kernel": ranks("final", ", expanded"),
    "beam_search_prefix": ranks("(SELECT p.* FROM walk p JOIN (SELECT qid, min(n) AS n FROM (SELECT n, qid FROM walk GROUP BY n, qid HAVING count(*) FILTER (rank <= 16 AND NOT expanded) = 0 AND count(*) >= 16) GROUP BY qid) s USING (n, qid))", ", expanded"),
    "stop_dataset": """SELECT qid, stage, prefix, round(prefix / 32, 6) AS prefix_frac, round(x / 32, 6) AS expanded_frac, round(visited / 32, 6) AS visited_frac, round(first_open / 32, 6) AS best_unexpanded, round(open / (32 - prefix), 6) AS next64, round(open / (32 - prefix), 6) AS next256,
  round(dk, 6) AS dk, round(edge - dk, 6) AS gap_prefix, round(g32 - dk, 6) AS gap32, round(coalesce(dk0 - dk, 0), 6) AS delta_dk, round(coalesce(edge0 - edge, 0), 6) AS delta_boundary,
  CASE WHEN top0 IS NULL THEN 1.0::DOUBLE ELSE len(list_filter(top, lambda i: NOT list_contains(top0, i))) / 10 END AS churn, CASE WHEN top <> f.ids THEN 1 ELSE 0 END AS label
FROM checks JOIN (SELECT qid, list(vec_id ORDER BY rank) AS ids FROM final WHERE rank <= 10 GROUP BY qid) f USING (qid)""",
    "result_checksum": "SELECT bit_xor(h) AS checksum FROM (SELECT list_reduce(list_prepend(2166136261, list(vec_id ORDER BY rank)), lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS h FROM truth GROUP BY qid)",
    "rerank_linear": topk("SELECT qid, vec_id, exact AS dist FROM expool", 10),
    "recall_at_k": "SELECT round(count(*) / (SELECT count(*) * 10 FROM qry), 6) AS recall FROM ranked r SEMI JOIN truth t USING (qid, vec_id) WHERE r.rank <= 10",
    "overlap_thresholds": "SELECT threshold, count(*) FILTER (r.rank <= threshold) AS matched, count(*) AS total FROM truth t JOIN ranked r USING (qid, vec_id), (SELECT unnest([10, 20, 50, 100]) AS threshold) GROUP BY threshold",
    "pq_rerank_overlap": f"SELECT threshold, count(*) FILTER (r.rank <= threshold) AS matched FROM truth t LEFT JOIN (SELECT qid, vec_id, {rank('qid')} AS rank FROM hdist) r USING (qid, vec_id), (SELECT unnest([10, 20, 32]) AS threshold) GROUP BY threshold",
    "gt_rank_hist": _HIST.format("before", "pool") + " UNION ALL " + _HIST.format("after", _RES),
    "iteration_summary": "SELECT round(avg(n), 6) AS avg, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, max(n) AS max FROM (SELECT t.qid, count(p.rank) AS n FROM truth t LEFT JOIN pool p USING (qid, vec_id) GROUP BY t.qid)",
    "hist_quantile": "SELECT q, min(depth) AS depth FROM (SELECT depth, sum(count(*)) OVER (ORDER BY depth) AS cum FROM (SELECT count(*) AS depth FROM pool GROUP BY vec_id) GROUP BY depth), (SELECT count(DISTINCT vec_id) AS n FROM pool), (SELECT unnest([0.5, 0.9, 0.99, 1.0]::DOUBLE[]) AS q) WHERE cum > floor(q * (n - 1)) GROUP BY q",
    "hotset_coverage": hot("SELECT vec_id AS id, count(*) AS n FROM pool GROUP BY vec_id"),
    "hotset_events": hot("SELECT user_id AS id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id"),
    "pareto_frontier": "SELECT recall, qps FROM (SELECT *, max(qps) OVER (ORDER BY recall DESC, qps ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in SWEEP) + ") t(recall, qps)) WHERE best IS NULL OR qps > best",
    "batch_plan": "SELECT b AS batch_id, b * 20 AS query_offset, CASE WHEN b = 4 THEN 23 ELSE 20 END AS num_queries FROM (SELECT unnest(range(5)) AS b)",
    "cache_sweep": "SELECT ratio, c AS cached_nodes, count(*) FILTER (vec_id < c) AS hits, count(*) FILTER (vec_id >= c) AS misses FROM pool, (SELECT ratio, least(n, floor(ratio * n))::BIGINT AS c FROM points, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS ratio)) GROUP BY ALL",
    "run_metrics": """SELECT round(avg(v.visited), 6) AS avg_visited, round(avg(p.expanded), 6) AS avg_expanded, round(avg(p.exact), 6) AS avg_exact, round(avg(p.pages), 6) AS avg_pages FROM
(SELECT qid, count(*) FILTER (expanded) AS expanded, count(*) FILTER (rank <= 16) AS exact, count(DISTINCT vec_id // 16) FILTER (rank <= 16) AS pages FROM pool1 GROUP BY qid) p JOIN
(SELECT qid, count(*) AS visited FROM (SELECT * FROM seen0 UNION SELECT * FROM front1) GROUP BY qid) v USING (qid)""",
}


_FLAT = "(SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM emb)"
_ROW = "row_number() OVER (PARTITION BY dim ORDER BY vec_id) - 1"
_BYTE = "least(255, greatest(0, floor((x + 1) * 127.5)))::BIGINT"
_REPORT = """SELECT '{}' AS stage, to_json(struct_pack(found := count(p.rank), not_found := count(*) FILTER (p.rank IS NULL), "min" := coalesce(min(p.rank), 0), "max" := coalesce(max(p.rank), 0), "sum" := coalesce(sum(p.rank), 0)::BIGINT))::VARCHAR AS report FROM truth t LEFT JOIN {} p USING (qid, vec_id)"""

BODIES |= {
    "scan_rawfloat": f"SELECT r AS vec_id, dim, round(x, 6) AS v FROM (SELECT {_ROW} AS r, dim, x FROM {_FLAT}), points WHERE r >= n // 2",
    "scan_vector_store": f"SELECT {_ROW} AS vec_id, dim, {_BYTE} AS v FROM {_FLAT}",
    "bvecs_to_fbin": f"SELECT {_ROW} AS vec_id, dim, {_BYTE} AS v FROM {_FLAT}",
    "scan_topology": "SELECT src, slot, dst FROM graph",
    "scan_topology_subset": "SELECT src, row_number() OVER (PARTITION BY src ORDER BY slot) AS slot, dst FROM graph, points WHERE src < n // 2 AND dst < n // 2",
    "scan_disk_graph": "SELECT vec_id, (SELECT count(*) FROM graph g WHERE g.src = vec_id) AS degree, (SELECT dst FROM graph g WHERE g.src = vec_id AND slot = 1) AS nearest, round(list_sum(v), 6) AS sum_v FROM emb",
    "scan_combined_nodes": "SELECT vec_id, dst AS neighbor, round(v[1], 6) AS first_v FROM emb JOIN graph ON src = vec_id",
    "scan_pq_codes": "SELECT vec_id, chunk, center FROM code",
    "pq_code_slice": "SELECT vec_id, chunk, center FROM code, points WHERE vec_id < n // 2",
    "scan_residual_pq": "SELECT vec_id, center AS first_center, round(err::FLOAT::DOUBLE, 6) AS err FROM (SELECT vec_id, center FROM rcode WHERE chunk = 0) JOIN errs USING (vec_id)",
    "scan_hpq": "SELECT vec_id, chunk, code, use_outlier FROM hcode",
    "scan_truth": "SELECT dense_rank() OVER (ORDER BY qid) - 1 AS query_no, rank, vec_id, round(dist::FLOAT::DOUBLE, 6) AS dist FROM truth",
    "page_trace_depths": "SELECT depth, count(*) AS pages FROM (SELECT count(*) AS depth FROM pool GROUP BY vec_id // 16) GROUP BY depth",
    "stop_trace": "SELECT qid, stop_prefix FROM stops",
    "rerank_stop_csv": f"SELECT qid, stage, prefix, {_ROUNDED}, CASE WHEN prefix < deepest THEN 1 ELSE 0 END AS label FROM feat JOIN need USING (qid)",
    "expanded_frequency_csv": "SELECT vec_id, count(*) AS n FROM final WHERE expanded GROUP BY vec_id",
    "truth_rank_report": _REPORT.format("before", "pool") + " UNION ALL " + _REPORT.format("after", _RES),
    "subset_manifest": "SELECT to_json(struct_pack(vectors := n // 2, dim := 64, codes := n // 2, chunks := 8, edges := (SELECT count(*) FROM graph WHERE src < n // 2 AND dst < n // 2)))::VARCHAR AS manifest FROM points",
    "run_rates": "SELECT round(count(DISTINCT qid) / 0.25, 6) AS qps, round(count(*) * 4096 / 0.25 / 1e9, 6) AS gb_s FROM pool WHERE rank <= 16",
}


_SCALAR = {"u8": "list_transform({}, lambda x: least(255, greatest(0, floor((x + 1) * 127.5))))", "i8": "list_transform({}, lambda x: least(127, greatest(-128, floor(x * 127))))"}


def scalars(kind: str) -> str:
    d = d2(_SCALAR[kind].format("v"), _SCALAR[kind].format("qv"))
    src = f"SELECT p.qid, p.vec_id, {d} AS dist FROM pool p JOIN emb USING (vec_id) JOIN qry USING (qid) WHERE p.rank <= 16"
    return f"SELECT *, '{kind}' AS kind FROM ({topk(src, 10)})"


BODIES["traversal_stop_csv"] = BODIES["stop_dataset"]
_TWO = "(SELECT qid, rank, vec_id, expanded FROM {})"
BODIES |= {
    "rerank_modes": " UNION ALL ".join(f"SELECT *, '{m}' AS mode FROM ({topk('SELECT qid, vec_id, exact AS dist FROM rpool', 10)})" for m in ("host", "linear", "tiled", "page_by_page", "persistent")),
    "rerank_replay_persistent": topk("SELECT qid, vec_id, exact AS dist FROM expool JOIN stops USING (qid) WHERE rank <= greatest(stop_prefix, 10)", 10),
    "rerank_exact_scalars": scalars("u8") + " UNION ALL " + scalars("i8"),
    "entry_providers": """SELECT qid, i + 1 AS pos, [300, 100][i + 1] AS vec_id, 'fixed' AS provider FROM qry, (SELECT unnest(range(2)) AS i) UNION ALL SELECT qid, rank, vec_id, 'per_query' FROM truth WHERE rank <= 3
UNION ALL SELECT qid, coalesce(pos, 1), coalesce(vec_id, 0), 'quantizer' FROM found LEFT JOIN (SELECT * FROM lists WHERE pos <= 4) USING (cluster_id)""",
    "snapshot_diff": f"SELECT qid, side, count(*) AS n FROM (SELECT *, 'only_before' AS side FROM ({_TWO.format('pool1')} EXCEPT ALL {_TWO.format('pool2')}) UNION ALL SELECT *, 'only_after' FROM ({_TWO.format('pool2')} EXCEPT ALL {_TWO.format('pool1')})) GROUP BY qid, side",
    "stage_lookup": "SELECT qid, CASE WHEN rank <= 10 THEN 0 WHEN rank <= 12 THEN 1 WHEN rank <= 14 THEN 2 WHEN rank <= 16 THEN 3 END AS stage, count(*) AS n FROM pool GROUP BY ALL",
    "rvq_model": "SELECT level, center, dim, round(x, 6) AS v FROM (SELECT 'coarse' AS level, center, unnest(pvt) AS x, unnest(range(64)) AS dim FROM coarse UNION ALL SELECT 'fine', center, unnest(pvt), unnest(range(64)) FROM fine)",
    "cache_sizes": "SELECT gib, c AS cached_nodes, count(*) FILTER (vec_id < c) AS hits, count(*) FILTER (vec_id >= c) AS misses FROM pool, (SELECT gib, least(n, floor(gib * 1073741824 / 256))::BIGINT AS c FROM points, (SELECT unnest([0.00001, 0.00005, 1.0]::DOUBLE[]) AS gib)) GROUP BY ALL",
}


def oracle_sql() -> dict[str, str]:
    return {k: sql(b) for k, b in BODIES.items()}


BODIES |= {
    "scan_fbin": "SELECT row_number() OVER (PARTITION BY dim ORDER BY vec_id) - 1 AS vec_id, dim, round(x, 6) AS v FROM (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM emb)",
    "scan_bvecs": "SELECT row_number() OVER (PARTITION BY dim ORDER BY vec_id) - 1 AS vec_id, dim, least(255, greatest(0, floor((x + 1) * 127.5)))::BIGINT AS v FROM (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM emb)",
    "scan_pq": "SELECT dim // 8 AS chunk, center, dim % 8 AS dim, round(x, 6) AS v FROM (SELECT row_number() OVER (PARTITION BY dim ORDER BY vec_id) - 1 AS center, dim, x FROM (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM emb)) WHERE center < 256",
}
