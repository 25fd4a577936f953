"""Exact top-k inner products by ball trees.

Vectors are packed into shards of bounded size; each shard gets a ball tree once and
is a file in the shared folder, named in a committed list with its centre and radius.
Queries are packed into blocks, a block is one task. The task takes the shards in
descending order of their inner-product upper bound  q.c + r |q|,  reads those that
may still hold a result, and goes through each tree best bound first. A node is
skipped for every query whose current kth score exceeds its bound; the kth scores are
shared by all nodes of all shards, and once no shard can reach them the task ends.
Ties at the bound are visited, so the smaller id wins exactly.
"""

from __future__ import annotations

import heapq
import io
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvane.llm._store import arrow_map, cut, list_files, new_path, open_path, ship

SHARD_ROWS = 8192
LEAF_ROWS = 512
BLOCK_ROWS = 256
EXACT = 2.0**53


def quantise(col: str, scale: int = 64):
    """floor(scale * x) of each component, x as double."""
    return F.transform(col, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(col: str):
    """Not null, not empty, no null or non-finite component."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(col).isNotNull() & (F.size(col) > 0) & ~F.coalesce(bad, F.lit(True))


def build_tree(x: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Row order, nodes (from, to, left, right; -1: leaf), centres and radii.
    Splits at the median along the line between two far points; rows that do not
    differ stay together."""
    order = np.arange(len(x))
    nodes: list[list[int]] = [[0, len(x), -1, -1]]
    centres, radii, i = [], [], 0
    while i < len(nodes):
        lo, hi = nodes[i][:2]
        p = x[order[lo:hi]]
        c = p.mean(axis=0)
        d = np.sqrt(((p - c) ** 2).sum(axis=1))
        centres.append(c)
        radii.append(d.max())
        if hi - lo > leaf and d.max() > 0:
            a = p[d.argmax()]
            b = p[((p - a) ** 2).sum(axis=1).argmax()]
            along = p @ (b - a)
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(along, mid)]
            nodes[i][2:] = [len(nodes), len(nodes) + 1]
            nodes += [[lo, lo + mid, -1, -1], [lo + mid, hi, -1, -1]]
        i += 1
    return order, [tuple(n) for n in nodes], np.array(centres), np.array(radii)


class Best:
    """The k best (score descending, id ascending) of each query of a block."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.kth = np.full(len(ids), np.iinfo(np.int64).min)
        self.q = self.s = self.i = np.zeros(0, np.int64)

    def offer(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = np.concatenate([self.q, q]), np.concatenate([self.s, s]), np.concatenate([self.i, i])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, np.arange(len(self.ids)))
        rank = np.arange(len(q)) - first[q]
        keep = rank < self.k
        full = rank == self.k - 1
        self.kth[q[full]] = s[full]
        self.q, self.s, self.i = q[keep], s[keep], i[keep]


def search(best: Best, block: np.ndarray, norm: np.ndarray, ids: np.ndarray, x: np.ndarray, tree) -> int:
    """Branch and bound over one shard, the node of highest bound first; returns how many scores were computed."""
    nodes, centres, radii = tree
    bound = upper(block, norm, centres, radii)
    queue, scored = [(-bound[:, 0].max(), 0)], 0
    while queue:
        _, n = heapq.heappop(queue)
        act = np.flatnonzero(bound[:, n] >= best.kth)
        if not len(act):
            continue
        lo, hi, left, right = nodes[n]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(queue, (-bound[act, child].max(), child))
            continue
        for z in range(lo, hi, 4 * LEAF_ROWS):
            own = ids[z : min(hi, z + 4 * LEAF_ROWS)]
            s = np.rint(block[act] @ x[z : z + len(own)].T).astype(np.int64)
            scored += s.size
            hit = (s >= best.kth[act][:, None]) & (own[None, :] != best.ids[act][:, None])
            r, c = np.nonzero(hit)
            if len(r):
                best.offer(act[r], s[r, c], own[c])
    return scored


def upper(block: np.ndarray, norm: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries with balls, with a margin for rounding."""
    bound = block @ centres.T + norm[:, None] * radii[None, :]
    return bound + 1e-6 * (1 + np.abs(bound))


def _bytes(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
    return out.getvalue()


def _load(data: bytes, n: int) -> list[np.ndarray]:
    src = io.BytesIO(data)
    return [np.load(src, allow_pickle=False) for _ in range(n)]


def _small(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type."""
    for t in (np.int8, np.int16, np.int32):
        if not x.size or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max):
            return x.astype(t)
    return x


def _packed(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of at most `size` rows (ids, matrix) of one dimension."""
    held: dict[int, list] = {}  # by dimension: vectors of another length never meet
    for b in batches:
        ids, col = b.column(0).to_numpy(), b.column(1)
        at, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
        dims = np.diff(at)
        for d in np.unique(dims):
            who = np.flatnonzero(dims == d)
            x = flat[at[who][:, None] + np.arange(d)]
            own = held.setdefault(int(d), [np.zeros(0, np.int64), np.zeros((0, d), np.int64)])
            own[0], own[1] = np.concatenate([own[0], ids[who]]), np.concatenate([own[1], x])
            while len(own[0]) >= size:
                yield own[0][:size], own[1][:size]
                own[0], own[1] = own[0][size:], own[1][size:]
    for i, x in held.values():
        if len(i):
            yield i, x


def write_shards(vectors: DataFrame, folder: str, size: int) -> DataFrame:
    """One file per shard below `folder`; returns the committed list: path, dim, n,
    centre, radius. Files of failed task attempts are in no list."""
    schema = pa.schema([("path", pa.string()), ("dim", pa.int64()), ("n", pa.int64()), ("centre", pa.binary()), ("radius", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _packed(batches, size):
            order, nodes, centres, radii = build_tree(x.astype(np.float64))
            path = f"{folder}/{uuid.uuid4().hex}.shard"
            with open_path(path, True) as f:
                f.write(_bytes(ids[order], _small(x[order]), np.array(nodes, np.int64), centres, radii))
            row = [path, x.shape[1], len(ids), centres[0].astype(np.float64).tobytes(), float(radii[0])]
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, schema, strict=True)], schema=schema)

    return cut(arrow_map(vectors.select("id", "v"), run, "path string, dim long, n long, centre binary, radius double"), "shards")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner
    products of every query row with every vector row but those of its own id.

    queries, vectors: (id long, v array<long>). Ties go to the smaller id; a repeated
    row counts each time; null ids take no part. Vectors of another length are no
    candidates. No queries or no vectors: no rows. Products must stay below 2**53 in
    size, where doubles are exact: a query and a shard that could exceed it are an
    error. A task holds its block, one shard and the list of shards (one row for each
    `shard_rows` vectors, read from the shared folder)."""
    spark = queries.sparkSession
    ship(spark)
    q, v = queries.select("id", "v").where("id is not null"), vectors.select("id", "v").where("id is not null")
    shards = write_shards(v, new_path(spark, "vectors"), shard_rows)
    listing = new_path(spark, "shard-list")
    few = pa.schema([("ids", pa.binary()), ("vecs", pa.binary()), ("dim", pa.int64())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _packed(batches, block_rows):
            yield pa.RecordBatch.from_arrays([pa.array([_bytes(ids)]), pa.array([_bytes(_small(x))]), pa.array([x.shape[1]], pa.int64())], schema=few)

    blocks = cut(arrow_map(q.coalesce(max(1, spark.sparkContext.defaultParallelism // 2)), pack, "ids binary, vecs binary, dim long"), "blocks")
    shards.select("dim", F.struct("path", "n", "centre", "radius").alias("s")).write.partitionBy("dim").parquet(listing)
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                (ids,), (x,) = _load(b.column(0)[r].as_py(), 1), _load(b.column(1)[r].as_py(), 1)
                best, block = Best(ids, k), x.astype(np.float64)
                norm = np.sqrt((block * block).sum(axis=1))
                paths, centres, radii = _listed(f"{listing}/dim={b.column(2)[r].as_py()}", block.shape[1])
                high = np.concatenate([upper(block, norm, centres[i : i + 4096], radii[i : i + 4096]).max(axis=0) for i in range(0, len(paths), 4096)]) if paths else np.zeros(0)
                for i in np.argsort(-high, kind="stable"):
                    if high[i] < best.kth.min():
                        break
                    if norm.max() * (np.sqrt((centres[i] ** 2).sum()) + radii[i]) >= EXACT:
                        raise ValueError("inner products reach 2**53")
                    if not (upper(block, norm, centres[i : i + 1], radii[i : i + 1])[:, 0] >= best.kth).any():
                        continue
                    with open_path(paths[i]) as f:
                        own, vecs, nodes, cs, rs = _load(f.read(), 5)
                    search(best, block, norm, own, vecs.astype(np.float64), ([tuple(n) for n in nodes.tolist()], cs, rs))
                rank = np.arange(len(best.q)) - np.searchsorted(best.q, best.q) + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((ids[best.q], rank, best.i, best.s), schema, strict=True)], schema=schema)

    return arrow_map(blocks.repartition(max(1, blocks.count())), run, "query_id long, rank int, vec_id long, score long")


def _listed(folder: str, dim: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Paths, centres and radii of the shards of one dimension, in order of path."""
    rows: list[tuple] = []
    for path in list_files(folder):
        with open_path(path) as f:
            rows += [(s["path"], s["centre"], s["radius"]) for s in pq.read_table(io.BytesIO(f.read())).column("s").to_pylist()]
    rows.sort(key=lambda r: r[0])
    return [r[0] for r in rows], np.array([np.frombuffer(r[1]) for r in rows]).reshape(len(rows), dim), np.array([r[2] for r in rows])
