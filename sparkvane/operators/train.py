"""Training of codebooks: k-means of single vectors on all rows, the codebooks of the
index on bounded samples.

A sample is the first `most` rows by id, so it is a bounded, documented part of the
table; everything trained on it is then used on all rows. One task (or one task a
chunk) holds the sample as a matrix and iterates on it; only the centers leave."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvane.operators.pq import outlier_rows
from sparkvane.operators.vectors import packed, rough
from sparkvane.session import delete, kept, ship

SAMPLE = 65_536
ITERATIONS, PQ_ITERATIONS, ALTERNATIONS = 25, 15, 10
LEAST_GAIN = 1e-4
BLOCK = 4096


def assign(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest center of each row (ties to the first) and the squared distance, rounded to nine digits."""
    at, d = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, BLOCK * 64 // max(1, len(centers)))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        far = np.round(((part[:, None, :] - centers[None]) ** 2).sum(axis=2), 9)
        at[lo : lo + step] = far.argmin(axis=1)
        d[lo : lo + step] = far[np.arange(len(part)), at[lo : lo + step]]
    return at, d


def kmeans(x: np.ndarray, start: np.ndarray, iterations: int | None = ITERATIONS) -> tuple[np.ndarray, np.ndarray, float]:
    """(centers, members of each, total error) of Lloyd's rounds from the given
    centers; empty centers keep their place. With `iterations`, the centers of least
    total error among those rounds and the members of the last round; without, rounds
    go on until no row changes its center, and the centers are the last ones."""
    centers, best, least, last = start.copy(), start, np.inf, None
    done = 0
    while iterations is None or done < iterations:
        at, d = assign(x, centers)
        if iterations is None or d.sum() < least:  # errors that round to the same do not tell rounds apart
            best, least = centers.copy(), float(d.sum())
        if last is not None and (at == last).all():
            break  # later rounds would repeat this one
        n = np.bincount(at, minlength=len(centers))
        for j in range(x.shape[1]):
            sums = np.bincount(at, x[:, j], minlength=len(centers))
            centers[n > 0, j] = sums[n > 0] / n[n > 0]
        last, done = at, done + 1
    members = np.bincount(last if last is not None else assign(x, centers)[0], minlength=len(centers))
    return best, members, least


def alternate(x: np.ndarray, coarse_k: int, fine_k: int, rounds: int = ALTERNATIONS, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, float]:
    """Two-level codebooks: coarse on x - fine, fine on x - coarse, in turn; those of
    least fine error are kept, and an improvement must be at least LEAST_GAIN."""
    coarse, fine, part = x[:coarse_k].copy(), None, np.zeros_like(x)
    best, least = None, np.inf
    for _ in range(rounds):
        coarse, _, _ = kmeans(x - part, coarse, iterations)
        rest = x - coarse[assign(x - part, coarse)[0]]
        fine, _, error = kmeans(rest, rest[:fine_k].copy() if fine is None else fine, iterations)
        part = fine[assign(rest, fine)[0]]
        if best is None or least - error >= LEAST_GAIN:
            best, least = (coarse.copy(), fine.copy()), error
    return *best, least


def sample(vectors: DataFrame, most: int = SAMPLE, id_col: str = "vec_id") -> DataFrame:
    """The first `most` rows by id."""
    return vectors.orderBy(id_col).limit(most)


def in_one_task(vectors: DataFrame, work: Callable[[np.ndarray], list[tuple[str, np.ndarray, np.ndarray]]], most: int = SAMPLE) -> DataFrame:
    """level, center, pivot, members of work(matrix of the sample in order of id)."""
    ship(vectors.sparkSession)
    rows = sample(vectors.select("vec_id", "v"), most).coalesce(1).sortWithinPartitions("vec_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1) for b in batches if len(b)]
        for level, centers, members in work(np.concatenate(parts)) if parts else ():
            yield _centers(level, centers, members)

    return rows.mapInArrow(run, "level string, center long, pivot array<double>, members long")


def _centers(level: str, centers: np.ndarray, members: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([level] * len(centers)), pa.array(np.arange(len(centers)), pa.int64()), pa.array(centers.tolist(), pa.list_(pa.float64())), pa.array(members, pa.int64())],
                                      names=["level", "center", "pivot", "members"])


def closest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The centers of assign(): rough distances settle the rows with one center within their error, differences the rest."""
    far = rough(x, centers)
    near = far <= far.min(axis=1)[:, None] + (1e-6 + 1e-10 * np.abs(far).max(initial=0.0))
    at, many = far.argmin(axis=1), np.flatnonzero(near.sum(axis=1) > 1)
    at[many] = assign(x[many], centers)[0]
    return at


def _round(blocks: DataFrame, centers: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """(members, sums, total error, whether a row has another center than by `before`)
    of one pass over all rows; a task returns one row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, error, moved = np.zeros(len(centers), np.int64), np.zeros(centers.shape), 0.0, before is None
        for b in batches:
            for vecs in b.column(1).to_pylist():
                x = np.frombuffer(vecs).reshape(-1, centers.shape[1])
                at = closest(x, centers)
                n += np.bincount(at, minlength=len(centers))
                for j in range(x.shape[1]):
                    sums[:, j] += np.bincount(at, x[:, j], minlength=len(centers))
                error += float(np.round(((x - centers[at]) ** 2).sum(axis=1), 9).sum())
                moved = moved or bool((at != closest(x, before)).any())
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n.tobytes()], "sums": [sums.tobytes()], "error": [error], "moved": [moved]})

    parts = sorted(blocks.select("n", "vecs").mapInArrow(run, "part long, n binary, sums binary, error double, moved boolean").collect())
    n = sum(np.frombuffer(p["n"], np.int64) for p in parts)
    sums = sum(np.frombuffer(p["sums"]) for p in parts).reshape(centers.shape)
    return n, sums, sum(p["error"] for p in parts), any(p["moved"] for p in parts)


def fit_kmeans(vectors: DataFrame, k: int, iterations: int | None = ITERATIONS) -> DataFrame:
    """center, pivot, members: kmeans() over all rows, from the first k by id;
    iterations=None: to convergence, with the last centers. A round is one pass over the table; counts and
    sums of each center are all that leaves a task."""
    spark = vectors.sparkSession
    ship(spark)
    schema = "center long, pivot array<double>, members long"
    first = sample(vectors.select("vec_id", "v"), k).collect()
    if not first:
        return spark.createDataFrame([], schema)
    centers, before, members = np.array([r["v"] for r in first], np.float64), None, None
    best, least, done = centers, np.inf, 0
    blocks, path = kept(packed(vectors.select("vec_id", "v"), BLOCK), "kmeans")
    while iterations is None or done < iterations:
        n, sums, error, moved = _round(blocks, centers, before)
        if iterations is None or error < least:
            best, least = centers, error
        members, done = n, done + 1
        if not moved:
            break  # later rounds would repeat this one
        before, centers = centers, np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    delete(spark, path)
    return spark.createDataFrame([(c, best[c].tolist(), int(members[c])) for c in range(len(best))], schema)


def fit_rvq(vectors: DataFrame, coarse_k: int, fine_k: int, rounds: int = ALTERNATIONS, iterations: int = ITERATIONS, most: int = SAMPLE) -> DataFrame:
    """level ('coarse' or 'fine'), center, pivot, members (zero: not counted)."""
    def work(x: np.ndarray):
        c, f, _ = alternate(x, coarse_k, fine_k, rounds, iterations)
        return [("coarse", c, np.zeros(len(c), np.int64)), ("fine", f, np.zeros(len(f), np.int64))]

    return in_one_task(vectors, work, most)


def fit_chunks(subs: DataFrame, k: int, iterations: int = PQ_ITERATIONS) -> DataFrame:
    """chunk, center, pivot: a codebook of k centers for each chunk, from its first k
    rows. subs (vec_id, chunk, sub) is a bounded sample; each chunk is one task."""
    ship(subs.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        x = np.array(t.column("sub").to_pylist(), np.float64)
        c, _, _ = kmeans(x, x[:k].copy(), iterations)
        return pa.table([pa.array(np.full(len(c), t.column("chunk")[0].as_py()), pa.int64()), pa.array(np.arange(len(c)), pa.int64()), pa.array(c.tolist(), pa.list_(pa.float64()))], names=["chunk", "center", "pivot"])

    return subs.select("vec_id", F.col("chunk").cast("long").alias("chunk"), "sub").groupBy("chunk").applyInArrow(run, "chunk long, center long, pivot array<double>")


def fit_outliers(subs: DataFrame, errors: DataFrame, k: int, fraction: float, least: int, most: int = SAMPLE) -> DataFrame:
    """The outlier codebook: per chunk, the rows of largest error (errors: vec_id,
    chunk, err) of all rows, at most `most`, make its training set."""
    rows = outlier_rows(errors, least, fraction, most)
    return fit_chunks(subs.join(rows.select("vec_id", "chunk"), ["vec_id", "chunk"]), k)
