"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features of a text are the distinct hashes of its words, word bigrams and
skip-grams (one and two words left out), folded into 2**bits slots. Per-coordinate
learning rates and the L1 term leave few non-zero weights; these, a bounded list,
are broadcast to score every whole text.

Training reads a bounded, deterministic sample of labelled rows: those with the
smallest hash of doc_id, at most `max_rows` and, in that order, no more than make
`max_slots` features together. Features are made where the documents lie; one task
gathers them batch by batch and runs through them several times in hash order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvane.llm._store import arrow_map, free, ship
from sparkvane.llm._text import IS_ALNUM, U64, Words, list_array, mix, pieces, utf8

BITS = 20
#: The fitting sample: labelled rows and their feature slots (four bytes each) in one task.
MAX_ROWS, MAX_SLOTS = 20_000, 36_000_000
EPOCHS = 3
#: Weight of a toxic row's gradient (toxic rows are few), learning rate, L1: the
#: choice that found most toxic rows of a validation fifth of the labelled rows
#: outside the held-out one without rejecting a clean row.
POSITIVE = 1.25
ALPHA, BETA, L1, L2 = 1.5, 1.0, 8.0, 0.5
_SALTS = (U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25), U64(0xC13FA9A902A6328F), U64(0x91E10DA5C79E7B1D))


@dataclass
class Model:
    """Non-zero weights: slots ascending, their weights, and the bias."""

    bits: int
    slots: np.ndarray
    weights: np.ndarray
    bias: float


def features(w: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and rows of all words, bigrams and skip-grams (repeats included)."""
    h, n = w.h, len(w.h)
    row = np.repeat(np.arange(len(w.n)), w.n)
    mask = U64((1 << bits) - 1)
    slots, rows = [mix(h ^ _SALTS[0]) & mask], [row]
    for gap in (1, 2, 3):
        if n > gap:
            same = row[gap:] == row[:-gap]
            slots.append((mix(h[:-gap][same] * _SALTS[gap] + h[gap:][same]) & mask))
            rows.append(row[gap:][same])
    return np.concatenate(slots).astype(np.int64), np.concatenate(rows)


def distinct(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots (int32) of each text, row by row, and the rows' offsets in them."""
    buf, offs = utf8(texts)
    flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i, j in pieces(offs):
        s, r = features(Words(buf, offs[i : j + 1], lower=True, table=IS_ALNUM), bits)
        key = np.unique((r << bits) | s)
        sizes.append(np.bincount(key >> bits, minlength=j - i))
        flat.append((key & ((1 << bits) - 1)).astype(np.int32))
    return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def fit(chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, positive: float = POSITIVE) -> Model:
    """FTRL-proximal, one row at a time in the given order. chunks: (slots, row
    offsets, labels), as distinct() gives them; the arrays are only read."""
    bias = 1 << bits
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weight(zi, ni, lam):
        return np.where(np.abs(zi) <= lam, 0.0, (np.sign(zi) * lam - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    def step(at, w, g) -> None:
        n_at = n[at]
        z[at] += g - (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / alpha * w
        n[at] = n_at + g * g

    for _ in range(epochs):
        for flat, at, y in chunks:
            for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), y.tolist(), strict=True):
                x = flat[a:b]
                w, w0 = weight(z[x], n[x], l1), weight(z[bias], n[bias], 0.0)
                g = (1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - t) * (positive if t else 1.0)
                if g:
                    step(x, w, g)
                    step(bias, w0, g)
    slots = np.flatnonzero(np.abs(z[:-1]) > l1)
    return Model(bits, slots, weight(z[slots], n[slots], l1), float(weight(z[bias], n[bias], 0.0)))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """__at, doc_id, text, __y of at most max_rows labelled documents. labels: doc_id,
    toxic; null ids and null labels are left out; a document labelled more than once
    counts as toxic if one label says so."""
    lab = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__y"))
    ids = lab.withColumn("__at", F.xxhash64("doc_id")).orderBy("__at", "doc_id").limit(max_rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("__at", "doc_id", "text", "__y")


def sample_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> DataFrame:
    """__at, doc_id, __y and slots of the sample, made where the texts lie: whole
    texts never meet in one task."""
    schema = pa.schema([("__at", pa.int64()), ("doc_id", pa.int64()), ("__y", pa.int32()), ("slots", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = distinct(b.column(2), bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int64()), b.column(3).cast(pa.int32()), list_array(flat, at, pa.int32())], schema=schema)

    return arrow_map(training_rows(docs, labels, max_rows), run, "__at long, doc_id long, __y int, slots array<int>")


def gather_sample(batches: Iterable[pa.RecordBatch], max_slots: int = MAX_SLOTS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of a sorted stream (label, slots) as chunks for fit(), up to the row
    with which max_slots slots are exceeded."""
    chunks, left = [], max_slots
    for b in batches:
        col = b.column(1)
        at = col.offsets.to_numpy().astype(np.int64)
        rows = int(np.searchsorted(at, at[0] + left, "right")) - 1
        if rows:
            chunks.append((col.values.to_numpy()[at[0] : at[rows]].copy(), at[: rows + 1] - at[0], b.column(0).to_numpy()[:rows].astype(float)))
        left -= int(at[rows] - at[0])
        if rows < len(b):
            break
    for _ in batches:  # the stream is read to its end
        pass
    return chunks


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_slots: int = MAX_SLOTS, bits: int = BITS, **params) -> Model:
    """Fit on the bounded sample in one task, which holds at most max_slots slots
    of four bytes; only the non-zero weights come back. No labelled rows: a model
    that scores every text 0.0 < 0.5. Rows that share a doc_id take part each."""
    ship(docs.sparkSession)
    rows = sample_rows(docs, labels, max_rows, bits).repartition(1).sortWithinPartitions("__at", "doc_id", "slots").select("__y", "slots")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = gather_sample(iter(batches), max_slots)
        if chunks:
            m = fit(chunks, bits, **params)
            slots, weights = np.append(m.slots, -1), np.append(m.weights, m.bias)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(weights, pa.float64())], names=["slot", "weight"])

    got = arrow_map(rows, run, "slot long, weight double").toArrow()
    slots, weights = got.column("slot").to_numpy(), got.column("weight").to_numpy()
    order = np.argsort(slots)
    slots, weights = slots[order], weights[order]
    if not len(slots):
        return Model(bits, slots, weights, -20.0)
    return Model(bits, slots[1:], weights[1:], float(weights[0]))


def score_texts(texts: pa.Array, m: Model) -> np.ndarray:
    buf, offs = utf8(texts)
    dense = np.zeros(1 << m.bits)
    dense[m.slots] = m.weights
    live = dense != 0
    out = np.full(len(offs) - 1, m.bias)
    for i, j in pieces(offs):
        s, r = features(Words(buf, offs[i : j + 1], lower=True, table=IS_ALNUM), m.bits)
        hit = live[s]
        key = np.unique((r[hit] << m.bits) | s[hit])
        out[i:j] += np.bincount(key >> m.bits, dense[key & ((1 << m.bits) - 1)], minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with one more column, the probability that the text is toxic. Null
    and empty texts get the bias alone. Only `text` is read for the score."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = free(docs, column)
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_texts(b.column(at), m), pa.float64())], names=[*names, column])

    return arrow_map(docs, run, schema)
