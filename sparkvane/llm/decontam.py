"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles into bands of doubling size.
Each item keeps a bottom-k MinHash sketch, its k smallest shingle hashes, with k
above the number of shingles that may be missing at the threshold:
k = s - ceil(t * s) + 1. A document whose containment of the item is at least t
misses at most k - 1 shingles of it, so it holds at least one sketch value: the
search loses nothing. A document is reduced to its hashes at or below the band's
largest sketch value, looked up among the band's sketches, and each candidate
item is verified on the exact shingle sets.

Sketches and item shingles are broadcast while they are under a size bound;
beyond it, documents' and items' hashes meet in joins dealt by hash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvane.llm._store import arrow_map, cut, cut_native, free, ship
from sparkvane.llm._text import Words, list_array, pieces, signed, unique_by_row, utf8

K, THRESHOLD = 5, 0.8
#: Benchmarks of more words are joined, not broadcast: 4 million words are some 30 MB
#: of text and 15 MB of sketch values in a worker. Shingles of items kept there.
BROADCAST_SHINGLES, HELD = 4_000_000, 200_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text: str | None, k: int = K) -> set[tuple[str, ...]]:
    """Distinct k-word shingles, A-Z lower-cased; fewer words: the whole sequence; none: empty."""
    w = _WORD.findall((text or "").translate(_UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def need(s: int, threshold: float = THRESHOLD) -> int:
    """Fewest shared shingles that make an item of s shingles contained."""
    return max(1, math.ceil(threshold * s - 1e-9))


@dataclass
class Band:
    """Items of one size band and shingle length: sketch values ascending with
    the item of each, and the largest value."""

    k: int
    values: np.ndarray
    items: np.ndarray
    top: int


@dataclass
class Index:
    bands: list[Band]
    ids: list[int]
    texts: list[str]


def build_index(ids: list[int], texts: list[str], k: int = K, threshold: float = THRESHOLD) -> Index:
    """Items with the same text each count; items without words match nothing."""
    groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    buf, offs = utf8(pa.array(texts, pa.large_string()))
    w = Words(buf, offs, lower=True)
    h, at = unique_by_row(*w.grams(k))
    for i in range(len(ids)):
        own = h[at[i] : at[i + 1]]
        if len(own):
            size = min(k, int(w.n[i]))
            groups.setdefault((size, len(own).bit_length()), []).append((i, own[: len(own) - need(len(own), threshold) + 1]))
    bands = []
    for (size, _), own in sorted(groups.items()):
        v = np.concatenate([x for _, x in own])
        who = np.concatenate([np.full(len(x), i) for i, x in own])
        order = np.argsort(v, kind="stable")
        bands.append(Band(size, v[order], who[order], v.max()))
    return Index(bands, ids, texts)


def candidates(w: Words, index: Index, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, item) whose sketch has a value among the row's hashes."""
    out = []
    for size in sorted({b.k for b in index.bands}):
        h, at = w.grams(size, short=False) if size < k else w.grams(k)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for b in (b for b in index.bands if b.k == size):
            low = h <= b.top
            hh, rr = h[low], row[low]
            lo, hi = np.searchsorted(b.values, hh, "left"), np.searchsorted(b.values, hh, "right")
            n = hi - lo
            hit = n > 0
            lo, n, rr = lo[hit], n[hit], rr[hit]
            pos = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append(np.unique(np.repeat(rr, n) * len(index.ids) + b.items[pos]))
    key = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return key // max(1, len(index.ids)), key % max(1, len(index.ids))


class Sets(dict):
    """Shingle sets of items, made when first asked for; at most HELD shingles are kept."""

    def __init__(self, texts: list[str], k: int):
        self.texts, self.k, self.held = texts, k, 0

    def __missing__(self, item: int) -> set[tuple[str, ...]]:
        out = shingles(self.texts[item], self.k)
        if self.held > HELD:
            self.clear()
            self.held = 0
        self.held += len(out)
        self[item] = out
        return out


def verify(text: str, items: Iterable[int], sets: dict[int, set], k: int, threshold: float) -> list[tuple[int, int, int]]:
    """(item, shared, size) of the items contained in the text, on exact words."""
    own: dict[int, set] = {}
    out = []
    for i in items:
        want = sets[i]
        size = len(next(iter(want)))
        if size not in own:
            words = _WORD.findall(text.translate(_UPPER))
            own[size] = {tuple(words[a : a + size]) for a in range(len(words) - size + 1)}
        shared = len(want & own[size])
        if shared >= need(len(want), threshold):
            out.append((i, shared, len(want)))
    return out


MATCH = T.StructType().add("item_id", T.LongType()).add("shared", T.LongType()).add("size", T.LongType())


def search(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD, bound: int = BROADCAST_SHINGLES) -> DataFrame:
    """docs plus `__matches`: array of (item_id, shared, size) with
    shared / size >= threshold, by item_id; empty where nothing matches.

    Null texts hold nothing; items with null id or without words match nothing.
    Every document row stays once, whatever its other columns are."""
    spark = docs.sparkSession
    ship(spark)
    docs = free(docs, "__matches", "__row", "__m")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if total > bound:
        return _search_joined(docs, items, k, threshold)
    got = items.orderBy("item_id", "text").toArrow()
    sent = spark.sparkContext.broadcast((got.column(0).to_pylist(), got.column(1).to_pylist()))
    names = docs.columns
    schema = T.StructType(list(docs.schema.fields)).add("__matches", T.ArrayType(MATCH))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("size", pa.int64())]))
    at_text = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = sent.value
        index = build_index(ids, texts, k, threshold)
        sets = Sets(texts, k)
        for b in batches:
            col = b.column(at_text)
            buf, offs = utf8(col)
            found: list[list] = [[] for _ in range(len(b))]
            for i, j in pieces(offs):
                rows, its = candidates(Words(buf, offs[i : j + 1], lower=True), index, k)
                for r in np.unique(rows):
                    hit = verify(col[i + int(r)].as_py(), its[rows == r].tolist(), sets, k, threshold)
                    found[i + int(r)] = sorted(({"item_id": ids[x], "shared": s, "size": n} for x, s, n in hit), key=lambda m: (m["item_id"], -m["shared"]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*names, "__matches"])

    return arrow_map(docs, run, schema)


def _search_joined(docs: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    """The same for a benchmark of any size: sketch values and documents' hashes
    meet by hash, candidates are verified by counting shared shingles by hash. Every
    benchmark row is judged by a number of its own, rows of one item_id too."""
    d = cut_native(docs.withColumn("__row", F.monotonically_increasing_id()), "decontam")
    items = cut(items.withColumn("item", F.monotonically_increasing_id()), "benchmark")
    item_h = cut(_hash_rows(items.select(F.col("item").alias("row"), "text"), k), "items")
    size = F.size("hashes")
    sketch = item_h.select(F.col("row").alias("item"), "words", size.alias("size"), F.explode(F.slice("hashes", F.lit(1), size - F.greatest(F.lit(1), F.ceil(F.lit(threshold) * size - 1e-9).cast("int")) + 1)).alias("h"))
    lengths = [r[0] for r in item_h.select("words").distinct().collect()]  # at most k values
    doc_h = _hash_rows(d.select(F.col("__row").alias("row"), "text"), k, tuple(sorted(lengths)))
    doc_h = cut(doc_h.select("row", "words", F.explode("hashes").alias("h")), "doc-hashes")
    pairs = doc_h.join(sketch, ["words", "h"]).select("row", "item", "words", "size").distinct()
    full = item_h.select(F.col("row").alias("item"), "words", F.explode("hashes").alias("h"))
    hits = pairs.join(full, ["item", "words"]).join(doc_h, ["row", "words", "h"]).groupBy("row", "item", "size").agg(F.count("*").alias("shared"))
    hits = hits.where(F.col("shared") >= F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("size") - 1e-9)))
    hits = hits.join(items.select("item", "item_id"), "item")
    m = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("item_id", (-F.col("shared")).alias("order"), F.col("shared").cast("long").alias("shared"), F.col("size").cast("long").alias("size")))).alias("__m"))
    m = m.withColumn("__m", F.transform("__m", lambda x: x.dropFields("order")))
    out = d.join(m, d["__row"] == m["row"], "left")
    return out.select(*[d[f"`{c}`"] for c in docs.columns], F.coalesce("__m", F.array().cast(T.ArrayType(MATCH))).alias("__matches"))


def _hash_rows(rows: DataFrame, k: int, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """row, words (shingle length), hashes ascending. Without lengths: items, by
    their own length of at most k words."""
    schema = pa.schema([("row", pa.int64()), ("words", pa.int32()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = utf8(b.column(1))
            for i, j in pieces(offs):
                w = Words(buf, offs[i : j + 1], lower=True)
                for n in lengths or (k,):
                    h, at = unique_by_row(*w.grams(n, short=not lengths))
                    size = np.full(j - i, n) if lengths else np.minimum(w.n, k)
                    keep = np.diff(at) > 0
                    arr = list_array(signed(h), at, pa.int64())
                    out = pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size, pa.int32()), arr], schema=schema)
                    yield out.filter(pa.array(keep))

    return arrow_map(rows, run, "row long, words int, hashes array<long>")


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents that contain no item."""
    return search(docs, benchmark, **params).where(F.size("__matches") == 0).drop("__matches")
