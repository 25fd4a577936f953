"""Repeated passages: what suffix arrays and suffix automata share.

Every window of `length` consecutive words has a minimiser: its `gram`-word
shingle of smallest hash (leftmost of equals). Consecutive windows with the same
minimiser form a run, so runs part all windows of a corpus, and equal windows
lie in runs of the same anchor (the minimiser's hash) at the same distance from
it. Work is dealt by anchor; a task compares runs of few anchors, each bounded:

1. runs: anchor, run hash, document, place (narrow rows, whole corpus)
2. runs whose anchor one document alone holds are done: nothing repeats there
3. equal runs are one class, owned by the smallest doc_id (pre-aggregated, so
   thousands of copies shrink to one row per task)
4. a kernel (suffix automaton or sparse suffix array) takes all classes of an
   anchor and finds, for every window, the smallest doc_id that owns it
5. a document loses the windows of its runs whose first owner is smaller; marks
   become word spans, spans are cut from the documents

Anchors with more than HEAVY classes are dealt by longer context before step 4, so
no anchor gathers in one task: the windows of an anchor are parted by the number
of words before it, and all windows of a part share the words around the anchor
that lie in each of them. Halving the parts lengthens that context until it is the
whole window, of which one class is left.

A word goes if a window over it also starts in a document of smaller doc_id.
Null texts are empty. Rows of null doc_id stay as they are and are no reference.
Rows that share a doc_id are judged each; none is smaller than the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvane.llm._store import arrow_map, cut, drop, free, ship
from sparkvane.llm._text import U64, Words, mix, pieces, signed, utf8

LENGTH, GRAM = 50, 8
HEAVY = 2000
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def sliding_min(c: np.ndarray, w: int) -> np.ndarray:
    size, m = 1, c
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def find_runs(w: Words, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of equal minimiser: row, start (word in its row), n (windows), off
    (words from start to the anchor), anchor, sh (hash of the run's words)."""
    g, gat = w.grams(gram, short=False)
    nw = np.maximum(w.n - length + 1, 0)
    if not nw.sum():
        none = np.zeros(0, np.int64)
        return {"row": none, "start": none, "n": none, "off": none, "anchor": none.astype(U64), "sh": none.astype(U64)}
    low = U64(0xFFFFFFFF)
    best = sliding_min((g & ~low) | np.arange(len(g), dtype=U64), length - gram + 1)
    wat = np.zeros(len(nw) + 1, np.int64)
    np.cumsum(nw, out=wat[1:])
    row = np.repeat(np.arange(len(nw)), nw)
    a = np.arange(wat[-1]) + (gat[:-1] - wat[:-1])[row]
    p = (best[a] & low).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(p)))
    row, a, p = row[at], a[at], p[at]
    start = a - gat[row]
    off = p - gat[row] - start
    first = w.at[row] + start
    sh = mix(w.rolling()(first, first + n + length - 1) ^ (off.astype(U64) * U64(0xBF58476D1CE4E5B9)))
    return {"row": row, "start": start, "n": n, "off": off, "anchor": g[p], "sh": sh}


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("sh", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("off", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs = b.column(0).to_numpy(), b.column(1).to_numpy()
            buf, offs = utf8(b.column(2))
            for i, j in pieces(offs):
                r = find_runs(Words(buf, offs[i : j + 1]), length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((signed(r["anchor"]), signed(r["sh"]), ids[i:j][r["row"]], hs[i:j][r["row"]], r["start"], r["n"], r["off"]), schema, strict=True)], schema=schema)

    return arrow_map(docs, run, "key long, sh long, doc_id long, h long, start int, n int, off int")


CLASS = "key long, sh long, owner long, n int, off int, words string"
_CLASS = pa.schema([("key", pa.int64()), ("sh", pa.int64()), ("owner", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("words", pa.string())])


def _extract(classes: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The classes with their words, joined by one space, from their owners' texts."""
    lists = classes.groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "sh", "start", "n", "off")).alias("runs"))
    src = docs.dropDuplicates(["doc_id", "h"]).join(lists, ["doc_id", "h"]).select("doc_id", "text", "runs")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for i in range(len(b)):
                doc, text, runs = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py()
                words = text.encode("utf-8", "surrogatepass").split()
                for r in runs:
                    t = b" ".join(words[r["start"] : r["start"] + r["n"] + length - 1]).decode("utf-8", "surrogatepass")
                    out.append((r["key"], r["sh"], doc, r["n"], r["off"], t))
                    size += len(t)
                    if size > 4 << 20:
                        yield _batch(out, _CLASS)
                        out, size = [], 0
            yield _batch(out, _CLASS)

    return arrow_map(src, run, CLASS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)


#: (groups: list of (sh, owner, n, off, words) per key, length) -> smallest owner of each window, class by class
Kernel = Callable[[list[list[tuple]], int], list[np.ndarray]]


def _compare(classes: DataFrame, kernel: Kernel, length: int) -> DataFrame:
    """key, sh, a, b, first: stretches of windows [a, b) of each class and the
    smallest doc_id that holds them, all classes of a key compared by the kernel."""
    schema = pa.schema([("key", pa.int64()), ("sh", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("first", pa.int64())])

    def judged(keys: list[int], groups: list[list[tuple]]) -> pa.RecordBatch:
        flat = [(k, c[0], c[2]) for k, g in zip(keys, groups, strict=True) for c in g]
        first = kernel(groups, length) if flat else []
        n = np.array([c[2] for c in flat], np.int64)
        values = np.concatenate(first) if flat else np.zeros(0, np.int64)
        begin = np.cumsum(n) - n
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        new[begin] = True
        at = np.flatnonzero(new)
        who = np.repeat(np.arange(len(flat)), n)[at]
        a = at - begin[who]
        b = np.append(at[1:], len(values)) - begin[who]
        keys_of, sh_of = (np.array([c[i] for c in flat], np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((keys_of[who], sh_of[who], a, b, values[at]), schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        groups: list[list[tuple]] = []
        held = 0
        for b in batches:
            for key, *c in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if not keys or keys[-1] != key:
                    if held >= 4000:
                        yield judged(keys, groups)
                        keys, groups, held = [], [], 0
                    keys.append(key)
                    groups.append([])
                groups[-1].append(tuple(c))
                held += 1
        yield judged(keys, groups)

    d = classes.select("key", "sh", "owner", "n", "off", "words").repartition("key").sortWithinPartitions("key", "owner", "sh")
    return arrow_map(d, run, "key long, sh long, a int, b int, first long")


def split_class(key: int, n: int, off: int, words: list[bytes], length: int, width: int) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """The parts of a class whose windows have j // width words before the anchor
    alike: (first window, key of anchor and shared context, run hash, n, off, words)."""
    for part in range((off - n + 1) // width, off // width + 1):
        lo, hi = part * width, part * width + width - 1  # words before the anchor
        a, z = off - min(off, hi), off - max(off - n + 1, lo)  # first and last window
        own = b" ".join(words[a : z + length])
        shared = b" ".join(words[off - lo : off - hi + length])
        yield a, _name(b"%d %d %d " % (key, width, part) + shared), _name(b"%d " % (off - a) + own), z - a + 1, off - a, own


def _name(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _split(classes: DataFrame, length: int, width: int) -> DataFrame:
    """up_key, up_sh, a and the class of every part of the classes."""
    schema = pa.schema([("up_key", pa.int64()), ("up_sh", pa.int64()), ("a", pa.int32()), *_CLASS])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for key, sh, owner, n, off, words in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                for a, own_key, own_sh, m, o, t in split_class(key, n, off, words.encode("utf-8", "surrogatepass").split(b" "), length, width):
                    out.append((key, sh, a, own_key, own_sh, owner, m, o, t.decode("utf-8", "surrogatepass")))
                    size += len(t)
                if size > 4 << 20:
                    yield _batch(out, schema)
                    out, size = [], 0
            yield _batch(out, schema)

    return arrow_map(classes.select("key", "sh", "owner", "n", "off", "words"), run, f"up_key long, up_sh long, a int, {CLASS}")


def first_owners(classes: DataFrame, kernel: Kernel, length: int, gram: int, heavy: int) -> DataFrame:
    """key, sh, a, b, first of all classes. Keys with more than `heavy` classes go
    through the kernel too, dealt by the longer context of their parts."""
    width, levels = length - gram + 1, []
    while True:
        many = cut(classes.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > heavy).select("key"), "heavy")
        if width == 1 or many.isEmpty():
            break
        width = -(-width // 2)
        parts = cut(_split(classes.join(many, "key"), length, width), "parts")
        levels.append((classes.join(many, "key", "left_anti"), parts.select("up_key", "up_sh", F.col("a").alias("shift"), "key", "sh")))
        least = parts.groupBy("key", "sh").agg(F.min("owner").alias("owner"), F.first("n").alias("n"), F.first("off").alias("off"), F.first("words").alias("words"))
        classes = cut(least, "classes")
    out = _compare(classes, kernel, length)
    for light, parts in reversed(levels):
        up = parts.join(cut(out, "owners"), ["key", "sh"])
        up = up.select(F.col("up_key").alias("key"), F.col("up_sh").alias("sh"), (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"), "first")
        out = up.unionByName(_compare(light, kernel, length))
    return out


def repeated_spans(docs: DataFrame, kernel: Kernel, length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """doc_id, h, spans: word spans [s, e) to remove, of documents (doc_id, h, text)."""
    runs = cut(_runs(docs.select("doc_id", "h", "text"), length, gram), "runs")
    # Joined tables are written first: a join of plain tables lets Spark split the rows of a very common anchor.
    both = cut(runs.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key"), "anchors")
    live = cut(runs.join(both, "key"), "live")
    drop(runs, both)
    cls = live.groupBy("key", "sh").agg(F.min(F.struct("doc_id", "h", "start", "n", "off")).alias("o")).select("key", "sh", "o.*")
    words = cut(_extract(cls, docs, length), "words")
    owners = first_owners(words, kernel, length, gram, heavy)
    owners = cut(owners.groupBy("key", "sh").agg(F.collect_list(F.struct("a", "b", "first")).alias("m")), "owners")
    drop(words)
    mine = F.filter("m", lambda x: x["first"] < F.col("doc_id"))
    hits = live.join(owners, ["key", "sh"]).select("doc_id", "h", "start", mine.alias("m")).where(F.size("m") > 0)
    hits = hits.select("doc_id", "h", F.transform("m", lambda x: F.struct((F.col("start") + x["a"]).alias("s"), (F.col("start") + x["b"] + F.lit(length - 1)).alias("e"))).alias("m"))
    return hits.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("m")).alias("spans"))


def removed_mask(spans: list[dict], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    for x in spans:
        edge[x["s"]] += 1
        edge[x["e"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove(docs: DataFrame, kernel: Kernel, length: int = LENGTH, gram: int = GRAM, spacing: str = "single", heavy: int = HEAVY) -> DataFrame:
    """All columns of docs with `text` replaced by what is kept, and __n_words,
    __n_removed, __spans (merged word spans).

    spacing: 'single' joins kept words by one space; 'original' keeps the white
    space between words that were neighbours (an untouched text stays as it is)."""
    ship(docs.sparkSession)
    if not 0 < gram <= length:
        raise ValueError("gram must lie between 1 and length")
    docs = free(docs, "__h", "__id", "__hh", "__spans_in", "__n_words", "__n_removed", "__spans")
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    src = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    spans = repeated_spans(src, kernel, length, gram, heavy).select(F.col("doc_id").alias("__id"), F.col("h").alias("__hh"), F.col("spans").alias("__spans_in"))
    d = keyed.join(spans, (keyed["doc_id"] == spans["__id"]) & (keyed["__h"] == spans["__hh"]), "left")
    names = docs.columns
    d = d.select(*[keyed[f"`{c}`"] for c in names], "__spans_in")
    at = names.index("text")
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    out_t = T.StructType([*docs.schema.fields, T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType()),
                          T.StructField("__spans", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ns, rs, ss = [], [], [], []
            for t, sp in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                n, merged, gone = len(words), [], 0
                if sp:
                    mask = removed_mask(sp, n)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    merged = [{"s": int(x), "e": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    gone = int(mask.sum())
                if spacing == "single":
                    kept = b" ".join(words if not gone else [x for x, m in zip(words, mask, strict=True) if not m])
                elif not gone:
                    kept = raw if t is not None else None
                else:
                    pos = [m.start() for m in _WORDS.finditer(raw)] + [len(raw)]
                    cuts, last = [], 0
                    for x in merged:
                        cuts.append(raw[last : pos[x["s"]]])
                        last = pos[x["e"]]
                    kept = b"".join([*cuts, raw[last:]])
                texts.append(kept)
                ns.append(n)
                rs.append(gone)
                ss.append(merged)
            cols = [*b.columns[: len(names)], pa.array(ns, pa.int64()), pa.array(rs, pa.int64()), pa.array(ss, span)]
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "__n_words", "__n_removed", "__spans"])

    return arrow_map(d, run, out_t)
