"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

Every document is its set of distinct k-word shingles (64-bit hashes). For a size
band, the universe of shingles is parted by hash into segments. Two sets that
link differ in at most H shingles, so with allocations a_i per segment (1: equal
segments match; 2: segments that differ in one shingle match too, by indexing
one-deletion neighbourhoods) and sum(a_i) = H + 1 + E, matching segments weigh
E + 1 or more together. Each set may therefore leave out its E weakest segments
of allocation 1, in any order that is the same for all sets, and the strongest
common one is still indexed by both. Of these E, the segments of fewest shingles
go at once, and then, in each set, those whose signature most classes share: texts
of a small vocabulary meet by chance in a few segments, and a set that shares no
more than those has no partner. So chance meetings do not tie unrelated texts to one
candidate component, whatever the size of the table. Band by band, the split between
allocations is the one of least estimated cost (signatures plus false candidates).

Equal sets are one class from the start. Classes that share a signature are
joined to the signature's smallest class; components of these candidate edges
are cut into blocks of bounded size, large ones by size band first, and every pair of
blocks whose sizes allow a link is one unit of work, in which all intersections are
counted exactly (a matrix product over the shared shingles). Only component links and counts leave a unit:
no pair rows are made. Shingles are compared as 64-bit hashes: two sets of 10^4
shingles have a wrong common count with probability under 10^-11.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvane.llm._store import arrow_map, cut, drop, free, ship
from sparkvane.llm._text import U64, Words, list_array, mix, pieces, signed, unique_by_row, utf8
from sparkvane.llm.components import components

K, PERCENT = 5, 80
BAND = 1.3
#: Segments that may be left out, as shares of those that two linked sets may differ in: of fewest shingles, and of the most shared signatures.
SLACK, SPARE = 0.25, 0.1
BLOCK = 1024
COLUMNS = 4096
SEEN = 200_000
#: Cost model: chance that an unrelated document holds a given shingle, and how many false partners a segment may bring.
SHARED, PARTNERS = 0.05, 16


def bounds(largest: int, ratio: float = BAND) -> np.ndarray:
    """Lower ends of the size bands, from 1."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, math.floor(out[-1] * ratio)))
    return np.array(out)


def most_apart(hi: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets of which the smaller has fewer than hi shingles."""
    a = hi - 1
    return (a + a * 100 // percent) * (100 - percent) // (100 + percent)


@dataclass(frozen=True)
class Scheme:
    """Segments of a band: m1 of allocation 1 (`drop` of them left out for few shingles
    and up to `spare` for shared signatures), then m2 of allocation 2."""

    m1: int
    m2: int
    drop: int
    spare: int


def allocate(hi: int, percent: int) -> Scheme | None:
    """The allocation of least cost; None where linked sets must be equal."""
    h = most_apart(hi, percent)
    if h == 0:
        return None
    drop, spare = math.ceil(SLACK * (h + 1)), math.ceil(SPARE * (h + 1))
    need, best = h + 1 + drop + spare, None
    for share in (0.0, 0.25, 0.5, 1.0):
        m2 = int(share * need / 2)
        m1 = need - 2 * m2
        e = min(drop, m1)
        q = hi / (m1 + m2)
        miss = math.exp(-q * (1 - SHARED))
        cost = (m1 - e) + m2 * (1 + q) + PARTNERS * ((m1 - e) * miss + m2 * miss * (1 + q))
        if best is None or cost < best[0]:
            # Without enough segments of allocation 1 less can be left out; the rest of the slack does no harm.
            best = cost, Scheme(m1, m2, e, min(spare, m1 - e))
    return best[1]


def set_hashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash of each row's set."""
    c = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h ^ U64(0x2545F4914F6CDD1D)), out=c[1:])
    return mix((c[at[1:]] - c[at[:-1]]) + np.diff(at).astype(U64) * U64(0xD1342543DE82EF95))


def signatures(h: np.ndarray, at: np.ndarray, low: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the rows' sets and the row of each."""
    return banded(h, at, low, percent)[:2]


def banded(h: np.ndarray, at: np.ndarray, low: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the rows' sets, the row of each and its group: the band, times
    2**32, plus the number that the row may yet leave out there (0: this one must
    stay). A row takes part in the schemes of all bands in which the smaller set of a
    linked pair may lie."""
    n = np.diff(at)
    top = np.searchsorted(low, n, "right") - 1
    bottom = np.searchsorted(low, -(-n * percent // 100), "right") - 1
    sigs, rows, groups = [], [], []
    for band in np.unique(np.concatenate([top, bottom])):
        if band < 0 or (plan := allocate(int(low[band + 1]), percent)) is None:
            continue
        who = np.flatnonzero((bottom <= band) & (band <= top) & (n > 0))
        if not len(who):
            continue
        size = n[who]
        idx = np.repeat(at[who] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        x = h[idx]
        m = plan.m1 + plan.m2
        seg = ((mix(x ^ U64(int(band) * 0x9E3779B97F4A7C15 % 2**64)) >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
        cell = np.repeat(np.arange(len(who)), size) * m + seg
        val = mix(x + U64(0x5851F42D4C957F2D))
        order = np.argsort(cell, kind="stable")
        cell, val = cell[order], val[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        total, count = np.zeros(len(who) * m, U64), np.zeros(len(who) * m, np.int64)
        total[cell[first]] = np.add.reduceat(val, first)
        count[cell[first]] = np.diff(np.append(first, len(cell)))
        name = (np.arange(m, dtype=U64) + U64(int(band) * 1_000_003 + 1)) * U64(0x9FB21C651E98DF25)
        sig = mix(total.reshape(-1, m) + name[None, :])
        if plan.m1:
            s1, c1 = sig[:, : plan.m1], count.reshape(-1, m)[:, : plan.m1]
            order = np.lexsort((s1, c1), axis=1)[:, plan.drop :]
            sigs.append(np.take_along_axis(s1, order, 1).ravel())
            rows.append(np.repeat(who, order.shape[1]))
            groups.append(np.full(order.size, (int(band) << 32) + plan.spare))
        if plan.m2:
            s2 = sig[:, plan.m1 :]
            sigs.append(s2.ravel())
            rows.append(np.repeat(who, plan.m2))
            own = cell % m >= plan.m1
            c = cell[own]
            sigs.append(mix(total[c] - val[own] + name[c % m]))
            rows.append(who[c // m])
            groups.append(np.full(s2.size + len(c), int(band) << 32))
    if not sigs:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(rows), np.concatenate(groups)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, h, n, cls of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = utf8(b.column(2))
            for i, j in pieces(offs):
                h, at = unique_by_row(*Words(buf, offs[i : j + 1], lower=True).grams(k))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(signed(set_hashes(h, at)), pa.int64())], names=["doc_id", "h", "n", "cls"])

    return arrow_map(docs, run, "doc_id long, h long, n long, cls long")


def _signature_rows(docs: DataFrame, k: int, percent: int, largest: int) -> DataFrame:
    """(sig, cls, grp): signatures of every class with their groups; copies met again in the same task are left out."""
    low = bounds(largest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            buf, offs = utf8(b.column(2))
            for i, j in pieces(offs):
                h, at = unique_by_row(*Words(buf, offs[i : j + 1], lower=True).grams(k))
                cls = signed(set_hashes(h, at))
                sig, row, grp = banded(h, at, low, percent)
                if len(seen) > SEEN:
                    seen.clear()
                new = np.array([not (c in seen or seen.add(c)) for c in cls.tolist()], bool)
                keep = new[row]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (signed(sig[keep]), cls[row[keep]], grp[keep])], names=["sig", "cls", "grp"])

    return arrow_map(docs, run, "sig long, cls long, grp long")


def _candidates(rows: DataFrame) -> DataFrame:
    """(a, b): classes a that share a signature with a smaller class b, the smallest of
    the signature's, when every set has left out the most shared of its signatures.
    min and max tell distinct classes apart without listing them."""
    w, own = Window.partitionBy("sig"), Window.partitionBy("cls", "grp").orderBy(F.desc("seen"), "sig")
    shared = rows.withColumn("lo", F.min("cls").over(w)).withColumn("hi", F.max("cls").over(w)).withColumn("seen", F.count("*").over(w)).where("lo < hi").select("sig", "cls", "grp", "seen")
    # A class that comes twice takes two turns for one signature: it keeps more, never less.
    rest = shared.withColumn("turn", F.row_number().over(own)).where(F.col("turn") > F.col("grp") % (1 << 32)).select("sig", "cls")
    return rest.withColumn("lo", F.min("cls").over(w)).where("cls <> lo").select(F.col("cls").alias("a"), F.col("lo").alias("b")).distinct()


def link_blocks(x: list[np.ndarray], y: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets of x and y (or of x alone) link: a boolean matrix."""
    own = y is None
    sets = x if own else x + y
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    col = np.cumsum(new) - 1
    use = np.bincount(col)[col] > 1  # a shingle of one set adds nothing
    col, who = col[use], who[use]
    col = np.cumsum(np.concatenate([[0], col[1:] != col[:-1]])) if len(col) else col
    a, b = len(x), len(sets) - (0 if own else len(x))
    inter = np.zeros((a, b), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, [c, c + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, int(col[hi - 1]) - c + 1)), np.float32)
        m[who[lo:hi], col[lo:hi] - c] = 1
        inter += m[:a] @ (m if own else m[a:]).T
    n = np.array([len(s) for s in sets])
    nx, ny = n[:a], n if own else n[a:]
    inter = np.rint(inter).astype(np.int64)
    link = 100 * inter >= percent * (nx[:, None] + ny[None, :] - inter)
    if own:
        np.fill_diagonal(link, False)
    return link


def roots(link: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a symmetric boolean matrix, for each index."""
    label = np.arange(len(link))
    while True:
        far = np.where(link, label[None, :], len(link)).min(axis=1)
        new = np.minimum(label, far)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _units(members: DataFrame, percent: int) -> DataFrame:
    """cls, units: the pairs of blocks of its component that may link, as (unit, side).
    members: cls, comp, n (narrow rows; sets follow later).

    A component of at most BLOCK classes is one block. A larger one is parted by size:
    sizes of linked sets lie within a factor of 100 / percent, so only blocks of one
    size band or of two neighbouring bands meet."""
    width = max(math.log(100 / percent) * 1.001, 1e-3)  # a little more: rounding must not part a pair
    total = members.groupBy("comp").agg(F.count("*").alias("classes"))
    band = F.when(F.col("classes") > BLOCK, F.floor(F.log(F.col("n").cast("double")) / width)).otherwise(0)
    d = members.join(total, "comp").withColumn("band", band.cast("long")).drop("classes")
    sizes = d.groupBy("comp", "band").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("blocks"))
    for name, step in (("above", -1), ("below", 1)):  # blocks of the neighbouring bands
        sizes = sizes.join(sizes.select("comp", (F.col("band") + step).alias("band"), F.col("blocks").alias(name)), ["comp", "band"], "left")
    d = d.join(sizes, ["comp", "band"]).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")))

    def meet(count, side, unit):
        all_of = F.filter(F.sequence(F.lit(0).cast("long"), F.coalesce(count, F.lit(0)).cast("long")), lambda o: o < F.coalesce(count, F.lit(0)))
        return F.transform(all_of, lambda o: F.struct(F.xxhash64("comp", *unit(o)).alias("unit"), side(o).cast("int").alias("side")))

    here, at = F.col("band"), F.col("block")
    own = meet(F.col("blocks"), lambda o: F.when(o == at, 0).when(at < o, 1).otherwise(2), lambda o: (here, F.least(at, o), here, F.greatest(at, o)))
    up = meet(F.col("above"), lambda o: F.lit(1), lambda o: (here, at, here + 1, o))
    down = meet(F.col("below"), lambda o: F.lit(2), lambda o: (here - 1, o, here, at))
    return d.select("cls", F.concat(own, up, down).alias("units"))


def _verify(members: DataFrame, percent: int) -> DataFrame:
    """members: cls, weight, hashes, units; a class that comes more than once counts once.
    (cls, root, links) per unit: root is a class that cls reaches by links (or cls), links counts linked documents."""

    def work(rows: list[tuple]) -> list[tuple]:
        x = [r for r in rows if r[0] < 2]
        y = [r for r in rows if r[0] == 2]
        if rows[0][0] > 0 and (not x or not y):
            return []
        if not y:
            link = link_blocks([r[3] for r in x], None, percent)
        else:
            part = link_blocks([r[3] for r in x], [r[3] for r in y], percent)
            link = np.zeros((len(x) + len(y),) * 2, bool)
            link[: len(x), len(x) :] = part
            link[len(x) :, : len(x)] = part.T
        both = x + y
        cls = np.array([r[1] for r in both])
        n = link @ np.array([r[2] for r in both], np.int64)
        root = cls[roots(link)]
        return [(int(c), int(r), int(k)) for c, r, k in zip(cls, root, n, strict=True) if k]

    schema = pa.schema([("cls", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out, seen = None, [], [], set()
        for b in batches:
            unit, side, cls, weight = (b.column(i).to_pylist() for i in range(4))
            col = b.column(4)
            at, flat = col.offsets.to_numpy(), col.values.to_numpy()
            for i, u in enumerate(unit):
                if u != now:
                    if rows:
                        out += work(rows)
                    now, rows, seen = u, [], set()
                if cls[i] not in seen:
                    seen.add(cls[i])
                    rows.append((side[i], cls[i], weight[i], flat[at[i] : at[i + 1]].copy()))
            yield _rows(out, schema)
            out = []
        if rows:
            out += work(rows)
        yield _rows(out, schema)

    units = members.select(F.explode("units").alias("u"), "cls", "weight", "hashes").select("u.unit", "u.side", "cls", "weight", "hashes")
    return arrow_map(units.repartition("unit").sortWithinPartitions("unit"), run, "cls long, root long, links long")


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)


def join(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """All columns of docs, __n_shingles (size of the set), __component (smallest
    doc_id reachable by links, itself included) and __links (documents linked with
    this one). Two documents link when 100 * |A & B| >= percent * |A | B|.

    Words: A-Z lower-cased; fewer than k words: the whole sequence is one shingle;
    none: the set is empty and links with nothing. Rows of null doc_id take no
    part (component null, no links). Repeated rows are documents of their own and
    link with each other."""
    return _join(docs, k, percent)


def _join(docs: DataFrame, k: int, percent: int, root: bool = False) -> DataFrame:
    """With root, also __root: a class that names the component. Components of
    different texts can have one smallest doc_id, where rows share it."""
    ship(docs.sparkSession)
    docs = free(docs, "__h", "__hh", "__id", "__n", "__n_shingles", "__component", "__links", "__root")
    named = ["__root"] if root else []
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    sets = cut(_sets(src, k), "sets")
    part = sets.where("n > 0 and doc_id is not null")
    classes = part.groupBy("cls").agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "h")).alias("first"), F.max("n").alias("n"))
    classes = cut(classes.select("cls", "weight", "n", "first.*"), "classes")
    largest = classes.agg(F.max("n")).first()[0] or 0
    cand = components(_candidates(_signature_rows(src.where("doc_id is not null"), k, percent, largest)))
    cand = cut(cand.unionByName(cand.select(F.col("comp").alias("node"), "comp").distinct()), "candidates")
    placed = cut(classes.join(cand, classes["cls"] == cand["node"]).select("doc_id", "h", "cls", "weight", "n", "comp"), "placed")
    want = placed.join(_units(placed.select("cls", "comp", "n"), percent), "cls").select("doc_id", "h", "cls", "weight", "units")
    members = cut(_hashes(src.join(want, ["doc_id", "h"]).select("cls", "weight", "units", "text"), k), "members")
    links = cut(_verify(members, percent), "links")
    drop(members, cand, placed)
    comp = components(links.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    least = comp.join(classes.select(F.col("cls").alias("node"), "doc_id"), "node").select("comp", "doc_id")
    least = least.unionByName(classes.join(comp.select("comp").distinct(), classes["cls"] == F.col("comp")).select("comp", "doc_id")).groupBy("comp").agg(F.min("doc_id").alias("low"))
    linked = comp.unionByName(comp.select(F.col("comp").alias("node"), "comp").distinct()).join(least, "comp").select(F.col("node").alias("cls"), "low", F.col("comp").alias("root"))
    counts = links.groupBy("cls").agg(F.sum("links").alias("links"))
    by_class = classes.select("cls", "weight", "doc_id").join(linked, "cls", "left").join(counts, "cls", "left")
    # Written first: a join of plain tables lets Spark split the rows of a class of very many copies.
    by_class = cut(by_class.select("cls", F.coalesce("low", "doc_id").alias("__component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("__links"), *[F.coalesce("root", "cls").alias(c) for c in named]), "by-class")
    drop(classes, links)
    rows = part.join(by_class, "cls").select(F.col("doc_id").alias("__id"), F.col("h").alias("__hh"), "__component", "__links", F.col("n").alias("__n"), *named).dropDuplicates(["__id", "__hh"])
    rest = sets.where("n = 0 or doc_id is null").select(F.col("doc_id").alias("__id"), F.col("h").alias("__hh"), F.col("doc_id").alias("__component"), F.lit(0).cast("long").alias("__links"), F.col("n").alias("__n"), *[F.lit(None).cast("long").alias(c) for c in named]).dropDuplicates(["__id", "__hh"])
    rows = rows.unionByName(rest)
    out = keyed.join(rows, keyed["doc_id"].eqNullSafe(rows["__id"]) & keyed["__h"].eqNullSafe(rows["__hh"]), "left")
    return out.select(*[keyed[f"`{c}`"] for c in docs.columns], F.col("__n").alias("__n_shingles"), "__component", "__links", *named)


def _hashes(found: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = utf8(b.column(3))
            for i, j in pieces(offs):
                h, at = unique_by_row(*Words(buf, offs[i : j + 1], lower=True).grams(k))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(3)), list_array(signed(h), at, pa.int64())], names=["cls", "weight", "units", "hashes"])

    return arrow_map(found, run, "cls long, weight long, units array<struct<unit:long,side:int>>, hashes array<long>")


def representatives(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the row of smallest doc_id (one of them, where
    rows of the group share it). Documents that link with nothing stay, rows of null
    doc_id too, and rows of one doc_id in different groups each."""
    docs = free(docs, "__h", "__hh", "__id", "__n", "__n_shingles", "__component", "__links", "__root")
    j = _join(docs, k, percent, root=True)
    j = j.where("doc_id is null or doc_id = __component")
    known = j.where("doc_id is not null and __n_shingles > 0").dropDuplicates(["__root"])
    return known.unionByName(j.where("doc_id is null or __n_shingles = 0")).select(*[f"`{c}`" for c in docs.columns])
