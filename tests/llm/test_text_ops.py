"""Operators on texts against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkvane.llm import automaton, bpe, chat, decontam, jaccard, passages, queries, sparse_sa, toxicity
from sparkvane.llm._text import Words, utf8
from sparkvane.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=5, n=60):
    """Copies, near copies, shared passages, nulls, empty, short and odd texts."""
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "tu", "é", "語") for b in ("ra", "so", "ne", "x")]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 160))) for _ in range(8)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    out = []
    for i in range(n):
        t = rng.choice(base)
        kind = rng.random()
        if kind < 0.3:
            w = t.split(" ")
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        elif kind < 0.5:
            t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) + "\t" + passage + "\n" + " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))
        elif kind < 0.6:
            t = t.upper()
        out.append((i, t, "en", "s", len(t)))
    out += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, " \t\n ", "en", "s", 4), (n + 3, "one two", "en", "s", 7), (n + 4, "ONE  two", "en", "s", 8), (None, base[0], "en", "s", 1), (3, out[3][1], "en", "s", 1), (n + 5, "a " * 400, None, "s", 800)]
    return out


def docs_of(spark, rows, **extra):
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    for k, v in extra.items():
        d = d.withColumn(k, F.lit(v))
    return d


def test_words_and_hashes_match_python():
    import pyarrow as pa

    texts = ["a  b\tc", "", None, "é語 x\x0b", " lead", "trail ", "A a"]
    buf, offs = utf8(pa.array(texts))
    w = Words(buf, offs, lower=True)
    assert w.n.tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert w.h[-1] == w.h[-2] == w.h[0]
    g, at = w.grams(2)
    assert np.diff(at).tolist() == [2, 0, 0, 1, 1, 1, 1]


def brute_removed(rows, length):
    first = {}
    for i, t, *_ in rows:
        if i is not None and t:
            w = WORD.findall(t)
            for a in range(len(w) - length + 1):
                k = tuple(w[a : a + length])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        if i is not None:
            for a in range(len(w) - length + 1):
                if first[tuple(w[a : a + length])] < i:
                    gone[a : a + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("op,heavy", [(automaton, 2000), (sparse_sa, 2000), (automaton, 1), (sparse_sa, 3)])
def test_repeats_match_brute_force(spark, op, heavy):
    rows = corpus()
    out = op.dedup(docs_of(spark, rows, __h=1, spans="x", owner=2), length=12, gram=4, spacing="single", heavy=heavy)
    key = lambda r: (r[0] is None, r)
    got = [(r["doc_id"], r["__n_words"], r["__n_removed"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()]
    assert sorted(got, key=key) == sorted(brute_removed(rows, 12), key=key)
    assert {"spans", "owner", "lang"} <= set(out.columns)


def test_kernels_find_the_smallest_owner_of_every_window():
    rng = random.Random(6)
    length = 6
    for size in (1, 40, 50_000):
        groups = []
        for g in range(30):
            anchor = [f"g{g}"]
            group = []
            for _ in range(rng.randint(1, 7)):
                left, right = ([rng.choice("ab") for _ in range(n)] for n in (rng.randint(0, 5), rng.randint(5, 9)))
                w = left + anchor + right
                most = min(len(left), len(w) - length)  # windows hold the anchor
                if most >= 0:
                    group.append((len(group), rng.randint(0, 5), most + 1, len(left), " ".join(w)))
            group.sort(key=lambda c: (c[1], c[0]))
            groups.append(group)
        want = []
        for group in groups:
            first = {}
            for _, owner, n, _, words in group:
                w = words.split()
                for a in range(n):
                    k = tuple(w[a : a + length])
                    first[k] = min(first.get(k, owner), owner)
            want += [[first[tuple(c[4].split()[a : a + length])] for a in range(c[2])] for c in group]
        shard, automaton.SHARD = automaton.SHARD, size
        try:
            got = automaton.kernel(groups, length)
        finally:
            automaton.SHARD = shard
        assert [x.tolist() for x in got] == want
        groups = [g for g in groups if g]
        assert [x.tolist() for x in sparse_sa.kernel(groups, length)] == want


def test_parts_of_a_class_cover_its_windows_and_agree_on_their_context():
    rng = random.Random(9)
    length = 10
    seen = {}
    for width in (4, 2, 1):
        for _ in range(200):
            w = [rng.choice("ab").encode() for _ in range(40)]
            n, off = rng.randint(1, 8), rng.randint(0, 7)
            n = min(n, off + 1)
            words = w[: n + length - 1]
            parts = list(passages.split_class(5, n, off, words, length, width))
            assert sorted(a + i for a, _, _, m, _, _ in parts for i in range(m)) == list(range(n))
            for a, key, sh, m, o, own in parts:
                assert own.split(b" ") == words[a : a + m + length - 1] and o == off - a
                for i in range(a, a + m):
                    part = (off - i) // width
                    assert seen.setdefault((width, tuple(words[i : i + length]), off - i), key) == key and (o - i + a) // width == part


def test_original_spacing_and_empty_table(spark):
    p = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"x\n{p}\ny", "en", "s", 0), (2, f"a\tb\n{p}\nc  d", "en", "s", 0)]
    got = {r["doc_id"]: r["text"] for r in sparse_sa.dedup(docs_of(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "a\tb\nc  d"}
    assert sparse_sa.dedup(docs_of(spark, rows).where("false")).count() == 0


def shingles(t, k):
    w = WORD.findall((t or "").translate(UP))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_links(rows, k, pct):
    s = [shingles(t, k) for _, t, *_ in rows]
    comp, links = list(range(len(rows))), [0] * len(rows)

    def root(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and s[a] and s[b] and 100 * len(s[a] & s[b]) >= pct * len(s[a] | s[b]):
                links[a] += 1
                links[b] += 1
                comp[root(a)] = root(b)
    low = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            low[root(a)] = min(low.get(root(a), r[0]), r[0])
    return [(r[0], len(s[a]), low.get(root(a)), links[a]) for a, r in enumerate(rows)]


@pytest.mark.parametrize("k,pct,block", [(4, 85, 1024), (5, 80, 1024), (2, 50, 3), (2, 80, 2)])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, k, pct, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(9)
    out = jaccard.join(docs_of(spark, rows, __n=1, cls=2, n=3), k, pct)
    key = lambda r: (r[0] is None, r)
    got = [(r["doc_id"], r["__n_shingles"], r["__component"], r["__links"]) for r in out.collect()]
    assert sorted(got, key=key) == sorted(brute_links(rows, k, pct), key=key)
    if k == 5:
        keep = jaccard.representatives(docs_of(spark, rows), k, pct)
        ids = sorted(r["doc_id"] for r in keep.where("doc_id is not null").collect())
        assert ids == sorted({r[2] for r in brute_links(rows, k, pct) if r[0] is not None})
        assert keep.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert jaccard.join(docs_of(spark, rows).where("false"), k, pct).count() == 0


def test_representatives_keep_unrelated_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = lambda t: t + " more"
    rows = [(1, a), (1, b), (1, near(b)), (1, b), (2, near(a)), (3, near(b)), (4, c), (4, c), (5, None), (5, "")]
    keep = jaccard.representatives(docs_of(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()
    assert sorted(r["doc_id"] for r in keep) == [1, 1, 4, 5, 5]
    assert {(r["text"] or " ")[0] for r in keep if r["doc_id"] == 1} == {"a", "b"}


def test_blocks_meet_where_sizes_allow_a_link_and_only_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(3)
    sizes = [rng.choice((8, 9, 10, 11, 20, 24, 25, 90, 100, 112)) for _ in range(60)]
    rows = [(i, i % 2, n) for i, n in enumerate(sizes)]
    by_unit = {}
    for r in jaccard._units(spark.createDataFrame(rows, "cls long, comp long, n long"), 85).collect():
        for u in r["units"]:
            by_unit.setdefault(u["unit"], []).append((u["side"], r["cls"]))
    met = {}
    for own in by_unit.values():
        x, y = [c for s, c in own if s < 2], [c for s, c in own if s == 2]
        assert len({c for _, c in own}) == len(own) <= 60
        pairs = [(a, b) for a in x for b in y] if any(s for s, _ in own) else [(a, b) for a in x for b in x if a < b]
        for a, b in pairs:
            met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    for a in range(60):
        for b in range(a + 1, 60):
            may = a % 2 == b % 2 and 100 * min(sizes[a], sizes[b]) >= 85 * max(sizes[a], sizes[b])
            assert met.get((a, b), 0) == 1 or not may and met.get((a, b), 0) == 0
    assert not any(max(sizes[a], sizes[b]) > 2 * min(sizes[a], sizes[b]) for a, b in met)


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(4)
    for pct in (50, 80, 85, 95):
        for _ in range(150):
            n = int(rng.integers(2, 300))
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            change = int(rng.integers(0, max(1, n * (100 - pct) // 150) + 1))
            b[:change] = rng.integers(0, 2**63, change).astype(np.uint64)
            b = b[: n - int(rng.integers(0, 2))]
            x, y = np.unique(a), np.unique(b)
            inter = len(np.intersect1d(x, y))
            if 100 * inter >= pct * (len(x) + len(y) - inter) and not np.array_equal(x, y):
                low = jaccard.bounds(400)
                s, r = jaccard.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), low, pct)
                assert set(s[r == 0].tolist()) & set(s[r == 1].tolist())


def test_chance_meetings_make_no_candidates(spark, monkeypatch):
    """Texts that share a few short passages are not candidates; near copies still are."""
    rng = random.Random(1)
    passages_ = [[f"p{i}q{j}" for j in range(10)] for i in range(30)]
    texts = [" ".join(sum(rng.sample(passages_, 4), []) + [f"w{i}x{j}" for j in range(200)]) for i in range(300)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*texts, texts[7] + " more"])]
    made = []
    monkeypatch.setattr(jaccard, "components", lambda e: made.append(e.collect()) or components(e))
    got = {r["doc_id"]: r["__component"] for r in jaccard.join(docs_of(spark, rows), 5, 80).collect()}
    assert got == {**{i: i for i in range(300)}, 300: 7}
    assert 1 <= len(made[0]) <= 10


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}


def test_decontamination_matches_brute_force(spark):
    rows = corpus(11)
    rng = random.Random(1)
    items = []
    for n in range(12):
        w = WORD.findall(rows[n][1])[: rng.randint(3, 30)]
        if n % 3 == 0 and len(w) > 6:
            w[len(w) // 2] = "changed"
        items.append((n, " ".join(w).title()))
    items += [(50, None), (51, ""), (None, "x y z"), (52, "one two"), (1, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t, *_ in rows:
        hit = set()
        for item, x in items:
            if item is None or not shingles(x, 5):
                continue
            size = len(next(iter(shingles(x, 5))))
            w = WORD.findall((t or "").translate(UP))
            own = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)}
            if len(shingles(x, 5) & own) >= 0.8 * len(shingles(x, 5)) - 1e-9:
                hit.add(item)
        want.append((i, tuple(sorted(hit))))
    key = lambda r: (r[0] is None, r)
    for bound in (10**6, 1):
        out = decontam.search(docs_of(spark, rows, item_id=3), bench, bound=bound)
        got = [(r["doc_id"], tuple(sorted({m["item_id"] for m in r["__matches"]}))) for r in out.collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert decontam.clean(docs_of(spark, rows), bench.where("false")).count() == len(rows)


def test_decontamination_judges_repeated_items_row_by_row(spark):
    w = [f"w{i}" for i in range(200)]
    item = " ".join(w[:24])  # 20 shingles
    bench = [(1, item)] * 2 + [(2, " ".join(w[100:124])), (2, " ".join(w[100:108] + w[130:190])), (3, item)]
    rows = [(n, " ".join(["x"] * 6 + w[:n + 4] + ["y"] * 6), "en", "s", 0) for n in (8, 12, 15, 16, 20)]  # n of 20 shared
    rows += [(30, " ".join(w[100:118]), "en", "s", 0), (31, " ".join(w[100:124]), "en", "s", 0)]
    b = spark.createDataFrame(bench, "item_id long, text string")
    full = lambda n: [(1, n, 20), (1, n, 20), (3, n, 20)]
    want = {8: [], 12: [], 15: [], 16: full(16), 20: full(20), 30: [], 31: [(2, 20, 20)]}
    for bound in (10**6, 1):
        out = decontam.search(docs_of(spark, rows), b, bound=bound).collect()
        assert {r["doc_id"]: [tuple(m) for m in r["__matches"]] for r in out} == want
        assert {r["doc_id"] for r in decontam.clean(docs_of(spark, rows), b, bound=bound).collect()} == {8, 12, 15, 30}


def test_bpe_equals_the_public_library(spark):
    import tiktoken

    ranks = bpe.load_ranks(bpe.default_vocabulary())
    enc = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    own = bpe.Bpe(ranks, bpe.default_pattern())
    rng = random.Random(2)
    alphabet = ["a", "b", "é", " ", "1", "½", "\n", "語", "🙂", "_", "'s", "the", "\x1c", "x" * 40, "\u2003"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["a" * 4000, "ab" * 1500, "".join(rng.choice("abc") for _ in range(5000)), "<|endoftext|>", None]
    d = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(d)).join(bpe.encode(d), "doc_id").collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert list(r["ids"]) == enc.encode_ordinary(t) and bytes(r["decoded"]).decode() == t
    assert len(got) == len(texts)
    again = bpe.encode(d, keep=("doc_id", "ids")).withColumn("decoded", F.lit(1))  # names that clash give way
    assert again.columns == ["doc_id", "ids", "decoded"] and again.schema["ids"].dataType.simpleString() == "array<int>"
    assert bpe.decode(again, keep=("doc_id", "decoded")).columns == ["doc_id", "decoded"]
    assert bpe.decode(bpe.encode(d.where("false"))).count() == 0
    left, right = own.tree(b"unbeliev"), own.tree(b"ably so")
    assert own.join(left, right) == own.tree(b"unbelievably so")


def test_bpe_tree_decides_pieces_outside_the_vocabulary():
    ranks = bpe.load_ranks(bpe.default_vocabulary())
    own = bpe.Bpe(ranks, bpe.default_pattern())
    rng = random.Random(8)
    joins = []
    real = own.join
    own.join = lambda a, b: (joins.append(1), real(a, b))[1]
    for _ in range(400):
        data = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(5, 300))).encode()
        assert own.tree(data) == own._short(data)
    assert len(joins) > 400


def plain_ftrl(rows, epochs, alpha, beta, l1, l2, positive):
    """FTRL-proximal by the book: one coordinate at a time; bias: None."""
    z, n = {}, {}
    w = lambda i: 0.0 if abs(z.get(i, 0.0)) <= (lam := 0.0 if i is None else l1) else ((lam if z[i] > 0 else -lam) - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)
    for _ in range(epochs):
        for slots, y in rows:
            own = {i: w(i) for i in [*slots, None]}
            g = (1 / (1 + math.exp(-sum(own.values()))) - y) * (positive if y else 1.0)
            for i, x in own.items():
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old**0.5) / alpha * x
    return {i: w(i) for i in z if w(i)}


def test_toxicity_fit_equals_plain_ftrl():
    rng = random.Random(4)
    rows = [(sorted({rng.randrange(64) for _ in range(rng.randint(0, 9))}), int(rng.random() < 0.4)) for _ in range(300)]
    flat = np.array([i for s, _ in rows for i in s], np.int32)
    at = np.cumsum([0] + [len(s) for s, _ in rows])
    y = np.array([t for _, t in rows], float)
    chunks = [(flat[: at[100]], at[:101], y[:100]), (flat[at[100] :], at[100:] - at[100], y[100:])]
    for l1, positive in ((0.0, 1.0), (0.7, 2.0)):
        m = toxicity.fit(chunks, 6, 2, 0.5, 1.0, l1, 0.3, positive)
        want = plain_ftrl(rows, 2, 0.5, 1.0, l1, 0.3, positive)
        bias = want.pop(None)
        assert m.slots.tolist() == sorted(want) and m.bias == pytest.approx(bias)
        assert m.weights.tolist() == pytest.approx([want[i] for i in sorted(want)])


def test_toxicity_sample_is_bounded_and_repeats_count():
    batch = lambda ls, ys: pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ls, pa.list_(pa.int32()))], names=["__y", "slots"])
    stream = [batch([[1, 2], [1, 2], []], [1, 1, 0]), batch([[3], [4, 5, 6]], [0, 1]), batch([[7]], [1])]
    got = toxicity.gather_sample(iter(stream), 6)
    assert [(f.tolist(), a.tolist(), y.tolist()) for f, a, y in got] == [([1, 2, 1, 2], [0, 2, 4, 4], [1, 1, 0]), ([3], [0, 1], [0])]
    assert len(toxicity.gather_sample(iter(stream))) == 3
    assert toxicity.gather_sample(iter(stream), 4)[0][1].tolist() == [0, 2, 4, 4]


def test_toxicity_query_reports_the_fold(spark, tmp_path):
    rows = [(i, ("vile rotten words here" if i % 3 == 0 else "calm plain words here") + f" x{i % 7}", "en", "s", 0) for i in range(200)]
    docs_of(spark, [*rows, (500, None, None, None, None), (501, "", "en", "s", 0)]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = queries.op8_toxicity(spark, str(tmp_path))
    assert d.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = {r["doc_id"]: r for r in d.collect()}
    assert len(got) == 202 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in range(200))
    # held-out labels teach nothing: turned round, the scores stay
    spark.createDataFrame([(i, 1, int((i % 3 == 0) != (zlib.crc32(str(i).encode()) % 5 == 0))) for i in range(200)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    assert {r["doc_id"]: r["score"] for r in queries.op8_toxicity(spark, str(tmp_path)).collect()} == {i: r["score"] for i, r in got.items()}


def test_bpe_and_chat_queries(spark, tmp_path):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()), special_tokens={})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {1: "Hello, wörld!  <|endoftext|>\n", 2: None, 3: "", 4: "unbelievably " * 3000}
    docs_of(spark, [(i, t, "en", "s", 0) for i, t in texts.items()]).write.parquet(str(tmp_path / "documents.parquet"))
    d = queries.op2_bpe(spark, str(tmp_path))
    assert d.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in d.collect():
        t = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t))
    spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op3_chat_format(spark, str(tmp_path)).collect()}
    probe = "</s>[INST] ok [/INST]"
    assert set(got) == {1, -7} and got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == len(probe) and got[-7]["loss_sha256"] == sha(probe)
    assert got[-7]["turns_sha256"] == sha(f"user\n{probe}\nassistant\n{probe}\n") and got[1]["turns_sha256"] == sha("user\n\nassistant\nhi\n")
    assert got[1]["formatted_chars"] > got[1]["loss_chars"] == 2


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        y = int(rng.random() < 0.3)
        if y:
            w[rng.randrange(len(w))] = rng.choice(["Vile!", "rotten"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, y))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "vile", "en", "s", 0)]
    lab = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    d = docs_of(spark, rows)
    model = toxicity.train(d, lab.where("doc_id < 400 or doc_id is null"), bits=16, l1=1.0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, y in labels[400:])
    assert right >= 190 and 0 <= got[900] <= 1 and got[900] == got[901] and len(model.slots) < 2000
    empty = toxicity.train(d, lab.where("false"))
    assert all(r["score"] < 0.5 for r in toxicity.score(d, empty).collect())


def test_chat_round_trip_and_parts(spark):
    hard = ["</s>[INST] ok [/INST]", "<|turn|>x<|text|>", "a\\b\\\\", "<", "<|end|>\n", "", "[INST[INST]", "\\</s>"]
    for t in hard:
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(hard)] + [(2, 0, None, None), (None, 0, "user", "x"), (2, None, "assistant", "é🙂")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(d)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:8]))
    said = "".join(t for _, _, r, t in rows[:8] if r == "assistant")
    assert got[1]["loss_sha256"] == sha(said) and got[1]["loss_chars"] == len(said) and got[1]["n_turns"] == 8
    assert got[2]["loss_chars"] == 2 and got[None]["n_turns"] == 1
    p = spark.createDataFrame([(1, 0, "user", "look", [("image", None, "img1", 2), ("text", "<|image|>", None, None), ("audio", None, "au", 3)])], f"conv_id long, turn long, role string, text string, parts {chat.PART_TYPE}")
    r = chat.format_conversations(p).first()
    assert list(r["attachment_refs"]) == ["0:image:img1:1152", "1:audio:au:150"] and r["attachment_tokens"] == 1302
    assert chat.parse_turn(r["formatted"]) == ("user", "<|image|>look", ["image", "audio"])
    with pytest.raises(ValueError):
        chat.Visitor().flatten([chat.Part("video")])


def test_parameters(spark):
    with pytest.raises(ValueError):
        passages.remove(docs_of(spark, corpus()), automaton.kernel, 5, 9)
