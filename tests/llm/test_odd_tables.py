"""Empty tables, very long texts, clashing names and repeated rows, operator by operator."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkvane.llm import automaton, bpe, chat, decontam, jaccard, sparse_sa, topk, toxicity, urls, warc
from sparkvane.llm._store import cut, cut_native, drop, new_path, scratch, shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"ids": "x", "decoded": 1, "score": 2.0, "__y": 1, "__at": 1, "h": 3, "spans": "s", "__matches": 4, "cls": 5, "key": 6, "owner": 7}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def operators(labels, bench):
    return {
        "bpe": lambda d: bpe.decode(bpe.encode(d)),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels, bits=12)),
        "decontam": lambda d: decontam.search(d, bench),
        "decontam joined": lambda d: decontam.search(d, bench, bound=0),
        "jaccard": jaccard.join,
        "representatives": jaccard.representatives,
        "suffix array": sparse_sa.dedup,
        "automaton": automaton.dedup,
    }


def test_empty_tables_give_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    d = docs_of(spark, [(1, "a b c")])
    for name, op in operators(labels, bench).items():
        assert op(d.where("false")).count() == 0, name
        assert op(d).count() == 1, name
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(talk).count() == 0 and chat.read_back(chat.format_conversations(talk)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(spark, pages).count() == 0
    assert urls.judge(pages, spark.createDataFrame([], "page_id long, bad int")).count() == 0
    assert topk.top_k(*[spark.createDataFrame([], "id long, v array<long>")] * 2, 3).count() == 0


def test_clashing_names_and_repeated_rows(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (80, 60, 0, 3)]
    rows = [(i, t) for i, t in enumerate(texts)] * 3 + [(None, texts[0]), (9, None), (9, None)]
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, " ".join(texts[0].split()[10:30]))] * 2 + [(None, texts[1]), (2, None), (3, "")], "item_id long, text string")
    d = docs_of(spark, rows)
    odd = d.withColumns({k: F.lit(v) for k, v in CLASH.items()})
    for name, op in operators(labels, bench).items():
        plain, clash = op(d), op(odd)
        same = [c for c in plain.columns if c not in CLASH] or ["doc_id"]
        key = lambda r: str(tuple(r))
        assert sorted(map(key, plain.select(*same).collect())) == sorted(map(key, clash.select(*same).collect())), name
        assert plain.count() == len(rows) or name == "representatives", name
    talk = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "assistant", "b")], "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit("x"), "formatted": F.lit(1), "loss_from": F.lit(2)})
    assert sorted((r["conv_id"], r["n_turns"]) for r in chat.read_back(chat.format_conversations(talk)).collect()) == [(1, 2), (2, 1)]
    v = spark.createDataFrame([(1, [1, 2], 5), (2, [2, 1], 6), (2, [2, 1], 7)], "id long, v array<long>, rank long").withColumn("score", F.lit("x"))
    got = topk.top_k(v.where("id = 1"), v, 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(tuple(r) for r in got.collect()) == [(1, 1, 2, 4), (1, 2, 2, 4)]


def test_texts_over_a_megabyte(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(200_000))
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(1, long), (2, long + " tail"), (3, "start " + passage), (4, f"{passage} {long[:1_100_000]}"), (5, "x" * 1_200_000)]
    d = docs_of(spark, rows).repartition(2)
    item = spark.createDataFrame([(7, " ".join(long.split()[150_000:150_030]))], "item_id long, text string")
    hit = {r["doc_id"]: len(r["__matches"]) for r in decontam.search(d, item).collect()}
    assert hit == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    comp = {r["doc_id"]: (r["__component"], r["__links"]) for r in jaccard.join(d).collect()}
    assert comp == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0)}
    want = {1: 0, 2: 200_000, 3: 0, 5: 0}
    for op in (sparse_sa, automaton):
        got = {r["doc_id"]: (r["__n_words"], r["__n_removed"]) for r in op.dedup(d).collect()}
        assert {i: got[i][1] for i in want} == want and got[4][0] - 1 <= got[4][1] + 1
    out = {r["doc_id"]: r for r in bpe.decode(bpe.encode(d, keep=("doc_id",)), keep=("doc_id",)).collect()}
    assert all(hashlib.sha256(bytes(out[i]["decoded"])).digest() == hashlib.sha256(t.encode()).digest() for i, t in rows)


def test_scratch_tables_come_and_go(spark):
    import os

    root = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    d = spark.range(50).selectExpr("id", "array(id, id + 1) AS v", "cast(id AS string) AS t", "named_struct('a', id, 'b', cast(id AS double)) AS s")
    with scratch(spark):
        before = set(os.listdir(root)) if os.path.isdir(root) else set()
        for make in (cut, cut_native):
            a = make(d)
            assert sorted(map(str, a.collect())) == sorted(map(str, d.collect())) and a.dtypes == d.dtypes
            assert make(d.where("false")).count() == 0
            drop(a)
        left = new_path(spark, "left")
        spark.range(3).write.parquet(left)
    assert {x for x in set(os.listdir(root)) - before if not x.startswith(".")} == set()


def test_files_of_failed_attempts_are_not_read(spark, tmp_path):
    """A first attempt leaves a file behind; only the file of the attempt that finished counts."""
    from pyspark import TaskContext

    from sparkvane.llm import _store

    def fails_once(batches):
        for b in batches:
            yield b
        if TaskContext.get().attemptNumber() == 0 and not (tmp_path / "failed").exists():
            (tmp_path / "failed").write_text("x")
            raise RuntimeError("lost")

    if spark.sparkContext.master.startswith("local[") and "," not in spark.sparkContext.master:
        with pytest.raises(Exception, match="lost"):  # a local session does not try again
            cut(_store.arrow_map(spark.range(100), fails_once, "id long"))
    assert cut(_store.arrow_map(spark.range(100), fails_once, "id long")).count() == 100
