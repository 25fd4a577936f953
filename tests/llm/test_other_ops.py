"""WARC, URL filters, top-k and the pipeline."""

import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvane.llm import queries, topk, urls, warc
from sparkvane.llm._store import new_path

PAGES = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    rows = [(5, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (9, None, "same"), (1, "u", None), (3, "u", ""), (7, "u", "é" * 5000), (None, "u", "same"), (None, None, "alone"), (2, "again", "same")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("k", F.lit(1)).withColumn("first_id", F.lit(2))
    manifest = warc.write_archives(pages, new_path(spark, "warc"), archive_bytes=300)
    out = warc.read_archives(manifest).collect()
    assert len(out) == len(rows) and manifest.agg(F.sum("records")).first()[0] == len(rows)
    by = {(r["page_id"], r["url"]): r for r in out}
    for i, u, h in rows:
        r = by[i, None if u is None else u.replace("\r", "%0D").replace("\n", "%0A")]
        data = (h or "").encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == warc.b32sha1(data)
        first = min((x[0] for x in rows if (x[2] or "") == (h or "") and x[0] is not None), default=None)
        if first is None or i == first:
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]) == data
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == first and r["payload"] is None
    assert warc.archive_pages(spark, pages.where("false")).count() == 0


def test_warc_reader_finds_damage():
    good = warc.page_record(1, "u", b"x" * 1000, None)
    assert [r["payload"] for r in warc.read_archive(io.BytesIO(good + good))] == [b"x" * 1000] * 2
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(good[:-5])))
    bad = warc.record([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:" + warc.b32sha1(b"other"))], b"data")
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(bad)))


def test_url_parts_rules_and_reputation(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?q#f"), (2, "http://b.net/x"), (3, "http://c.example.com/de/"), (4, "https://x.org/fr/y"), (5, None), (6, "no scheme"), (7, "http://net"), (8, "http://notnet.com/x"), (9, "a://b://c/d?x"), (10, "http://")]
    rows += [(100 + i, f"http://bad.site.com/{i}") for i in range(60)] + [(200 + i, f"http://good.site.com/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("zz")).withColumn("n", F.lit(1))
    labels = spark.createDataFrame([(100 + i, 1) for i in range(40)] + [(200 + i, 0) for i in range(40)] + [(None, 1), (1, None)], "page_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(pages, labels).collect()}
    assert len(got) == len(rows)
    want = {1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("b.net", "/x", "net/", "block"), 3: ("c.example.com", "/de/", "example.com/de/", "block"), 4: ("x.org", "/fr/y", "org/fr/", "allow"),
            5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("net", "", None, "allow"), 8: ("notnet.com", "/x", None, "allow"), 9: ("b:", "//c/d", None, "allow"), 10: ("", "", None, "allow")}
    for k, v in want.items():
        assert tuple(got[k][c] for c in ("host", "path", "rule", "verdict")) == v
    assert got[159]["verdict"] == "block" and got[259]["verdict"] == "allow"
    assert {r["verdict"] for r in urls.judge(pages.where("page_id > 4 and page_id <> 200"), labels.where("false")).collect()} == {"allow"}
    assert urls.judge(pages.where("false"), labels).count() == 0


def test_unlabelled_hosts_take_their_domains_prior(spark):
    labelled = [(f"h{h}.{d}", b) for h in range(4) for d, b in (("spam.com", 1), ("fine.com", 0), ("good.org", 0), ("vile.bad", 1), ("worse.bad", 1)) for _ in range(30)]
    rows = list(enumerate(h for h, _ in labelled)) + [(1000, "new.spam.com"), (1001, "new.fine.com"), (1002, "x.other.bad"), (1003, "x.other.org"), (1004, "x.else.where"), (1005, "x.other.com"), (1006, "h0.spam.com")]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(labelled)], "page_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(pages, labels).collect()}
    assert len(got) == len(rows)

    def strength(groups):
        spread = sum((n - 1) * m * (1 - m) for n, _, m in groups)
        rho = (sum(n * (b / n - m) ** 2 for n, b, m in groups) - sum(m * (1 - m) for _, _, m in groups)) / spread
        return max(1.0, min(1000.0, 1 / rho - 1)) if rho > 0 else 1000.0

    m0 = (360 + 1) / (600 + 2)
    suf = {"com": (240, 120), "org": (120, 0), "bad": (240, 240)}
    s1 = strength([(n, b, m0) for n, b in suf.values()])
    m1 = {k: (b + m0 * s1) / (n + s1) for k, (n, b) in suf.items()}
    dom = {"spam.com": 120, "fine.com": 0, "good.org": 0, "vile.bad": 120, "worse.bad": 120}
    s2 = strength([(120, b, m1[k.split(".")[1]]) for k, b in dom.items()])
    m2 = {k: (b + m1[k.split(".")[1]] * s2) / (120 + s2) for k, b in dom.items()}
    s3 = strength([(30, b // 4, m2[k]) for k, b in dom.items() for _ in range(4)])
    for i, m, s in ((1000, m2["spam.com"], s3), (1001, m2["fine.com"], s3), (1002, m1["bad"], s2), (1003, m1["org"], s2), (1004, m0, s1), (1005, m1["com"], s2)):
        assert got[i]["host_rate"] == pytest.approx(m) and got[i]["host_lower"] == pytest.approx(m - urls.Z * (m * (1 - m) / (s + 1)) ** 0.5)
    assert [got[i]["verdict"] for i in range(1000, 1007)] == ["block", "allow", "block", "allow", "allow", "allow", "block"]
    assert got[1006]["host_rate"] == got[0]["host_rate"] > got[1000]["host_rate"]


def test_sites_under_a_suffix_of_two_labels_have_priors_of_their_own(spark, tmp_path):
    labelled = [(f"h{h}.{d}.co.uk", b) for h in range(4) for d, b in (("spam", 0), ("fine", 1), ("good", 1)) for _ in range(30)]
    rows = list(enumerate(h for h, _ in labelled)) + [(1000, "new.spam.co.uk"), (1001, "new.fine.co.uk"), (1002, "spam.co.uk"), (1003, "co.uk"), (1004, "new.notco.uk")]
    spark.createDataFrame([(i, f"http://{h}/", "") for i, h in rows], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(labelled)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["page_id"]: r["verdict"] for r in queries.op7_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(1000, 1005)] == ["block", "allow", "block", "allow", "allow"]
    parts = {r["host"]: (r["domain"], r["suffix"]) for r in urls.parse(spark.read.parquet(str(tmp_path / "pages.parquet")), urls.PUBLIC_SUFFIXES).collect()}
    assert parts["h0.spam.co.uk"] == ("spam.co.uk", "co.uk") and parts["co.uk"] == ("co.uk", "co.uk") and parts["new.notco.uk"] == ("notco.uk", "uk")


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)) / 3
    x[50:120] = x[7]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, []), (404, [1.0, 2.0]), (7, x[3].astype(np.float32).tolist()), (None, x[1].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(topk.usable("embedding"))
    v = d.select(F.col("vec_id").alias("id"), topk.quantise("embedding").alias("v")).repartition(3)
    got = topk.top_k(v.where("id % 20 = 0"), v, 5, shard_rows=64, block_rows=4)
    base = [(i, np.floor(64 * np.float32(e).astype(float)).astype(int)) for i, e in rows if e is not None and i not in (401, 402, 403, None)]
    want = []
    for q, a in base:
        if q % 20 == 0:
            own = sorted((-int(a @ b), i) for i, b in base if i != q and len(b) == len(a))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(own)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.top_k(v.where("false"), v, 5).count() == 0 and topk.top_k(v, v.where("false"), 5).count() == 0
    huge = spark.createDataFrame([(0, [2**40, 1]), (1, [2**40, 2])], "id long, v array<long>")
    with pytest.raises(Exception, match="2\\*\\*53"):
        topk.top_k(huge, huge, 1).collect()


def test_topk_skips_what_cannot_win():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-9, 9, (600, 6)) + c for c in (np.zeros(6, int), np.full(6, 200))]).astype(float)
    order, nodes, centres, radii = topk.build_tree(x, 32)
    best = topk.Best(np.array([-1, -2]), 3)
    block = np.ones((2, 6))
    scored = topk.search(best, block, np.sqrt((block**2).sum(axis=1)), np.arange(1200)[order], x[order], (nodes, centres, radii))
    assert scored <= 2 * 700  # the far half is never scored
    want = np.lexsort((np.arange(1200), -(x @ np.ones(6))))[:3]
    assert best.i.tolist() == [*want, *want]


def test_pipeline_stages_do_their_work(spark, tmp_path):
    import corpus_pipeline

    from sparkvane.llm import toxicity

    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(200):
        t = text(80)
        if i % 5 == 0:
            t += " vile rotten"
        docs.append((i, t))
        labels.append((i, 1, int(i % 5 == 0)))
    near, passage, item = text(100), text(70), text(20)
    docs += [(300, near), (301, near + " more"), (302, text(50) + " " + passage), (303, text(50) + " " + passage), (304, text(40) + " " + item + " " + text(40)), (305, None), (306, ""), (307, passage)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 300 in got and 301 not in got and 304 not in got and 307 not in got and {302, 303, 305, 306} <= set(got)
    model = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), corpus_pipeline.table(spark, str(tmp_path), "labels").where(corpus_pipeline.fold("doc_id") != 0))
    kept = {r["doc_id"] for r in toxicity.score(spark.read.parquet(str(tmp_path / "documents.parquet")), model).where("score < 0.5").collect()}
    assert set(got) & set(range(200)) == kept & set(range(200)) and len([i for i in got if i < 200 and i % 5 == 0]) < 10
    import tiktoken

    from sparkvane.llm import bpe

    enc = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()), special_tokens={})
    left = docs[203][1].replace(passage, "").rstrip()
    assert enc.decode(got[303]["ids"]).strip() == left.strip()
    for i, t in docs[:200]:
        if i in got:
            assert list(got[i]["ids"]) == enc.encode_ordinary(t) and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert got[305]["n_tokens"] == 0 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_array", "decontamination", "bpe"]
