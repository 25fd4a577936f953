"""Queries over the corpus tables: thin digests of the operators' outputs, and
DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import automaton, bpe, chat, decontam, jaccard, sparse_sa, topk, toxicity, urls, warc

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").where(topk.usable("embedding")).select(F.col("vec_id").alias("id"), topk.quantise("embedding").alias("v"))
    return topk.top_k(v.where("id % 20 = 0"), v, 20)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents")).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text(), 256).alias("ids_sha256"))
    out = bpe.decode(encoded, keep=("doc_id", "n_tokens", "ids_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def fold(doc_id: str):
    """crc32 of the id as text, modulo 5: 0 marks the held-out fifth."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold("doc_id") != 0))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.read_back(chat.format_conversations(rows.unionByName(own)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it contains an item, and which."""
    out = decontam.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("__matches", lambda m: m["item_id"])))
    return out.select("doc_id", (F.size("__matches") > 0).cast("int").alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("item_ids"))


OP4_SQL = r"""
WITH dw AS (SELECT doc_id, rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, greatest(len(w) - 5 + 1, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM bw WHERE len(w) > 0),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT rid, k, unnest(list_transform(range(1, greatest(len(w) - k + 1, 0) + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM dw, ks),
hit AS (SELECT rid, item_id FROM (SELECT rid, item_id, count(*) AS c FROM ds JOIN bs USING (k, s) GROUP BY ALL) JOIN bn USING (item_id) WHERE c >= 0.8 * n - 1e-9),
m AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids FROM hit GROUP BY rid)
SELECT doc_id, CASE WHEN n_items IS NULL THEN 0 ELSE 1 END AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids
FROM dw LEFT JOIN m USING (rid)
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(s, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)
    return out.select("doc_id", F.col("__n_shingles").alias("n_shingles"), F.col("__component").alias("component_id"), F.col("__links").alias("n_links"))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(list_transform(range(1, greatest(len(w) - 4 + 1, 1) + 1), lambda i: md5(array_to_string(w[i:i + 3], ' ')))) AS h FROM d WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT rid AS src, rid AS at FROM d UNION SELECT r.src, l.b FROM r JOIN l ON l.a = r.at),
k AS (SELECT src, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.at GROUP BY src),
c AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM d JOIN k ON k.src = d.rid LEFT JOIN n ON n.rid = d.rid LEFT JOIN c ON c.a = d.rid
"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcomes of pages: a label's doc_id names the page; low
    quality or toxic counts as bad."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages"), outcomes(spark, sf_dir), suffixes=urls.PUBLIC_SUFFIXES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def _strength_sql(mean: str) -> str:
    b, s = f"sum(n * (bad / n - {mean}) * (bad / n - {mean}))", f"sum((n - 1) * {mean} * (1 - {mean}))"
    rho = f"(({b}) - sum({mean} * (1 - {mean}))) / ({s})"
    return f"CASE WHEN {s} > 0 AND {rho} > 0 THEN greatest(1.0, least(1000.0, 1 / ({rho}) - 1)) ELSE 1000.0 END"


OP7_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
s AS (SELECT *, CASE WHEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN ({', '.join(f"'{x}'" for x in urls.PUBLIC_SUFFIXES)})
  THEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') ELSE string_split(host, '.')[-1] END AS suffix FROM p),
d AS (SELECT *, CASE WHEN length(host) <= length(suffix) + 1 THEN host
  ELSE string_split(substr(host, 1, length(host) - length(suffix) - 1), '.')[-1] || '.' || suffix END AS domain FROM s),
lab AS (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END AS bad FROM labels),
o AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM d JOIN lab ON doc_id = page_id WHERE bad IS NOT NULL GROUP BY ALL),
t AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m0 FROM o),
x1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m0) AS m0 FROM o, t GROUP BY suffix),
k1 AS (SELECT {_strength_sql('m0')} AS s FROM x1),
y1 AS (SELECT suffix, (bad + m0 * s) / (n + s) AS m1 FROM x1, k1),
x2 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(m1) AS m1 FROM o JOIN y1 USING (suffix) GROUP BY suffix, domain),
k2 AS (SELECT {_strength_sql('m1')} AS s FROM x2),
y2 AS (SELECT suffix, domain, (bad + m1 * s) / (n + s) AS m2 FROM x2, k2),
x3 AS (SELECT host, n, bad, m2 FROM o JOIN y2 USING (suffix, domain)),
k3 AS (SELECT {_strength_sql('m2')} AS s FROM x3),
y3 AS (SELECT host, bad + m2 * s AS a, n - bad + (1 - m2) * s AS b FROM x3, k3),
rep AS (SELECT host, a / (a + b) - 1.645 * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) AS lower FROM y3),
pd AS (SELECT suffix, domain, m2 - 1.645 * sqrt(m2 * (1 - m2) / (s + 1)) AS lower FROM y2, k3),
ps AS (SELECT suffix, m1 - 1.645 * sqrt(m1 * (1 - m1) / (s + 1)) AS lower FROM y1, k2),
pg AS (SELECT m0 - 1.645 * sqrt(m0 * (1 - m0) / (s + 1)) AS lower FROM t, k1),
rules(action, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM (SELECT DISTINCT page_id, host, path FROM d), rules WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY page_id)
SELECT d.page_id, d.host, d.path, hit.rule, coalesce(hit.action, CASE WHEN coalesce(rep.lower, pd.lower, ps.lower, pg.lower) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM d CROSS JOIN pg LEFT JOIN hit ON hit.page_id = d.page_id LEFT JOIN rep ON rep.host = d.host LEFT JOIN pd ON pd.suffix = d.suffix AND pd.domain = d.domain LEFT JOIN ps ON ps.suffix = d.suffix
"""


def _kept(out: DataFrame) -> DataFrame:
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(sparse_sa.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), spacing="single"))


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(automaton.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), spacing="single"))


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL),
dup AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS f FROM win) WHERE doc_id > f),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS pos FROM dup),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS t FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(t, ' ' ORDER BY pos) AS s FROM word ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_topk": op1_topk, "op2_bpe": op2_bpe, "op4_decontamination": op4_decontamination, "op8_toxicity": op8_toxicity,
            "op3_chat_format": op3_chat_format, "pipeline": pipeline, "op5_warc": op5_warc, "op6_jaccard_join": op6_jaccard_join, "op9_suffix_array": op9_suffix_array, "op10_suffix_automaton": op10_suffix_automaton, "op7_url_filter": op7_url_filter}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op4_decontamination": OP4_SQL, "op5_warc": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op9_suffix_array": REPEATS_SQL, "op10_suffix_automaton": REPEATS_SQL, "op7_url_filter": OP7_SQL}
