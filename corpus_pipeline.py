"""A corpus pipeline: toxic documents go, one document of each near-duplicate
group stays, repeated passages are cut, contaminated documents go, the rest is
encoded. Every stage reads what its predecessor wrote as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import bpe, decontam, jaccard, sparse_sa, toxicity
from sparkvane.llm._store import drop_path, new_path, scratch
from sparkvane.llm.queries import fold, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a model fitted on labelled documents outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id") != 0)
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, "__toxic").where("__toxic < 0.5").drop("__toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.representatives(docs, 5, 80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut out; a
    document of which nothing is left goes. n_chars follows the text."""
    out = sparse_sa.dedup(docs, spacing="original").where("__n_removed = 0 or __n_removed < __n_words")
    cols = [F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the bytes decoded from them."""
    enc = bpe.encode(docs.select("doc_id", "text"))
    enc = enc.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text(), 256).alias("ids_sha256"))
    out = bpe.decode(enc.withColumn("all_ids", F.col("ids")), ids="all_ids", keep=("doc_id", "ids", "n_tokens", "ids_sha256"))
    return out.select("doc_id", "ids", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", tokenise),
]

#: Training a model and BPE have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. A stage's scratch tables are deleted once its
    result is written, and that result once the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
