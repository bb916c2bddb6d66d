"""Documents to packed training sequences, in five stages of the subpackage llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import contamination, line_runs, near_copies, packing, scratch, toxicity
from quire.llm.registry import load


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by what the labelled documents among them teach."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its repeated lines taken out; ``n_chars`` follows the text."""
    kept = line_runs.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id, by the operator of op1 as it stands there.

    Of several rows of one doc_id the smallest by text, source and language stays; texts are shuffled for those only.
    Rows without a doc_id take no part and stay.
    """
    first = near_copies.near_copies(docs).where("doc_id = component_id").groupBy("doc_id").count()
    first = scratch.settle(first, "first")
    rest = [c for c in ("text", "source", "lang", "n_chars") if c in docs.columns]
    rest += [c for c in docs.columns if c not in (*rest, "doc_id")]
    alone = docs.join(first.where("count = 1"), "doc_id", "left_semi").select(*docs.columns)
    repeated = docs.join(first.where("count > 1"), "doc_id", "left_semi")
    repeated = repeated.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("__row")).select("doc_id", "__row.*")
    return alone.unionByName(repeated).union(docs.where(F.col("doc_id").isNull()))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = contamination.contaminated(docs, load(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
ORACLE_SQL = None  # fingerprints, models and tokenizers are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.settle(stage(spark, docs, sf_dir), name)
    return docs
