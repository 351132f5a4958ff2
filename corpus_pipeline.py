"""A corpus pipeline from the operators of the training-data subpackage.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir)
and returns a DataFrame, which run() writes as Parquet and reads again for the
next.  All stages but the last return the columns of `documents`; the last adds
the epoch in which a document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoframe.llm import decontaminate, id_filter, jaccard_join, mixing, span_dedup, toxicity
from cartoframe.runtime import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.is_held_out())
    model = toxicity.fit(docs, labels)
    return toxicity.score_toxicity(docs, model, 0.3).where("predicted = 0").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles and a similarity of 0.8, the one of least doc_id stays."""
    groups = jaccard_join.ngram_jaccard_components(docs, 5, 80, 100)
    gone = Scratch(spark, "copies").table(groups.where("component_id <> doc_id").select("doc_id").distinct())
    maybe, kept = id_filter.split(docs, "doc_id", id_filter.build(gone))
    return kept.unionByName(maybe.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns))


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of sentences leave the texts; texts that nothing is left of go."""
    kept = span_dedup.remove_repeated_spans(docs, tails=True).where("n_removed = 0 or length(trim(text)) > 0")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold windows of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10, "documents")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by target weights: rare sources in several epochs, the abundant ones in part."""
    placed = docs.withColumn("domain", mixing.domain_of(F.col("source")))
    taken = mixing.mix(placed, F.expr("coalesce(sum(supply), 0)"), max_epochs=4, carry=tuple(docs.columns))
    return taken.select(*docs.columns, "domain", "epoch", "n_tokens")


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", repeated_spans),
    ("benchmark_decontamination", benchmark_leaks),
    ("mixing", mixture),
]

#: Learned scores and global first occurrences of variable runs are not expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return docs
