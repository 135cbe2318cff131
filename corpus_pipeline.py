"""From raw documents to a training mix: quality, lines, near duplicates, benchmarks, source weights.

Each stage takes what its predecessor kept, as Parquet, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.llm import decontaminate, line_dedup, mixing, near_duplicates, quality
from alertmill.llm.common import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good_ones(docs, model, least=quality.KEEP)


def single_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of similar lines stays; texts shrink, documents stay, ``n_chars`` follows. Other columns, whatever their names, go along."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*(rest or [F.lit(1).alias("none")])).alias("carried")), carry=["carried"])
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[(new[c] if c in new else F.col("carried").getField(c)).alias(c) for c in docs.columns])


def single_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_duplicates.one_of_each(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    hits = decontaminate.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stage(hits.select(F.col("doc_id").alias("gone")).distinct(), "leaks")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", good_documents),
    ("lines", single_lines),
    ("near_duplicates", single_documents),
    ("decontamination", clean_documents),
    ("mixing", source_mix),
]

#: The first stage fits models, so no SQL gives the rows; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
