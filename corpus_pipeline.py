"""Corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet and reads it again for the next. All stages but the last return
the columns of ``documents``. Near duplicates are judged on shingles of five words at
a similarity of 0.8; of each group the smallest doc_id stays.

A row's identity is its doc_id and text: repeated rows pass or fail together until the
near-duplicate stage, which keeps one of them. Different texts of one doc_id are one document
there, which stays or goes whole; rows with a null doc_id pass that stage. Null and empty
texts fail the quality rules, and very long ones are judged whole. Extra columns of
``documents`` are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orogen.llm import line_dedup, mixing, ngram_join, packing, quality
from orogen.llm.kit import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    tied = docs.select(*COLUMNS, F.xxhash64("text").alias("tie"))
    kept = quality.quality_rules(tied).filter("kept").select(F.col("doc.doc_id").alias("kept_id"), F.col("doc.tie").alias("kept_tie"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("tie") == F.col("kept_tie"))
    return tied.join(kept, same, "left_semi").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go."""
    out = line_dedup.drop_frequent_lines(docs.select(*COLUMNS), least=10)
    return out.select("doc.doc_id", F.col("kept").alias("text"), "doc.lang", "doc.source", F.length("kept").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    groups = ngram_join.similarity_components(docs, k=5, num=8, den=10)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    same = Window.partitionBy("doc_id", F.xxhash64("text"), F.length("text"))
    one = F.row_number().over(same.orderBy("lang", "source", "n_chars"))
    kept = docs.select(*COLUMNS).join(first, "doc_id", "left_semi").withColumn("one", one).filter("one = 1")
    return kept.select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities calibrated to source, language and topic targets."""
    return mixing.mix_sources(docs.select(*COLUMNS)).filter("kept").select(*(f"doc.{c}" for c in COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in as few sequences as best fit finds."""
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Token ids come from a tokenizer, which SQL cannot express; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.save(docs, f"stage-{k}")
    return docs
