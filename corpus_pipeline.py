"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.llm import boilerplate, decontaminate, jaccard, packing
from tastemap.llm.common import keep, set_aside
from tastemap.llm.queries import GOOD, quality
from tastemap.llm.tokens import public_path
from tastemap.sources import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    renamed, names = set_aside(docs, "score")
    good = quality(spark, renamed, sf_dir).where(F.col("score") >= GOOD).drop("score")
    return good.withColumnsRenamed(names).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that are boilerplate of their source."""
    renamed, names = set_aside(docs, "n_lines", "n_dropped")
    kept = boilerplate.drop_boilerplate(renamed, text="text", host="source")
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    kept = kept.withColumn("n_chars", n_chars.cast("bigint")).drop("n_lines", "n_dropped")
    return kept.withColumnsRenamed(names).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.representatives(docs, size=5, percent=75)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_path("word_bpe_49k.json"), end=0, size=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL expresses neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
