"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.llm import balltree, jaccard, katz, licenses, nbsvm, segments, stringkernel
from tastemap.llm.boilerplate import PAGES_SQL, drop_boilerplate, page_lines
from tastemap.llm.common import crc_fold
from tastemap.llm.decontaminate import report
from tastemap.llm.packing import pack
from tastemap.llm.phrases import PHRASES_SQL, collocations
from tastemap.llm.simple8b import token_files
from tastemap.llm.tokens import public_path
from tastemap.llm.whitening import whiten
from tastemap.sources import table


def op1_katz(spark: SparkSession, directory: str) -> DataFrame:
    return katz.score(table(spark, directory, "documents"), crc_fold("doc_id", 10) == 0)


def op2_simple8b(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return token_files(documents, public_path("byte_bpe_50k.json"), end=0)


def op3_jaccard(spark: SparkSession, directory: str) -> DataFrame:
    return jaccard.join(table(spark, directory, "documents"), size=5, percent=75)


def op4_edit_counts(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return segments.counts(documents, public_path("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return pack(documents, public_path("word_bpe_49k.json"), end=0, size=2048)


def op6_licenses(spark: SparkSession, directory: str) -> DataFrame:
    return licenses.scan(table(spark, directory, "documents"))


def op7_boilerplate(spark: SparkSession, directory: str) -> DataFrame:
    lines = page_lines(table(spark, directory, "pages"))
    return drop_boilerplate(lines, text="text", host="host")


def op8_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    return report(table(spark, directory, "documents"), table(spark, directory, "benchmark"), 10)


#: Score from which a document counts as good.
GOOD = 0.7


def quality(spark: SparkSession, documents: DataFrame, directory: str) -> DataFrame:
    """``documents`` with their score, by a model that saw no held-out label."""
    labels = table(spark, directory, "labels")
    held_out = crc_fold("doc_id", 4) == 2
    model = nbsvm.train(nbsvm.labelled_sample(documents, labels, held_out))
    return nbsvm.score(documents, model)


def op9_quality(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").select("doc_id", "text")
    return quality(spark, documents, directory).select(
        "doc_id",
        (crc_fold("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


def op10_balltree(spark: SparkSession, directory: str) -> DataFrame:
    vectors = balltree.quantised(table(spark, directory, "embeddings"), "vec_id", "embedding", 256)
    found = balltree.top_k(vectors, vectors.where("id % 50 = 0"), k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: Score from which a document counts as toxic.
TOXIC = 0.5


def op11_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents").select("doc_id", "text")
    labels = table(spark, directory, "labels").select("doc_id", F.col("toxic").alias("quality"))
    held_out = crc_fold("doc_id", 5) == 0
    model = stringkernel.train(nbsvm.labelled_sample(documents, labels, held_out))
    return stringkernel.score(documents, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def op12_phrases(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return collocations(documents, support=10, longest=3, top=2000, covered=50)


def op13_whitening(spark: SparkSession, directory: str) -> DataFrame:
    return whiten(table(spark, directory, "embeddings"), "vec_id", "embedding", k=16, scale=64, shift=1_000_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz": op1_katz,
    "op2_simple8b": op2_simple8b,
    "op3_jaccard": op3_jaccard,
    "op4_edit_counts": op4_edit_counts,
    "op5_packing": op5_packing,
    "op6_licenses": op6_licenses,
    "op7_boilerplate": op7_boilerplate,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_balltree": op10_balltree,
    "op11_toxicity": op11_toxicity,
    "op12_phrases": op12_phrases,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op7_boilerplate": PAGES_SQL,
    "op10_balltree": """
        WITH vectors AS (
            SELECT vec_id,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), queries AS (
            SELECT vec_id, min(v) AS v FROM vectors WHERE vec_id % 50 = 0 GROUP BY vec_id
        ), ranked AS (
            SELECT q.vec_id AS query_id, r.vec_id,
                   CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score,
                   CAST(row_number() OVER (PARTITION BY q.vec_id
                        ORDER BY list_dot_product(q.v, r.v) DESC, r.vec_id) AS INTEGER) AS rank
            FROM queries q JOIN vectors r ON q.vec_id <> r.vec_id
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op12_phrases": PHRASES_SQL,
}
