"""The retrieval tables made from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.lexical import query_terms, term_matches, tokens
from ..plans.staging import is_small, staged
from ..sources.benchmark_files import Dataset


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, title, text)``; one source counts as having no title."""
    title = F.when(F.col("source") != "src0", F.col("source"))
    return table(spark, folder, "documents").select("doc_id", title.alias("title"), "text")


def plain_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).withColumnRenamed("doc_id", "qid")


def _phrase(text):
    """Terms in order between single blanks, with a blank at both ends."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def qrels(spark: SparkSession, folder: str) -> DataFrame:
    """``(qid, doc_id, rel)``: documents that hold the query passage term by term.

    The longest term of each passage finds the candidates by an equi-join; only
    those are compared as text. rel is 1 plus the quality label.
    """
    docs, asked = plain_corpus(spark, folder), queries(spark, folder)
    anchors = query_terms(asked).groupBy("qid").agg(F.max_by("term", F.struct(F.length("term"), "term")).alias("term"))
    pairs = staged(term_matches(tokens(docs), anchors).select("qid", "doc_id").distinct(), "pairs")
    phrases = asked.select("qid", _phrase(F.col("text")).alias("passage"))
    passages = pairs.join(phrases, "qid")
    passages = F.broadcast(passages) if is_small(passages) else passages
    found = docs.join(passages, "doc_id").where(F.contains(_phrase(F.col("text")), F.col("passage")))
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return found.select("qid", "doc_id").join(labels, "doc_id", "left").select(
        "qid", "doc_id", (F.lit(1) + F.coalesce("quality", F.lit(0))).cast("int").alias("rel"))


def datasets(spark: SparkSession, folder: str) -> dict[str, Dataset]:
    """The documents without and with titles, on the same stored judgements."""
    asked, judged = queries(spark, folder), staged(qrels(spark, folder), "qrels")
    return {"plain": Dataset("plain", plain_corpus(spark, folder), asked, judged),
            "titled": Dataset("titled", corpus(spark, folder), asked, judged)}
