"""The common benchmark folder: corpus.jsonl, queries.jsonl, qrels/<split>.tsv.

Each of the three may be one file or a folder of part files, so a corpus of any
size is read in parallel. Schemas are given, nothing is inferred.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contents
from ..plans.staging import staged

# Field names and header of the layout.
CORPUS_SCHEMA = "_id string, title string, text string"
QUERIES_SCHEMA = "_id string, text string"
QRELS_SCHEMA = "`query-id` string, `corpus-id` string, score int"


@dataclass(frozen=True)
class Dataset:
    """``corpus(doc_id, [title], text)``, ``queries(qid, text)``, ``qrels(qid, doc_id, rel)``."""

    name: str
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame
    # Documents and queries, where they have been counted.
    sizes: tuple[int, int] | None = None

    def stored(self) -> Dataset:
        """The same tables written once as parquet, so that JSON is parsed a single time.

        Rows are counted while they are written, as observed metrics of these jobs.
        """
        counts = [Observation(), Observation()]
        corpus, queries = (staged(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
                           for df, seen, name in zip((self.corpus, self.queries), counts, ("corpus", "queries")))
        sizes = tuple(seen.get["n"] for seen in counts)
        return Dataset(self.name, corpus, queries, staged(self.qrels, "qrels"), sizes)

    def counted(self) -> tuple[int, int]:
        return self.sizes or (self.corpus.count(), self.queries.count())


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(CORPUS_SCHEMA).json(f"{folder}/corpus.jsonl")
    return rows.select(F.col("_id").alias("doc_id"), "title", "text")


def read_queries(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(QUERIES_SCHEMA).json(f"{folder}/queries.jsonl")
    return rows.select(F.col("_id").alias("qid"), "text")


def read_qrels(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    rows = spark.read.schema(QRELS_SCHEMA).csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True)
    return rows.select(F.col("query-id").alias("qid"), F.col("corpus-id").alias("doc_id"),
                       F.col("score").alias("rel"))


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Only queries that have at least one judgement."""
    return queries.join(qrels.select("qid"), "qid", "left_semi")


def read_dataset(spark: SparkSession, folder: str, name: str | None = None, split: str = "test") -> Dataset:
    qrels = read_qrels(spark, folder, split)
    return Dataset(name or folder.rstrip("/").rsplit("/", 1)[-1], read_corpus(spark, folder),
                   judged_queries(read_queries(spark, folder), qrels), qrels)


def write_corpus(corpus: DataFrame, folder: str) -> None:
    corpus.select(F.col("doc_id").cast("string").alias("_id"), "title", "text").write.json(f"{folder}/corpus.jsonl")


def write_queries(queries: DataFrame, folder: str) -> None:
    queries.select(F.col("qid").cast("string").alias("_id"), "text").write.json(f"{folder}/queries.jsonl")


def write_qrels(qrels: DataFrame, folder: str, split: str = "test") -> None:
    rows = qrels.select(F.col("qid").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("rel").alias("score"))
    rows.write.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True)


def write_contents(corpus: DataFrame, path: str) -> None:
    """JSON lines ``{id, contents}``."""
    corpus.select(F.col("doc_id").alias("id"), contents().alias("contents")).write.json(path)


def read_contents(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    rows = spark.read.schema(f"id {id_type}, contents string").json(path)
    return rows.select(F.col("id").alias("doc_id"), "contents")
