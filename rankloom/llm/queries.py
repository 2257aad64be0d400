"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.decontamination import contamination, contamination_digest
from rankloom.llm.gnat import hard_negatives, quantised
from rankloom.llm.hilbert import shards
from rankloom.llm.hnsw import search_every
from rankloom.llm.language_id import identify
from rankloom.llm.oracle import SQL  # noqa: F401
from rankloom.llm.periodic_runs import digest, periodic_runs, with_loops
from rankloom.llm.pieces import encode_decode
from rankloom.llm.quality import fit, grades, kept, score
from rankloom.llm.quotes import conversations
from rankloom.llm.simhash import near_duplicates
from rankloom.llm.substrings import dedup
from rankloom.llm.suffix_arrays import dedup_bytes
from rankloom.llm.url_cascade import filter_urls


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from four fifths of them."""
    return identify(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document and the chance of the best one, learnt from the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, grades(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", "expected_grade", "tail_probability", kept().alias("kept"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: three-word shingles, links at 3 bits or fewer."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether decoding gives the text again."""
    return encode_decode(table(spark, sf_dir, "documents"), MODEL)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of ten consecutive benchmark words."""
    return contamination_digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quotes, replies after what they quote."""
    return conversations(table(spark, sf_dir, "conversations"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 20-word passages that occur earlier."""
    return dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op8_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by rules, else by an exact cascade of Bloom filters over hosts."""
    return filter_urls(table(spark, sf_dir, "pages"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all other vectors for every vector whose id is divisible by 100."""
    return search_every(table(spark, sf_dir, "embeddings"))


def op10_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal counts along a Hilbert curve through language, source and length."""
    return shards(table(spark, sf_dir, "documents"), 24)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels nearly as close as the positives, for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"))
    return hard_negatives(quantised(vectors))


def op12_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 100-byte strings that start earlier."""
    return dedup_bytes(table(spark, sf_dir, "documents"), keep_text=False)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, a tenth of which are made to go on in loops."""
    return digest(periodic_runs(with_loops(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality, op3_simhash, op4_pieces, op5_decontamination, op6_quotes,
                                    op7_substrings, op8_url_cascade, op9_hnsw, op10_hilbert, op11_hard_negatives, op12_suffix_arrays, op13_periodic_runs)}

