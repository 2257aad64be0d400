"""From raw documents to token pieces: five stages, each stored before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import decontamination, pieces, quality, simhash, substrings
from rankloom.llm.common import saved
from rankloom.llm.queries import MODEL, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the best grade reaches the cut that costs 1 % of good ones.

    Texts that are null or have no words go, also where there are no ratings
    and all others stay.
    """
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, quality.grades(table(spark, sf_dir, "labels")))
    has_words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    return quality.score(docs.where(has_words), model).where(quality.kept()).select(*COLUMNS)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of op3's contract connect (three words, 3 bits): the one with the smallest id.

    Of the rows without an id one of each group stays beside it. Rows that
    repeat an id are told apart, so those that are no near duplicates stay.
    """
    rows = saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows", compression="zstd")
    groups = simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    named = groups.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    first = named.groupBy("component_id", F.isnull("doc_id")).agg(F.min(F.struct("doc_id", "row")).alias("first"))
    # The same plan at every size.
    kept = saved(first.select("first.row"), "kept-rows").hint("merge")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without 20-word passages that occur earlier; ``n_chars`` counts what is left.

    Null and empty texts stay as they are, and so do rows that repeat; a text
    of which nothing is left stays as an empty one. Of copies of a passage the
    one at the smallest id stays, rows without an id coming first.
    """
    left = substrings.dedup(docs, carry=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without ten consecutive words of a benchmark item, told by their texts, whatever their ids."""
    keyed = docs.select(*COLUMNS, F.sha2("text", 256).alias("text_key"))
    found = decontamination.contamination(keyed.select(F.col("text_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = saved(found.where("n_hit > 0").select(F.col("doc_id").alias("text_key")).distinct(), "leaks")
    return keyed.join(leaks, "text_key", "left_anti").select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document: null for a null text, none for an empty one; repeated rows stay."""
    return pieces.encode_decode(docs, MODEL)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_first),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", keep_clean),
    ("SentencePiece encoding", to_pieces),
]

# Fitted weights and hashes have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
