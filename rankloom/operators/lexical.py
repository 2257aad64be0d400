"""BM25 over postings stored in blocks of documents.

One exchange of raw text places every document in one shard, where it is
analysed and packed into blocks with bounds (``term_blocks``). A search scans
the blocks in place; only k rows per task and query leave it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Analyzer, label, words
from ..plans.staging import BROADCAST_BYTES, is_small, new_path, staged, text_shards, write_meta
from .ranking import SCORE_PLACES, top_k
from .term_blocks import Part, block_topk, blocks_of_terms, renamed_by_exchange, renamed_terms, rows_of

# The usual defaults of the scoring formula.
K1 = 0.9
B = 0.4

# A term is hot when it holds more than 1/HOT_PARTS of all postings, so there
# are fewer than HOT_PARTS hot terms whatever the corpus.
HOT_PARTS = 1000


def tokens(corpus: DataFrame, analyzer: Analyzer = words) -> DataFrame:
    return corpus.select("doc_id", F.explode(analyzer(F.col("text"))).alias("term"))


def drop_terms(terms: DataFrame, stop_list: DataFrame) -> DataFrame:
    """Anti-join on a stop list; the list is broadcast only while it is small."""
    stops = stop_list.select("term").distinct()
    return terms.join(F.broadcast(stops) if is_small(stops) else stops, "term", "left_anti")


def postings(corpus: DataFrame, analyzer: Analyzer = words, shards: int | None = None) -> DataFrame:
    """``(doc_id, dl, term, tf)``: term counts and document length."""
    shards = text_shards(corpus, shards)
    return (
        corpus.select("doc_id", "text")
        .repartition(shards, "doc_id")
        .select("doc_id", analyzer(F.col("text")).alias("terms"))
        # The length is taken before the array is exploded, so rows do not carry
        # the array; the outer form keeps the optimizer from analysing every
        # text a second time, ahead of the exchange, to find empty ones.
        .select("doc_id", "terms", F.size("terms").cast("long").alias("dl"))
        .select("doc_id", "dl", F.explode_outer("terms").alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("doc_id", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def doc_freq(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(rows: DataFrame) -> DataFrame:
    """One row: documents with at least one term, their mean and total length."""
    return (
        rows.groupBy("doc_id").agg(F.max("dl").alias("dl"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("total"))
    )


def query_terms(queries: DataFrame, analyzer: Analyzer = words) -> DataFrame:
    return (
        queries.select("qid", F.explode(analyzer(F.col("text"))).alias("term"))
        .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    )


def stem_table(terms: DataFrame, stemmer: Callable[[str], str]) -> DataFrame:
    """``(term, stem)`` of the distinct terms; the stemmer sees each of them once, however often it occurs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(list(map(stemmer, batch.column("term").to_pylist())), pa.string())],
                                             names=["term", "stem"])

    return terms.where(F.col("term").isNotNull()).select("term").distinct().mapInArrow(task, "term string, stem string")


def stemmed(rows: DataFrame, stems: DataFrame, count: str) -> DataFrame:
    """``rows`` with ``term`` replaced by its stem; rows that become alike are one, their ``count`` added up.

    The table of stems is broadcast while it is small. Rows without a stem in it go.
    """
    joined = rows.join(F.broadcast(stems) if is_small(stems) else stems, "term")
    others = [c for c in rows.columns if c not in ("term", count)]
    return joined.groupBy(*others, F.col("stem").alias("term")).agg(F.sum(count).alias(count)).select(rows.columns)


def _stemmed_blocks(blocks: DataFrame, stems: DataFrame, shards: int, broadcast_bytes: int | None) -> DataFrame:
    if is_small(stems, broadcast_bytes):
        return renamed_terms(blocks.drop("block"), stems)
    return renamed_by_exchange(blocks, stems, shards)


@dataclass(frozen=True)
class LexicalIndex:
    """Blocks of documents, document frequencies and statistics of a corpus whose ``doc_id`` is a key."""

    blocks: DataFrame
    doc_freq: DataFrame
    n: int
    avgdl: float
    total: int
    analysis: str
    stemmer: Callable[[str], str] | None = None

    _META = "n long, avgdl double, total long, analysis string"

    @property
    def postings(self) -> DataFrame:
        """``(doc_id, dl, term, tf)``, unpacked from the blocks."""
        return rows_of(self.blocks).withColumnRenamed("value", "tf")

    @classmethod
    def build(cls, corpus: DataFrame, path: str | None = None, analyzer: Analyzer = words,
              shards: int | None = None, stemmer: Callable[[str], str] | None = None, broadcast_bytes: int | None = None) -> LexicalIndex:
        """Analyse and store ``corpus(doc_id, text)``. A ``stemmer`` is applied to the distinct terms and its table, kept as
        ``stems``, joined back with the blocks; it is broadcast up to the limit."""
        spark = corpus.sparkSession
        path = path or new_path(spark, "lexical")
        shards = text_shards(corpus, shards)
        analysed = (corpus.select("doc_id", "text").repartition(shards, "doc_id")
                    .select("doc_id", analyzer(F.col("text")).alias("terms")))
        blocks = blocks_of_terms(analysed)
        if stemmer is not None:
            # Stored with their numbers, which a second reading would give out anew.
            blocks = staged(blocks.withColumn("block", F.monotonically_increasing_id()), "plain-blocks", f"{path}/plain")
            stems = staged(stem_table(blocks.select(F.explode("terms").alias("term")), stemmer), "stems", f"{path}/stems")
            blocks = _stemmed_blocks(blocks, stems, shards, broadcast_bytes)
        blocks = staged(blocks, "blocks", f"{path}/blocks")
        # One row for each block and term, not one for each posting.
        counted = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term"))
        frequencies = staged(counted.agg(F.sum("t.sizes").alias("df")), "doc_freq", f"{path}/doc_freq")
        in_block = F.aggregate("lengths", F.lit(0).cast("long"), lambda total, x: total + x)
        stats = blocks.agg(F.coalesce(F.sum(F.size("lengths")), F.lit(0)).alias("n"), F.coalesce(F.sum(in_block), F.lit(0)).alias("total")).first()
        n, total, analysis = stats["n"], stats["total"], _analysis(analyzer, stemmer)
        write_meta(spark, f"{path}/meta", n=n, avgdl=total / n if n else 0.0, total=total, analysis=analysis)
        return cls(blocks, frequencies, n, total / n if n else 0.0, total, analysis, stemmer)

    @classmethod
    def open(cls, spark: SparkSession, path: str, analyzer: Analyzer = words, stemmer: Callable[[str], str] | None = None) -> LexicalIndex:
        """An index stored by ``build`` with the same analysis; another one would ask for terms that are not there."""
        meta = spark.read.schema(cls._META).json(f"{path}/meta").first()
        index = cls(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/doc_freq"), meta["n"], meta["avgdl"], meta["total"],
                    meta["analysis"], stemmer)
        index.check(analyzer)
        return index

    def check(self, analyzer: Analyzer) -> None:
        if _analysis(analyzer, self.stemmer) != self.analysis:
            raise ValueError(f"the index was analysed by {self.analysis!r}, not by {_analysis(analyzer, self.stemmer)!r}")

    def query_terms(self, queries: DataFrame, analyzer: Analyzer = words) -> DataFrame:
        """``(qid, term, qtf)`` analysed as the documents were."""
        self.check(analyzer)
        terms = query_terms(queries, analyzer)
        if self.stemmer is None:
            return terms
        terms = staged(terms, "query-terms")
        return stemmed(terms, staged(stem_table(terms, self.stemmer), "query-stems"), "qtf")


def _analysis(analyzer: Analyzer, stemmer: Callable[[str], str] | None) -> str:
    return label(analyzer) + (f", stems by {label(stemmer)}" if stemmer else "")


def term_matches(rows: DataFrame, query_side: DataFrame, frequencies: DataFrame | None = None,
                 total: int | None = None, small: bool | None = None) -> DataFrame:
    """Equi-join of query terms with postings-like rows on ``term``.

    A query side of checked size is broadcast and the postings stay where they
    are. A larger one is joined by an exchange on the term; hot terms are split
    over salts by document so that no task holds one term's whole list.
    ``small`` is the outcome of the check where the caller has made it already.
    """
    if is_small(query_side) if small is None else small:
        return rows.join(F.broadcast(query_side), "term")
    frequencies = doc_freq(rows) if frequencies is None else frequencies
    total = frequencies.agg(F.sum("df")).first()[0] if total is None else total
    part = max(1, (total or 0) // HOT_PARTS)
    hot = frequencies.where(F.col("df") > part).select(
        "term", F.ceil(F.col("df") / part).cast("int").alias("salts"))
    # At most HOT_PARTS rows by construction.
    hot = F.broadcast(hot)
    spread = (
        rows.join(hot, "term", "left")
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int"))
        .drop("salts")
    )
    copies = (
        query_side.join(hot, "term", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .drop("salts")
    )
    return spread.join(copies, ["term", "salt"]).drop("salt")


def bm25_weights(index: LexicalIndex, terms: DataFrame, small: bool | None = None) -> DataFrame:
    """``(qid, term, weight)``: query count times inverse document frequency."""
    small = is_small(terms) if small is None else small
    df = F.col("df").cast("double")
    idf = F.log(F.lit(1.0) + (F.lit(float(index.n)) - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return index.doc_freq.join(F.broadcast(terms) if small else terms, "term").select(
        "qid", "term", (F.col("qtf").cast("double") * idf).alias("weight"))


def _parts(index: LexicalIndex, k1: float, b: float) -> DataFrame:
    """``(doc_id, term, part)``: the saturated, length-adjusted term count."""
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    length = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / F.lit(float(index.avgdl or 1.0)))
    return index.postings.select("doc_id", "term", (tf / (tf + length)).alias("part"))


def pair_scores(rows: DataFrame, weights: DataFrame, frequencies: DataFrame | None, total: int | None,
                small: bool) -> DataFrame:
    """``(qid, doc_id, score)`` of every pair that shares a term, by join and sum."""
    matched = term_matches(rows, weights, frequencies, total, small)
    return matched.groupBy("qid", "doc_id").agg(
        F.round(F.sum(F.col("weight") * F.col("part")), SCORE_PLACES).alias("score"))


def bm25_scores(index: LexicalIndex, queries: DataFrame, k1: float = K1, b: float = B,
                analyzer: Analyzer = words, broadcast_bytes: int | None = None) -> DataFrame:
    """``(qid, doc_id, score)`` for every document that shares a term with a query."""
    terms = index.query_terms(queries, analyzer)
    # The weights have the rows and width of the terms, so one check serves both.
    small = is_small(terms, broadcast_bytes)
    return pair_scores(_parts(index, k1, b), bm25_weights(index, terms, small), index.doc_freq, index.total, small)


def bm25_candidates(index: LexicalIndex, queries: DataFrame, candidates: DataFrame, k1: float = K1, b: float = B,
                    analyzer: Analyzer = words, broadcast_bytes: int | None = None) -> DataFrame:
    """``(qid, doc_id, score)`` for the pairs of ``candidates(qid, doc_id)`` that share a term.

    Each pair brings its query's terms to the document, so rows grow with the
    candidates and not with queries times documents.
    """
    terms = index.query_terms(queries, analyzer)
    weights = bm25_weights(index, terms, is_small(terms, broadcast_bytes))
    return candidate_parts(candidates, weights, _parts(index, k1, b), broadcast_bytes).groupBy("qid", "doc_id").agg(
        F.round(F.sum(F.col("weight") * F.col("part")), SCORE_PLACES).alias("score"))


def candidate_parts(candidates: DataFrame, weights: DataFrame, parts: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """``(doc_id, term, qid, weight, part)`` of the candidates' shared terms.

    What the candidates ask for is stored once and broadcast while it is small,
    so that the postings of all documents are neither exchanged nor sorted for them.
    """
    asked = staged(candidates.select("qid", "doc_id").distinct().join(weights, "qid"), "asked")
    return (F.broadcast(asked) if is_small(asked, broadcast_bytes) else asked).join(parts, ["doc_id", "term"])


def bm25_topk(index: LexicalIndex, queries: DataFrame, k: int, k1: float = K1, b: float = B,
              analyzer: Analyzer = words, broadcast_bytes: int | None = None, looked_at: Accumulator | None = None,
              skipped: Accumulator | None = None) -> DataFrame:
    """The k best documents of every query. The counters tell how many blocks were scored and passed over."""
    average = float(index.avgdl or 1.0)

    def part(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        tf = values.astype(np.float64)
        return tf / (tf + k1 * (1.0 - b + b * lengths / average))

    return sparse_topk(index.blocks, index.query_terms(queries, analyzer), k, lambda terms, small: bm25_weights(index, terms, small), part,
                       lambda: _parts(index, k1, b), index.doc_freq, index.total, broadcast_bytes, looked_at, skipped)


def sparse_topk(blocks: DataFrame, query_side: DataFrame, k: int, weigh: Callable[[DataFrame, bool], DataFrame], part: Part,
                rows: Callable[[], DataFrame], frequencies: DataFrame | None = None, total: int | None = None,
                broadcast_bytes: int | None = None, looked_at: Accumulator | None = None, skipped: Accumulator | None = None) -> DataFrame:
    """Best documents of all queries by the sum of weight times part over shared terms.

    ``weigh(query rows, small)`` gives ``(qid, term, weight)``, ``rows()`` the
    stored ``(doc_id, term, part)``. A query side over the broadcast limit is
    cut by query into chunks under it; each chunk scans the index once and
    leaves k rows per query, far less than an exchange of every matching pair.
    A single query too large for the limit still goes through the exchange join.
    """
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    # Once on disk: the texts of the queries are analysed a single time.
    stored = staged(query_side, "query-side")

    def search(some: DataFrame, small: bool) -> DataFrame:
        """A run whose score is DOUBLE on every path, as chunks of both go to one table."""
        if small:
            return block_topk(blocks, weigh(some, True), k, part, looked_at, skipped)
        found = top_k(pair_scores(rows(), weigh(some, False), frequencies, total, False), k)
        return found.withColumn("score", F.col("score").cast("double"))

    size = _held_bytes(stored, k)
    if size <= limit or limit <= 0:
        return search(stored, size <= limit)
    # A quarter more chunks than bytes ask for, as hashing is not perfectly even.
    chunks = math.ceil(1.25 * size / limit)
    path = new_path(stored.sparkSession, "chunked-run")
    for i in range(chunks):
        some = stored.where(F.pmod(F.xxhash64("qid"), F.lit(chunks)) == i)
        run = search(some, _held_bytes(some, k) <= limit)
        run.write.mode("append").parquet(path)
    return stored.sparkSession.read.schema(run.schema).parquet(path)


def _held_bytes(query_side: DataFrame, k: int) -> int:
    """What a task holds of a query side: its rows, and 24 bytes for each of k rows per query.

    The second part stays in the task and may be eight times as large.
    """
    width = F.coalesce(F.octet_length("term"), F.lit(0)) + 32
    held, queries = query_side.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)), F.count_distinct("qid")).first()
    return held + 3 * k * queries
