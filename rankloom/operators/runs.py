"""Shaping of hit lists into the run table ``(qid, doc_id, score, rank)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import is_small
from .ranking import ranked

RUN_COLUMNS = ("qid", "doc_id", "score", "rank")


def real_hits(hits: DataFrame, idx: str = "idx") -> DataFrame:
    """Row number -1 marks an empty slot of a fixed-length hit list."""
    return hits.where(F.col(idx) >= 0)


def hits_to_run(hit_lists: DataFrame, ids: DataFrame) -> DataFrame:
    """``(qid, hits ARRAY<STRUCT<idx, score>>)`` and ``(idx, doc_id)`` to a run.

    Position in the array is the hit's place in the list.
    """
    flat = hit_lists.select("qid", F.posexplode("hits").alias("pos", "hit")).select(
        "qid", "pos", F.col("hit.idx").alias("idx"), F.col("hit.score").cast("double").alias("score"))
    kept = real_hits(flat)
    named = kept.join(F.broadcast(ids) if is_small(ids) else ids, "idx")
    return ranked(dedupe_hits(named))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """One score per (query, document): the one at the last position wins."""
    return hits.groupBy("qid", "doc_id").agg(F.max_by("score", "pos").alias("score"))


def differs_from_query(run: DataFrame) -> Column:
    """True where the document is not the query itself; ids of unlike types meet as text."""
    qid, doc_id = F.col("qid"), F.col("doc_id")
    if run.schema["qid"].dataType != run.schema["doc_id"].dataType:
        qid, doc_id = qid.cast("string"), doc_id.cast("string")
    return qid != doc_id


def drop_identical(run: DataFrame) -> DataFrame:
    """Leave out a document that carries the query's own id; ranks close up."""
    return ranked(run.where(differs_from_query(run)).select("qid", "doc_id", "score"))


def union_runs(*runs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), runs)
