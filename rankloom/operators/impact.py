"""Learned-impact search: a sparse integer dot product over (doc_id, term, weight)."""

from __future__ import annotations

import numpy as np
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import is_small, new_path, staged, text_shards
from .lexical import candidate_parts, pair_scores, sparse_topk
from .term_blocks import block_sums, blocks_of_weights, rows_of

IMPACT_SCHEMA = "doc_id {}, term string, weight int"


def quantize_impacts(weights: DataFrame, scale: float = 100.0) -> DataFrame:
    """Real term weights to integers; weights that round to zero carry no score and go."""
    level = F.round(F.col("weight") * F.lit(float(scale))).cast("int")
    return weights.withColumn("weight", level).where(F.col("weight") != 0)


class ImpactIndex:
    """Impacts of documents: a table ``(doc_id, term, weight)``, the blocks made of it, or both."""

    def __init__(self, impacts: DataFrame | None = None, blocks: DataFrame | None = None):
        self._impacts, self._blocks = impacts, blocks

    @property
    def impacts(self) -> DataFrame:
        if self._impacts is not None:
            return self._impacts
        return rows_of(self._blocks).select("doc_id", "term", F.col("value").cast("int").alias("weight"))

    @property
    def stored(self) -> DataFrame | None:
        """The blocks where they are all there is; a ready-made table may have rows that have no place in a block."""
        return self._blocks if self._impacts is None else None

    @property
    def blocks(self) -> DataFrame:
        """Blocks for the search; those of a ready-made table are stored when they are first asked for."""
        if self._blocks is None:
            self._blocks = ImpactIndex.build(self._impacts)._blocks
        return self._blocks

    @classmethod
    def build(cls, impacts: DataFrame, path: str | None = None, shards: int | None = None) -> ImpactIndex:
        """Store impacts sharded by document, as the search wants them."""
        path = path or new_path(impacts.sparkSession, "impacts")
        sharded = impacts.select("doc_id", "term", "weight").repartition(text_shards(impacts, shards), "doc_id").sortWithinPartitions("doc_id")
        return cls(blocks=staged(blocks_of_weights(sharded), "blocks", f"{path}/blocks"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ImpactIndex:
        """A table stored by ``build``."""
        return cls(blocks=spark.read.parquet(f"{path}/blocks"))

    @classmethod
    def load(cls, spark: SparkSession, path: str, id_type: str = "bigint") -> ImpactIndex:
        """A ready-made impact table in plain parquet, produced elsewhere, whose ids are of ``id_type``."""
        return cls(spark.read.schema(IMPACT_SCHEMA.format(id_type)).parquet(path))


def _parts(index: ImpactIndex) -> DataFrame:
    return index.impacts.select("doc_id", "term", F.col("weight").cast("long").alias("part"))


def _asked(query_impacts: DataFrame) -> DataFrame:
    return query_impacts.select("qid", "term", F.col("weight").cast("long").alias("weight"))


def impact_scores(index: ImpactIndex, query_impacts: DataFrame, total: int | None = None,
                  broadcast_bytes: int | None = None) -> DataFrame:
    """``(qid, doc_id, score)`` with an exact LONG score."""
    asked = _asked(query_impacts)
    small = is_small(asked, broadcast_bytes)
    if small and index.stored is not None:
        held = asked.toArrow()
        if not held.column("weight").null_count:
            return block_sums(index.stored, held, asked.schema["qid"].dataType)
    return pair_scores(_parts(index), asked, None, total, small)


def impact_candidates(index: ImpactIndex, query_impacts: DataFrame, candidates: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """``(qid, doc_id, score)`` for the pairs of ``candidates(qid, doc_id)`` that share a term.

    Each pair brings its query's terms to the document, so rows grow with the
    candidates and not with queries times documents.
    """
    parts = candidate_parts(candidates, _asked(query_impacts), _parts(index), broadcast_bytes)
    return parts.groupBy("qid", "doc_id").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))


def _whole(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return values.astype(np.float64)


def impact_topk(index: ImpactIndex, query_impacts: DataFrame, k: int, total: int | None = None,
                broadcast_bytes: int | None = None, looked_at: Accumulator | None = None, skipped: Accumulator | None = None) -> DataFrame:
    """Sums of integer products of either sign, exact in the double the blocks use; any shared term makes a hit."""
    run = sparse_topk(index.blocks, _asked(query_impacts), k, lambda asked, small: asked, _whole, lambda: _parts(index), None, total,
                      broadcast_bytes, looked_at, skipped)
    return run.withColumn("score", F.col("score").cast("long"))
