"""Exact search over vectors stored in balls, most of which a query need not open.

Vectors near each other are stored in one row with their centre and the
greatest distance from it. No vector of such a ball has a greater inner product
with a query q than q . centre + |q| * radius, so a task passes over a ball
whose bound is below the k-th best score it has seen, for each query by itself.
What is left is scored in full: the run is that of ``dense.search``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.memory import give_back
from ..plans.staging import new_path, shard_count, staged
from . import dense
from .dense import BestRows, _score_block, id_array, in_chunks, list_matrix, packed_arrow
from .ivf import assign_cells
from .quantize import seed_vectors
from .ranking import SCORE_PLACES, packed_rows, packed_schema

# Vectors of a ball, and seeds that say which ones are near each other.
BALL_ROWS, SEEDS = 128, 64
# What a rounded score and a computed bound may differ by.
SLACK = 2 * 10.0 ** -SCORE_PLACES


@dataclass(frozen=True)
class BallIndex:
    balls: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, seeds: int = SEEDS, ball_rows: int = BALL_ROWS, shards: int | None = None) -> BallIndex:
        """Store ``vectors(doc_id, vector)``; rows without an id or a vector are left out."""
        path = path or new_path(vectors.sparkSession, "balls")
        rows = vectors.where(F.col("vector").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "vector")
        placed = assign_cells(rows, seed_vectors(rows, seeds))
        # By range of cell and hash: a cell that holds a third of the rows is cut.
        sorted_rows = placed.repartitionByRange(shard_count(vectors, shards), "cell", F.xxhash64("doc_id")).sortWithinPartitions("cell")
        kind = T.StructType([T.StructField("doc_ids", T.ArrayType(vectors.schema["doc_id"].dataType)),
                             *T.StructType.fromDDL("vectors binary, centre binary, radius double").fields])
        return cls(staged(sorted_rows.mapInArrow(_packing(ball_rows), kind), "balls", path))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BallIndex:
        return cls(spark.read.parquet(path))

    def search(self, queries: DataFrame, k: int, skip_identical: bool = False, looked_at: Accumulator | None = None,
               skipped: Accumulator | None = None, **options) -> DataFrame:
        """``run(qid, doc_id, score, rank)``, exact. The counters tell how many pairs of a query and a ball were scored and passed over."""
        out = packed_schema(queries.schema["qid"].dataType, self.balls.schema["doc_ids"].dataType.elementType)

        def scan(part: DataFrame) -> DataFrame:
            table = part.toArrow()
            shared = part.sparkSession.sparkContext.broadcast((id_array(table.column("qid")), list_matrix(table.column("vector"))))
            return self.balls.mapInArrow(_scan(shared, k, skip_identical, packed_arrow(out), looked_at, skipped), out)

        return in_chunks(queries.select("qid", "vector"), k, scan, **options)


def _packing(ball_rows: int):
    def ball(ids: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        centre = vectors.mean(axis=0)
        radius = float(np.sqrt(((vectors - centre) ** 2).sum(axis=1).max()))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([vectors.tobytes()], pa.binary()),
                                           pa.array([centre.tobytes()], pa.binary()), pa.array([radius])], names=["doc_ids", "vectors", "centre", "radius"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 20 * ball_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            whole = size // ball_rows * ball_rows
            for at in range(0, whole, ball_rows):
                part = table.slice(at, ball_rows)
                yield ball(part.column("doc_id").combine_chunks(), list_matrix(part.column("vector")))
            held, size = table.slice(whole).to_batches(), size - whole
        table = pa.Table.from_batches(held) if held else None
        for at in range(0, size, ball_rows):
            part = table.slice(at, ball_rows)
            yield ball(part.column("doc_id").combine_chunks(), list_matrix(part.column("vector")))

    return task


def _scan(shared, k: int, skip_identical: bool, schema: pa.Schema, looked_at, skipped):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries = shared.value
        best = BestRows(len(qids), k)
        length = np.sqrt((queries * queries).sum(axis=1))
        seen = passed = 0
        for whole in batches:
            # Bounds of all queries, for as many balls as the buffer has room for.
            room = max(1, dense.SCORE_BUFFER // max(1, len(qids)))
            for batch in (whole.slice(start, room) for start in range(0, whole.num_rows, room)):
                centres = np.stack([np.frombuffer(c) for c in batch.column("centre").to_pylist()])
                radius = batch.column("radius").to_numpy()
                bounds = queries @ centres.T + length[:, None] * radius if len(qids) else np.empty((0, batch.num_rows))
                # The most promising balls first, so that the floors rise early.
                for at in np.argsort(-bounds.sum(axis=0), kind="stable").tolist():
                    active = np.flatnonzero(bounds[:, at] + SLACK >= best.floor)
                    seen, passed = seen + len(active), passed + len(qids) - len(active)
                    if not len(active):
                        continue
                    ids = id_array(batch.column("doc_ids")[at].values)
                    vectors = np.frombuffer(batch.column("vectors")[at].as_buffer()).reshape(len(ids), -1)
                    _score_block(best, active, qids, ids, lambda part, rows: queries[part] @ vectors[rows].T, slice(None), skip_identical)
                    if best.pending > best.kept + 4 * k * len(qids):
                        best.merge()
        if looked_at is not None:
            looked_at.add(seen)
        if skipped is not None:
            skipped.add(passed)
        best.merge()
        for q, s, d in best.parts:
            yield from packed_rows(q, s, d, qids, schema)
        give_back()

    return task
