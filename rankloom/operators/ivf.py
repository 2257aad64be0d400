"""Approximate search by probing cells of an inverted file.

Vectors are assigned to the nearest of ``nlist`` centres and stored partitioned
by cell; a query scores only the vectors in its ``nprobe`` nearest cells. More
probes mean more effort and recall; ``nprobe = nlist`` equals exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import new_path, write_meta
from . import dense
from .dense import list_matrix
from .quantize import (
    Int8Codec, PqCodec, codec_of, codec_state, coded_search, lloyd, read_matrices, seed_vectors, squared_distances, write_matrices,
)

ROUNDS = 2
# Share of the cells probed where nothing else is asked for. The given vectors, which have little structure,
# then have nine tenths of their neighbours found; vectors in clusters need far less.
EFFORT = 0.7


def suggested_cells(vectors: int) -> int:
    """As many cells as they hold vectors on average."""
    return max(1, math.isqrt(max(vectors - 1, 0)) + 1)


def suggested_probes(cells: int) -> int:
    return max(1, math.ceil(EFFORT * cells))


def train_cells(vectors: DataFrame, nlist: int, rounds: int = ROUNDS, trial: int = 0) -> np.ndarray:
    """Centres (nlist, dim), or as many as there are vectors; every trial starts from a set of its own."""
    seeds = seed_vectors(vectors, nlist, trial)
    return lloyd(vectors, seeds[None, :, :], rounds)[0]


def nearest_cells(vectors: DataFrame, centres: np.ndarray, probes: int, column: str = "cells") -> DataFrame:
    """Add the ids of the ``probes`` nearest centres, nearest first."""
    schema = T.StructType([*vectors.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))])
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    names = [*vectors.columns, column]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = min(probes, len(shared.value))
        step = max(1, 4_000_000 // len(shared.value))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                distance = squared_distances(list_matrix(batch.column("vector")), shared.value)
                if near == 1:
                    chosen = distance.argmin(1)[:, None]
                else:
                    chosen = np.argsort(distance, axis=1, kind="stable")[:, :near]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(chosen) + 1, dtype=np.int32) * near),
                    pa.array(chosen.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=names)

    return vectors.where(F.col("vector").isNotNull()).mapInArrow(task, schema)


def assign_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    nearest = nearest_cells(vectors, centres, 1)
    return nearest.withColumn("cell", F.element_at("cells", 1)).drop("cells")


@dataclass(frozen=True)
class CellIndex:
    """Vectors or codes stored by cell, with the centres and the codec to read them."""

    rows: DataFrame
    centres: np.ndarray
    payload: str = "vector"
    codec: Int8Codec | PqCodec | None = None

    @classmethod
    def build(cls, vectors: DataFrame, nlist: int | None = None, rounds: int = ROUNDS, trial: int = 0,
              codec: Int8Codec | PqCodec | None = None, path: str | None = None) -> CellIndex:
        """``nlist`` cells, by default the square root of the number of vectors. For more than some ten thousand see ``two_level``."""
        spark = vectors.sparkSession
        path = path or new_path(spark, "cells")
        vectors = vectors.select("doc_id", "vector")
        nlist = nlist or suggested_cells(vectors.count())
        centres = train_cells(vectors, nlist, rounds, trial)
        rows = assign_cells(vectors, centres)
        payload = "vector"
        if codec is not None:
            rows, payload = codec.encode(rows), "codes"
        # Rebalancing brings a cell's rows together and splits a large cell into
        # several files, so neither many tiny files nor one huge task arises.
        rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        kind, state = codec_state(codec)
        write_matrices(spark, {"centres": centres, **state}, f"{path}/matrices")
        write_meta(spark, f"{path}/meta", schema=ddl, payload=payload, codec=kind)
        return cls(spark.read.schema(rows.schema).parquet(f"{path}/rows"), centres, payload, codec)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        """An index stored by ``build``, with its centres and codec."""
        meta = spark.read.schema("schema string, payload string, codec string").json(f"{path}/meta").first()
        found = read_matrices(spark, f"{path}/matrices")
        return cls(spark.read.schema(meta["schema"]).parquet(f"{path}/rows"), found["centres"], meta["payload"], codec_of(meta["codec"], found))

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, vectors: DataFrame | None = None, factor: int = 1, **options) -> DataFrame:
        """The k best in the ``nprobe`` nearest cells (``EFFORT`` of all by default); with ``vectors`` the k best of ``factor`` times as many by their exact scores."""
        asked = nearest_cells(queries.select("qid", "vector"), self.centres, nprobe or suggested_probes(len(self.centres)))
        found = coded_search(asked, self.rows, k if vectors is None else k * factor, self.codec, **options)
        return found if vectors is None else dense.rerank(found, queries, vectors, k)
