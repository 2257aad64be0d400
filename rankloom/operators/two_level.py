"""Cells in two levels: coarse centres, and fine centres of their own inside each coarse cell.

Only the coarse centres pass through the driver. The fine ones are trained
cell by cell on a bounded sample and stay in a table, one row a coarse cell;
rows and queries meet the centres of their coarse cell in a shuffle. The
number of cells is therefore not limited by what fits one process. A query
probes the nearest fine cells inside its nearest coarse cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import new_path, staged, write_meta
from . import dense
from .dense import list_matrix
from .ivf import assign_cells, nearest_cells, train_cells
from .quantize import (
    CENTROID_PLACES, Int8Codec, PqCodec, codec_of, codec_state, coded_search, read_matrices, squared_distances, write_matrices,
)

# Sampled vectors for each fine centre, and vectors of a coarse cell that one task assigns.
SAMPLE_A_CENTRE = 64
ROWS_A_TASK = 500_000


@dataclass(frozen=True)
class TwoLevelCells:
    """Vectors or codes with the cell they are in, and the centres of both levels."""

    rows: DataFrame
    coarse: np.ndarray
    fine: DataFrame
    width: int
    codec: Int8Codec | PqCodec | None = None

    @classmethod
    def build(cls, vectors: DataFrame, coarse: int, fine: int, rounds: int = 2, trial: int = 0, codec: Int8Codec | PqCodec | None = None,
              path: str | None = None, sample: int = SAMPLE_A_CENTRE, rows_a_task: int = ROWS_A_TASK) -> TwoLevelCells:
        """``coarse`` times ``fine`` cells for ``vectors(doc_id, vector)``; coarse cells with fewer vectors have fewer fine ones.

        Coarse centres are trained on all vectors, fine ones on the ``sample``
        times ``fine`` vectors of their coarse cell that a hash puts first; every
        vector is placed. Every ``trial`` starts from seeds of its own.
        """
        spark = vectors.sparkSession
        path = path or new_path(spark, "two-level")
        centres = train_cells(vectors.select("doc_id", "vector"), coarse, rounds, trial)
        placed = staged(assign_cells(vectors.select("doc_id", "vector"), centres).withColumnRenamed("cell", "coarse"), "coarse-cells")
        order = Window.partitionBy("coarse").orderBy(F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.lit(f"fine {trial}"))), "doc_id")
        picked = placed.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample * fine)
        trained = picked.groupBy("coarse").applyInArrow(_train(fine, rounds), "coarse int, centres binary")
        table = staged(trained, "fine-centres", f"{path}/fine")
        # One row a coarse cell.
        parts = {r["coarse"]: -(-r["count"] // rows_a_task) for r in placed.groupBy("coarse").count().collect()}
        rows = _place(placed, table, parts, fine)
        rows = rows if codec is None else codec.encode(rows)
        rows.hint("rebalance", "coarse").sortWithinPartitions("coarse", "cell").write.mode("overwrite").partitionBy("coarse").parquet(f"{path}/rows")
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        kind, state = codec_state(codec)
        write_matrices(spark, {"coarse": centres, **state}, f"{path}/matrices")
        write_meta(spark, f"{path}/meta", schema=ddl, codec=kind, width=fine)
        return cls(spark.read.schema(rows.schema).parquet(f"{path}/rows"), centres, table, fine, codec)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TwoLevelCells:
        """An index stored by ``build``, with its centres and codec."""
        meta = spark.read.schema("schema string, codec string, width int").json(f"{path}/meta").first()
        found = read_matrices(spark, f"{path}/matrices")
        return cls(spark.read.schema(meta["schema"]).parquet(f"{path}/rows"), found["coarse"], spark.read.parquet(f"{path}/fine"), meta["width"],
                   codec_of(meta["codec"], found))

    def probes(self, queries: DataFrame, coarse: int, cells: int) -> DataFrame:
        """``(qid, vector, cells)``: the ``cells`` nearest fine cells inside the ``coarse`` nearest coarse ones, nearest first."""
        near = nearest_cells(queries.select("qid", "vector"), self.coarse, coarse, "near")
        asked = near.select("qid", "vector", F.explode("near").alias("coarse"))
        schema = T.StructType([queries.schema["qid"], *T.StructType.fromDDL("cell int, distance double").fields])

        def nearest(batch: pa.RecordBatch, first: int, centres: np.ndarray) -> pa.RecordBatch:
            distance = squared_distances(list_matrix(batch.column("vector")), centres)
            chosen = np.argsort(distance, axis=1, kind="stable")[:, :cells]
            owner = np.repeat(np.arange(len(chosen)), chosen.shape[1])
            return pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(owner)), pa.array((first + chosen).ravel().astype(np.int32)),
                                               pa.array(np.take_along_axis(distance, chosen, axis=1).ravel())], names=["qid", "cell", "distance"])

        found = _with_centres(asked, self.fine, F.xxhash64("qid"), {}, self.width, nearest, schema)
        # At most coarse * cells entries for a query.
        best = found.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "cell"))), 1, cells).alias("best"))
        return queries.select("qid", "vector").join(best.select("qid", F.transform("best", lambda x: x.cell).alias("cells")), "qid")

    def search(self, queries: DataFrame, k: int, coarse: int, cells: int, vectors: DataFrame | None = None, factor: int = 1, **options) -> DataFrame:
        """The k best in the probed cells; with ``vectors`` the k best of ``factor`` times as many by their exact scores."""
        asked = self.probes(queries, coarse, cells)
        asked = staged(asked, "probes")
        prune = lambda chosen: F.col("coarse").isin(sorted({c // self.width for c in chosen}))
        found = coded_search(asked, self.rows, k if vectors is None else k * factor, self.codec, prune=prune, **options)
        return found if vectors is None else dense.rerank(found, queries, vectors, k)


def _train(fine: int, rounds: int):
    """Lloyd's rounds on one coarse cell's sample, from its first vectors by hash."""
    def train(table: pa.Table) -> pa.Table:
        rows = list_matrix(table.sort_by("at").column("vector"))
        centres = rows[:fine].copy()
        for _ in range(rounds):
            chosen = squared_distances(rows, centres).argmin(axis=1)
            for c in np.unique(chosen):
                centres[c] = np.round(rows[chosen == c].mean(axis=0), CENTROID_PLACES)
        return pa.table([table.column("coarse").slice(0, 1), pa.array([centres.tobytes()], pa.binary())], ["coarse", "centres"])

    return train


def _place(placed: DataFrame, fine: DataFrame, parts: dict[int, int], width: int) -> DataFrame:
    schema = T.StructType([placed.schema["doc_id"], placed.schema["vector"], *T.StructType.fromDDL("coarse int, cell int").fields])

    def assign(batch: pa.RecordBatch, first: int, centres: np.ndarray) -> pa.RecordBatch:
        cell = squared_distances(list_matrix(batch.column("vector")), centres).argmin(axis=1).astype(np.int32) + np.int32(first)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("vector"), batch.column("coarse"), pa.array(cell)], names=schema.names)

    return _with_centres(placed, fine, F.xxhash64("doc_id"), parts, width, assign, schema)


def _with_centres(rows: DataFrame, fine: DataFrame, key, parts: dict[int, int], width: int, work, schema: T.StructType) -> DataFrame:
    """``work(batch, number of the first fine cell, centres)`` for rows that have a ``coarse`` cell.

    A coarse cell's centres stand before its rows in the sorted partition. A
    large cell is dealt to several partitions, each with a copy of the centres.
    """
    split = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else None
    of = (lambda: F.coalesce(split[F.col("coarse")], F.lit(1))) if parts else (lambda: F.lit(1))
    names = rows.columns
    mine = rows.select("*", F.pmod(key, of()).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("centres"))
    heads = fine.select("coarse", "centres", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), (of() - 1).cast("int"))).alias("part"))
    met = heads.unionByName(mine, allowMissingColumns=True).select(*names, "centres", "part", "kind")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = first = None
        for batch in batches:
            starts = np.flatnonzero(batch.column("kind").to_numpy() == 0).tolist()
            for start, end in zip([-1, *starts], [*starts, batch.num_rows]):
                if start >= 0:
                    first = batch.column("coarse")[start].as_py() * width
                    data = np.frombuffer(batch.column("centres")[start].as_buffer())
                    centres = data
                part = batch.slice(start + 1, end - start - 1)
                if part.num_rows:
                    dim = len(part.column("vector")[0])
                    yield work(part, first, centres.reshape(-1, dim))

    return (met.repartition(n, "coarse", "part").sortWithinPartitions("coarse", "part", "kind").mapInArrow(task, schema))
