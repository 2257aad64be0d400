"""Compressed vectors: int8 codes over one range, and product-quantisation codes.

Codes are stored as small-integer arrays. A search decodes int8 codes inside
the Arrow batch and scores them with the same block product as exact search.
Product codes are not decoded: a table of the products of a few queries with
every code of every block is made for each batch, and a row's score is the sum
of the entries that its codes point at. The tables of all queries at once would
be 32 times as large as the queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.memory import give_back
from ..plans.staging import BROADCAST_BYTES, new_path, staged, write_meta
from . import dense
from .dense import list_matrix

# Code range of int8, and blocks and bits of product quantisation.
INT8_LEVELS = 127
PQ_BLOCKS = 8
PQ_BITS = 8
PQ_ROUNDS = 2
# Queries whose table of products is held at once.
TABLE_QUERIES = 256
CENTROID_PLACES = 6


@dataclass(frozen=True)
class Int8Codec:
    """One global range; a component becomes round((x - lo) / (hi - lo) * 127)."""

    lo: float
    hi: float

    @classmethod
    def fit(cls, vectors: DataFrame) -> Int8Codec:
        row = vectors.agg(F.min(F.array_min("vector")).cast("double").alias("lo"),
                          F.max(F.array_max("vector")).cast("double").alias("hi")).first()
        return cls(row["lo"] or 0.0, row["hi"] or 0.0)

    @property
    def span(self) -> float:
        return (self.hi - self.lo) or 1.0

    def encode(self, vectors: DataFrame) -> DataFrame:
        """``vector`` replaced by ``codes ARRAY<TINYINT>``, in the JVM."""
        def code(x):
            return F.round((x.cast("double") - F.lit(self.lo)) / F.lit(self.span) * F.lit(float(INT8_LEVELS))).cast("tinyint")

        return vectors.withColumn("codes", F.transform("vector", code)).drop("vector")

    def decode(self, column) -> np.ndarray:
        return self.lo + list_matrix(column) * (self.span / INT8_LEVELS)


def squared_distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """All squared distances, rounded so that ties mean the same everywhere."""
    d = (rows * rows).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (rows @ centres.T)
    return np.round(d, CENTROID_PLACES)


def nearest_codes(rows: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Code of the nearest centre in each block; the lowest code wins a tie."""
    blocks, _, width = codebook.shape
    out = np.empty((len(rows), blocks), dtype=np.int64)
    step = max(1, 4_000_000 // codebook.shape[1])
    for start in range(0, len(rows), step):
        part = rows[start:start + step]
        for m in range(blocks):
            out[start:start + step, m] = squared_distances(
                part[:, m * width:(m + 1) * width], codebook[m]).argmin(1)
    return out


def seed_vectors(vectors: DataFrame, n: int, trial: int = 0) -> np.ndarray:
    """n vectors (all, if fewer) in the order of a hash of id and trial: repeatable, and no matter how ids were given out."""
    order = F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.lit(str(trial))))
    rows = (vectors.where(F.col("vector").isNotNull()).select("vector", order.alias("order"), "doc_id")
            .orderBy("order", "doc_id").limit(n).select("vector").toArrow())
    seeds = list_matrix(rows.column("vector"))
    if not len(seeds):
        raise ValueError("no vectors to seed the centres from")
    return seeds


def lloyd(vectors: DataFrame, codebook: np.ndarray, rounds: int) -> np.ndarray:
    """A fixed number of Lloyd rounds over all vectors, for all blocks at once.

    ``codebook`` is (blocks, codes, width): one block of full width trains
    search cells, several blocks train product quantisation. A task sends one
    row of sums per centre it met, so a centre that attracts a third of all
    vectors costs no more than any other. Only the codebook, whose size is set
    by parameters, passes through the driver.
    """
    if codebook.nbytes > BROADCAST_BYTES:
        raise ValueError(f"a codebook of {codebook.nbytes} bytes is over the limit of {BROADCAST_BYTES}")
    blocks, codes, width = codebook.shape
    schema = "block int, code int, n long, sums array<double>"
    rows = vectors.where(F.col("vector").isNotNull()).select("vector")
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(codebook)
        sums = rows.mapInArrow(_partial_sums(shared), schema)
        means = (
            sums.select("block", "code", "n", F.posexplode("sums").alias("dim", "total"))
            .groupBy("block", "code", "dim").agg((F.sum("total") / F.sum("n")).alias("mean"))
            .select("block", "code", "dim", F.round("mean", CENTROID_PLACES).alias("mean"))
            .toArrow()
        )
        # A centre nobody chose keeps its place.
        codebook = codebook.copy()
        at = tuple(means.column(c).to_numpy() for c in ("block", "code", "dim"))
        codebook[at] = means.column("mean").to_numpy()
    return codebook


def _partial_sums(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook = shared.value
        blocks, codes, width = codebook.shape
        counts = np.zeros((blocks, codes), dtype=np.int64)
        sums = np.zeros((blocks, codes, width))
        for batch in batches:
            rows = list_matrix(batch.column("vector"))
            if not len(rows):
                continue
            chosen = nearest_codes(rows, codebook)
            for m in range(blocks):
                counts[m] += np.bincount(chosen[:, m], minlength=codes)
                for d in range(width):
                    sums[m, :, d] += np.bincount(chosen[:, m], weights=rows[:, m * width + d], minlength=codes)
        block, code = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(block, pa.int32()), pa.array(code, pa.int32()), pa.array(counts[block, code]),
            pa.array(list(sums[block, code]), pa.list_(pa.float64())),
        ], names=["block", "code", "n", "sums"])
        give_back()

    return task


@dataclass(frozen=True)
class PqCodec:
    """Product quantisation: ``codebook`` is (blocks, codes, width)."""

    codebook: np.ndarray

    @classmethod
    def fit(cls, vectors: DataFrame, blocks: int = PQ_BLOCKS, bits: int = PQ_BITS,
            rounds: int = PQ_ROUNDS) -> PqCodec:
        seeds = seed_vectors(vectors, 2 ** bits)
        if seeds.shape[1] % blocks:
            raise ValueError(f"{seeds.shape[1]} components do not divide into {blocks} blocks")
        start = seeds.reshape(len(seeds), blocks, -1).transpose(1, 0, 2).copy()
        return cls(lloyd(vectors, start, rounds))

    def encode(self, vectors: DataFrame) -> DataFrame:
        """``vector`` replaced by ``codes ARRAY<SMALLINT>``, one code per block."""
        kept = [c for c in vectors.columns if c != "vector"]
        schema = T.StructType([vectors.schema[c] for c in kept] + [T.StructField("codes", T.ArrayType(T.ShortType()))])
        shared = vectors.sparkSession.sparkContext.broadcast(self.codebook)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = nearest_codes(list_matrix(batch.column("vector")), shared.value).astype(np.int16)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, "codes"])
            give_back()

        return vectors.where(F.col("vector").isNotNull()).select(*kept, "vector").mapInArrow(task, schema)

    def decode(self, column) -> np.ndarray:
        codes = list_matrix(column).astype(np.int64)
        if not len(codes):
            return np.zeros((0, self.codebook.shape[0] * self.codebook.shape[2]))
        return np.concatenate([self.codebook[m][codes[:, m]] for m in range(len(self.codebook))], axis=1)

    @property
    def query_bytes(self) -> int:
        """What ``product`` holds of each of the ``TABLE_QUERIES`` queries that it scores at once."""
        return 8 * self.codebook.shape[0] * self.codebook.shape[1]

    def product(self, queries: np.ndarray):
        """Scores by lookup in the products of queries and codebook, for ``dense.search``."""
        blocks, size, width = self.codebook.shape

        def of_batch(column):
            codes = list_matrix(column).astype(np.intp).reshape(len(column), blocks)

            def scores(part: np.ndarray, rows) -> np.ndarray:
                mine = codes[rows]
                total = np.empty((len(part), len(mine)))
                for start in range(0, len(part), TABLE_QUERIES):
                    asked = queries[part[start:start + TABLE_QUERIES]]
                    # A line of a table has one code's products with all queries, so a lookup copies whole lines.
                    found = np.zeros((len(mine), len(asked)))
                    for m in range(blocks):
                        own = asked[:, m * width:(m + 1) * width].T
                        # Fewer rows than codes need no table.
                        found += (self.codebook[m] @ own)[mine[:, m]] if len(mine) >= size else self.codebook[m][mine[:, m]] @ own
                    total[start:start + TABLE_QUERIES] = found.T
                return total

            return scores

        return of_batch


def coded_search(queries: DataFrame, rows: DataFrame, k: int, codec: Int8Codec | PqCodec | None, **options) -> DataFrame:
    """``dense.search`` over plain vectors, or over codes in the way of their codec."""
    if isinstance(codec, PqCodec):
        return dense.search(queries, rows, k, "codes", product=codec.product, **options)
    return dense.search(queries, rows, k, "vector" if codec is None else "codes", dense.plain if codec is None else codec.decode, **options)


def codec_state(codec: Int8Codec | PqCodec | None) -> tuple[str, dict[str, np.ndarray]]:
    """Kind and numbers of a codec, to be stored with what it has encoded."""
    if codec is None:
        return "none", {}
    if isinstance(codec, Int8Codec):
        return "int8", {"range": np.array([codec.lo, codec.hi])}
    return "pq", {"codebook": codec.codebook}


def codec_of(kind: str, found: dict[str, np.ndarray]) -> Int8Codec | PqCodec | None:
    return {"none": lambda: None, "int8": lambda: Int8Codec(*map(float, found["range"])), "pq": lambda: PqCodec(found["codebook"])}[kind]()


def write_matrices(spark: SparkSession, matrices: dict[str, np.ndarray], path: str) -> None:
    """One row a matrix; their sizes are set by the parameters of the index."""
    rows = [(name, list(m.shape), m.ravel().astype(float).tolist()) for name, m in matrices.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


@dataclass(frozen=True)
class FlatIndex:
    """Vectors or codes for exact search over what is stored, with the codec to read them."""

    rows: DataFrame
    codec: Int8Codec | PqCodec | None = None

    @classmethod
    def build(cls, vectors: DataFrame, codec: Int8Codec | PqCodec | None = None, path: str | None = None) -> FlatIndex:
        spark = vectors.sparkSession
        path = path or new_path(spark, "flat")
        rows = vectors.select("doc_id", "vector") if codec is None else codec.encode(vectors.select("doc_id", "vector"))
        stored = staged(rows, "rows", f"{path}/rows")
        kind, state = codec_state(codec)
        write_matrices(spark, state, f"{path}/matrices")
        write_meta(spark, f"{path}/meta", codec=kind)
        return cls(stored, codec)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FlatIndex:
        """An index stored by ``build``."""
        kind = spark.read.schema("codec string").json(f"{path}/meta").first()["codec"]
        return cls(spark.read.parquet(f"{path}/rows"), codec_of(kind, read_matrices(spark, f"{path}/matrices")))

    def search(self, queries: DataFrame, k: int, vectors: DataFrame | None = None, factor: int = 1, **options) -> DataFrame:
        """The k best; with ``vectors`` the k best of ``factor`` times as many candidates by their exact scores."""
        if vectors is None:
            return coded_search(queries, self.rows, k, self.codec, **options)
        return dense.rerank(coded_search(queries, self.rows, k * factor, self.codec, **options), queries, vectors, k)
