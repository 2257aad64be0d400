"""Batched encoding of text with a caller's model, inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: rows handed to the model at once.
BATCH_ROWS = 256


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length > 0, length, 1.0)


def _list_array(matrix: np.ndarray) -> pa.Array:
    rows, dims = matrix.shape
    values = pa.array(np.ascontiguousarray(matrix, dtype=np.float32).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dims), values)


def encode_dense(texts: DataFrame, encoder: Callable, text: str = "text", batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Replace ``text`` by ``vector ARRAY<FLOAT>`` of unit length.

    ``encoder()`` runs once per task and returns ``list[str] -> matrix``.
    """
    kept = [c for c in texts.columns if c != text]
    schema = T.StructType([texts.schema[c] for c in kept] + [T.StructField("vector", T.ArrayType(T.FloatType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                matrix = np.asarray(encode(part.column(text).to_pylist()), dtype=np.float64)
                columns = [part.column(c) for c in kept] + [_list_array(_unit_rows(matrix))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "vector"])

    return texts.select(*kept, F.coalesce(text, F.lit("")).alias(text)).mapInArrow(task, schema)


def encode_sparse(texts: DataFrame, encoder: Callable, key: str = "qid", text: str = "text",
                  batch_rows: int = BATCH_ROWS) -> DataFrame:
    """``(key, term, weight DOUBLE)`` rows from a model that weighs terms."""
    schema = T.StructType([texts.schema[key], T.StructField("term", T.StringType()),
                           T.StructField("weight", T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                weighted = encode(part.column(text).to_pylist())
                owner = np.repeat(np.arange(part.num_rows), [len(w) for w in weighted])
                yield pa.RecordBatch.from_arrays([
                    part.column(key).take(pa.array(owner)),
                    pa.array([term for w in weighted for term, _ in w], pa.string()),
                    pa.array([weight for w in weighted for _, weight in w], pa.float64()),
                ], names=[key, "term", "weight"])

    return texts.select(key, F.coalesce(text, F.lit("")).alias(text)).mapInArrow(task, schema)
