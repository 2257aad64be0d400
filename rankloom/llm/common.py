"""Shared helpers: tables in the shared folder, Arrow batches as byte strings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.memory import give_back

# Text bytes that a task turns into Python objects at once.
CHUNK_BYTES = 4 * 1024 * 1024


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, else in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/llm"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    The table outlives executors and cuts the lineage. ``options`` are those of the Parquet writer.
    """
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``CHUNK_BYTES`` of ``text``, at least one row each."""
    for batch in batches:
        start, size = 0, 0
        column = batch.column(text)
        for at, n in enumerate(pa.compute.binary_length(column).to_pylist()):
            if size and size + (n or 0) > CHUNK_BYTES:
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def with_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank``, its gapless position from 0 in the order of ``order``; written once.

    Rows go to ranges of the order, so no task sees more than its range: the
    ranges are cut by all columns of ``order``, which splits a value that a
    third of the rows share as long as a later column differs.
    """
    low = (1 << 33) - 1
    placed = saved(df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
                   .withColumn("rank", F.monotonically_increasing_id()), name)
    # One row for each partition, so both the window and the broadcast are as small as the number of partitions.
    sizes = placed.groupBy(F.shiftright("rank", 33).alias("range")).count()
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return (placed.withColumn("range", F.shiftright("rank", 33)).join(F.broadcast(starts), "range")
            .select(*columns, (F.col("start") + F.col("rank").bitwiseAND(F.lit(low))).alias("rank")))
