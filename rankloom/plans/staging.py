"""Where intermediate tables go and how large a side may be before it is broadcast.

Intermediate tables are ordinary parquet tables in the shared folder named by
``spark.checkpoint.dir``. They outlive executors, cut lineage and let every
later step read only the columns it needs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side, in measured bytes, that is sent whole to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Stored bytes that are worth a shard of their own.
SHARD_BYTES = 32 * 1024 * 1024
# The same where texts become terms: a stored byte of text may take 50 bytes of a task as rows of terms.
TEXT_SHARD_BYTES = 8 * 1024 * 1024
# More tasks than this are a burden for the driver; a shard is streamed through its task, so it may be larger.
MOST_SHARDS = 50_000
# Bytes of a file that Spark reads in one partition, by default, and estimates from which on nothing is known.
SPLIT_BYTES = 128 * 1024 * 1024
UNKNOWN_BYTES = 1 << 60


def staging_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else one in the warehouse, which executors reach as well."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staging").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet and return the written table."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, shards: int | None = None) -> DataFrame:
    """``df`` itself, or dealt out by ``key`` if it is too small to have a partition for every core.

    Decided by the size that the plan's leaves state, without running anything.
    """
    spark = df.sparkSession
    size = estimated_bytes(df)
    if not shards and size is not None and size >= spark.sparkContext.defaultParallelism * SPLIT_BYTES:
        return df
    return df.repartition(shard_count(df, shards), key)


def shard_count(df: DataFrame, shards: int | None = None) -> int:
    """One shard for each ``SHARD_BYTES`` that Spark estimates, at least one for every core; the session's shuffle partitions if it can't tell."""
    if shards:
        return shards
    spark = df.sparkSession
    size = estimated_bytes(df)
    if size is None:
        return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(spark.sparkContext.defaultParallelism, min(MOST_SHARDS, -(-size // SHARD_BYTES)))


def text_shards(df: DataFrame, shards: int | None = None) -> int:
    """One shard for each ``TEXT_SHARD_BYTES`` of the tables that ``df`` is made from, at least one for every core.

    Counted by the leaves of the plan, so texts and the terms made of them get equal numbers and need one exchange between them.
    """
    if shards:
        return shards
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= UNKNOWN_BYTES:
        return shard_count(df)
    return max(spark.sparkContext.defaultParallelism, min(MOST_SHARDS, -(-size // TEXT_SHARD_BYTES)))


def estimated_bytes(df: DataFrame) -> int | None:
    """The size of ``df`` by Spark's statistics of its plan; None where they hold its stand-in for an unknown size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else None


def write_meta(spark: SparkSession, path: str, **values) -> None:
    """One JSON row that describes a stored index."""
    row = spark.range(1).select(*[F.lit(value).alias(name) for name, value in values.items()])
    row.coalesce(1).write.mode("overwrite").json(path)


def _width(field: T.StructField):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(F.size(column), F.lit(0)) * 8
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows, counted by one aggregation that returns one number."""
    width = F.lit(16)
    for field in df.schema.fields:
        width = width + _width(field)
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    return measured_bytes(df) <= (BROADCAST_BYTES if limit is None else limit)
