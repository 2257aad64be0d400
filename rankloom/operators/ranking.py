"""The k best rows of every query, ties broken by document id."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_PLACES = 6
# From this many partitions on, top rows are merged in two steps.
MANY_PARTITIONS = 1_000
# Rows that a task holds before it cuts them to the best ones.
HELD_ROWS = 1_000_000
# Rows of a run that are worth a task of their own where lists are merged, as a Python task takes a tenth of a second by itself.
MERGED_ROWS = 50_000
# Up to this k Spark cuts each partition before the exchange by itself.
WINDOW_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def ranked(scores: DataFrame, by: Sequence[str] = ("qid",)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order))


def top_k(scores: DataFrame, k: int, by: Sequence[str] = ("qid",), parts: int | None = None) -> DataFrame:
    """``run(qid, doc_id, score, rank)`` with rank <= k.

    Every partition is cut to k rows per query before the exchange, so a query
    that matches most of the corpus moves few rows. Spark does this itself for
    k up to a limit of the session; beyond it the tasks do (``best_in_tasks``).
    With very many partitions even those are too many for one task per query:
    they are first merged in ``parts`` groups of partitions.
    """
    parts = _groups(scores) if parts is None else parts
    if k > int(scores.sparkSession.conf.get(WINDOW_LIMIT, "1000")):
        scores = best_in_tasks(scores, k, by)
    if parts > 1:
        # Any split into groups gives the same result.
        grouped = scores.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts)))
        scores = ranked(grouped, [*by, "part"]).where(F.col("rank") <= k).drop("rank", "part")
    return ranked(scores, by).where(F.col("rank") <= k)


def _groups(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return math.isqrt(partitions) if partitions >= MANY_PARTITIONS else 1


def best_in_tasks(scores: DataFrame, k: int, by: Sequence[str] = ("qid",)) -> DataFrame:
    """The rows of ``scores`` that are among the k best of their partition for their query, in no order.

    A task holds at most k rows for each query it has met and ``HELD_ROWS`` more.
    """
    keys = [*[(c, "ascending") for c in by], ("score", "descending"), ("doc_id", "ascending")]

    def cut(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=keys))
        n = table.num_rows
        first = np.zeros(n, bool)
        first[:1] = True
        for c in by:
            column = table.column(c)
            same = pc.equal(column.slice(1), column.slice(0, n - 1))
            # Two nulls are one key.
            null = column.is_null().to_numpy()
            same = pc.fill_null(same, False).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)
            first[1:] |= ~(same | (null[1:] & null[:-1]))
        place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        return table.filter(pa.array(place < k))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kept = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > kept + HELD_ROWS:
                best = cut(held)
                held, size = best.to_batches(), best.num_rows
                kept = size
        if held:
            yield from cut(held).to_batches(max_chunksize=100_000)

    return scores.mapInArrow(task, scores.schema)


def packed_rows(query: np.ndarray, score: np.ndarray, doc: np.ndarray, qids: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row ``(qid, doc_id, score)`` of lists for each query, from entries in order of ``query``, a position in ``qids``."""
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(query)] if len(query) else starts
    for at in range(0, len(starts), 1000):
        a, b = starts[at], ends[min(at + 1000, len(starts)) - 1]
        offsets = pa.array(np.r_[starts[at:at + 1000], b].astype(np.int32) - np.int32(a))
        yield pa.RecordBatch.from_arrays(
            [pa.array(qids[query[starts[at:at + 1000]]]).cast(schema.field("qid").type),
             pa.ListArray.from_arrays(offsets, pa.array(doc[a:b]).cast(schema.field("doc_id").type.value_type)),
             pa.ListArray.from_arrays(offsets, pa.array(score[a:b]))],
            names=["qid", "doc_id", "score"])


def packed_schema(qid: T.DataType, doc_id: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("qid", qid), T.StructField("doc_id", T.ArrayType(doc_id)), T.StructField("score", T.ArrayType(T.DoubleType()))])


def merge_tasks(packed: DataFrame, rows: int) -> int:
    """Tasks that merge a run of ``rows`` rows: one for each ``MERGED_ROWS`` or core, but not more than the session's shuffle partitions."""
    spark = packed.sparkSession
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-rows // MERGED_ROWS)))


def merged(packed: DataFrame, k: int, parts: int | None = None, tasks: int | None = None) -> DataFrame:
    """``run(qid, doc_id, score, rank)`` of the k best, from ``packed(qid, doc_id, score)`` rows of lists.

    Each task of a search sends one row a query. They meet by query and are
    cut as they stream past, so a task holds k rows of a query and
    ``HELD_ROWS`` more, for any k and however many tasks there were. ``tasks``
    is how many merge, by default the session's shuffle partitions.
    """
    parts = _groups(packed) if parts is None else parts
    n = tasks or int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts > 1:
        grouped = packed.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts))).repartition(n, "qid", "part")
        packed = grouped.sortWithinPartitions("qid", "part").drop("part").mapInArrow(_merge(k, False), packed.schema)
    kinds = [packed.schema["qid"], T.StructField("doc_id", packed.schema["doc_id"].dataType.elementType),
             T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    return packed.repartition(n, "qid").sortWithinPartitions("qid").mapInArrow(_merge(k, True), T.StructType(kinds))


def _merge(k: int, flat: bool):
    from .dense import id_array

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, last, kinds = 0, None, None
        for batch in batches:
            kinds = batch.schema
            qids = id_array(batch.column("qid"))
            lists = batch.column("doc_id")
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            held.append((qids[owner], batch.column("score").flatten().to_numpy(), id_array(lists.flatten())))
            size += len(owner)
            if size > HELD_ROWS:
                best = _best(held, k)
                # The last query may go on in the next batch.
                cut = int(np.searchsorted(best[0], best[0][-1])) if len(best[0]) else 0
                yield from _out([c[:cut] for c in best], kinds, flat)
                held = [tuple(c[cut:] for c in best)]
                size = len(held[0][0])
        if held:
            yield from _out(_best(held, k), kinds, flat)

    return task


def _best(held, k: int) -> list[np.ndarray]:
    """The k best entries of each query, in order of query, score and id; queries come in ascending order already."""
    q, s, d = (np.concatenate(c) for c in zip(*held))
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    number = np.cumsum(first)
    order = np.lexsort((d, -s, number))
    number = number[order]
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    order = order[place < k]
    return [q[order], s[order], d[order]]


def _out(best, kinds: pa.Schema, flat: bool) -> Iterator[pa.RecordBatch]:
    q, s, d = best
    if not len(q):
        return
    if not flat:
        new = np.r_[True, q[1:] != q[:-1]]
        yield from packed_rows(np.cumsum(new) - 1, s, d, q[new], kinds)
        return
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) + 1
    for at in range(0, len(q), 100_000):
        cut = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q[cut]).cast(kinds.field("qid").type), pa.array(d[cut]).cast(kinds.field("doc_id").type.value_type),
             pa.array(s[cut]), pa.array(rank[cut].astype(np.int32))], names=["qid", "doc_id", "score", "rank"])
