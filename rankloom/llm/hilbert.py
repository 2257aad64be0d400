"""Shards along a Hilbert curve through several metadata columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from operator import gt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import partitions, saved, with_rank

BITS = 5
COLUMNS = ("lang", "source", "n_chars")


def _gray_inverse(code: int) -> int:
    value = 0
    while code:
        value ^= code
        code >>= 1
    return value


def curve_steps(dims: int) -> tuple[list[int], list[int]]:
    """The curve as a state machine: (digit, next state) at ``state << dims | cell``.

    A state is an entry corner and a direction. A cell's digit is the inverse
    Gray code of the corner turned into the state's frame; the digit's own
    entry corner and direction, turned back, give the next state.
    """
    size = 1 << dims

    def right(value, by):
        by %= dims
        return (value >> by | value << dims - by) & size - 1

    def trailing_ones(value):
        return (~value & value + 1).bit_length() - 1

    digits, nexts = [], []
    for state in range(size * dims):
        entry, turn = divmod(state, dims)
        for cell in range(size):
            digit = _gray_inverse(right(cell ^ entry, turn + 1))
            even = max(digit - 1, 0) & ~1
            corner = right(even ^ even >> 1, -(turn + 1))
            step = 0 if digit == 0 else trailing_ones(digit - 1 + digit % 2) % dims
            digits.append(digit)
            nexts.append((entry ^ corner) * dims + (turn + step + 1) % dims)
    return digits, nexts


def curve_index(cells: Sequence[Column], bits: int) -> Column:
    """Position on the curve of a point of ``len(cells)`` coordinates of ``bits`` bits each."""
    dims = len(cells)
    digits, nexts = (F.array(*map(F.lit, part)) for part in curve_steps(dims))

    def step(state, level):
        cell = F.lit(0)
        for k, c in enumerate(cells):
            cell = cell + F.call_function("shiftright", c, level).bitwiseAND(F.lit(1)) * F.lit(1 << k)
        at = state["state"] * F.lit(1 << dims) + cell
        return F.struct((state["index"] * F.lit(1 << dims) + F.get(digits, at)).alias("index"), F.get(nexts, at).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    levels = F.array(*[F.lit(b) for b in reversed(range(bits))])
    return F.aggregate(levels, start, step, lambda state: state["index"])


def _is_text(docs: DataFrame, name: str) -> bool:
    return isinstance(docs.schema[name].dataType, (T.StringType, T.BinaryType))


def _number(docs: DataFrame, name: str) -> Column:
    """A number that orders the values of a column as they are ordered."""
    kind, column = docs.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    return column.cast("double")


def text_cuts(docs: DataFrame, name: str, steps: int) -> list:
    """Values of a string column that cut its rows into ``steps`` runs of about equal counts, in order.

    Whole values are counted, so a value that many rows share is counted with
    all of them and none is cut short. The distinct values are added up along
    their order, range by range; only the fewer than ``steps`` cuts come here.
    """
    value = F.col(f"`{name}`").alias("value")
    counted = docs.select(value).where("value IS NOT NULL").groupBy("value").count()
    n = partitions(docs)
    placed = saved(counted.repartitionByRange(n, "value").withColumn("range", F.spark_partition_id()), "values")
    # One row for each range.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("range").agg(F.sum("count").alias("size"))
    total = ranges.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    starts = ranges.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy("value")
    upto = placed.withColumn("upto", F.sum("count").over(inside)).join(F.broadcast(starts), "range").withColumn("upto", F.col("start") + F.col("upto"))
    # A value whose rows reach over the next multiple of total / steps.
    cut = F.expr(f"upto * {steps} div {max(total, 1)} > (upto - count) * {steps} div {max(total, 1)} AND upto < {total}")
    return sorted(r.value for r in upto.where(cut).select("value").collect())


def curve_column(docs: DataFrame, columns: Sequence[str] = COLUMNS, bits: int = BITS) -> Column:
    """The curve index of a row of ``docs`` in ``columns`` (2 to 5 of them).

    Every column is cut at its own quantiles into 2 ** bits steps; nulls are in
    the lowest. The quantiles are of the whole table: for numbers and dates from
    one aggregation over these columns alone, for strings from the counts of
    their distinct values (``text_cuts``).
    """
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [c for c in columns if not _is_text(docs, c)]
    row = docs.agg(*[F.percentile_approx(_number(docs, c), steps).alias(f"q{k}") for k, c in enumerate(numbers)]).first() if numbers else ()
    quantiles = dict(zip(numbers, row))
    cells = []
    for name in columns:
        text = _is_text(docs, name)
        cuts = text_cuts(docs, name, 1 << bits) if text else sorted(set(quantiles[name] or []))
        value = F.col(f"`{name}`") if text else _number(docs, name)
        below = F.filter(F.array(*map(F.lit, cuts)), partial(gt, value)) if cuts else F.array()
        cells.append(F.when(value.isNull(), 0).otherwise(F.size(below)))
    # Held as one value, so that the steps below do not evaluate the cuts again.
    point = F.array(F.array(*cells))
    return F.get(F.transform(point, lambda p: curve_index([F.get(p, k) for k in range(len(cells))], bits)), 0)


def shards(docs: DataFrame, shards: int, columns: Sequence[str] = COLUMNS, bits: int = BITS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve)`` for every row of ``docs``.

    Rows in curve order, then by doc_id, size and checksum, are cut into runs
    whose counts are at most one apart (law ``rows``). ``size`` is the UTF-8
    bytes of the text plus 8; a null text has 8 and a null checksum. Null
    metadata lie in the lowest step. Repeated rows stay. The text is read once;
    only these narrow rows are sorted.
    """
    narrow = saved(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), curve_column(docs, columns, bits).alias("curve")), "curve")
    ordered = with_rank(narrow, ["curve", "doc_id", "size", "text_crc32"], "curve-order")
    rows = narrow.count()
    # Shard s holds the ranks from ceil(s * rows / shards) on.
    shard = F.expr(f"rank * {shards} div {max(rows, 1)}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    return (ordered.withColumn("shard", shard)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"))


def write_runs(docs: DataFrame, path: str, runs: int, columns: Sequence[str] = COLUMNS, bits: int = BITS) -> None:
    """Write whole rows as Parquet in ``runs`` files along the curve.

    Each file then spans a small range of every one of ``columns``, so the
    column statistics of Parquet skip most files for a filter on any of them.
    Cuts follow sampled quantiles of (curve, doc_id); use ``shards`` for exact ones.
    """
    curve = "__curve"
    while curve in docs.columns:
        curve += "_"
    (docs.withColumn(curve, curve_column(docs, columns, bits)).repartitionByRange(runs, curve, "doc_id")
     .sortWithinPartitions(curve, "doc_id").drop(curve).write.parquet(path))
