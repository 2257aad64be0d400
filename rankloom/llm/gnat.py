"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings.

Inner products become distances: with a further component sqrt(M - |x|^2) all
rows lie on a sphere of squared radius M, and a row's squared distance to an
anchor, which gets 0 there, is |anchor|^2 + M - 2 * score. A window of scores
is then an annulus around the anchor.

Every node has split points; a row belongs to the nearest one. For every split
point and every sibling subtree the node keeps the least and greatest distance
between them. By the triangle inequality these ranges say which distances to an
anchor a subtree can hold; where they miss the annulus, all of it is left out.
The two upper levels are made from a bounded sample and are small enough for
every task. Their leaves are cut into chunks of bounded size, one row of a
table each, with a third level of their own, whose leaves are scanned with
exact whole numbers. Only the queries that can find something travel to a chunk.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import partitions, saved

# Most split points of a node, rows that they are chosen from, rows of a leaf to aim at, rows of a chunk, split points in a chunk.
FANOUT, SAMPLE, LEAF_ROWS, CHUNK_ROWS, LOCAL_FANOUT = 16, 8192, 2048, 8192, 24
# Queries that travel together, and such blocks that one copy of a chunk meets.
BLOCK, BLOCKS_A_COPY = 256, 64
ANY = (-(1 << 63), (1 << 63) - 1)


def quantised(vectors: DataFrame, factor: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, label, vector, dim)`` with components floor(factor * x) as doubles.

    Rows with a null id, label or vector, an empty vector, or a null or
    non-finite component are left out. Of rows with one id the one with the
    least label and then the least vector stays.
    """
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    taken = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & (F.size(embedding) > 0) & finite).select(
        F.col(vec_id).alias("vec_id"), F.struct(F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vector")).alias("row"))
    rows = taken.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")
    # Not F.floor, which gives whole numbers of 64 bits.
    whole = F.transform("vector", lambda x: F.rint(x * factor) - F.when(F.rint(x * factor) > x * factor, 1.0).otherwise(0.0))
    return rows.select("vec_id", "label", whole.alias("vector"), F.size("vector").alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with the component that puts them on the sphere."""
    return np.column_stack([x, np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond a long they stay at its ends."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    big = [[int(v) for v in row] for row in a.tolist()], [[int(v) for v in row] for row in b.tolist()]
    return np.array([[min(max(sum(map(int.__mul__, p, q)), ANY[0]), ANY[1]) for q in big[1]] for p in big[0]], np.int64).reshape(len(a), len(b))


def _split_points(sample: np.ndarray, count: int) -> np.ndarray:
    """Positions of points far from each other: each next one has the greatest distance to those before."""
    if not len(sample):
        return np.empty(0, np.int64)
    taken = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(taken) < count and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[taken[-1:]])[:, 0])
    return np.array(taken)


class Node:
    """Split points, and for each of them the range of distances to every sibling's rows."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.low = np.full((len(points), len(points)), np.inf)
        self.high = np.full((len(points), len(points)), -np.inf)

    def children(self, rows: np.ndarray, widen: bool) -> np.ndarray:
        """The child of each row; with ``widen`` the ranges take the rows in."""
        apart = _distances(rows, self.points)
        child = apart.argmin(axis=1)
        for j in np.unique(child) if widen else ():
            self.low[:, j] = np.minimum(self.low[:, j], apart[child == j].min(axis=0))
            self.high[:, j] = np.maximum(self.high[:, j], apart[child == j].max(axis=0))
        return child

    def reach(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that each query (a row) can have to rows of each child; (inf, -inf) for an empty one."""
        apart = _distances(queries, self.points)[:, :, None]
        return np.maximum(apart - self.high, self.low - apart).max(axis=1), (apart + self.high).min(axis=1)


def _possible(node: Node, queries: np.ndarray, norm: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which children of ``node`` can hold a score in one of the windows of each query."""
    square = (queries * queries).sum(axis=1)[:, None] + norm
    slack = 1e-6 * np.sqrt(square)
    near, far = node.reach(queries)
    empty = far < 0
    best = (square - np.maximum(near - slack, 0) ** 2) / 2 + 1
    worst = (square - (far + slack) ** 2) / 2 - 1
    # A point's own rounding, for scores that doubles do not hold exactly.
    best, worst = best + 1e-9 * np.abs(square), worst - 1e-9 * np.abs(square)
    return ((best[:, :, None] >= low[:, None, :]) & (worst[:, :, None] <= high[:, None, :])).any(axis=2) & ~empty


class Tree:
    """The two upper levels, for rows of one size."""

    def __init__(self, sample: np.ndarray, norm: float, fanout: int = FANOUT):
        lifted = _lifted(sample, norm)
        self.norm = norm
        self.root = Node(lifted[_split_points(lifted, fanout)])
        child = _distances(lifted, self.root.points).argmin(axis=1)
        self.below = [Node(mine[_split_points(mine, fanout)]) for mine in (lifted[child == k] for k in range(len(self.root.points)))]

    def nodes(self) -> list[Node]:
        return [self.root, *self.below]

    def place(self, rows: np.ndarray, fanout: int, widen: bool = False) -> np.ndarray:
        """The leaf of each row; with ``widen`` the nodes' ranges take the rows in."""
        lifted = _lifted(rows, self.norm)
        child = self.root.children(lifted, widen)
        leaf = np.empty(len(rows), np.int64)
        for k in np.unique(child):
            leaf[child == k] = k * fanout + self.below[k].children(lifted[child == k], widen)
        return leaf

    def leaves(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray, fanout: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, positions of the queries that can find something there)."""
        flat = np.column_stack([queries, np.zeros(len(queries))])
        upper = _possible(self.root, flat, self.norm, low, high)
        for k in np.flatnonzero(upper.any(axis=0)):
            mine = np.flatnonzero(upper[:, k])
            lower = _possible(self.below[k], flat[mine], self.norm, low[mine], high[mine])
            for j in np.flatnonzero(lower.any(axis=0)):
                yield int(k * fanout + j), mine[lower[:, j]]


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


class Index:
    """A tree over the rows of one size: the upper levels in memory, a table of chunks."""

    def __init__(self, tree: Tree, chunks: DataFrame, count: dict[int, int], dim: int, fanout: int):
        self.tree, self.chunks, self.count, self.dim, self.fanout = tree, chunks, count, dim, fanout

    @classmethod
    def build(cls, rows: DataFrame, dim: int, fanout: int | None = None, sample: int = SAMPLE, chunk_rows: int = CHUNK_ROWS) -> Index:
        """Index ``rows(vec_id, label, vector)``, all of size ``dim``; ``sample`` rows of least hash give the split points."""
        norm, size = rows.select(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), F.count(F.lit(1))).first()
        fanout = fanout or min(FANOUT, 2 + math.isqrt(size // LEAF_ROWS))
        picked = rows.select("vec_id", "vector").orderBy(F.xxhash64(F.lit("split"), "vec_id"), "vec_id").limit(sample)
        # At most ``sample`` rows, few enough for the driver.
        points = np.array([r.vector for r in picked.select("vector").toLocalIterator()], np.float64).reshape(-1, dim)
        tree = Tree(points, float(norm or 0), fanout)
        sent = rows.sparkSession.sparkContext.broadcast(tree)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = sent.value.place(_matrix(batch.column("vector"), dim), fanout)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

        kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label", "vector")}
        placed = saved(rows.select(*kinds).mapInArrow(place, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", leaf bigint"), "placed-vectors")

        def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = sent.value
            for node in mine.nodes():
                node.low[:], node.high[:] = np.inf, -np.inf
            for batch in batches:
                mine.place(_matrix(batch.column("vector"), dim), fanout, True)
            out = [(n, i, j, node.low[i, j], node.high[i, j]) for n, node in enumerate(mine.nodes())
                   for i, j in zip(*np.nonzero(node.high >= 0))]
            kinds = [pa.int32()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], t) for k, t in enumerate(kinds)], ["node", "i", "j", "low", "high"])

        # One row for each pair of siblings: at most fanout ** 2 * (fanout + 1).
        ranges = (placed.select("vector").mapInArrow(widen, "node int, i int, j int, low double, high double")
                  .groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")))
        for r in ranges.collect():
            node = tree.nodes()[r.node]
            node.low[r.i, r.j], node.high[r.i, r.j] = r.low, r.high
        # One row for each leaf.
        count = {r.leaf: -(-r["count"] // chunk_rows) for r in placed.groupBy("leaf").count().collect()}
        sizes = F.create_map(*[F.lit(x) for pair in count.items() for x in pair]) if count else F.lit(None)
        cut = placed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), sizes[F.col("leaf")]).cast("int") if count else F.lit(0))
        def make(table: pa.Table) -> pa.Table:
            ids = table.column("vec_id").combine_chunks().cast(pa.int64()).to_numpy()
            x = _matrix(table.column("vector").combine_chunks(), dim)
            lifted = _lifted(x, tree.norm)
            node = Node(lifted[_split_points(lifted[:4 * chunk_rows], LOCAL_FANOUT)])
            child = node.children(lifted, True)
            order = np.lexsort((ids, child))
            names = table.column("label").combine_chunks().cast(pa.int64()).to_numpy()
            data = _packed(ids=ids[order], labels=names[order], x=x[order], ends=np.cumsum(np.bincount(child, minlength=len(node.points))),
                           points=node.points, low=node.low, high=node.high)
            return pa.table([table.column("leaf").slice(0, 1), table.column("chunk").slice(0, 1), pa.array([data], pa.binary())],
                            ["leaf", "chunk", "data"])

        made = cut.groupBy("leaf", "chunk").applyInArrow(make, "leaf bigint, chunk int, data binary")
        return cls(tree, saved(made, "gnat-chunks"), count, dim, fanout)

    def search(self, queries: DataFrame, k: int, same_label: bool, own_leaf: bool = False) -> DataFrame:
        """``(query_id, slot, rank, vec_id, score)``: for each window the ``k`` rows of highest score in it, ties by smaller id.

        ``queries(vec_id, label, vector, low, high)`` have arrays of windows,
        both ends included. Rows are those of the same label, without the query
        itself, or those of any other label. With ``own_leaf`` only the query's
        own leaf is looked at.
        """
        spark = queries.sparkSession
        sent = spark.sparkContext.broadcast((self.tree, self.count, self.fanout, self.dim))
        stored = saved(queries.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "vector", "low", "high"), "windows")
        copies = max(1, -(-stored.count() // (BLOCK * BLOCKS_A_COPY)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, count, fanout, dim = sent.value
            block = TaskContext.get().partitionId()
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    block += 1
                    part = batch.slice(start, BLOCK)
                    ids, labels = (part.column(c).to_numpy() for c in ("id", "label"))
                    x = _matrix(part.column("vector"), dim)
                    slots = len(part.column("low")[0])
                    low, high = (part.column(c).flatten().to_numpy().reshape(-1, slots) for c in ("low", "high"))
                    if own_leaf:
                        leaf = tree.place(x, fanout)
                        found = [(int(k), np.flatnonzero(leaf == k)) for k in np.unique(leaf)]
                    else:
                        found = tree.leaves(x, low, high, fanout)
                    out = []
                    for leaf, mine in found:
                        data = _packed(ids=ids[mine], labels=labels[mine], x=x[mine], low=low[mine], high=high[mine])
                        out += [(leaf, chunk, block % copies, data) for chunk in range(count.get(leaf, 0))]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()),
                                                      pa.array([r[2] for r in out], pa.int32()), pa.array([1] * len(out), pa.int32()),
                                                      pa.array([r[3] for r in out], pa.binary())], ["leaf", "chunk", "copy", "kind", "data"])

        norm = self.tree.norm

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = node = None
            for batch in batches:
                for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data")):
                    row = np.load(io.BytesIO(data.as_buffer()))
                    if kind == 0:
                        # A chunk stands before the queries that were sent to it.
                        chunk = {c: row[c] for c in row.files}
                        node = Node(chunk["points"])
                        node.low, node.high = chunk["low"], chunk["high"]
                    else:
                        yield _best(chunk, node, {c: row[c] for c in row.files}, norm, k, same_label)

        chunks = self.chunks.select("leaf", "chunk", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), "data")
        met = (chunks.unionByName(stored.mapInArrow(deal, "leaf bigint, chunk int, copy int, kind int, data binary"))
               .repartition(partitions(queries), "leaf", "chunk", "copy").sortWithinPartitions("leaf", "chunk", "copy", "kind"))
        found = met.mapInArrow(scan, "query_id bigint, slot int, vec_id bigint, score bigint")
        order = Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "slot", "rank", "vec_id", "score")


def _best(chunk: dict, node: Node, block: dict, norm: float, k: int, same_label: bool) -> pa.RecordBatch:
    """The ``k`` best rows of a chunk for every window of every query of a block."""
    x, ends = block["x"], chunk["ends"]
    can = _possible(node, np.column_stack([x, np.zeros(len(x))]), norm, block["low"], block["high"])
    out: list[tuple[np.ndarray, ...]] = []
    for cells in np.unique(can, axis=0):
        if not cells.any():
            continue
        mine = np.flatnonzero((can == cells).all(axis=1))
        rows = np.concatenate([np.arange(ends[c - 1] if c else 0, ends[c]) for c in np.flatnonzero(cells)])
        ids, labels = chunk["ids"][rows], chunk["labels"][rows]
        scores = _scores(x[mine], chunk["x"][rows])
        for q, own in zip(mine.tolist(), scores):
            fits = (labels == block["labels"][q]) & (ids != block["ids"][q]) if same_label else labels != block["labels"][q]
            for slot, (low, high) in enumerate(zip(block["low"][q].tolist(), block["high"][q].tolist())):
                hit = np.flatnonzero(fits & (own >= low) & (own <= high))
                if len(hit) > k:
                    hit = hit[own[hit] >= np.partition(own[hit], len(hit) - k)[len(hit) - k]]
                hit = hit[np.lexsort((ids[hit], -own[hit]))[:k]]
                out.append((np.full(len(hit), block["ids"][q]), np.full(len(hit), slot), ids[hit], own[hit]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "slot", "vec_id", "score"])


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
                   fanout: int | None = None, sample: int = SAMPLE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from ``rows(vec_id, label, vector, dim)``.

    The score is the inner product. Anchors are the rows whose id is divisible
    by ``every``; their positives are the ``positives`` other rows of their
    label with the highest scores. The negatives of an anchor and a positive
    are the ``negatives`` rows of other labels with the highest scores among
    those of ``least`` to ``most`` per cent of the positive's score. Ties go to
    the smaller id. Vectors are whole numbers; only vectors of one size are
    compared. ``quantised`` gives such rows and says what is left out. No rows,
    no other row of a label or none in the window give no rows.
    """
    spark: SparkSession = rows.sparkSession
    rows = saved(rows, "whole-vectors")
    result = spark.createDataFrame([], RESULT)
    for dim in sorted(r.dim for r in rows.select("dim").distinct().collect()):
        mine = rows.where(F.col("dim") == dim)
        index = Index.build(mine, dim, fanout, sample, chunk_rows)
        anchors = mine.where(F.col("vec_id") % every == 0).select("vec_id", "label", "vector")
        # First the anchor's own leaf: the last of its positives there is a bound for the others.
        near = index.search(anchors.withColumns({"low": F.array(F.lit(ANY[0])), "high": F.array(F.lit(ANY[1]))}), positives, True, own_leaf=True)
        bound = near.where(F.col("rank") == positives).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
        asked = anchors.join(bound, "vec_id", "left").select(
            "vec_id", "label", "vector", F.array(F.coalesce("bound", F.lit(ANY[0]))).alias("low"), F.array(F.lit(ANY[1])).alias("high"))
        found = saved(index.search(asked, positives, True), "positives")
        # A window for each positive: 50 * positive <= 100 * negative <= 95 * positive, in whole numbers.
        exact = F.col("score").cast("decimal(30, 0)")
        low, high = F.ceil(exact * least / 100), F.floor(exact * most / 100)
        windows = (found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", low.cast("bigint").alias("low"), high.cast("bigint").alias("high")))).alias("w"))
                   .withColumnRenamed("query_id", "vec_id"))
        # As many windows for every query; the missing ones hold nothing.
        def ends(name: str, empty: int):
            return F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get(F.col(f"w.{name}"), i - 1), F.lit(empty)))
        asked = anchors.join(windows, "vec_id").select("vec_id", "label", "vector", ends("low", ANY[1]).alias("low"), ends("high", ANY[0]).alias("high"))
        mined = index.search(asked, negatives, False)
        named = found.select(F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), (F.col("rank") - 1).alias("slot"),
                             F.col("score").alias("positive_score"))
        result = result.union(mined.withColumnsRenamed({"query_id": "anchor_id", "vec_id": "negative_id", "score": "negative_score"})
                              .join(named, ["anchor_id", "slot"])
                              .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    return result
