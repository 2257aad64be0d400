"""k best vectors of every query by inner product, exact over what is scanned.

Two plans with the same result:

* the query side is small (measured): it is broadcast, every task scans its
  own part of the vectors in blocks and keeps k rows per query;
* the query side is large: it is cut into chunks under the limit and each chunk
  is broadcast in turn. A chunk scans the vectors where they are, so no vector
  is ever shuffled, and a task leaves k rows per query for its whole split.

With ``cell`` columns on both sides only vectors of probed cells are scored;
queries of one nearest cell then share a chunk, which reads few partitions.

Scores are formed in double precision. Those that cannot be among the k best by
their product in single precision, less its largest error, are never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.memory import give_back
from ..plans.staging import BROADCAST_BYTES, is_small, new_path, staged
from .ranking import SCORE_PLACES, merge_tasks, merged, packed_rows, packed_schema, top_k

# Chunks of queries in work at a time; a task holds one of them.
CHUNKS_AT_ONCE = 3
# Scores held at once while a batch is scanned.
SCORE_BUFFER = 1_000_000
# Bytes of decoded vectors that are scored together, and the queries and vectors of one product in single precision.
DECODED_BYTES = 16_000_000
BLOCK_QUERIES, BLOCK_ROWS = 256, 4096
# Vectors of which only the best score is compared, where k is small against a block.
GROUP = 16
# Largest component that single precision takes here, so that no product of two leaves its range.
LARGEST = 1e15

Decoder = Callable[[pa.Array], np.ndarray]
# ``product(queries)(column)(positions of queries, positions of rows)``: a matrix of scores. The first step is made
# once for a scan, the second once for each Arrow batch.
Product = Callable[[np.ndarray], Callable[[pa.Array], Callable[[np.ndarray, np.ndarray | slice], np.ndarray]]]


def list_matrix(column) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix, without a row loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(rows, -1) if rows else np.zeros((0, 0))


def plain(column) -> np.ndarray:
    return list_matrix(column)


def id_array(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ids = column.to_numpy(zero_copy_only=False)
    # Strings of fixed width sort and compare fast; ids of other kinds, such as decimals, stay objects.
    return ids.astype(str) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else ids


class BestRows:
    """The k best (score, id) of each query over the blocks seen so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = self.kept = 0

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        n = scores.shape[1]
        floor = self.floor[rows]
        if n >= self.k:
            # The k-th best of any block bounds the final k-th best from below.
            floor = np.maximum(floor, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
            self.floor[rows] = floor
        q, c = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        self._keep(rows[q], scores[q, c], ids[c])

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Single (query, score, id) candidates instead of a full block."""
        good = scores >= self.floor[rows]
        self._keep(rows[good], scores[good], ids[good])

    def _keep(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((rows, scores, ids))
        self.pending += len(rows)
        # Often enough that the floors rise while there is something to save.
        if self.pending > self.kept + min(1_000_000, max(50_000, 2 * self.k * len(self.floor))):
            self.merge()

    def merge(self) -> None:
        if not self.parts:
            return
        columns, self.parts = list(zip(*self.parts)), []
        q, s, i = (np.concatenate(column) for column in columns)
        # The parts are as large as what was made of them.
        del columns
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        keep = place < self.k
        self.parts = [(q[keep], s[keep], i[keep])]
        self.kept, self.pending = int(keep.sum()), 0


def _score_block(best: BestRows, rows: np.ndarray, qids: np.ndarray, ids: np.ndarray, product, inside: np.ndarray | slice,
                 skip_identical: bool) -> None:
    own = ids[inside]
    step = max(1, SCORE_BUFFER // max(1, len(own)))
    for start in range(0, len(rows), step):
        part = rows[start:start + step]
        scores = np.round(product(part, inside), SCORE_PLACES)
        if skip_identical and len(own):
            _drop_own(scores, own, qids[part])
        best.add(part, scores, own)


def _drop_own(scores: np.ndarray, ids: np.ndarray, asked: np.ndarray) -> None:
    """Take a query's own id out of its row of scores."""
    # Ids of unlike types are compared as text.
    own, asked = (ids, asked) if ids.dtype.kind == asked.dtype.kind else (ids.astype(str), asked.astype(str))
    order = np.argsort(own, kind="stable")
    at = np.searchsorted(own[order], asked)
    upto = np.searchsorted(own[order], asked, side="right")
    for r in np.nonzero(upto > at)[0]:
        scores[r, order[at[r]:upto[r]]] = -np.inf


class Screen:
    """The k best rows of each query by products in single precision, and the few of them that may count in double precision.

    The maxima of groups of rows are scores of different rows, so k rows reach
    the k-th best maximum, less the error of single precision. Only groups
    that come up to it are looked into.
    """

    def __init__(self, best: BestRows, queries: np.ndarray):
        self.best, self.queries = best, queries
        self.norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        # False for a query with components out of range.
        self.fit = np.abs(queries).max(axis=1, initial=0.0) <= LARGEST
        # Scores that k rows seen so far are sure to reach.
        self.sure = np.full((len(queries), best.k), -np.inf, np.float32)
        self.group = max(1, min(GROUP, BLOCK_ROWS // 16 // max(1, best.k)))
        self.scores = np.empty(BLOCK_QUERIES * (BLOCK_ROWS + self.group), np.float32)

    def takes(self, vectors: np.ndarray) -> bool:
        return bool(np.abs(vectors).max(initial=0.0) <= LARGEST)

    def add(self, asking: np.ndarray, qids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, skip_identical: bool) -> None:
        """Score ``vectors`` for the queries at the positions ``asking``."""
        odd = asking[~self.fit[asking]]
        if len(odd):
            _score_block(self.best, odd, qids, ids, lambda part, rows: self.queries[part] @ vectors[rows].T, slice(None), skip_identical)
            asking = asking[self.fit[asking]]
        single = vectors.astype(np.float32)
        # Components and sums are rounded once for each component, and a few times more below; scores are rounded to their places.
        error = (vectors.shape[1] + 16) * 2.0 ** -24 * np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0.0))
        places = 0.6 * 10.0 ** -SCORE_PLACES
        own = _own_rows(ids, qids[asking]) if skip_identical else None
        for start in range(0, len(asking), BLOCK_QUERIES):
            part = asking[start:start + BLOCK_QUERIES]
            self._block(part, single, vectors, ids, (error * self.norms[part] + places).astype(np.float32),
                        own(start, start + len(part)) if own else (np.empty(0, int),) * 2)

    def _block(self, part, single, vectors, ids, error, own) -> None:
        queries = self.queries[part]
        asked, sure, floor = queries.astype(np.float32), self.sure[part], self.best.floor[part].astype(np.float32)
        cut = np.maximum(sure.min(1), floor) - error
        found, held = [], 0
        for at in range(0, len(single), BLOCK_ROWS):
            rows = single[at:at + BLOCK_ROWS]
            groups = -(-len(rows) // self.group)
            scores = self.scores[:len(part) * groups * self.group].reshape(len(part), -1)
            np.matmul(asked, rows.T, out=scores[:, :len(rows)])
            scores[:, len(rows):] = -np.inf
            inside = (own[1] >= at) & (own[1] < at + len(rows))
            scores[own[0][inside], own[1][inside] - at] = -np.inf
            # Row r of the block is in group r % groups.
            lanes = scores.reshape(len(part), self.group, groups)
            best = lanes.max(1)
            hit = best >= cut[:, None]
            higher = np.flatnonzero(hit.any(1))
            if not len(higher):
                continue
            reached = np.concatenate([sure[higher], best[higher] - error[higher, None]], axis=1)
            sure[higher] = np.partition(reached, groups, axis=1)[:, groups:]
            cut = np.maximum(sure.min(1), floor) - error
            hit = best >= cut[:, None]
            q, g = np.divmod(np.flatnonzero(hit), groups)
            near = lanes[q, :, g]
            c, lane = np.nonzero((near >= cut[q, None]) & (near > -np.inf))
            found.append((q[c], at + lane * groups + g[c], near[c, lane]))
            held += len(c)
            if held > SCORE_BUFFER:
                self._offer(part, queries, vectors, ids, found, cut)
                found, held = [], 0
        self.sure[part] = sure
        self._offer(part, queries, vectors, ids, found, cut)

    def _offer(self, part, queries, vectors, ids, found, cut) -> None:
        """Scores in double precision of what single precision leaves, now that more rows have been seen."""
        if not found:
            return
        q, r, near = (np.concatenate(column) for column in zip(*found))
        left = near >= cut[q]
        q, r = q[left], r[left]
        scores = np.empty(len(q))
        step = max(1, DECODED_BYTES // max(1, queries[:1].nbytes))
        for at in range(0, len(q), step):
            pairs = slice(at, at + step)
            scores[pairs] = np.einsum("ij,ij->i", queries[q[pairs]], vectors[r[pairs]])
        self.best.offer(part[q], np.round(scores, SCORE_PLACES), ids[r])


def _own_rows(ids: np.ndarray, asked: np.ndarray) -> Callable[[int, int], tuple[np.ndarray, np.ndarray]]:
    """A function that gives the positions of queries ``start`` to ``stop``, from 0, and of the rows that carry their ids."""
    # Ids of unlike types are compared as text.
    ids, asked = (ids, asked) if ids.dtype.kind == asked.dtype.kind else (ids.astype(str), asked.astype(str))
    order = np.argsort(ids, kind="stable")
    first, upto = (np.searchsorted(ids[order], asked, side=side) for side in ("left", "right"))

    def of(start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        n = upto[start:stop] - first[start:stop]
        q = np.repeat(np.arange(len(n)), n)
        return q, order[np.arange(len(q)) - np.repeat(np.cumsum(n) - n - first[start:stop], n)]

    return of


def _screen_task(shared, k: int, payload: str, decode: Decoder, skip_identical: bool, schema: pa.Schema):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries, probes = shared.value
        best = BestRows(len(qids), k)
        screen, everyone = Screen(best, queries), np.arange(len(qids))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []

        def scan() -> None:
            if not held:
                return
            ids, vectors = (np.concatenate(c) for c in zip(*((i, v) for i, v, _ in held)))
            cells = None if probes is None else np.concatenate([c for *_, c in held])
            held.clear()
            for cell in [None] if probes is None else np.unique(cells):
                asking = everyone if probes is None else probes.get(int(cell))
                if asking is not None:
                    inside = slice(None) if probes is None else cells == cell
                    screen.add(asking, qids, vectors[inside], ids[inside], skip_identical)

        size = 0
        for batch in batches:
            vectors = decode(batch.column(payload))
            if not len(vectors):
                continue
            ids = id_array(batch.column("doc_id"))
            cells = None if probes is None else batch.column("cell").to_numpy()
            if screen.takes(vectors):
                held.append((ids, vectors, cells))
                size += vectors.nbytes
                if size < DECODED_BYTES:
                    continue
                scan()
            else:
                scan()
                _score_batch(best, everyone, probes, qids, ids, cells, lambda part, rows: queries[part] @ vectors[rows].T, skip_identical)
            size = 0
        scan()
        best.merge()
        for q, s, d in best.parts:
            yield from packed_rows(q, s, d, qids, schema)
        give_back()

    return task


def _score_batch(best: BestRows, everyone, probes, qids, ids, cells, product, skip_identical: bool) -> None:
    if probes is None:
        _score_block(best, everyone, qids, ids, product, slice(None), skip_identical)
        return
    for cell in np.unique(cells):
        asking = probes.get(int(cell))
        if asking is not None:
            _score_block(best, asking, qids, ids, product, np.flatnonzero(cells == cell), skip_identical)


def _scan_task(shared, k: int, payload: str, score: Product, skip_identical: bool, schema: pa.Schema):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries, probes = shared.value
        best = BestRows(len(qids), k)
        everyone, of_batch = np.arange(len(qids)), score(queries)
        for batch in batches:
            ids, product = id_array(batch.column("doc_id")), of_batch(batch.column(payload))
            cells = None if probes is None else batch.column("cell").to_numpy()
            _score_batch(best, everyone, probes, qids, ids, cells, product, skip_identical)
        best.merge()
        for q, s, d in best.parts:
            yield from packed_rows(q, s, d, qids, schema)
        give_back()

    return task


def arrow_id(field: T.StructField) -> pa.DataType:
    return to_arrow_type(field.dataType)


def search(queries: DataFrame, vectors: DataFrame, k: int, payload: str = "vector", decode: Decoder = plain,
           skip_identical: bool = False, broadcast_bytes: int | None = None,
           query_block: int | None = None, product: Product | None = None, query_bytes: int = 0,
           prune: Callable[[list[int]], Column] | None = None) -> DataFrame:
    """``run(qid, doc_id, score, rank)``.

    ``queries(qid, vector[, cells ARRAY<INT>])``, ``vectors(doc_id, payload[, cell])``.
    ``decode`` turns the payload column of an Arrow batch into a float matrix;
    a ``product`` scores the column without decoding it, and ``query_bytes`` is
    what it holds of each query as long as the scan goes on. ``prune`` is a condition on the stored rows
    that holds for all rows of the given cells.
    """
    probing = "cells" in queries.columns
    # A row without an id can be neither asked for nor returned.
    stored = vectors.where(F.col(payload).isNotNull() & F.col("doc_id").isNotNull())
    out = packed_schema(queries.schema["qid"].dataType, vectors.schema["doc_id"].dataType)

    def scan(part: DataFrame) -> DataFrame:
        table = part.toArrow()
        qids, matrix, probes = id_array(table.column("qid")), list_matrix(table.column("vector")), None
        rows = stored
        if probing:
            cells = table.column("cells").combine_chunks()
            flat = cells.flatten().to_numpy()
            owner = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
            probes = {int(c): owner[flat == c] for c in np.unique(flat)}
            # A literal list of probed cells prunes the partitions of a stored index.
            rows = rows.where(F.col("cell").isin(list(probes)))
            rows = rows.where(prune(list(probes))) if prune else rows
        rows = rows.select("doc_id", payload, *(["cell"] if probing else []))
        shared = rows.sparkSession.sparkContext.broadcast((qids, matrix, probes))
        task = _scan_task(shared, k, payload, product, skip_identical, packed_arrow(out)) if product else \
            _screen_task(shared, k, payload, decode, skip_identical, packed_arrow(out))
        return rows.mapInArrow(task, out)

    # A screen holds 4 bytes more of each of the k rows.
    return in_chunks(queries, k, scan, broadcast_bytes, query_block, query_bytes if product else query_bytes + 4 * k + 16)


def packed_arrow(out: T.StructType) -> pa.Schema:
    doc_id = T.StructField("doc_id", out["doc_id"].dataType.elementType)
    return pa.schema([("qid", arrow_id(out["qid"])), ("doc_id", pa.list_(arrow_id(doc_id))), ("score", pa.list_(pa.float64()))])


def in_chunks(queries: DataFrame, k: int, scan: Callable[[DataFrame], DataFrame], broadcast_bytes: int | None = None,
              query_block: int | None = None, query_bytes: int = 0) -> DataFrame:
    """The run of ``scan`` over all queries that have an id and a vector, as many at once as the limit for broadcasts allows."""
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    probing = "cells" in queries.columns
    wanted = ["qid", "vector"] + (["cells"] if probing else [])
    # Fresh column identities, as both sides may come from one table.
    queries = queries.where(F.col("vector").isNotNull() & F.col("qid").isNotNull()).select(*[F.col(c).alias(c) for c in wanted])
    # What one task holds: the query side, and 24 bytes for each of k rows per
    # query, which are sorted and copied there as the scan goes on.
    row = F.size("vector") * 8 + F.lit(16 + k * 24 + query_bytes) + (F.size("cells") * 8 if probing else F.lit(0))
    held, rows = queries.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    if held <= limit:
        return _merged(scan(queries), k, rows)
    # As many queries in a chunk as a task may hold.
    query_block = query_block or max(1, limit * rows // held)
    # Once on disk, as every chunk reads them.
    stored = staged(queries, "queries")
    spark = stored.sparkSession
    path = new_path(spark, "chunked-run")

    def run(numbered: tuple[int, DataFrame]) -> tuple[str, T.StructType]:
        number, part = numbered
        found = _merged(scan(part), k, query_block)
        # A folder each, as writers of one folder end each other's work.
        found.write.parquet(f"{path}/{number}")
        return f"{path}/{number}", found.schema

    # Tasks of the next chunk fill the cores that the last tasks of a chunk, its merging and its way through the driver leave idle.
    with ThreadPoolExecutor(CHUNKS_AT_ONCE) as pool:
        paths, kinds = zip(*pool.map(inheritable_thread_target(spark)(run), enumerate(_chunks(stored, query_block, probing))))
    return spark.read.schema(kinds[0]).parquet(*paths)


def _merged(packed: DataFrame, k: int, queries: int) -> DataFrame:
    return merged(packed, k, tasks=merge_tasks(packed, queries * k))


def _chunks(queries: DataFrame, size: int, probing: bool) -> Iterator[DataFrame]:
    """The queries in parts of about ``size``, cut by the hash of the id or, where cells are probed, by nearest cell first."""
    nearest = F.element_at("cells", 1) if probing else F.lit(0)
    # One row a cell, as many as the trained model has.
    counts = sorted(queries.groupBy(nearest.alias("cell")).count().collect())
    packed: list[int] = []
    room = size
    for cell, n in counts:
        if packed and n > room:
            yield queries.where(nearest.isin(packed))
            packed, room = [], size
        if n <= size:
            packed.append(cell)
            room -= n
        else:
            parts = -(-n // size)
            for k in range(parts):
                yield queries.where((nearest == cell) & (F.pmod(F.xxhash64("qid"), F.lit(parts)) == k))
    if packed:
        yield queries.where(nearest.isin(packed))


def rerank(run: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k best of ``run``'s candidates by their exact inner products.

    ``run(qid, doc_id)``, ``queries(qid, vector)``, ``vectors(doc_id, vector)``.
    Only the candidates' vectors are read against their queries; the run and
    the queries are broadcast as far as their measured size allows.
    """
    pairs = staged(run.select("qid", "doc_id").distinct(), "candidates")
    asked = queries.where(F.col("vector").isNotNull()).select(F.col("qid").alias("qid"), F.col("vector").alias("asked"))
    pairs = pairs.join(F.broadcast(asked) if is_small(asked) else asked, "qid")
    stored = vectors.where(F.col("vector").isNotNull()).select("doc_id", "vector")
    found = stored.join(F.broadcast(pairs) if is_small(pairs) else pairs, "doc_id").select("qid", "doc_id", "asked", "vector")
    out = T.StructType([run.schema["qid"], run.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.einsum("ij,ij->i", list_matrix(batch.column("asked")), list_matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("doc_id"), pa.array(np.round(scores, SCORE_PLACES))],
                                             names=["qid", "doc_id", "score"])

    return top_k(found.mapInArrow(task, out), k)
