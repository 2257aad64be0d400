"""Nearest neighbours by one navigable small-world graph for each shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import saved

# Links of a node, twice as many in the bottom layer; candidates looked at for a new node and for a query.
LINKS, EF_BUILD, EF_SEARCH = 16, 64, 160
# Rows of a shard on average; a shard's vectors and a block of queries are one row of a table each.
SHARD_ROWS = 8192
QUERY_BLOCK = 1024
# New nodes that get their candidates from one matrix product.
STEP = 256

GRAPH = "dim int, part int, ids binary, vectors binary, first binary, layers array<struct<nodes: binary, links: binary>>"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, vector, dim)`` as doubles, without rows whose id or vector is null, or whose vector is zero, empty or not finite.

    Of rows with one id the least vector stays.
    """
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    taken = (vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite & F.exists(embedding, lambda x: x != 0))
             .select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")))
    return taken.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def _spread(distance: np.ndarray, between: np.ndarray, most: int) -> list[int]:
    """Of candidates, nearest first, those nearer to the node than to any taken before, then the nearest others."""
    taken: list[int] = []
    for k in range(len(distance)):
        if len(taken) == most:
            break
        if not taken or distance[k] < between[k, taken].min():
            taken.append(k)
    others = [k for k in range(len(distance)) if k not in set(taken)]
    return taken + others[:most - len(taken)]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _layer(vectors: np.ndarray, most: int) -> np.ndarray:
    """Links of one layer as rows of node numbers, -1 where there are fewer.

    Nodes come in order; a node links to a spread choice of the nearest nodes
    that came before it, and these link back. A node with too many links keeps
    a spread choice of them.
    """
    n = len(vectors)
    near: list[list[int]] = [[] for _ in range(n)]

    def pruned(node: int) -> list[int]:
        among = np.array(sorted(set(near[node])))
        distance = _squares(vectors[node:node + 1], vectors[among])[0]
        among = among[np.argsort(distance, kind="stable")[:EF_BUILD]]
        return list(among[_spread(np.sort(distance)[:EF_BUILD], _squares(vectors[among], vectors[among]), most)])

    for start in range(0, n, STEP):
        end = min(start + STEP, n)
        apart = _squares(vectors[start:end], vectors[:end])
        for node in range(start, end):
            if node == 0:
                continue
            before = apart[node - start, :node]
            among = np.argpartition(before, EF_BUILD)[:EF_BUILD] if node > EF_BUILD else np.arange(node)
            among = among[np.argsort(before[among], kind="stable")]
            chosen = among[_spread(before[among], _squares(vectors[among], vectors[among]), max(most // 2, 1))]
            near[node] += chosen.tolist()
            for other in chosen.tolist():
                near[other].append(node)
                if len(near[other]) >= 2 * most:
                    near[other] = pruned(other)
    links = np.full((n, most), -1, np.int32)
    for node in range(n):
        kept = near[node] if len(near[node]) <= most else pruned(node)
        links[node, :len(kept)] = kept
    return links


def build_graph(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """The graph of one shard as flat arrays. Equal vectors share a node: ``first`` says where a node's ids begin."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    first = np.flatnonzero(np.r_[True, (vectors[1:] != vectors[:-1]).any(1)])
    # Nodes in an order that has nothing to do with their place.
    shuffle = np.random.default_rng(len(ids)).permutation(len(first))
    points = vectors[first][shuffle]
    layers, size = [], len(points)
    while True:
        # Layer sizes fall by the number of links; a layer holds the nodes that came first.
        layers.append({"nodes": np.arange(size, dtype="<i4").tobytes(),
                       "links": _layer(points[:size], 2 * LINKS if not layers else LINKS).astype("<i4").tobytes()})
        if size <= LINKS:
            break
        size = -(-size // LINKS)
    ends = np.r_[first[1:], len(ids)]
    members = np.concatenate([ids[first[k]:ends[k]] for k in shuffle])
    starts = np.r_[0, np.cumsum((ends - first)[shuffle])]
    return {"ids": members.astype("<i8").tobytes(), "vectors": points.astype("<f8").tobytes(),
            "first": starts.astype("<i8").tobytes(), "layers": layers}


class Graph:
    """A shard's graph, read back from its row."""

    def __init__(self, row: dict):
        self.ids, self.first = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["first"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
        self.layers = []
        for layer in row["layers"]:
            n = len(layer["nodes"]) // 4
            self.layers.append(np.frombuffer(layer["links"], "<i4").reshape(n, -1))

    def _beam(self, query: np.ndarray, links: np.ndarray, entries: list[int], ef: int) -> list[tuple[float, int]]:
        seen = np.zeros(len(links), bool)
        seen[entries] = True
        apart = self.vectors[entries] - query
        ahead = [(float(d), e) for d, e in zip((apart * apart).sum(1), entries)]
        best = [(-d, e) for d, e in ahead]
        heapq.heapify(ahead)
        heapq.heapify(best)
        while ahead:
            distance, node = heapq.heappop(ahead)
            if len(best) >= ef and distance > -best[0][0]:
                break
            new = links[node]
            new = new[new >= 0]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            apart = self.vectors[new] - query
            for d, e in zip((apart * apart).sum(1).tolist(), new.tolist()):
                if len(best) < ef or d < -best[0][0]:
                    heapq.heappush(ahead, (d, e))
                    heapq.heappush(best, (-d, e))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, e) for d, e in best)

    def search(self, query_id: int, query: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and distances of the k nearest found, without the query's own id."""
        at = [0]
        for links in self.layers[:0:-1]:
            at = [self._beam(query, links, at, 1)[0][1]]
        nodes = np.array([e for _, e in self._beam(query, self.layers[0], at, max(ef, k + 1))])
        # Exact distances; of a node's equal vectors no more than k besides the query can count.
        distance = np.sqrt(((self.vectors[nodes] - query) ** 2).sum(1))
        ids = [self.ids[self.first[n]:min(self.first[n] + k + 1, self.first[n + 1])] for n in nodes]
        distance = np.repeat(distance, [len(i) for i in ids])
        ids = np.concatenate(ids)
        other = ids != query_id
        ids, distance = ids[other], distance[other]
        best = np.lexsort((ids, distance))[:k]
        return ids[best], distance[best]


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The stored index of ``usable`` vectors, a row for each shard and dimension, and the number of shards.

    Every vector is in one shard, by the hash of its id; a shard has about ``shard_rows`` rows.
    """
    parts = max(1, -(-vectors.count() // shard_rows))

    def build(table: pa.Table) -> pa.Table:
        dim, part = table["dim"][0].as_py(), table["part"][0].as_py()
        found = build_graph(table["vec_id"].to_numpy().astype(np.int64),
                            table["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
        kind = pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())]))
        return pa.table({"dim": pa.array([dim], pa.int32()), "part": pa.array([part], pa.int32()),
                         "ids": pa.array([found["ids"]], pa.binary()), "vectors": pa.array([found["vectors"]], pa.binary()),
                         "first": pa.array([found["first"]], pa.binary()), "layers": pa.array([found["layers"]], kind)})

    sharded = vectors.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.lit(parts)).cast("int"))
    return saved(sharded.groupBy("dim", "part").applyInArrow(build, GRAPH), "graphs"), parts


def _query_blocks(queries: DataFrame, parts: int, block: int) -> DataFrame:
    """Queries packed into blocks, each for every shard."""
    blocks = max(1, -(-queries.count() // block))

    def pack(table: pa.Table) -> pa.Table:
        values = table["vector"].combine_chunks().flatten().to_numpy()
        return pa.table({"dim": table["dim"].slice(0, 1), "query_ids": pa.array([table["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                         "queries": pa.array([values.astype("<f8").tobytes()], pa.binary())})

    dealt = queries.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)))
    packed = dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, query_ids binary, queries binary")
    return packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def nearest(index: DataFrame, parts: int, queries: DataFrame, k: int = 10, ef: int = EF_SEARCH, block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of every query's dimension, ties to the smaller id.

    Every shard is searched for every block of queries; a task holds one shard
    and one block. Each shard gives k rows a query, which are then merged.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                graph = Graph(row)
                ids = np.frombuffer(row["query_ids"], "<i8")
                points = np.frombuffer(row["queries"], "<f8").reshape(len(ids), -1)
                found = [graph.search(int(i), p, k, ef) for i, p in zip(ids, points)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])),
                    pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "vec_id", "score"])

    # No broadcast: a side is as large as all vectors, though of few rows.
    joined = index.hint("merge").join(_query_blocks(queries, parts, block), ["dim", "part"])
    found = joined.mapInArrow(rows, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search_every(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Nearest neighbours of the rows whose id is divisible by ``every`` among all other rows.

    Rows without a usable vector take no part; vectors of another dimension
    than the query's are no candidates. With fewer than k candidates all come.
    Other columns are ignored; no usable rows give no rows.
    """
    vectors = saved(usable(embeddings), "vectors")
    index, parts = build_index(vectors)
    return nearest(index, parts, vectors.where(F.col("vec_id") % every == 0), k)
