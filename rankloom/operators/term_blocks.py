"""Term postings stored in blocks of documents, searched with bounds that rise and skip.

A row of the table is a block of a few hundred documents: its distinct terms,
for each of them the documents that hold it with their values, and what bounds
the score it can give: greatest and least value and shortest length. A search
scans the blocks where they are, without a join or an exchange. For every
block and query the bounds of the shared terms are added up first; as soon as
the k-th best score that the task has seen is above the sum, the query passes
over the block, and a block that all queries pass over is not unpacked at all.
Pairs of query and document never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.memory import give_back
from .dense import SCORE_BUFFER, BestRows, arrow_id, id_array
from .ranking import SCORE_PLACES, merged, packed_rows, packed_schema

# Documents of a block.
BLOCK_DOCS = 512
# Rows that a task returns at once.
OUT_ROWS = 100_000
# What a rounded score may be above the sum it was rounded from.
SLACK = 10.0 ** -SCORE_PLACES

# ``part(values, lengths)``: what a term gives to a document, before the query's weight; the more
# of a value and the less of a length, the more.
Part = Callable[[np.ndarray, np.ndarray], np.ndarray]

LISTS = {"lengths": pa.int32(), "terms": pa.string(), "sizes": pa.int32(), "most": pa.int32(), "least": pa.int32(),
         "shortest": pa.int32(), "places": pa.int32(), "values": pa.int32()}


def block_schema(doc_id: T.DataType) -> T.StructType:
    kinds = {pa.int32(): T.IntegerType(), pa.string(): T.StringType()}
    return T.StructType([T.StructField("doc_ids", T.ArrayType(doc_id)),
                         *[T.StructField(name, T.ArrayType(kinds[kind])) for name, kind in LISTS.items()]])


def _block(doc_ids: pa.Array, doc: np.ndarray, terms: pa.Array, value: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """One block from entries (position in ``doc_ids``, term, value)."""
    coded = terms.dictionary_encode()
    by_term = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_term), np.int64)
    rank[by_term] = np.arange(len(by_term))
    code = rank[coded.indices.to_numpy()]
    order = np.lexsort((doc, code))
    code, doc, value = code[order], doc[order], value[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    columns = {"lengths": lengths, "terms": coded.dictionary.take(pa.array(by_term)), "sizes": np.diff(np.r_[starts, len(code)]),
               "most": np.maximum.reduceat(value, starts), "least": np.minimum.reduceat(value, starts),
               "shortest": np.minimum.reduceat(lengths[doc], starts), "places": doc, "values": value}

    def row(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    arrays = [row(doc_ids)] + [row(columns[c] if kind == pa.string() else pa.array(columns[c].astype(np.int32))) for c, kind in LISTS.items()]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_ids", *LISTS])


def blocks_of_terms(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks from ``(doc_id, terms ARRAY<STRING>)``: values are counts of terms, lengths numbers of terms.

    Rows without an id or without terms have no place in a block.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("terms")), 0)
            kept = np.flatnonzero(pc.and_(pc.greater(size, 0), batch.column("doc_id").is_valid()).to_numpy(zero_copy_only=False))
            for start in range(0, len(kept), block_docs):
                # Taken block by block: a second copy of all terms of the batch would be as large as the batch.
                part = batch.take(pa.array(kept[start:start + block_docs]))
                lists = part.column("terms")
                lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                key = np.repeat(np.arange(len(lists)), lengths) * np.int64(len(coded.dictionary)) + coded.indices.to_numpy()
                key, count = np.unique(key, return_counts=True)
                doc, code = key // len(coded.dictionary), key % len(coded.dictionary)
                yield _block(part.column("doc_id"), doc, coded.dictionary.take(pa.array(code)), count, lengths)
        give_back()

    return docs.mapInArrow(task, block_schema(docs.schema["doc_id"].dataType))


def renamed_terms(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """The same blocks with every term under its name in ``names(term, stem)``, a small table of all terms; values of one name add up."""
    table = names.select("term", "stem").toArrow()
    shared = blocks.sparkSession.sparkContext.broadcast((table.column("term").combine_chunks(), table.column("stem").combine_chunks()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, stems = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                yield _renamed(batch, at, terms, stems)
        give_back()

    return blocks.mapInArrow(task, blocks.schema)


def renamed_by_exchange(blocks: DataFrame, names: DataFrame, shards: int) -> DataFrame:
    """``renamed_terms`` for any number of terms; ``blocks`` have a ``block``, a number of their own, which is left out.

    One row for each block and term meets the names, not one for each posting, and goes back to its block.
    """
    kept = [f for f in blocks.schema.fields if f.name != "block"]
    # A name of its own for the number, as both sides come from one table.
    terms = blocks.select(F.col("block").alias("home"), F.explode("terms").alias("term")).repartition(shards, "term")
    named = terms.join(names.select("term", "stem").repartition(shards, "term"), "term").select("home", "term", "stem")

    def task(block: pa.Table, own: pa.Table) -> pa.Table:
        batch = block.select([f.name for f in kept]).combine_chunks().to_batches()[0]
        return pa.Table.from_batches([_renamed(batch, 0, own.column("term").combine_chunks(), own.column("stem").combine_chunks())])

    # As many parts as shards, so that no task gets more blocks as the corpus grows.
    mine = blocks.repartition(shards, "block").groupBy("block")
    return mine.cogroup(named.repartition(shards, "home").groupBy("home")).applyInArrow(task, T.StructType(kept))


def _renamed(batch: pa.RecordBatch, at: int, terms: pa.Array, stems: pa.Array) -> pa.RecordBatch:
    lists = _lists(batch, at)
    named = stems.take(pc.index_in(batch.column("terms")[at].values, value_set=terms)).dictionary_encode()
    size = np.int64(len(lists["lengths"]))
    key = np.repeat(named.indices.to_numpy().astype(np.int64), lists["sizes"]) * size + lists["places"]
    key, entry = np.unique(key, return_inverse=True)
    value = np.bincount(entry, lists["values"]).astype(np.int64)
    return _block(batch.column("doc_ids")[at].values, key % size, named.dictionary.take(pa.array(key // size)), value, lists["lengths"].astype(np.int64))


def blocks_of_weights(rows: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks from ``(doc_id, term, weight INT[, dl])`` whose partitions are in order of doc_id; lengths are ``dl``, or 0."""
    measured = "dl" in rows.columns

    def cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("doc_id").combine_chunks()
        own = id_array(ids)
        new = np.r_[True, own[1:] != own[:-1]]
        number = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        for start in range(0, len(firsts), block_docs):
            a = firsts[start]
            b = firsts[start + block_docs] if start + block_docs < len(firsts) else len(own)
            mine = firsts[start:start + block_docs]
            yield _block(ids.take(pa.array(mine)), number[a:b] - start, table.column("term").slice(a, b - a).combine_chunks(),
                         table.column("weight").slice(a, b - a).to_numpy(),
                         table.column("dl").to_numpy()[mine] if measured else np.zeros(len(mine), np.int64))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column("doc_id").is_valid(), batch.column("term").is_valid()))
            held.append(batch)
            size += batch.num_rows
            if size < 500_000:
                continue
            table = pa.Table.from_batches(held)
            own = id_array(table.column("doc_id").combine_chunks())
            # The last document may go on in the next batch.
            last = int(np.flatnonzero(own != own[-1])[-1]) + 1 if (own != own[-1]).any() else 0
            if last:
                yield from cut(table.slice(0, last))
                held = table.slice(last).to_batches()
                size = len(own) - last
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield from cut(table)
        held, table = [], None
        give_back()

    return rows.select("doc_id", "term", "weight", *(["dl"] if measured else [])).mapInArrow(task, block_schema(rows.schema["doc_id"].dataType))


def _lists(batch: pa.RecordBatch, at: int) -> dict[str, np.ndarray]:
    return {c: batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in ("doc_ids", "terms")}


def rows_of(blocks: DataFrame) -> DataFrame:
    """``(doc_id, dl, term, value)``: the stored postings one by one."""
    doc_id = blocks.schema["doc_ids"].dataType.elementType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                lists = _lists(batch, at)
                term = np.repeat(np.arange(len(lists["sizes"])), lists["sizes"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[at].values.take(pa.array(lists["places"])), pa.array(lists["lengths"][lists["places"]].astype(np.int64)),
                     batch.column("terms")[at].values.take(pa.array(term)), pa.array(lists["values"].astype(np.int64))],
                    names=["doc_id", "dl", "term", "value"])
        give_back()

    schema = T.StructType([T.StructField("doc_id", doc_id), *T.StructType.fromDDL("dl long, term string, value long").fields])
    return blocks.select("doc_ids", "lengths", "terms", "sizes", "places", "values").mapInArrow(task, schema)


def block_topk(blocks: DataFrame, weights: DataFrame, k: int, part: Part, looked_at: Accumulator | None = None,
               skipped: Accumulator | None = None) -> DataFrame:
    """``run`` of the k best documents by the sum of weight times part over shared terms.

    ``weights(qid, term, weight)`` are small, which the caller has checked, and
    of either sign. ``looked_at`` and ``skipped`` count pairs of a block and a
    query that share a term, by whether they were scored or passed over.
    """
    spark = blocks.sparkSession
    asked = weights.select("qid", "term", F.col("weight").cast("double").alias("weight")).toArrow()
    vocabulary, order, starts = _by_term(asked)
    qids, owner = np.unique(id_array(asked.column("qid")), return_inverse=True)
    shared = spark.sparkContext.broadcast((qids, vocabulary, starts, owner[order], asked.column("weight").to_numpy()[order]))
    doc_id = blocks.schema["doc_ids"].dataType.elementType
    packed = packed_schema(weights.schema["qid"].dataType, doc_id)
    schema = pa.schema([("qid", arrow_id(packed["qid"])), ("doc_id", pa.list_(arrow_id(T.StructField("doc_id", doc_id)))), ("score", pa.list_(pa.float64()))])
    return merged(blocks.mapInArrow(_task(shared, k, part, schema, looked_at, skipped), packed), k)


def _by_term(asked: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of query rows, the rows in order of them, and where each term starts in this order."""
    coded = asked.column("term").combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    return coded.dictionary.cast(pa.string()), order, np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))


def block_sums(blocks: DataFrame, weights: pa.Table, qid: T.DataType) -> DataFrame:
    """``(qid, doc_id, score LONG)`` of every pair that shares a term: the exact sum of weight times value.

    For blocks that hold all entries of a document, so that a pair is summed up
    where its block lies and nothing is exchanged. ``weights(qid, term, weight
    LONG)`` are small, which the caller has checked, and no weight is null.
    """
    asked = weights.filter(weights.column("term").is_valid())
    vocabulary, order, starts = _by_term(asked)
    coded = asked.column("qid").combine_chunks().dictionary_encode(null_encoding="encode")
    shared = blocks.sparkSession.sparkContext.broadcast(
        (coded.dictionary, vocabulary, starts, coded.indices.to_numpy()[order], asked.column("weight").to_numpy()[order]))
    out = T.StructType([T.StructField("qid", qid), T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), T.StructField("score", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vocabulary, starts, owner, weight = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                held, codes = _held(batch, at, vocabulary)
                if not len(held):
                    continue
                lists, ids = _lists(batch, at), batch.column("doc_ids")[at].values
                query, factor, term = _entries(held, codes, starts, owner, weight)
                for asking, cell, place, by in _portions(query, factor, term, lists, len(ids)):
                    touched, sums = _whole_sums(cell, by * lists["values"][place].astype(np.int64), len(asking) * len(ids))
                    for a in range(0, len(touched), OUT_ROWS):
                        cut = touched[a:a + OUT_ROWS]
                        yield pa.RecordBatch.from_arrays(
                            [qids.take(pa.array(asking[cut // len(ids)])), ids.take(pa.array(cut % len(ids))), pa.array(sums[a:a + OUT_ROWS])],
                            names=["qid", "doc_id", "score"])
        give_back()

    return blocks.select("doc_ids", "terms", "sizes", "places", "values").mapInArrow(task, out)


def _whole_sums(cell: np.ndarray, value: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that have entries, in order, and the sums of their whole numbers."""
    if 8 * len(cell) > cells:
        touched = np.flatnonzero(np.bincount(cell, minlength=cells))
        size = cells
    else:
        touched, cell = np.unique(cell, return_inverse=True)
        size = len(touched)
    # A double holds whole numbers up to 2 ** 53.
    if np.abs(value.astype(np.float64)).sum() < 2.0 ** 53:
        sums = np.bincount(cell, weights=value, minlength=size).astype(np.int64)
    else:
        sums = np.zeros(size, np.int64)
        np.add.at(sums, cell, value)
    return touched, sums[touched] if size == cells else sums


def _task(shared, k: int, part: Part, schema: pa.Schema, looked_at, skipped):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vocabulary, starts, owner, weight = shared.value
        best = BestRows(len(qids), k)
        seen = passed = 0
        for batch in batches:
            for at in range(batch.num_rows):
                held, codes = _held(batch, at, vocabulary)
                if not len(held):
                    continue
                lists = _lists(batch, at)
                a, b = _score(best, lists, held, codes, starts, owner, weight, part, id_array(batch.column("doc_ids")[at].values))
                seen, passed = seen + a, passed + b
        if looked_at is not None:
            looked_at.add(seen)
        if skipped is not None:
            skipped.add(passed)
        best.merge()
        for q, s, d in best.parts:
            yield from packed_rows(q, s, d, qids, schema)
        give_back()

    return task


def _held(batch: pa.RecordBatch, at: int, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a block's terms that a query asks for, and their positions in the vocabulary."""
    codes = pc.index_in(batch.column("terms")[at].values, value_set=vocabulary).to_numpy(zero_copy_only=False)
    held = np.flatnonzero(~np.isnan(codes) if codes.dtype.kind == "f" else codes >= 0)
    return held, codes[held].astype(np.int64)


def _entries(held: np.ndarray, codes: np.ndarray, starts: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, weight and position of the term for each pair of a term of the block and a query that holds it."""
    uses = starts[codes + 1] - starts[codes]
    entry = np.repeat(starts[codes] - np.r_[0, np.cumsum(uses)[:-1]], uses) + np.arange(uses.sum())
    return owner[entry], weight[entry], np.repeat(held, uses)


def _portions(query: np.ndarray, factor: np.ndarray, term: np.ndarray, lists: dict, docs: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The postings that the entries ask for, whole queries at a time, as many as the buffer has room for.

    Yields the queries, and for each posting its cell in a matrix of them and the documents, its place in the block and the weight.
    """
    order = np.argsort(query, kind="stable")
    query, factor, term = query[order], factor[order], term[order]
    begins = np.cumsum(lists["sizes"]) - lists["sizes"]
    length = lists["sizes"][term]
    upto = np.cumsum(length)
    firsts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    room = max(1, SCORE_BUFFER // docs)
    at = 0
    while at < len(firsts):
        begin = firsts[at]
        base = upto[begin] - length[begin]
        last = int(np.searchsorted(upto[np.r_[firsts[1:], len(query)] - 1], base + SCORE_BUFFER, "right"))
        last = max(at + 1, min(last, at + room))
        cut = slice(begin, firsts[last] if last < len(firsts) else len(query))
        size = length[cut]
        place = np.repeat(begins[term[cut]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        asking = query[firsts[at:last]]
        row = np.repeat(np.searchsorted(asking, query[cut]), size)
        yield asking, row * docs + lists["places"][place], place, np.repeat(factor[cut], size)
        at = last


def _score(best: BestRows, lists: dict, held: np.ndarray, codes: np.ndarray, starts: np.ndarray, owner: np.ndarray, weight: np.ndarray,
           part: Part, ids: np.ndarray) -> tuple[int, int]:
    """Score one block for the queries whose bound reaches their floor; numbers of queries scored and passed over."""
    query, factor, term = _entries(held, codes, starts, owner, weight)
    uses = starts[codes + 1] - starts[codes]
    high = part(lists["most"][held], lists["shortest"][held])
    low = part(lists["least"][held], lists["shortest"][held])
    # A document without the term gets nothing, so a bound is never below 0.
    bound = np.maximum(factor * np.repeat(high, uses), np.maximum(factor * np.repeat(low, uses), 0.0))
    bounds = np.bincount(query, bound, len(best.floor))
    sharing = np.bincount(query, minlength=len(best.floor)) > 0
    active = sharing & (bounds + SLACK >= best.floor)
    if not active.any():
        return 0, int(sharing.sum())
    mine = active[query]
    every = part(lists["values"], lists["lengths"][lists["places"]])
    for asking, cell, place, by in _portions(query[mine], factor[mine], term[mine], lists, len(ids)):
        _add(best, asking, cell, by * every[place], ids)
    return int(active.sum()), int(sharing.sum() - active.sum())


def _add(best: BestRows, asking: np.ndarray, cell: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
    """Sum the entries of every (query, document) cell and offer the sums; a cell with an entry counts whatever its sum."""
    cells = len(asking) * len(ids)
    if 8 * len(cell) > cells:
        sums = np.round(np.bincount(cell, weights=value, minlength=cells), SCORE_PLACES)
        sums[np.bincount(cell, minlength=cells) == 0] = -np.inf
        best.add(asking, sums.reshape(len(asking), len(ids)), ids)
    else:
        touched, place = np.unique(cell, return_inverse=True)
        sums = np.bincount(place, weights=value, minlength=len(touched))
        best.offer(asking[touched // len(ids)], np.round(sums, SCORE_PLACES), ids[touched % len(ids)])
