"""Benchmark passages in training documents, found with a positional inverted index."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import as_bytes, chunks, saved

# Lower-case letters, digits and everything beyond ASCII; on UTF-8 bytes this is the same as on characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
# Free positions between two documents of an index block, so that no phrase, near or exact, runs across.
GAP = 32
# Benchmark text that one broadcast holds; a larger benchmark is sent in several.
ITEM_BYTES = 8 * 1024 * 1024

INDEX = ("terms binary, term_ends binary, places binary, doc_starts binary, doc_words binary, docs array<{0}>")


def words(text: bytes | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z; none for null."""
    return WORD.findall(text.lower()) if text else []


def build_index(docs: DataFrame) -> DataFrame:
    """Postings of all words of all documents: one row for each block of documents.

    A block of about 4 MB of text (one document at least) numbers its words
    through, with a gap after each document. ``terms`` are its distinct words,
    sorted, ``places`` the sorted numbers of each term's words one term after
    the other, ``term_ends`` where each term's stop.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = as_bytes(batch.column("text"))
            number: dict[bytes, int] = {}
            ids, sizes = [], []
            for text in texts:
                found = words(text)
                sizes.append(len(found))
                ids += map(number.setdefault, found, count(len(ids)))
            # A word's id so far is where it came first; make it its place in sorted order.
            first = np.fromiter(ids, np.int64, len(ids))
            terms = sorted(number)
            order = np.zeros(len(ids), np.int32)
            order[np.fromiter(map(number.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms))
            term = order[first]
            sizes = np.array(sizes, np.int64)
            starts = np.r_[0, np.cumsum(sizes + GAP)[:-1]]
            place = np.arange(len(term)) + np.repeat(np.arange(len(sizes)) * GAP, sizes)
            by_term = np.argsort(term, kind="stable")
            ends = np.cumsum(np.bincount(term, minlength=len(terms)))
            yield pa.RecordBatch.from_arrays([
                pa.array([b" ".join(terms)], pa.binary()), pa.array([ends.astype("<i4").tobytes()], pa.binary()),
                pa.array([place[by_term].astype("<i4").tobytes()], pa.binary()), pa.array([starts.astype("<i8").tobytes()], pa.binary()),
                pa.array([sizes.astype("<i4").tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id")),
            ], ["terms", "term_ends", "places", "doc_starts", "doc_words", "docs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, INDEX.format(kind))


class Block:
    """One row of the index, opened for the terms of a test set."""

    def __init__(self, row: dict, numbers: dict[bytes, int]):
        ends = np.frombuffer(row["term_ends"], "<i4")
        self.places = np.frombuffer(row["places"], "<i4")
        self.starts = np.frombuffer(row["doc_starts"], "<i8")
        self.sizes = np.frombuffer(row["doc_words"], "<i4").astype(np.int64)
        self.docs = row["docs"]
        # First and last posting of every test term; equal where the block lacks it.
        self.low, self.high = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        terms = row["terms"].split(b" ") if len(ends) else []
        mine = np.fromiter(map(numbers.get, terms, [-1] * len(terms)), np.int64, len(terms))
        at = np.flatnonzero(mine >= 0)
        self.low[mine[at]] = np.where(at > 0, ends[at - 1], 0)
        self.high[mine[at]] = ends[at]

    def list_of(self, term: int) -> np.ndarray:
        return self.places[self.low[term]:self.high[term]]

    def starts_of(self, terms: list[int], slop: int = 0) -> np.ndarray:
        """Places where the phrase of ``terms`` starts.

        The lists are taken from the rarest term on, each shifted back by its
        offset in the phrase, and intersected. With ``slop`` a term may stand
        that many words off its place.
        """
        offsets = sorted(range(len(terms)), key=lambda k: self.high[terms[k]] - self.low[terms[k]])
        found = self.list_of(terms[offsets[0]]).astype(np.int64) - offsets[0]
        for k in offsets[1:]:
            if not len(found):
                break
            places = self.list_of(terms[k])
            at = np.searchsorted(places, found + (k - slop))
            found = found[(at < len(places)) & (places[np.minimum(at, len(places) - 1)] <= found + (k + slop))]
        return found

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


class TestSet:
    """Windows of a set of items as lists of term numbers, each with the items that hold it."""

    def __init__(self, items: list[tuple], window: int):
        self.numbers: dict[bytes, int] = {}
        held: dict[tuple, set[int]] = {}
        self.ids = [item for item, _ in items]
        for n, (_, text) in enumerate(items):
            terms = [self.numbers.setdefault(w, len(self.numbers)) for w in words(text)]
            for k in range(max(len(terms) - window, 0) + 1 if terms else 0):
                held.setdefault(tuple(terms[k:k + window]), set()).add(n)
        self.windows, self.items = list(map(list, held)), list(held.values())
        size = max(map(len, self.windows), default=1)
        # Windows as a matrix; a shorter one repeats its last term.
        self.matrix = np.array([w + w[-1:] * (size - len(w)) for w in self.windows], np.int64).reshape(-1, size)

    def possible(self, block: Block) -> np.ndarray:
        """Windows all of whose terms the block has."""
        return np.flatnonzero((block.high > block.low)[self.matrix].all(axis=1))


def _test_sets(items: DataFrame, limit: int) -> list[Broadcast]:
    """The items in broadcasts of at most ``limit`` bytes of text (one item at least)."""
    context, out, part, size = items.sparkSession.sparkContext, [], [], 0
    for item, text in items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).orderBy("item_id").toLocalIterator():
        text = bytes(text or b"")
        if part and size + len(text) > limit:
            out.append(context.broadcast(part))
            part, size = [], 0
        part.append((item, text))
        size += len(text)
    return [*out, context.broadcast(part)]


def match(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Exact (``slop`` 0) or proximity matches of items in an index.

    Returns ``(doc_id, n_words, n_hit, items, spans)`` for every document:
    ``items`` are the sorted ids, as strings, of items with an occurring window,
    ``spans`` the maximal runs ``(start, end)`` of words inside occurrences. A
    window is ``window`` consecutive words of an item, or all words of a
    shorter one. Items without words match nothing; a null item_id is left out
    of ``items`` but hits. In a proximity match every word of a window stands
    within ``slop`` words of its place; the span then is that of the window
    from its start. Items of any total size are taken in broadcasts of
    ``item_bytes``, one after the other over each block.
    """
    if not 0 <= 2 * slop < GAP or window < 1:
        raise ValueError(f"slop must be under {GAP // 2} and a window have a word")
    kind = index.schema["docs"].dataType.elementType.simpleString()
    parts = _test_sets(items, item_bytes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = TestSet(parts[0].value, window) if len(parts) == 1 else None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names if name != "docs"}
                row["docs"] = batch.column("docs").slice(k, 1).flatten()
                n_docs, hits, cover = len(row["docs"]), None, None
                for part in parts:
                    tests = only or TestSet(part.value, window)
                    block = Block(row, tests.numbers)
                    if cover is None:
                        room = int(block.starts[-1] + block.sizes[-1] + GAP) if n_docs else 0
                        cover, hits = np.zeros(room + 1, np.int32), [set() for _ in range(n_docs)]
                    for w in tests.possible(block):
                        found = block.starts_of(tests.windows[w], slop)
                        # A near match may begin before its document.
                        found = np.maximum(found, 0)
                        if len(found):
                            np.add.at(cover, found, 1)
                            np.add.at(cover, np.minimum(found + len(tests.windows[w]), len(cover) - 1), -1)
                            names = {tests.ids[i] for i in tests.items[w]} - {None}
                            for d in np.unique(block.doc_of(found + (slop if slop else 0))):
                                hits[d] |= names
                inside = np.cumsum(cover) > 0 if n_docs else np.zeros(0, bool)
                out = {"n_hit": [], "items": [], "spans": []}
                sums = np.r_[0, np.cumsum(inside)]
                for d in range(n_docs):
                    start, end = block.starts[d], block.starts[d] + block.sizes[d]
                    out["n_hit"].append(int(sums[end] - sums[start]))
                    edge = np.flatnonzero(np.diff(np.r_[0, inside[start:end].astype(np.int8), 0])) if out["n_hit"][-1] else []
                    out["spans"].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                    out["items"].append(sorted(hits[d]))
                yield pa.RecordBatch.from_arrays([
                    row["docs"], pa.array(block.sizes), pa.array(out["n_hit"], pa.int64()),
                    pa.array(out["items"], pa.list_(pa.string())),
                    pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ], ["doc_id", "n_words", "n_hit", "items", "spans"])

    return index.mapInArrow(rows, f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, "
                                  "spans array<struct<start: bigint, end: bigint>>")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """``match`` for every row of ``docs(doc_id, text)``, over an index stored in the shared folder.

    A null or empty text has no words and is clean. Repeated rows stay, each
    with its own result; other columns are ignored.
    """
    return match(saved(build_index(docs), "postings"), items, window, slop)


def contamination_digest(matches: DataFrame) -> DataFrame:
    joined = F.array_join("items", ",")
    return matches.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                          F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
