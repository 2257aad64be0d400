"""Passages that occur earlier in the corpus, found with suffix automata of reference shards.

1. A window of 20 words marks the six-word runs in it whose hash is least: its
   anchors. Equal windows have equal anchors at equal places, so an earlier
   copy of a window lies around another occurrence of its anchor.
2. Anchors are counted over the corpus. Only around those that occur again are
   the 14 words before and after, the context, looked at; it holds every window
   with the anchor in it.
3. Equal contexts are one class; its earliest place is the reference. The
   references of one anchor are a shard, small enough for a suffix automaton.
   Each is streamed through it: where the match is 20 words or longer, the
   state that holds just the last 20 knows the earliest place they end.
4. What a class learns goes to all documents with the context: later copies
   lose all its windows, the first those that start earlier still.

Shards hold what can match each other, so instead of every automaton going to
every executor it goes where its contexts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress, groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import as_bytes, chunks, partitions, saved, shared_path

WINDOW = 20
ANCHOR = 6
# Words of a context before and after its anchor's first; offsets of a window's start before it.
BEFORE = WINDOW - ANCHOR
# Contexts that go through one automaton; with more, see ``_by_core``.
SHARD_CONTEXTS = 256
# Windows of an anchor that share a core, by the words they have before the anchor.
BLOCKS = tuple((a, min(a + 3, BEFORE)) for a in range(0, BEFORE + 1, 4))
# Rows without an id get one below this, by a hash of their text; other ids are greater.
LEAST_ID = -(1 << 62)


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of a text; none under 20 words."""
    n = len(words)
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = np.fromiter(map(crc32, words), np.uint64, n)
    run = word[:n - ANCHOR + 1].copy()
    for k in range(1, ANCHOR):
        run = run * np.uint64(0x9E3779B97F4A7C15) + word[k:n - ANCHOR + 1 + k]
    run = (run ^ run >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    run ^= run >> np.uint64(32)
    # Least run of every window, then for every run the greatest of the least ones over windows with it.
    least = _sliding(run, BEFORE + 1, np.minimum)
    ends = np.zeros(BEFORE, np.uint64)
    most = _sliding(np.r_[ends, least, ends], BEFORE + 1, np.maximum)
    at = np.flatnonzero(run == most)
    return run[at].view(np.int64), at


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


class Contexts:
    """The contexts of a text's anchors, cut from its words joined by one space."""

    def __init__(self, words: list[bytes]):
        self.text = b" ".join(words)
        # Where each word starts, and one past the end as if another word came.
        self.starts = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]

    def at(self, places: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Hash and words of the context of each place."""
        first = np.maximum(places - BEFORE, 0)
        last = np.minimum(places + WINDOW, len(self.starts) - 1)
        text, digest = self.text, xxhash.xxh3_128_digest
        return [(digest(cut := text[start:end], seed=before), cut) for start, end, before in
                zip(self.starts[first].tolist(), (self.starts[last] - 1).tolist(), (places - first).tolist())]


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(pairs[:, 0]), pa.array(pairs[:, 1])


def _anchored(docs: DataFrame) -> DataFrame:
    """``(id, anchors, again)``, stored: the distinct anchors of every document and those it has more than once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [np.unique(anchors((text or b"").split())[0], return_counts=True) for text in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists([a for a, _ in found]), _lists([a[n > 1] for a, n in found])],
                                             ["id", "anchors", "again"])

    return saved(docs.select("id", "text").mapInArrow(rows, "id bigint, anchors array<bigint>, again array<bigint>"), "anchors")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)), pa.array(np.concatenate(arrays)))


def _candidates(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with ``anchors`` as a table bucketed by id, and its name; anchors null where none is repeated."""
    anchored = _anchored(docs)
    counted = anchored.select(F.explode(F.concat("anchors", "again")).alias("anchor")).groupBy("anchor").count()
    repeated = saved(counted.where("count > 1").select("anchor"), "repeated-anchors")
    mine = (anchored.select("id", F.explode("anchors").alias("anchor")).join(repeated, "anchor")
            .groupBy("id").agg(F.collect_set("anchor").alias("anchors")))
    # Both by the same number of buckets: the table needs no exchange in the later joins by id.
    n = partitions(docs)
    joined = docs.repartition(n, "id").join(mine, "id", "left")
    path = shared_path(docs.sparkSession, "candidates")
    name = "candidates_" + path.rsplit("-", 1)[1]
    joined.write.format("parquet").option("compression", "zstd").bucketBy(n, "id").option("path", path).saveAsTable(name)
    return docs.sparkSession.table(name), name


def _occurrences(candidates: DataFrame) -> DataFrame:
    """``(anchor, c1, c2, id, tag, at, more)``: a row for every document and context class around a repeated anchor.

    ``at`` is the first place of the class in the document, ``more`` the others
    as bytes, mostly null. ``tag`` tells apart rows with one id.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            anchor, digests, doc, tags, first, more = [], [], [], [], [], []
            for text, own, mine in zip(as_bytes(batch.column("text")), batch.column("id").to_pylist(), batch.column("anchors")):
                words = (text or b"").split()
                hashes, places = anchors(words)
                again = np.isin(hashes, mine.values.to_numpy())
                seen: dict[bytes, int] = {}
                others: dict[int, list[int]] = {}
                for hashed, at, (digest, _) in zip(hashes[again].tolist(), places[again].tolist(), Contexts(words).at(places[again])):
                    row = seen.setdefault(digest, len(digests))
                    if row < len(digests):
                        others.setdefault(row, []).append(at)
                    else:
                        anchor.append(hashed)
                        digests.append(digest)
                        first.append(at)
                doc += [own] * len(seen)
                tags += [_tag(text or b"")] * len(seen)
                more += [np.array(others[row], "<i4").tobytes() if row in others else None for row in seen.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int64()), *_halves(digests), pa.array(doc, pa.int64()), pa.array(tags, pa.int32()),
                 pa.array(first, pa.int32()), pa.array(more, pa.binary())], ["anchor", "c1", "c2", "id", "tag", "at", "more"])

    return candidates.where("anchors IS NOT NULL").select("text", "id", "anchors").mapInArrow(
        rows, "anchor bigint, c1 bigint, c2 bigint, id bigint, tag int, at int, more binary")


def _tag(text: bytes) -> int:
    return crc32(text) - (1 << 31)


class Automaton:
    """Suffix automaton of several word sequences; every state knows the place where it was met first."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length, first, edges, link) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, state: int, word, to: int) -> int:
        """The state of the words up to ``state`` and ``word``, on its own."""
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._state(self.length[state] + 1, self.first[to], dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list, doc: int, start: int) -> None:
        """Take in words that begin at word ``start`` of document ``doc``; earlier places come first."""
        last = 0
        for k, word in enumerate(words):
            to = self.next[last].get(word)
            if to is not None:
                last = self._split(last, word, to)
                continue
            new = self._state(self.length[last] + 1, (doc, start + k), {}, 0)
            state = last
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = new
                state = self.link[state]
            if state >= 0:
                self.link[new] = self._split(state, word, self.next[state][word])
            last = new

    def earliest(self, words: list, size: int) -> Iterator[tuple[int, tuple]]:
        """(k, place) for every end k of a match of ``size`` or more words: where its last ``size`` words first end."""
        state, matched = 0, 0
        for k, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            if matched >= size:
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                    matched = self.length[state]
                yield k, self.first[state]


def shard_masks(contexts: list[tuple[int, int, int, list]]) -> list[int]:
    """For each context ``(id, its start, place of the anchor, words)``, in order of place, the windows that start earlier elsewhere.

    Bit d stands for the window that starts d words before the anchor.
    """
    automaton = Automaton()
    for doc, start, _, words in contexts:
        automaton.add(words, doc, start)
    masks = []
    for doc, start, at, words in contexts:
        mask = 0
        for k, place in automaton.earliest(words, WINDOW):
            if place < (doc, start + k):
                mask |= 1 << at - (start + k - WINDOW + 1)
        masks.append(mask)
    return masks


def _by_shard(contexts: DataFrame) -> DataFrame:
    """``(c1, c2, mask)`` of classes with windows that start earlier, one automaton for each ``anchor``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "id", "start", "at", "c1", "c2", "text")]))
        out: list[tuple[int, int, int]] = []
        for _, group in groupby(every, key=lambda row: row[0]):
            shard = list(group)
            if len(shard) > 1:
                masks = shard_masks([(doc, start, at, text.split(b" ")) for _, doc, start, at, _, _, text in shard])
                out += [(row[4], row[5], mask) for row, mask in zip(shard, masks) if mask]
            if len(out) > 10_000:
                yield _triples(out)
                out = []
        yield _triples(out)

    return (contexts.repartition(partitions(contexts), "anchor").sortWithinPartitions("anchor", "id", "start")
            .mapInArrow(rows, "c1 bigint, c2 bigint, mask bigint"))


def _triples(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], pa.int64()) for k in range(3)], ["c1", "c2", "mask"])


def _by_core(contexts: DataFrame, shard_contexts: int) -> DataFrame:
    """The same for anchors with very many contexts, such as a common line in many surroundings.

    Windows with 0 to 3 words before the anchor all hold the same 17 words, and
    so on: these cores are anchors of their own with a part of the context
    each. What still has very many goes window by window.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, start, at, c1, c2, text in zip(*[batch.column(c).to_pylist() for c in ("id", "start", "at", "c1", "c2", "text")]):
                words, before = text.split(b" "), at - start
                for a, b in BLOCKS:
                    # Without the whole core there is no window of the block.
                    if a <= before and before + WINDOW - b <= len(words):
                        core = xxhash.xxh64_intdigest(b" ".join(words[before - a:before + WINDOW - b]), seed=a) - (1 << 63)
                        first = max(before - b, 0)
                        out.append((core, doc, start + first, at, c1, c2, b" ".join(words[first:before + WINDOW - a])))
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.binary())],
                                             ["anchor", "id", "start", "at", "c1", "c2", "text"])

    cores = saved(contexts.mapInArrow(rows, "anchor bigint, id bigint, start bigint, at bigint, c1 bigint, c2 bigint, text binary"), "cores")
    hot = saved(cores.groupBy("anchor").count().where(F.col("count") > shard_contexts).select("anchor"), "hot-cores")
    return _by_shard(cores.join(hot, "anchor", "left_anti")).union(_by_window(cores.join(hot, "anchor", "left_semi")))


def _by_window(contexts: DataFrame) -> DataFrame:
    """The same window by window, so that no task gets all contexts of an anchor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c1, c2, doc, start, at, text in zip(*[batch.column(c).to_pylist() for c in ("c1", "c2", "id", "start", "at", "text")]):
                words = text.split(b" ")
                for k in range(len(words) - WINDOW + 1):
                    digest = xxhash.xxh3_128_digest(b" ".join(words[k:k + WINDOW]))
                    out.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True),
                                c1, c2, doc, start + k, 1 << at - start - k))
            names = ["w1", "w2", "c1", "c2", "id", "start", "bit"]
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], pa.int64()) for k in range(len(names))], names)

    windows = contexts.mapInArrow(rows, "w1 bigint, w2 bigint, c1 bigint, c2 bigint, id bigint, start bigint, bit bigint")
    first = saved(windows.groupBy("w1", "w2").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1").drop("n"), "first-windows")
    later = windows.join(first, ["w1", "w2"]).where(F.struct("id", "start") > F.col("first"))
    return later.groupBy("c1", "c2").agg(F.bit_or("bit").alias("mask"))


def _class_masks(candidates: DataFrame, classes: DataFrame, shard_contexts: int) -> DataFrame:
    """``(c1, c2, mask)``: which windows of a class's first occurrence start earlier within another class."""
    sizes = saved(classes.groupBy("anchor").count().where("count > 1"), "shard-sizes")
    places = (classes.join(sizes, "anchor")
              .groupBy(F.col("first.id").alias("id")).agg(F.collect_list(F.struct(F.col("first.at").alias("at"),
                                                                                  (F.col("count") > shard_contexts).alias("large"))).alias("places")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            anchor, doc, digests, texts, at, large = [], [], [], [], [], []
            for text, own, asked in zip(as_bytes(batch.column("text")), batch.column("id").to_pylist(), batch.column("places").to_pylist()):
                words = (text or b"").split()
                anchor_of = dict(zip(*(x.tolist() for x in reversed(anchors(words)))))
                # A row with the same id and another text has no such place.
                asked = [place for place in asked if place["at"] in anchor_of]
                for place, (digest, cut) in zip(asked, Contexts(words).at(np.array([place["at"] for place in asked], np.int64))):
                    anchor.append(anchor_of[place["at"]])
                    doc.append(own)
                    at.append(place["at"])
                    digests.append(digest)
                    texts.append(cut)
                    large.append(place["large"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(np.maximum(np.array(at, np.int64) - BEFORE, 0)),
                 pa.array(at, pa.int64()), *_halves(digests), pa.array(texts, pa.binary()), pa.array(large, pa.bool_())], ["anchor", "id", "start", "at", "c1", "c2", "text", "large"])

    contexts = saved(candidates.select("text", "id").join(places, "id").select("text", "id", "places").mapInArrow(
        rows, "anchor bigint, id bigint, start bigint, at bigint, c1 bigint, c2 bigint, text binary, large boolean"), "contexts")
    found = _by_shard(contexts.where("NOT large")).union(_by_core(contexts.where("large"), shard_contexts))
    # A class split over cores has a part of its mask from each.
    return found.groupBy("c1", "c2").agg(F.bit_or("mask").alias("mask"))


EVERY = (1 << BEFORE + 1) - 1


def removed(n: int, places: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are in a window that starts earlier too: bit d of a mask is the window d words before its place."""
    gone = np.zeros(n + 1, np.int64)
    for d in range(BEFORE + 1):
        starts = places[masks >> d & 1 == 1] - d
        starts = starts[(starts >= 0) & (starts + WINDOW <= n)]
        # Places of one kind are distinct.
        np.add.at(gone, starts, 1)
        np.add.at(gone, starts + WINDOW, -1)
    return np.cumsum(gone[:-1]) > 0


def _told(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """(tags, places, masks) of every document that is told something."""
    flat = lists.flatten()
    tag, at, mask = (flat.field(c).to_numpy() for c in ("tag", "at", "mask"))
    more = flat.field("more").to_pylist()
    end = 0
    for valid, size in zip(lists.is_valid().to_pylist(), pa.compute.list_value_length(lists).to_pylist()):
        if not valid:
            yield None
            continue
        start, end = end, end + size
        further = [(np.frombuffer(m, "<i4"), k) for k, m in enumerate(more[start:end]) if m]
        tags, places, masks = tag[start:end], at[start:end].astype(np.int64), mask[start:end].astype(np.int64)
        if further:
            # Only the first place of a class may have windows left.
            tags = np.r_[tags, np.concatenate([np.full(len(p), tags[k]) for p, k in further])]
            places = np.r_[places, np.concatenate([p for p, _ in further])]
            masks = np.r_[masks, np.full(len(places) - len(masks), EVERY)]
        yield tags, places, masks


def dedup(docs: DataFrame, keep_text: bool = True, shard_contexts: int = SHARD_CONTEXTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *carry, n_words, n_removed, kept_sha256[, kept])`` for every row of ``docs(doc_id, text)``.

    Words go that lie in 20 consecutive words which start earlier as well: at a
    smaller doc_id, or earlier in the same document. ``kept`` are the others
    joined by one space. doc_id is a whole number; a null stands before all
    others. Rows with one doc_id count as one document: places with the same
    id and start are no earlier than each other. Of rows without an id those
    with one text count as one document, and others come in the order of a hash
    of the text; ids are not below -2 ** 62. A null or empty text has no
    words and keeps the empty text. Where nothing goes ``kept`` is the text as
    it was. Of the other columns those named in ``carry`` come along.
    """
    carried = {f"carry_{k}": c for k, c in enumerate(carry)}
    # Spread over all ids below LEAST_ID, so that many rows without an id are no group.
    unnamed = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2) * 1 - F.lit((1 << 63) - 1) - 1
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), unnamed).alias("id"), "text",
                        *[F.col(f"`{c}`").alias(name) for name, c in carried.items()])
    candidates, name = _candidates(keyed)
    # Texts are split once for the classes and for what is told.
    occurrences = saved(_occurrences(candidates), "occurrences", compression="zstd")
    classes = saved(occurrences.groupBy("anchor", "c1", "c2").agg(F.min(F.struct("id", "at")).alias("first"),
                                                                            F.sum(1 + F.coalesce(F.octet_length("more"), F.lit(0)) / 4).alias("n")), "classes")
    masks = saved(_class_masks(candidates, classes, shard_contexts), "masks")
    telling = saved(classes.join(masks, ["c1", "c2"], "left").where("n > 1 OR mask IS NOT NULL")
                    .select("c1", "c2", "first", F.coalesce("mask", F.lit(0)).alias("mask")), "telling-classes")
    is_first = (F.col("first.id") == F.col("id")) & (F.col("first.at") == F.col("at"))
    entry = F.struct("tag", "at", "more", F.when(is_first, F.col("mask")).otherwise(EVERY).cast("int").alias("mask"))
    told = (occurrences.select("c1", "c2", "id", "tag", "at", "more").join(telling, ["c1", "c2"])
            .groupBy("id").agg(F.collect_set(entry).alias("told")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for text, told in zip(as_bytes(batch.column("text")), _told(batch.column("told"))):
                words = (text or b"").split()
                gone = np.zeros(len(words), bool)
                if told is not None:
                    tags, places, masks = told
                    mine = tags == _tag(text or b"")
                    gone = removed(len(words), places[mine], masks[mine])
                kept = b" ".join(compress(words, (~gone).tolist()) if told is not None else words)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(None if not keep_text or text is None else (kept if gone.any() else text).decode())
            types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", *carried)], *[pa.array(out[c], t) for c, t in types.items()]],
                                             ["id", *carried, *types])

    joined = candidates.select("id", "text", *carried).join(told, "id", "left")
    along = "".join(f"{c} {joined.schema[c].dataType.simpleString()}, " for c in carried)
    done = joined.mapInArrow(rows, f"id bigint, {along}n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    result = saved(done if keep_text else done.drop("kept"), "deduplicated")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    doc_id = F.when(F.col("id") >= LEAST_ID, F.col("id")).cast(docs.schema["doc_id"].dataType)
    return result.select(doc_id.alias("doc_id"), *[F.col(c).alias(n) for c, n in carried.items()], "n_words", "n_removed", "kept_sha256",
                         *(["kept"] if keep_text else []))
