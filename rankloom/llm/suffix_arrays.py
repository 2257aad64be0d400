"""Repeated byte strings of a corpus, found with suffix arrays built bucket by bucket over a difference cover.

1. Texts are stored in blocks. Every 100-byte window has an anchor, the first
   of the 40-byte grams in it whose hash is least; equal windows have equal
   anchors at equal places. Blocks send the hashes of their anchors, in pieces
   by hash, and are told which ones occur again.
2. Around a repeated anchor lies its context: the windows that it is the anchor
   of. Equal contexts are one class, of which the earliest place stands for
   all: elsewhere every window is a copy.
3. Anchors with several classes are left. The contexts of such anchors go
   to one task each and are sorted as suffixes there (``equal_windows``): a
   difference cover modulo 7 is ranked first; then one bucket of suffixes at a
   time is sorted by leading bytes, and longer ties are decided by the cover's
   ranks at the offset where both suffixes are in the cover.
4. Blocks are told which windows of which contexts start earlier elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import as_bytes, chunks, partitions, saved, shared_path

WINDOW = 100
GRAM = 40
# Offsets of a window's start before its anchor: 0 to BEFORE.
BEFORE = WINDOW - GRAM
EVERY = (1 << BEFORE + 1) - 1
# Every difference modulo 7 is one of two members of the cover.
PERIOD, COVER = 7, (0, 1, 3)
DEPTH = 84
# Bytes of contexts that are sorted together, and suffixes of one bucket.
SHARD_BYTES, BUCKET = 1 << 21, 1 << 16
# Contexts of an anchor in one task; with more it is split, see ``_by_core``.
SHARD_CONTEXTS = 4096
# Windows with SPREAD + 1 neighbouring starts share a core.
SPREAD = 12
# Positions whose hashes are worked out at once.
SEGMENT = 1 << 19
# Anchor hashes that one task compares at once.
PIECE_HASHES = 1 << 22
NULL_ID = -(1 << 63)

_MIX = np.uint64(0x9E3779B97F4A7C15)
# A fixed odd value for every byte.
_BYTE = (np.arange(1, 257, dtype=np.uint64) * _MIX ^ np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(29)) | np.uint64(1)


def _power(size: int) -> np.uint64:
    return np.uint64(pow(int(_MIX), size, 1 << 64))


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling; 40 = 32 + 8."""
    run, size, eight = _BYTE[text], 1, None
    while size < 32:
        run = run[:-size] * _power(size) + run[size:]
        size *= 2
        eight = run if size == 8 else eight
    n = len(text) - GRAM + 1
    run = run[:n] * _power(8) + eight[32:32 + n]
    run = (run ^ run >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return run ^ run >> np.uint64(29)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that stand one after the other in ``text`` up to ``ends``.

    Hashes, positions, and the starts of the first and last window that each is
    the anchor of. Windows that an anchor has start one after the other.
    """
    found: list[np.ndarray] = []
    low = np.uint64((1 << 20) - 1)
    with np.errstate(over="ignore"):
        for at in range(0, max(len(text) - WINDOW + 1, 0), SEGMENT):
            part = text[at:at + SEGMENT + WINDOW - 1]
            run = _gram_hashes(part)
            # The least hash and, in the low bits, the first place that has it.
            key = run & ~low | np.arange(len(run), dtype=np.uint64)
            anchor = (_sliding(key, BEFORE + 1, np.minimum) & low).astype(np.int64)
            # No window reaches over the end of a text.
            cuts = ends[np.searchsorted(ends, at, "right"):np.searchsorted(ends, at + len(part), "left")] - at
            over = np.zeros(len(anchor) + 1, np.int32)
            np.add.at(over, np.maximum(cuts - WINDOW + 1, 0).clip(max=len(anchor)), 1)
            np.add.at(over, cuts.clip(max=len(anchor)), -1)
            starts = np.flatnonzero(np.cumsum(over[:-1]) == 0)
            anchor = anchor[starts]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)] if len(starts) else np.empty(0, bool)
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(starts)] - 1 if len(first) else first
            found.append(np.stack([run[anchor[first]].view(np.int64), anchor[first] + at, starts[first] + at, starts[last] + at]))
    if not found:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    hashes, places, first, last = np.concatenate(found, axis=1)
    # A segment's last anchor may have windows in the next one.
    new = np.r_[True, places[1:] != places[:-1]] if len(places) else np.empty(0, bool)
    kept = np.flatnonzero(new)
    ends_of = np.r_[kept[1:], len(places)] - 1 if len(kept) else kept
    return hashes[kept].view(np.uint64), places[kept], first[kept], last[ends_of]


def _ranks(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Dense ranks from 0 on, of one column of keys or of pairs of small numbers."""
    if second is not None:
        first = first * np.int64(int(second.max(initial=0)) + 1) + second
    order = np.argsort(first)
    key = first[order]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]]) if len(key) else key
    return ranks


def _cover_ranks(size: int, lead: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks by DEPTH = 84 bytes of the cover's suffixes that a window of ``starts`` can be compared at.

    Ranks of 7 bytes are joined to 14, 28, 56 and 84; each width only where a
    greater one asks for it.
    """
    in_cover = np.isin(np.arange(PERIOD), COVER)
    near = np.zeros(size + DEPTH, bool)
    for d in range(PERIOD):
        near[starts + d] = True
    asked = {DEPTH: near}
    for wide, narrow, steps in ((84, 56, (0,)), (56, 28, (0, 28)), (28, 14, (0, 14)), (14, 7, (0, 7))):
        asked[narrow] = np.zeros_like(near)
        for step in steps:
            asked[narrow][step:] |= asked[wide][:len(near) - step]
        if narrow == 28:
            asked[narrow][56:] |= near[:-56]
    sample = {width: (at := np.flatnonzero(mask))[in_cover[at % PERIOD]] for width, mask in asked.items()}
    rank = np.zeros(size + 2 * DEPTH, np.int64)
    rank[sample[7]] = _ranks(lead[sample[7]] >> np.uint64(8))
    kept = None
    for width in (7, 14, 28):
        at = sample[2 * width]
        wider = np.zeros_like(rank)
        wider[at] = _ranks(rank[at], rank[at + width])
        kept = rank if width == 28 else None
        rank = wider
    at = sample[DEPTH]
    cover = np.zeros_like(rank)
    cover[at] = _ranks(rank[at], kept[at + 56])
    return cover


def _below(group: np.ndarray, key: np.ndarray, span: np.int64) -> np.ndarray:
    """How many of the same group have a smaller key; keys are from 0 to ``span``."""
    if not len(group):
        return group
    key = group * span + key
    order = np.argsort(key)
    ordered, groups = key[order], group[order]
    new = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], np.arange(len(key)), 0))
    first = np.maximum.accumulate(np.where(np.r_[True, groups[1:] != groups[:-1]], np.arange(len(key)), 0))
    out = np.empty(len(key), np.int64)
    out[order] = new - first
    return out


def equal_windows(text: np.ndarray, starts: np.ndarray, bucket: int = BUCKET) -> np.ndarray:
    """A number for each of ``starts``: its place in the alphabetical order of the windows from there, the same for equal ones.

    Memory beyond ``text`` is the ranks of the cover, three sevenths of its
    positions at most, and one bucket of suffixes.
    """
    size = len(text)
    if not len(starts):
        return np.empty(0, np.int64)
    padded = np.concatenate([text, np.zeros(WINDOW + DEPTH + 8, np.uint8)]).astype(np.uint64)
    lead = padded
    for width in (1, 2, 4):
        lead = lead[:len(lead) - width] << np.uint64(8 * width) | lead[width:]
    cover = _cover_ranks(size, lead, starts)
    top = np.int64(int(cover.max()) + 1)
    shared = {(a, b): next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
              for a in range(PERIOD) for b in range(PERIOD)}
    numbers = np.empty(len(starts), np.int64)
    leads = lead[starts]
    by_lead = np.argsort(leads)
    leads = leads[by_lead]
    new = np.flatnonzero(np.r_[True, leads[1:] != leads[:-1]])
    at = 0
    while at < len(starts):
        # Whole groups of equal leading bytes, up to a bucket of them.
        last = np.searchsorted(new, at + bucket, "right") - 1
        end = int(new[last]) if new[last] > at else len(starts) if last + 1 >= len(new) else int(new[last + 1])
        end = len(starts) if at + bucket >= len(starts) else end
        chosen = by_lead[at:end]
        here = starts[chosen]
        # The group of equal leading bytes, from 0 on in the bucket, and where it starts.
        group = np.searchsorted(new, np.arange(at, end), "right") - 1
        begin = new[group]
        group -= group[0]
        size = np.bincount(group)
        residue = here % PERIOD
        low, high = np.full(len(size), PERIOD), np.zeros(len(size), np.int64)
        np.minimum.at(low, group, residue)
        np.maximum.at(high, group, residue)
        numbers[chosen] = begin
        tied = size[group] > 1
        # Where all of a group have one residue they are in the cover at the same offset: one sort does.
        mixed = low[group] != high[group]
        tail = np.zeros(len(here), np.int64)
        tail[tied] = _ranks(_ranks(lead[here[tied] + DEPTH]), _ranks(lead[here[tied] + DEPTH + 8]))
        tails = np.int64(int(tail.max()) + 1)
        own = np.array([shared[a, a] for a in range(PERIOD)])
        plain = np.flatnonzero(tied & ~mixed)
        numbers[chosen[plain]] += _below(group[plain], (cover[here[plain] + own[residue[plain]]] * tails + tail[plain]), top * tails)
        lists = [np.flatnonzero(tied & mixed & (residue == a)) for a in range(PERIOD)]
        for a, mine in enumerate(lists):
            for b, others in enumerate(lists):
                if len(mine) and len(others):
                    d = shared[a, b]
                    theirs = np.sort((group[others] * top + cover[here[others] + d]) * tails + tail[others])
                    first = group[mine] * top * tails
                    numbers[chosen[mine]] += np.searchsorted(theirs, first + cover[here[mine] + d] * tails + tail[mine]) - np.searchsorted(theirs, first)
        at = end
    return numbers


def later_windows(contexts: list[tuple[tuple, int, int, bytes]], bucket: int = BUCKET) -> list[int]:
    """For each context ``(document's place, start in it, bytes before the anchor, bytes)`` the windows that start earlier in another one.

    Bit d stands for the window that starts d bytes before the anchor. Of
    contexts with the same bytes only the earliest is sorted; all windows of
    the others are copies.
    """
    earliest: dict[tuple, tuple] = {}
    for doc, start, before, text in contexts:
        if earliest.get((before, text), (doc, start)) >= (doc, start):
            earliest[before, text] = (doc, start)
    distinct = [(*place, *key) for key, place in earliest.items()]
    masks = dict(zip(earliest, _later(distinct, bucket)))
    out = []
    for doc, start, before, text in contexts:
        whole = max(min(len(text) - WINDOW, before) + 1, 0)
        first = earliest[before, text] == (doc, start)
        out.append(masks[before, text] if first else (1 << whole) - 1 << before + 1 - whole if whole else 0)
    return out


def _later(contexts: list[tuple[tuple, int, int, bytes]], bucket: int) -> list[int]:
    before = np.fromiter((b for _, _, b, _ in contexts), np.int64, len(contexts))
    # All anchors at one residue, so that windows of one anchor are mostly compared in one sort.
    texts, offset, at = [], np.empty(len(contexts), np.int64), 0
    for k, (_, _, b, text) in enumerate(contexts):
        pad = -(at + b) % PERIOD
        texts += [bytes(pad), text]
        offset[k] = at + pad
        at += pad + len(text)
    sizes = np.fromiter((len(text) for *_, text in contexts), np.int64, len(contexts))
    # Windows that lie in the context and hold the anchor's first byte, or all of a core.
    count = np.maximum(np.minimum(sizes - WINDOW, before) + 1, 0)
    of = np.repeat(np.arange(len(contexts)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    numbers = equal_windows(np.frombuffer(b"".join(texts), np.uint8), offset[of] + inside, bucket)
    docs = {doc: k for k, doc in enumerate(sorted({doc for doc, *_ in contexts}))}
    doc = np.fromiter((docs[c[0]] for c in contexts), np.int64, len(contexts))[of]
    start = np.fromiter((c[1] for c in contexts), np.int64, len(contexts))[of] + inside
    order = np.lexsort((start, doc, numbers))
    new = np.r_[True, numbers[order][1:] != numbers[order][:-1]]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    later = np.zeros(len(of), bool)
    later[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    masks = np.zeros(len(contexts), np.int64)
    np.bitwise_or.at(masks, of[later], np.int64(1) << (before[of] - inside)[later])
    return masks.tolist()


def _halves(digests: list[bytes]) -> list[pa.Array]:
    pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]


def _blocks(docs: DataFrame) -> tuple[DataFrame, str]:
    """Texts of about 4 MB in one row, as a table bucketed by ``block``, and its name.

    ``(block, text, ends, ids, tags)``: where each text ends, its doc_id and a hash of it.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks([batch]):
                texts = [t or b"" for t in as_bytes(part.column("text"))]
                ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
                tags = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task]), pa.array([b"".join(texts)], pa.binary()), pa.array([ends.tolist()], pa.list_(pa.int64())),
                     pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([tags], pa.list_(pa.int64()))],
                    ["block", "text", "ends", "ids", "tags"])
                task += 1

    path = shared_path(docs.sparkSession, "blocks")
    name = "blocks_" + path.rsplit("-", 1)[1]
    (docs.mapInArrow(rows, "block bigint, text binary, ends array<bigint>, ids array<bigint>, tags array<bigint>")
     .write.format("parquet").option("compression", "zstd").bucketBy(partitions(docs), "block").option("path", path).saveAsTable(name))
    return docs.sparkSession.table(name), name


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Each block as arrays, one in memory at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            out = {c: v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for c, v in row.items() if c in ("ends", "ids", "tags")}
            out |= {"block": row["block"].as_py(), "text": np.frombuffer(row["text"].as_buffer(), np.uint8)}
            yield out | {c: v.as_py() for c, v in row.items() if c not in out}


def _dealt(text: np.ndarray, ends: np.ndarray, buckets: int):
    """(anchors, distinct hashes by bucket and value, their buckets, which occur twice here)."""
    found = anchors(text, ends)
    hashes = found[0]
    distinct, counts = np.unique(hashes, return_counts=True)
    bucket = ((distinct * _MIX >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return found, distinct[order], bucket[order], counts[order] > 1


def _repeated(blocks: DataFrame, buckets: int) -> DataFrame:
    """``(block, told)``: for pieces of the block's distinct anchors, a bit for each that another block has as well."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            _, distinct, bucket, _ = _dealt(row["text"], row["ends"], buckets)
            new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
            cut = [p.tobytes() for p in np.split(distinct, new[1:])] if len(new) else []
            yield pa.RecordBatch.from_arrays([pa.array(bucket[new], pa.int64()), pa.array([row["block"]] * len(new), pa.int64()),
                                              pa.array(cut, pa.binary())], ["bucket", "block", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("bucket", "block", "hashes")]))
        for bucket, group in groupby(every, key=lambda row: row[0]):
            group = [(block, np.frombuffer(h, np.uint64)) for _, block, h in group]
            order = np.argsort(together := np.concatenate([h for _, h in group]))
            same = together[order][1:] == together[order][:-1]
            again = np.zeros(len(together), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            parts = np.split(again, np.cumsum([len(h) for _, h in group])[:-1])
            told = [(block, np.packbits(bits).tobytes()) for (block, _), bits in zip(group, parts) if bits.any()]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in told], pa.int64()), pa.array([bucket] * len(told), pa.int64()),
                                              pa.array([bits for _, bits in told], pa.binary())], ["block", "bucket", "bits"])

    n = min(buckets, partitions(blocks) * 8)
    replies = (blocks.select("block", "text", "ends").mapInArrow(pieces, "bucket bigint, block bigint, hashes binary")
               .repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, "block bigint, bucket bigint, bits binary"))
    return replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("told"))


def _occurrences(blocks: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    """``(anchor, c1, c2, id, tag, at, block, pos, before, after, more)``: a row for every block and context class around a repeated anchor.

    ``id``, ``tag``, ``at`` are the first place of the class in the block, ``more`` the positions of its later ones as bytes.
    The first window starts ``before`` bytes before the position, and ``after`` ones follow it.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            text, ends, ids, tags = row["text"], row["ends"], row["ids"], row["tags"]
            found, distinct, bucket, again = _dealt(text, ends, buckets)
            for reply in row["told"] or []:
                a, b = np.searchsorted(bucket, [reply["bucket"], reply["bucket"] + 1])
                again[a:b] |= np.unpackbits(np.frombuffer(reply["bits"], np.uint8), count=b - a).astype(bool)
            hit = np.isin(found[0], distinct[again])
            hashes, places, first, last = (c[hit] for c in found)
            data, digest = text.tobytes(), xxhash.xxh3_128_digest
            digests = [digest(data[a:b], seed=c) for a, b, c in zip(first.tolist(), (last + WINDOW).tolist(), (places - first).tolist())]
            c1, c2 = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
            doc = np.searchsorted(ends, places, "right")
            at, own, tag = places - np.r_[0, ends][doc], ids[doc], tags[doc]
            # Classes together, each by place: those at the first place are rows, the positions of the others go with the first.
            order = np.lexsort((at, tag, own, c2, c1, hashes))
            columns = [c[order] for c in (hashes.view(np.int64), c1, c2, own, tag, at, places, (places - first).astype(np.int32), (last - first).astype(np.int32))]
            new = np.zeros(len(order), bool)
            new[:1] = True
            for c in columns[:3]:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            head = starts[np.cumsum(new) - 1] if len(order) else order
            kept = np.logical_and.reduce([c == c[head] for c in columns[3:6]])
            more: list[bytes | None] = [None] * len(order)
            for begin, end in zip(starts.tolist(), np.r_[starts[1:], len(order)].tolist()):
                if end - begin > 1 and not kept[begin:end].all():
                    more[begin] = columns[6][begin:end][~kept[begin:end]].astype("<i8").tobytes()
            more = [m for m, k in zip(more, kept.tolist()) if k]
            block = np.full(int(kept.sum()), row["block"])
            yield pa.RecordBatch.from_arrays([*[pa.array(c[kept]) for c in columns[:6]], pa.array(block), *[pa.array(c[kept]) for c in columns[6:]],
                                              pa.array(more, pa.binary())], ["anchor", "c1", "c2", "id", "tag", "at", "block", "pos", "before", "after", "more"])

    joined = blocks.join(told.hint("shuffle_hash"), "block", "left")
    return saved(joined.mapInArrow(rows, "anchor bigint, c1 bigint, c2 bigint, id bigint, tag bigint, at bigint, block bigint, pos bigint, "
                                         "before int, after int, more binary"), "occurrences", compression="zstd")


CONTEXT = "anchor bigint, id bigint, tag bigint, start bigint, before bigint, c1 bigint, c2 bigint, text binary"


def _contexts(blocks: DataFrame, classes: DataFrame, shard_contexts: int) -> DataFrame:
    """The context of the first place of every class that shares its anchor with another class."""
    sizes = saved(classes.groupBy("anchor").count().where("count > 1"), "shard-sizes")
    asked = (classes.join(sizes, "anchor").select(F.col("first.block").alias("block"), F.struct(
        F.col("first.pos").alias("pos"), F.col("first.before").alias("before"), F.col("first.after").alias("after"), "anchor", "c1", "c2",
        (F.col("count") > shard_contexts).alias("large")).alias("place"))
        .groupBy("block").agg(F.collect_list("place").alias("places")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = next(_one_by_one([batch.slice(k, 1).drop_columns(["places"])]))
                flat = batch.column("places")[k].values
                asked = {c: flat.field(c) for c in ("anchor", "c1", "c2", "large")}
                at, before, after = (flat.field(c).to_numpy().astype(np.int64) for c in ("pos", "before", "after"))
                doc = np.searchsorted(row["ends"], at, "right")
                begin, first, last = np.r_[0, row["ends"]][doc], at - before, at - before + after + WINDOW
                data = row["text"].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [asked["anchor"], pa.array(row["ids"][doc]), pa.array(row["tags"][doc]), pa.array(first - begin), pa.array(at - first),
                     asked["c1"], asked["c2"], pa.array([data[a:b] for a, b in zip(first.tolist(), last.tolist())], pa.binary()), asked["large"]],
                    [*CONTEXT_NAMES, "large"])

    return saved(blocks.join(asked.hint("shuffle_hash"), "block").mapInArrow(rows, CONTEXT + ", large boolean"), "contexts")


CONTEXT_NAMES = [c.split()[0] for c in CONTEXT.split(", ")]
PLAIN = [c for c in CONTEXT_NAMES if c != "text"]


def _by_shard(contexts: DataFrame) -> DataFrame:
    """``(c1, c2, mask)`` of classes with windows that start earlier; all contexts of an ``anchor`` are in one task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in CONTEXT_NAMES]))
        held, size = [], 0
        for _, group in groupby(every, key=lambda row: row[0]):
            shard = list(group)
            if len(shard) > 1:
                held += shard
                size += sum(len(row[-1]) for row in shard)
            if size >= SHARD_BYTES:
                yield _masks(held)
                held, size = [], 0
        yield _masks(held)

    return (contexts.repartition(partitions(contexts), "anchor").sortWithinPartitions("anchor")
            .mapInArrow(rows, "c1 bigint, c2 bigint, mask bigint"))


def _masks(held: list[tuple]) -> pa.RecordBatch:
    masks = later_windows([((doc, tag), start, before, text) for _, doc, tag, start, before, _, _, text in held])
    out = [(row[5], row[6], mask) for row, mask in zip(held, masks) if mask]
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], pa.int64()) for k in range(3)], ["c1", "c2", "mask"])


def _by_core(contexts: DataFrame, shard_contexts: int) -> DataFrame:
    """The same for anchors with very many contexts, such as a common line in many surroundings.

    The windows with 0 to 12 bytes before the anchor all hold the same 88
    bytes, and so on: these cores are anchors of their own, with a part of the
    context each. What still has very many goes window by window.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, doc, tag, start, before, c1, c2, text in zip(*[batch.column(c).to_pylist() for c in CONTEXT_NAMES]):
                for a in range(0, BEFORE + 1, SPREAD + 1):
                    b = min(a + SPREAD, BEFORE)
                    if a <= before and before - b + WINDOW <= len(text):
                        core = xxhash.xxh64_intdigest(text[max(before - a, 0):before - b + WINDOW], seed=a) - (1 << 63)
                        first = max(before - b, 0)
                        # ``before`` counts to the last start of the core's windows; the anchor is ``a`` bytes on.
                        out.append((core, doc, tag, start + first, before - a - first, c1, c2, a, text[first:before - a + WINDOW]))
            columns = list(zip(*out)) if out else [()] * 9
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:8]], pa.array(columns[8], pa.binary())],
                                             [*PLAIN, "a", "text"])

    schema = ", ".join(f"{c} bigint" for c in [*PLAIN, "a"]) + ", text binary"
    cores = saved(contexts.select(*CONTEXT_NAMES).mapInArrow(rows, schema), "cores")
    sizes = saved(cores.groupBy("anchor").count().where("count > 1"), "core-sizes")
    sized = cores.join(sizes, "anchor")
    # Classes of one core under one name, so that the mask can be shifted to the anchor's place afterwards.
    named = lambda df: df.withColumn("c2", F.col("c2").bitwiseXOR(F.col("a"))).select(*CONTEXT_NAMES)
    names = cores.select("c1", F.col("c2").bitwiseXOR(F.col("a")).alias("n2"), "c2", "a")
    found = (_by_shard(named(sized.where(F.col("count") <= shard_contexts)))
             .union(_by_window(named(sized.where(F.col("count") > shard_contexts)))).withColumnRenamed("c2", "n2"))
    return found.join(names, ["c1", "n2"]).select("c1", "c2", F.expr("shiftleft(mask, cast(a as int))").alias("mask"))


def _by_window(contexts: DataFrame) -> DataFrame:
    """The same window by window, so that no task gets all contexts of an anchor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, doc, tag, start, before, c1, c2, text in zip(*[batch.column(c).to_pylist() for c in CONTEXT_NAMES]):
                for k in range(min(len(text) - WINDOW, before) + 1):
                    digest = xxhash.xxh3_128_digest(text[k:k + WINDOW])
                    out.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True),
                                c1, c2, doc, tag, start + k, 1 << before - k))
            names = ["w1", "w2", "c1", "c2", "id", "tag", "start", "bit"]
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], pa.int64()) for k in range(len(names))], names)

    windows = saved(contexts.mapInArrow(rows, "w1 bigint, w2 bigint, c1 bigint, c2 bigint, id bigint, tag bigint, start bigint, bit bigint"), "windows")
    place = F.struct("id", "tag", "start")
    first = saved(windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first-windows")
    later = windows.join(first, ["w1", "w2"]).where(place > F.col("first"))
    return later.groupBy("c1", "c2").agg(F.bit_or("bit").alias("mask"))


def _removed(size: int, pos: np.ndarray, before: np.ndarray, after: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which bytes of a block lie in a window that starts earlier elsewhere: bit d of a mask is the window d bytes before its position.

    ``before`` is the greatest d there is, ``after`` how many windows follow that one; EVERY stands for all of them.
    """
    gone = np.zeros(size + 1, np.int64)

    def cover(first: np.ndarray, last: np.ndarray) -> None:
        np.add.at(gone, first, 1)
        np.add.at(gone, last + WINDOW, -1)

    whole = mask == EVERY
    start = pos[whole] - before[whole]
    cover(start, start + after[whole])
    pos, mask = pos[~whole], mask[~whole]
    for d in range(BEFORE + 1) if len(pos) else ():
        at = pos[mask >> d & 1 == 1] - d
        cover(at, at)
    return np.cumsum(gone[:-1]) > 0


def dedup_bytes(docs: DataFrame, keep_text: bool = True, shard_contexts: int = SHARD_CONTEXTS, hashes: int = PIECE_HASHES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept])`` for every row of ``docs(doc_id, text)``.

    Bytes of the UTF-8 text go that lie in 100 consecutive bytes of a text
    which start earlier as well: at a smaller doc_id, or earlier in the same
    document. ``spans`` are the maximal runs of such bytes as (start, end),
    ``kept`` the other bytes (which may cut a character). doc_id is a whole
    number; a null stands before all others. Rows with one doc_id and one text
    count as one document; with different texts the order is by a hash of the
    text. A null or empty text has no bytes. Repeated rows stay. Other columns
    are ignored, no rows give no rows.
    """
    spark = docs.sparkSession
    blocks, name = _blocks(docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id"), "text"))
    size = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # One position in (BEFORE + 2) / 2 is an anchor on average.
    buckets = max(partitions(docs), -(-2 * size // ((BEFORE + 2) * hashes)))
    occurrences = _occurrences(blocks, saved(_repeated(blocks, buckets), "repeated-anchors"), buckets)
    classes = saved(occurrences.groupBy("anchor", "c1", "c2").agg(
        F.min(F.struct("id", "tag", "at", "block", "pos", "before", "after")).alias("first"),
        F.sum(1 + F.coalesce(F.octet_length("more"), F.lit(0)) / 8).alias("n")), "classes")
    contexts = _contexts(blocks, classes, shard_contexts)
    masks = saved(_by_shard(contexts.where("NOT large")).union(_by_core(contexts.where("large"), shard_contexts))
                  .groupBy("c1", "c2").agg(F.bit_or("mask").alias("mask")), "masks")
    telling = saved(classes.join(masks, ["c1", "c2"], "left").where("n > 1 OR mask IS NOT NULL")
                    .select("anchor", "c1", "c2", F.col("first").alias("first_place"), F.coalesce("mask", F.lit(0)).alias("mask")), "telling-classes")
    is_first = (F.col("first_place.id") == F.col("id")) & (F.col("first_place.tag") == F.col("tag")) & (F.col("first_place.at") == F.col("at"))
    entry = F.struct("pos", "before", "after", "more", F.when(is_first, F.col("mask")).otherwise(EVERY).cast("bigint").alias("mask"))
    told = (occurrences.join(telling, ["anchor", "c1", "c2"]).where(~is_first | (F.col("mask") != 0) | F.col("more").isNotNull())
            .groupBy("block").agg(F.collect_list(entry).alias("told")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = next(_one_by_one([batch.slice(k, 1).drop_columns(["told"])]))
                text, ends = row["text"], row["ends"]
                gone = np.zeros(len(text), bool)
                if batch.column("told")[k].is_valid:
                    flat = batch.column("told")[k].values
                    pos, before, after, mask = (flat.field(c).to_numpy().astype(np.int64) for c in ("pos", "before", "after", "mask"))
                    more = [np.frombuffer(m or b"", "<i8") for m in flat.field("more").to_pylist()]
                    count = np.fromiter(map(len, more), np.int64, len(more))
                    gone = _removed(len(text), np.concatenate([pos, *more]), np.r_[before, np.repeat(before, count)],
                                    np.r_[after, np.repeat(after, count)], np.r_[mask, np.full(count.sum(), EVERY)])
                out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": [], "kept": []}
                for start, end in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                    mine = gone[start:end]
                    edges = np.flatnonzero(np.diff(np.r_[0, mine.view(np.int8), 0])) if mine.any() else np.empty(0, np.int64)
                    kept = text[start:end][~mine].tobytes() if len(edges) else text[start:end].tobytes()
                    out["n_bytes"].append(end - start)
                    out["n_removed"].append(end - start - len(kept))
                    out["n_spans"].append(len(edges) // 2)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["spans"].append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()] if keep_text else None)
                    out["kept"].append(kept if keep_text else None)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"]), *[pa.array(v, t) for v, t in zip(out.values(), kinds)]], ["id", *out])

    result = blocks.join(told.hint("shuffle_hash"), "block", "left").mapInArrow(
        rows, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
              "spans array<struct<start: bigint, end: bigint>>, kept binary")
    result = saved(result if keep_text else result.drop("spans", "kept"), "deduplicated")
    spark.sql(f"DROP TABLE {name}")
    doc_id = F.when(F.col("id") != NULL_ID, F.col("id")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return result.select(doc_id, *[c for c in result.columns if c != "id"])
