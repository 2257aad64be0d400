"""SimHash near-duplicates, candidates found by chains of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import as_bytes, chunks, partitions, saved
from rankloom.llm.components import components

SEED = 42
SHINGLE = 3
DISTANCE = 3
SEGMENTS, WIDTH = 4, 16
# Distinct fingerprints of a segment value from which on the next segment is part of the key too.
HOT_BUCKET = 4096


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of lower-cased words; 0 for none.

    Bit b is set if it is set in over half of the hashes of the shingles, repeats included.
    """
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [words]
    else:
        shingles = zip(*(words[k:] for k in range(shingle)))
    digest, join = xxhash.xxh64_digest, b" ".join
    hashes = np.frombuffer(b"".join([digest(join(s), SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        set_in += np.unpackbits(hashes[at:at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``, whole texts; a null text has no words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fps = [fingerprint((text or b"").lower().split(), shingle) for text in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, fp bigint")


def chain_links(fps: np.ndarray, first: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect fingerprints agreeing in segment ``first``, as pairs of positions.

    Breadth first: what a fingerprint reaches leaves the set still to be
    compared, so a dense cluster of n costs about n steps and gives n - 1
    links. A pair is looked at as long as the differences of the segments
    ``first``, ``first`` + 1, ... (in a ring) stay within ``distance`` / 4 per
    segment; any pair within ``distance`` passes for at least one ``first``.
    """
    masks = []
    covered = 0
    for step in range(SEGMENTS):
        covered |= (1 << WIDTH) - 1 << WIDTH * ((first + step) % SEGMENTS)
        masks.append((np.uint64(covered), (step + 1) * distance // SEGMENTS))
    rest, ahead, out = np.arange(len(fps)), [], []
    while len(rest):
        if not ahead:
            ahead.append(rest[0])
            rest = rest[1:]
        at = ahead.pop()
        kept = np.arange(len(rest))
        apart = fps[rest] ^ fps[at]
        for mask, budget in masks[1:]:
            near = np.bitwise_count(apart & mask) <= budget
            kept, apart = kept[near], apart[near]
        if len(kept):
            found = rest[kept]
            out += [(at, other) for other in found]
            ahead.extend(found)
            rest = np.delete(rest, kept)
    return out


def links(distinct: DataFrame, distance: int = DISTANCE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Edges ``(src, dst)`` that connect all ``fp`` within ``distance`` (at most 3) bits.

    Every fingerprint goes to four buckets, one per 16-bit segment. A bucket
    with many fingerprints is split by its next segment with one bit left out,
    for each of the 16 bits: the chain of two segments allows one difference
    at most, so two fingerprints of a chain still meet. A task holds one
    bucket, eight bytes a fingerprint.
    """
    if not 0 <= distance < SEGMENTS:
        raise ValueError("a segment must agree: distance is 0 to 3")

    def segment(k):
        return F.shiftrightunsigned("fp", WIDTH * (k % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))

    def kept_bits(bit):
        return F.shiftleft(F.lit(bit + 1).cast("long"), 16) + F.col("next").bitwiseAND(F.lit(0xFFFF ^ 1 << bit).cast("long"))

    in_segments = distinct.select("fp", F.explode(F.array(*[
        F.struct((F.lit(k << WIDTH) + segment(k)).alias("bucket"), segment(k + 1).alias("next")) for k in range(SEGMENTS)
    ])).alias("s")).select("fp", "s.*")
    hot = in_segments.groupBy("bucket").count().where(F.col("count") > hot_bucket).select("bucket", F.lit(True).alias("hot"))
    parts = F.when(F.col("hot"), F.array(*[kept_bits(b) for b in range(WIDTH)])).otherwise(F.array(F.lit(0).cast("long")))
    keyed = (in_segments.join(hot, "bucket", "left").select("fp", "bucket", F.explode(parts).alias("part"))
             .select("fp", (F.shiftleft("bucket", 21) + F.col("part")).alias("bucket")))

    def of_bucket(bucket: int, fps: np.ndarray) -> list[tuple[int, int]]:
        fps = fps.view(np.uint64)
        return [(fps[a], fps[b]) for a, b in chain_links(fps, bucket >> 21 + WIDTH, distance)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bucket, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                held_bucket = np.concatenate([held_bucket, batch.column("bucket").to_numpy()])
                held_fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
                # The last bucket may go on in the next batch.
                cut = int(np.searchsorted(held_bucket, held_bucket[-1])) if len(held_bucket) else 0
            else:
                cut = len(held_bucket)
            bucket, fps = held_bucket[:cut], held_fp[:cut]
            held_bucket, held_fp = held_bucket[cut:], held_fp[cut:]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if cut else np.empty(0, int)
            ends = np.r_[starts[1:], cut] if cut else starts
            found = []
            for start, end in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                found += of_bucket(int(bucket[start]), fps[start:end])
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    return (keyed.repartition(partitions(distinct), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(rows, "src bigint, dst bigint"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE,
                    hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id that links of at most ``distance``
    differing bits reach. Null and empty texts have fingerprint zero and link
    like any other. A null doc_id joins links but names no component unless
    nothing else is there (null then). Repeated rows stay. Other columns are
    ignored. No rows give no rows.
    """
    marked = saved(fingerprints(docs, shingle), "fingerprints")
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), distance, hot_bucket))
    rooted = saved(distinct.join(roots, distinct.fp == roots.node, "left")
                   .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    named = saved(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    classes = saved(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
