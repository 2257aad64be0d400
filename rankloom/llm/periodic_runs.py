"""Runs of repeated words, found by seeds on diagonals.

In a run of period q words q apart are equal, so on the diagonal of lag q a
stretch of equal words stands that is as long as the run less q: at least six
words, as runs have 12 words or more, and at least q. A run is therefore seen
by the k-grams of that minimum overlap: six words for lags up to 11, twelve for
lags of 12 to 23, and so on by doubling. For each of these sizes

1. grams are numbered exactly, longer ones from two halves, and only places
   whose gram occurs again in the same document stay;
2. occurrences of a gram at most half its size apart form a chain, which is
   periodic itself. A pair of places is a seed if it has a lag of this size
   and at least one of them is the first of its chain: any other pair has the
   same diagonal as the pair one step back in both chains. Within one chain
   only neighbours count, other lags being multiples of its period. So there
   are a few seeds for each word, however often a gram is repeated;
3. seeds are extended in order along their diagonal to both sides, and a seed
   before the furthest place that its lag has covered is not extended again.

A stretch that is long enough is a run if its first q words are no power of a
shorter word sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import as_bytes, chunks

SHORTEST = 12
# The minimum overlap on the diagonal of any run.
SEED = SHORTEST // 2
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _numbered(ids: list[np.ndarray]) -> np.ndarray:
    """Dense numbers of rows of several columns of numbers from 0 on."""
    first = ids[0]
    for other in ids[1:]:
        first = np.unique(first * np.int64(int(other.max(initial=0)) + 1) + other, return_inverse=True)[1].astype(np.int64)
    return first


def _seeds(places: np.ndarray, grams: np.ndarray, size: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) of the pairs to be extended, for lags of ``least`` to ``most``; ``places`` ascend."""
    order = np.argsort(grams, kind="stable")
    at, gram = places[order], grams[order]
    base = gram * np.int64(int(at.max()) + 1)
    key = base + at
    first = np.r_[True, (gram[1:] != gram[:-1]) | (at[1:] - at[:-1] > size // 2)]
    chain = np.cumsum(first)
    heads = np.flatnonzero(first)
    found = []
    for step in (-1, 1):
        # Heads before each place, then heads after the places that are none.
        mine = np.arange(len(at)) if step < 0 else np.flatnonzero(~first)
        if step < 0:
            low, high = base + np.maximum(at - most, 0), base + np.maximum(at - least, -1)
        else:
            low, high = base[mine] + at[mine] + least, base[mine] + np.minimum(at[mine] + most, int(at.max()))
        start, end = np.searchsorted(key[heads], low), np.searchsorted(key[heads], high, "right")
        count = np.maximum(end - start, 0)
        mine = np.repeat(mine, count)
        head = heads[np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        left, right = (head, mine) if step < 0 else (mine, head)
        apart = (chain[left] != chain[right]) | (right - left == 1)
        found.append((at[right[apart]] - at[left[apart]], at[left[apart]]))
    lag, place = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, lag))
    return lag[order], place[order]


def _equal_from(ids: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on, where ``a`` < ``b``."""
    done, step = 0, 32
    while b + done < len(ids):
        differ = ids[a + done:a + done + step][:len(ids) - b - done] != ids[b + done:b + done + step]
        if differ.any():
            return done + int(differ.argmax())
        done += len(differ)
        step *= 4
    return done


def _equal_before(ids: np.ndarray, a: int, b: int) -> int:
    """How many words before ``a`` equal those before ``b``, where ``a`` < ``b``."""
    done, step = 0, 32
    while a > done:
        n = min(step, a - done)
        differ = ids[a - done - n:a - done] != ids[b - done - n:b - done]
        if differ.any():
            return done + int(differ[::-1].argmax())
        done += n
        step *= 4
    return done


def _is_power(root: np.ndarray) -> bool:
    """Whether a word sequence is a shorter one written several times."""
    n = rest = len(root)
    factor = 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            period = n // factor
            if (root[period:] == root[:-period]).all():
                return True
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return False


def runs(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All runs ``(start, length, period)`` by start and period.

    ``ids`` are the words of several documents, one after the other up to
    ``ends``; equal words have equal numbers in a document and other numbers in
    any other document.
    """
    found: list[tuple[int, int, int]] = []
    sizes = np.diff(np.r_[0, ends])
    left = np.repeat(ends, sizes) - np.arange(len(ids))
    size, grams, places = 1, ids, np.arange(len(ids))
    numbers = np.full(len(ids), -1, np.int64)
    for parts in (3, 2) + (2,) * 64:
        # Grams of ``parts`` times the size; their parts all occur again and lie in one document.
        wide = size * parts
        numbers[:] = -1
        numbers[places] = grams
        places = places[left[places] >= wide]
        columns = [numbers[places + k * size] for k in range(parts)]
        alive = np.logical_and.reduce([c >= 0 for c in columns])
        places, columns, size = places[alive], [c[alive] for c in columns], wide
        if not len(places):
            break
        grams = _numbered(columns)
        again = np.bincount(grams)[grams] > 1
        places, grams = places[again], grams[again]
        if not len(places):
            break
        if size < SEED:
            continue
        last_lag, covered = 0, -1
        for lag, at in zip(*(x.tolist() for x in _seeds(places, grams, size, 1 if size == SEED else size, 2 * size - 1))):
            if lag != last_lag:
                last_lag, covered = lag, -1
            if at < covered:
                continue
            covered = at + _equal_from(ids, at, at + lag)
            start = at - _equal_before(ids, at, at + lag)
            length = covered - start + lag
            if length >= max(SHORTEST, 2 * lag) and not _is_power(ids[start:start + lag]):
                found.append((start, length, lag))
    return np.array(sorted((s, q, n) for s, n, q in found), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row of ``docs(doc_id, text)``.

    Words are what stands between spaces, tabs and line ends. A run is a
    stretch of at least 12 words and two periods that no neighbouring word
    extends; its period is the smallest there is. ``runs`` are ordered by start
    and period, starts count words from 0. ``collapsed`` are the words joined
    by one space, without those after the first period of some run. A null or
    empty text has no words, no runs and an empty ``collapsed``. Rows are taken
    one by one, whatever their ids; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts, numbers, base = [], [], 0
            for text in as_bytes(batch.column("text")):
                words = (text or b"").split()
                own: dict[bytes, int] = {}
                numbers.append(np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words)) + base)
                base += len(own)
                texts.append(words)
            ends = np.cumsum([len(w) for w in texts])
            every = runs(np.concatenate([np.empty(0, np.int64), *numbers]), ends)
            doc = np.searchsorted(ends, every[:, 0], "right")
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            out, collapsed = [], []
            for words, end, a, b in zip(texts, ends.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                mine = every[a:b] - [end - len(words), 0, 0]
                out.append([{"start": s, "length": n, "period": q} for s, n, q in mine.tolist()])
                if len(mine):
                    kept = np.ones(len(words), bool)
                    for s, n, q in mine.tolist():
                        kept[s + q:s + n] = False
                    words = compress(words, kept.tolist())
                collapsed.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()),
                 pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                 pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def with_loops(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: a tenth of the documents, by a hash of the id, go on by repeating a piece of theirs from some word on.

    With h the CRC-32 of the decimal id and g = h div 10, texts with h % 10 = 0
    repeat their p words from word a on, where a = g % n and p = 1 + (n - a) div (3 + g % 8). A row without an id stays as it is.
    """
    hashed = F.crc32(F.col("doc_id").cast("string"))
    g = "crc32(cast(doc_id as string)) div 10"
    looped = F.expr(f"""
        transform(array(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)), w -> CASE WHEN size(w) = 0 THEN '' ELSE
          transform(array(named_struct('a', ({g}) % size(w), 'p', 1 + (size(w) - ({g}) % size(w)) div (3 + ({g}) % 8))), c ->
            array_join(concat(slice(w, 1, cast(c.a as int)),
                              transform(sequence(c.a, size(w) - 1L), i -> w[cast(c.a + (i - c.a) % c.p as int)])), ' '))[0] END)[0]""")
    return docs.select("doc_id", F.when((hashed % 10 == 0) & F.col("text").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The longest run and hashes of all runs and of the collapsed text, for the rows of ``periodic_runs``."""
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS less, r.start AS start, r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    longest: Column = -F.col("best.less")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), longest.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * longest / F.col("best.period")).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
