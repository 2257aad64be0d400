"""Runs of repeated words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from rankloom.llm import periodic_runs
from rankloom.llm.queries import QUERIES
from tests.llm.helpers import DOCS, documents, rows_of, with_clashing_columns

SPACE = r"[^\x20\x09-\x0D]+"


def slow_runs(words):
    """(start, length, period) of all runs, by comparing all words of every distance."""
    out = []
    names = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    for period in range(1, len(ids) // 2 + 1):
        same = ids[:-period] == ids[period:]
        edges = np.flatnonzero(np.diff(np.r_[0, same.astype(int), 0]))
        for start, end in edges.reshape(-1, 2).tolist():
            length = end - start + period
            part = ids[start:start + length]
            if length >= max(12, 2 * period) and not any((part[d:] == part[:-d]).all() for d in range(1, period)):
                out.append((start, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, words):
    found = slow_runs(words)
    kept = [True] * len(words)
    for start, length, period in found:
        kept[start + period:start + length] = [False] * (length - period)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *(best and (*best, 1000 * best[1] // best[2]) or (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(w for w, k in zip(words, kept) if k).encode()).hexdigest())


def slow_loops(doc_id, text):
    words = re.findall(SPACE, text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_of_random_words():
    rng = random.Random(1)
    total = 0
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            words = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(0, 130))]
            for _ in range(rng.randrange(4) if words else 0):
                a, q = rng.randrange(len(words)), rng.randrange(1, 40)
                for x in range(a + q, min(len(words), a + rng.randrange(130))):
                    words[x] = words[x - q]
            docs.append(words)
        numbers, base = [], 0
        for words in docs:
            numbers += [w + base for w in words]
            base += 5
        ends = np.cumsum([len(w) for w in docs])
        want = [(s + int(end) - len(words), n, q) for words, end in zip(docs, ends) for s, n, q in slow_runs(words)]
        assert [tuple(r) for r in periodic_runs.runs(np.array(numbers, np.int64), ends).tolist()] == want
        total += len(want)
    assert total > 150


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [[0] * 900, [0] * 400 + [1] + [0] * 400, ([0] * 30 + [1]) * 25, fibonacci(900), [0, 1] * 300 + [0, 0, 1] * 100,
                                   list(range(300)) * 3, list(range(11)) + [1] * 11])
def test_runs_of_very_regular_words(words):
    got = periodic_runs.runs(np.array(words, np.int64), np.array([len(words)]))
    assert [tuple(r) for r in got.tolist()] == slow_runs(words)


def test_seeds_stay_few():
    """A word a hundred thousand times over has one run, and not a pair of places for every lag."""
    ids = np.zeros(100_000, np.int64)
    lag, _ = periodic_runs._seeds(np.arange(99_989), np.zeros(99_989, np.int64), 12, 12, 23)
    assert len(lag) == 0
    assert periodic_runs.runs(ids, np.array([100_000])).tolist() == [[0, 100_000, 1]]


def test_operator_on_awkward_documents(spark):
    docs = documents(spark)
    rows = docs.collect()
    want = [slow_row(r.doc_id, re.findall(SPACE, r.text or "")) for r in rows if len(r.text or "") < 5000]
    long = docs.where("doc_id = 16").first().text.split()
    got = periodic_runs.digest(periodic_runs.periodic_runs(with_clashing_columns(docs)))
    assert rows_of(got.where("doc_id <> 16 OR doc_id IS NULL")) == sorted(want, key=repr)
    assert sum(r[1] for r in want) > 5
    full = periodic_runs.periodic_runs(docs).where("doc_id = 16").first()
    assert full.n_words == len(long) and full.runs == [] and full.collapsed == " ".join(long)
    empty = periodic_runs.periodic_runs(docs).where("doc_id IN (12, 13, 14)").select("n_words", "runs", "collapsed")
    assert all(tuple(r) == (0, [], "") for r in empty.collect())


def test_loops_and_query(spark, folder, tmp_path):
    docs = documents(spark, n=80)
    got = {(r.doc_id, tuple(re.findall(SPACE, r.text or ""))) for r in periodic_runs.with_loops(docs).collect()}
    assert got == {(r.doc_id, tuple(slow_loops(r.doc_id, r.text))) for r in docs.collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((slow_row(r.doc_id, slow_loops(r.doc_id, r.text)) for r in rows), key=repr)
    assert rows_of(QUERIES["op13_periodic_runs"](spark, folder)) == want
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_periodic_runs"](spark, str(tmp_path)).count() == 0
