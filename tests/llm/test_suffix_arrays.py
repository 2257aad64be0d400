"""Byte dedup against brute force."""

import bisect
import hashlib
import random

import numpy as np
import pytest

from rankloom.llm import suffix_arrays
from rankloom.llm.queries import QUERIES
from tests.llm.helpers import DOCS, documents, rows_of, with_clashing_columns


def slow_dedup(rows, window=100):
    """Rows of the result from (doc_id, text), where rows with one id have one text."""
    texts = [(t or "").encode() for _, t in rows]
    first = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in order:
        for at in range(len(texts[k]) - window + 1):
            first.setdefault(texts[k][at:at + window], (rows[k], at))
    out = []
    for row, text in zip(rows, texts):
        gone = np.zeros(len(text) + 1, bool)
        for at in range(len(text) - window + 1):
            if first[text[at:at + window]] != (row, at):
                gone[at:at + window] = True
        edges = np.diff(np.r_[0, gone.astype(int)])
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((row[0], len(text), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed=1, n=70):
    """Texts that share passages of about 100 bytes and more, in many surroundings, across and within documents."""
    rng = random.Random(seed)

    def noise(size, letters="abcdé "):
        return "".join(rng.choice(letters) for _ in range(size))

    line, long, short = noise(115), noise(700), noise(70)
    rows = []
    for k in range(n):
        text = noise(rng.randrange(0, 400))
        for _ in range(rng.randrange(0, 3)):
            a = rng.randrange(500)
            text += rng.choice([line, short, long[a:a + rng.randrange(60, 400)], line[:rng.randrange(80, 115)]]) + noise(rng.randrange(60))
        rows.append((k * 3 - 20, text))
    rows[5] = (rows[5][0], rows[4][1])
    rows[6] = (rows[6][0], rows[4][1][:150] + "#" + rows[4][1][150:])
    rows[7] = (rows[7][0], "x" * 1200)
    rows[8] = (rows[8][0], "xy" * 300 + "漢字😀" * 40)
    rows += [(1000, None), (1001, ""), rows[9], rows[9], (1002, "漢字😀" * 9 + "漢字"), (1003, noise(40_000)), (1004, long)]
    return rows


def test_order_of_windows():
    rng = np.random.default_rng(0)
    for bucket in (1, 7, 50, 1 << 16):
        for size in (100, 160, 900):
            text = rng.integers(97, 99, size).astype(np.uint8)
            again = rng.integers(97, 100, 130).astype(np.uint8)
            for at in rng.integers(0, size, 6):
                text[at:at + 130] = again[:len(text[at:at + 130])]
            starts = np.arange(size - 99)
            windows = [text[a:a + 100].tobytes() for a in starts]
            want = [bisect.bisect_left(sorted(windows), w) for w in windows]
            assert suffix_arrays.equal_windows(text, starts, bucket).tolist() == want


@pytest.mark.parametrize("segment", [1 << 19, 1000, 333])
def test_anchors_do_not_depend_on_segments(segment, monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 9000).astype(np.uint8)
    ends = np.array([40, 40, 139, 239, 1000, 5000, 9000])
    want = {}
    low = np.uint64((1 << 20) - 1)
    for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
        run = suffix_arrays._gram_hashes(text[a:b]) & ~low if b - a >= 100 else []
        for w in range(len(run) - 60):
            place = a + w + int(run[w:w + 61].argmin())
            want[place] = (want.get(place, (a + w,))[0], a + w)
    monkeypatch.setattr(suffix_arrays, "SEGMENT", segment)
    _, places, first, last = suffix_arrays.anchors(text, ends)
    assert [(p, (a, b)) for p, a, b in zip(places.tolist(), first.tolist(), last.tolist())] == sorted(want.items())


# Few contexts in a task: cores, and windows of their own.
@pytest.mark.parametrize("contexts, hashes", [(4096, 1 << 22), (3, 50), (1, 1 << 22)])
def test_bytes_that_occur_earlier_go(spark, contexts, hashes):
    rows = passages()
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOCS).repartition(5)
    want = slow_dedup(rows)
    assert sum(r[2] for r in want) > 5000
    got = suffix_arrays.dedup_bytes(with_clashing_columns(docs), shard_contexts=contexts, hashes=hashes)
    assert rows_of(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == want
    for r in got.collect():
        assert len(r.kept) == r.n_bytes - r.n_removed == r.n_bytes - sum(s.end - s.start for s in r.spans)
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_rows_without_an_id(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abc") for _ in range(300))
    rows = [(None, text), (None, text), (None, text[:200] + "?"), (3, text), (3, text), (3, None)]
    got = suffix_arrays.dedup_bytes(spark.createDataFrame(rows, "doc_id int, text string"), keep_text=False)
    assert got.dtypes[0] == ("doc_id", "int")
    # Of the two texts without an id the one whose hash is less comes first.
    assert rows_of(got.select("doc_id", "n_bytes", "n_removed")) in (
        sorted([(None, 300, a), (None, 300, a), (None, 201, b), (3, 0, 0), (3, 300, 300), (3, 300, 300)], key=repr) for a, b in ((0, 200), (200, 0)))


def test_awkward_documents(spark):
    docs = documents(spark)
    rows = {(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}
    want = slow_dedup(sorted(rows, key=repr))
    got = suffix_arrays.dedup_bytes(docs.where("doc_id IS NOT NULL"), keep_text=False)
    assert sorted(set(rows_of(got)), key=repr) == want and got.count() == docs.where("doc_id IS NOT NULL").count()


def test_query_and_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = slow_dedup([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in want) > 1000
    assert rows_of(QUERIES["op12_suffix_arrays"](spark, folder).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == want
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op12_suffix_arrays"](spark, str(tmp_path)).count() == 0
