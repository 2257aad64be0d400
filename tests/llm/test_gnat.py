"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from rankloom.llm import gnat
from rankloom.llm.queries import QUERIES
from tests.llm.helpers import rows_of, with_clashing_columns

VECTORS = "vec_id bigint, embedding array<float>, label int"


def slow_negatives(rows, factor=256):
    """Rows of the result from (vec_id, embedding, label), whose labels are taken as they are."""
    points = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [math.floor(factor * float(np.float32(x))) for x in v])
            points[i] = min(points.get(i, row), row)
    out = []
    for a, (label, v) in points.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in points.items() if i != a and len(w) == len(v))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a, positive, rank, i, -p, -n) for rank, (n, i, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def awkward(seed=2, n=400):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in rng.normal(size=6) / 4], int(rng.integers(0, 4))) for k in range(n)]
    # Equal vectors under one label and under others, and zeros.
    rows += [(n + k, rows[7][1], k % 3) for k in range(60)] + [(600 + k, [0.0] * 6, k % 2) for k in range(60)]
    rows += [(None, [1.0] * 6, 1), (1000, None, 1), (1050, [1.0, None] * 3, 1), (1100, [float("nan")] * 6, 0), (1150, [float("inf")] * 6, 0),
             (1200, [], 1), (1250, [1.0] * 6, None), (1300, [1.0, 2.0], 1), (1301, [1.0, 2.0], 1), (1302, [0.9, 1.9], 0), (1400, [3.0], 2),
             rows[50], (50, [9.0] * 6, 3), (-100, [float(x) for x in rng.normal(size=6)], 2)]
    return rows


@pytest.mark.parametrize("fanout, sample, chunk", [(None, 8192, 8192), (16, 8192, 8192), (3, 40, 25)])
def test_against_brute_force(spark, fanout, sample, chunk):
    rows = awkward()
    want = slow_negatives(rows)
    assert len(want) > 100
    df = with_clashing_columns(spark.createDataFrame(rows, VECTORS).repartition(3))
    got = gnat.hard_negatives(gnat.quantised(df), fanout=fanout, sample=sample, chunk_rows=chunk)
    assert rows_of(got) == want


def test_scores_beyond_exact_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(10**5, 2 * 10**6, 3)], k % 2) for k in range(120)]
    assert rows_of(gnat.hard_negatives(gnat.quantised(spark.createDataFrame(rows, VECTORS)))) == slow_negatives(rows)
    a, b = np.array([[3e5, 2e9]]), np.array([[5e9, 7e8 + 1], [2**40 + 1.0, 1.0], [0.0, 1e300]])
    assert gnat._scores(a, b).tolist() == [[300_000 * 5 * 10**9 + 2 * 10**9 * (7 * 10**8 + 1), 300_000 * (2**40 + 1) + 2 * 10**9, 2**63 - 1]]


def test_ranges_leave_out_only_what_cannot_match():
    rng = np.random.default_rng(3)
    # Clusters, of which a thin window needs few.
    centres = rng.normal(size=(12, 8)) * 300
    x = np.floor(np.repeat(centres, 60, axis=0) + rng.normal(size=(720, 8)) * 10)
    norm = float((x * x).sum(axis=1).max())
    tree = gnat.Tree(x[::5], norm, 6)
    for node in tree.nodes():
        node.low[:], node.high[:] = np.inf, -np.inf
    leaf = tree.place(x, 6, True)
    queries = x[::90]
    scores = gnat._scores(queries, x)
    low, high = np.sort(scores, axis=1)[:, [-40]], np.sort(scores, axis=1)[:, [-10]]
    kept = dict(tree.leaves(queries, low, high, 6))
    for q in range(len(queries)):
        needed = set(leaf[(scores[q] >= low[q]) & (scores[q] <= high[q])].tolist())
        assert needed <= {k for k, mine in kept.items() if q in mine}
    assert sum(map(len, kept.values())) < 0.5 * len(queries) * len(np.unique(leaf))


def test_query_and_empty_tables(spark, folder, tmp_path):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in vectors.collect()]
    assert rows_of(QUERIES["op11_hard_negatives"](spark, folder)) == slow_negatives(rows)
    spark.createDataFrame([], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op11_hard_negatives"](spark, str(tmp_path)).count() == 0
    one = gnat.quantised(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], VECTORS))
    assert gnat.hard_negatives(one).count() == 0
