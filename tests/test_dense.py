"""Vector search against numpy over all pairs."""

import threading
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.catalog import fixtures as fx
from rankloom.functions.vectors import inner_product, l2_normalize, unit_interval_score
from rankloom.operators import balls, dense, ivf
from rankloom.operators.balls import BallIndex
from rankloom.operators.encode import encode_dense
from rankloom.operators.quantize import FlatIndex, Int8Codec, PqCodec
from rankloom.operators.two_level import TwoLevelCells

from .conftest import rows

CELLS = 16


@pytest.fixture(scope="module")
def vectors(spark, folder):
    return fx.vectors(spark, folder).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.withColumnRenamed("doc_id", "qid")


@pytest.fixture(scope="module")
def exact(asked, vectors):
    return rows(dense.search(asked, vectors, 10, skip_identical=True))


def recall(run, exact):
    pairs = {(q, d) for q, d, *_ in exact}
    return len(pairs & {(q, d) for q, d, *_ in run}) / len(pairs)


def brute_force(asked, vectors, k, skip_identical):
    q, v = asked.orderBy("qid").collect(), vectors.orderBy("doc_id").collect()
    scores = np.round(np.array([r["vector"] for r in q], float) @ np.array([r["vector"] for r in v], float).T, 6)
    out = []
    for i, row in enumerate(q):
        order = sorted((-s, v[j]["doc_id"]) for j, s in enumerate(scores[i])
                       if not (skip_identical and v[j]["doc_id"] == row["qid"]))
        out += [(row["qid"], d, -s, r) for r, (s, d) in enumerate(order[:k], 1)]
    return sorted(out)


def test_exact_search_equals_all_pairs(asked, vectors, exact):
    assert exact == brute_force(asked, vectors, 10, True)
    assert rows(dense.search(asked, vectors, 3)) == brute_force(asked, vectors, 3, False)


def test_large_query_side_gives_the_same_run(asked, vectors, exact):
    grid = dense.search(asked, vectors, 10, skip_identical=True, broadcast_bytes=0, query_block=70)
    assert rows(grid) == exact


def test_many_copies_and_string_ids(spark):
    """Two thirds of the vectors are copies; ties go to the lowest id."""
    data = [(f"d{i:03d}", [1.0, 0.0] if i % 3 else [0.0, float(i)]) for i in range(300)]
    v = spark.createDataFrame(data, "doc_id string, vector array<float>").repartition(5)
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("d001", [1.0, 0.1])], "qid string, vector array<float>")
    want = brute_force(q, v, 7, True)
    assert rows(dense.search(q, v, 7, skip_identical=True)) == want
    assert rows(dense.search(q, v, 7, skip_identical=True, broadcast_bytes=0, query_block=1)) == want


def test_fewer_vectors_than_k_and_null_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "doc_id long, vector array<float>")
    q = spark.createDataFrame([(7, [0.5, 0.0])], "qid long, vector array<float>")
    assert rows(dense.search(q, v, 5)) == [(7, 1, 0.5, 1)]


def test_probing_every_cell_is_exact_and_more_probes_find_more(asked, vectors, exact):
    index = ivf.CellIndex.build(vectors, CELLS)
    found = [recall(rows(index.search(asked, 10, n, skip_identical=True)), exact) for n in (1, 4, 8)]
    assert found == sorted(found) and found[0] > 0.1
    assert rows(index.search(asked, 10, CELLS, skip_identical=True)) == exact
    one = rows(index.search(asked, 10, 4, skip_identical=True))
    grid = index.search(asked, 10, 4, skip_identical=True, broadcast_bytes=0, query_block=40)
    assert rows(grid) == one


def test_effort_by_size_finds_nine_tenths(vectors, asked, exact):
    index = ivf.CellIndex.build(vectors)
    assert len(index.centres) == 23
    assert recall(rows(index.search(asked, 10, skip_identical=True)), exact) >= 0.9
    assert [ivf.suggested_cells(n) for n in (0, 1, 2, 16, 17)] == [1, 1, 2, 4, 5] and ivf.suggested_probes(1) == 1


def test_trials_start_from_other_seeds(vectors):
    first, second = ivf.train_cells(vectors, 8, 1, 0), ivf.train_cells(vectors, 8, 1, 1)
    assert first.shape == second.shape == (8, 64) and not np.allclose(first, second)
    # Any trial has seeds, of as many vectors as there are.
    few = vectors.limit(3)
    assert ivf.train_cells(few, 8, 1, 10_000).shape == (3, 64)
    assert ivf.CellIndex.build(vectors.limit(1)).search(vectors.limit(1).withColumnRenamed("doc_id", "qid"), 5).count() == 1


@pytest.mark.parametrize("codec", [None, Int8Codec, PqCodec])
def test_stored_cell_index_reopens(spark, vectors, asked, codec, tmp_path):
    path = str(tmp_path / "cells")
    made = ivf.CellIndex.build(vectors, CELLS, codec=codec and codec.fit(vectors), path=path)
    again = ivf.CellIndex.open(spark, path)
    assert rows(again.search(asked.where("qid < 50"), 5)) == rows(made.search(asked.where("qid < 50"), 5))


def test_probed_cells_prune_the_stored_partitions(vectors, asked):
    index = ivf.CellIndex.build(vectors, CELLS)
    run = index.search(asked.where("qid = 3"), 5, 2)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_compressed_search_is_close(asked, vectors, exact):
    int8 = Int8Codec.fit(vectors)
    run = rows(dense.search(asked, int8.encode(vectors), 10, "codes", int8.decode, skip_identical=True))
    assert recall(run, exact) >= 0.9
    pq = PqCodec.fit(vectors)
    run = rows(dense.search(asked, pq.encode(vectors), 10, "codes", pq.decode, skip_identical=True))
    assert recall(run, exact) >= 0.4
    index = ivf.CellIndex.build(vectors, CELLS, codec=int8)
    assert recall(rows(index.search(asked, 10, CELLS, skip_identical=True)), exact) >= 0.9


def test_lookups_equal_decoded_products(vectors):
    codec = PqCodec.fit(vectors)
    rng = np.random.default_rng(0)
    queries, codes = rng.normal(size=(7, 64)), pa.array(rng.integers(0, 256, (50, 8)).tolist(), pa.list_(pa.int16()))
    part, inside = np.array([5, 1, 6]), np.arange(3, 40, 2)
    got = codec.product(queries)(codes)(part, inside)
    assert np.allclose(got, queries[part] @ codec.decode(codes)[inside].T)
    assert codec.query_bytes == 8 * 8 * 256


@pytest.mark.parametrize("codec", [None, Int8Codec, PqCodec])
def test_flat_index_reopens(spark, vectors, asked, codec, tmp_path):
    made = FlatIndex.build(vectors, codec and codec.fit(vectors), str(tmp_path / "flat"))
    again = FlatIndex.open(spark, str(tmp_path / "flat"))
    assert rows(again.search(asked.where("qid < 50"), 5)) == rows(made.search(asked.where("qid < 50"), 5))


def test_candidates_by_codes_ranked_by_vectors(vectors, asked, exact):
    index = FlatIndex.build(vectors, PqCodec.fit(vectors))
    found = rows(index.search(asked, 10, vectors, 10, skip_identical=True))
    assert recall(found, exact) >= 0.9
    # Exact scores, so whatever is found stands in the order of the exact run.
    assert {(q, d, s) for q, d, s, _ in found if (q, d) in {(q, d) for q, d, *_ in exact}} <= {(q, d, s) for q, d, s, _ in exact}
    # All rows as candidates: the exact run.
    assert rows(index.search(asked, 10, vectors, 60, skip_identical=True)) == exact
    cells = ivf.CellIndex.build(vectors, CELLS, codec=PqCodec.fit(vectors))
    assert rows(cells.search(asked, 10, CELLS, vectors, 60, skip_identical=True)) == exact


def clustered(spark, n=4000, dim=16):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, dim)) * 5
    points = centres[np.arange(n) % 20] + rng.normal(size=(n, dim)) * 0.2
    return spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(points)], "doc_id long, vector array<float>").cache()


def test_balls_out_of_reach_are_passed_over(spark, vectors, asked, exact, tmp_path):
    index = BallIndex.build(vectors, ball_rows=32)
    assert rows(index.search(asked, 10, skip_identical=True)) == exact
    assert rows(index.search(asked, 10, skip_identical=True, broadcast_bytes=0, query_block=70)) == exact
    points = clustered(spark)
    queries = points.where("doc_id % 40 = 7").select(F.col("doc_id").alias("qid"), "vector")
    index = BallIndex.build(points, str(tmp_path / "balls"), shards=2)
    looked_at, skipped = (spark.sparkContext.accumulator(0) for _ in range(2))
    got = rows(BallIndex.open(spark, str(tmp_path / "balls")).search(queries, 10, looked_at=looked_at, skipped=skipped))
    assert got == rows(dense.search(queries, points, 10))
    assert looked_at.value + skipped.value == queries.count() * index.balls.count() and skipped.value > 1000
    odd = spark.createDataFrame([(None, [1.0]), (1, None), (2, [0.5])], "doc_id long, vector array<float>")
    assert rows(BallIndex.build(odd).search(spark.createDataFrame([(9, [2.0])], "qid long, vector array<float>"), 5)) == [(9, 2, 1.0, 1)]


@pytest.mark.parametrize("codec", [None, PqCodec])
def test_cells_of_two_levels(spark, vectors, asked, exact, codec, tmp_path):
    path = str(tmp_path / "cells")
    index = TwoLevelCells.build(vectors, 6, 5, codec=codec and codec.fit(vectors), path=path, rows_a_task=40)
    assert index.rows.count() == 500 and index.rows.where("cell div 5 <> coarse").count() == 0
    options = {"skip_identical": True} if codec is None else {"vectors": vectors, "factor": 50, "skip_identical": True}
    assert rows(index.search(asked, 10, 6, 30, **options)) == exact
    found = [recall(rows(index.search(asked, 10, c, n, **options)), exact) for c, n in ((2, 3), (4, 12), (5, 20))]
    assert found == sorted(found) and found[-1] >= 0.85
    again = TwoLevelCells.open(spark, path)
    few = asked.where("qid < 60")
    assert rows(again.search(few, 10, 4, 12, **options)) == rows(index.search(few, 10, 4, 12, **options))
    plan = again.search(few.where("qid = 3"), 5, 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(coarse" in plan or "PartitionFilters: [coarse" in plan


def test_fine_centres_lie_in_their_coarse_cell(spark):
    """Twenty clusters in 5 coarse cells; few probes find all neighbours."""
    points = clustered(spark)
    queries = points.where("doc_id % 40 = 7").select(F.col("doc_id").alias("qid"), "vector")
    index = TwoLevelCells.build(points, 5, 8)
    near = [(q, d) for q, d, *_ in rows(dense.search(queries, points, 10))]
    got = [(q, d) for q, d, *_ in rows(index.search(queries, 10, 2, 8))]
    assert len(set(near) & set(got)) >= 0.95 * len(near)


def test_codes_of_a_constant_table(spark):
    v = spark.createDataFrame([(1, [0.5, 0.5])], "doc_id long, vector array<float>")
    codec = Int8Codec.fit(v)
    assert codec.encode(v).first()["codes"] == [0, 0]
    with pytest.raises(ValueError):
        PqCodec.fit(spark.createDataFrame([(1, [0.1] * 9)], "doc_id long, vector array<float>"))


def test_array_functions_agree_with_block_products(asked, vectors, exact):
    one = asked.where("qid = 5").select(F.col("vector").alias("q"))
    other = {r[0]: r[1] for r in vectors.withColumn("q", F.lit(one.first()["q"]).cast("array<float>"))
             .select("doc_id", F.round(inner_product(F.col("q"), F.col("vector")), 6)).collect()}
    assert all(other[d] == s for q, d, s, _ in exact if q == 5)


def test_normalising_guards_the_zero_vector(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r[0] for r in v.select(l2_normalize(F.col("v"))).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]
    assert v.select(unit_interval_score(F.lit(1.0))).first()[0] == 1.0


class ShapeEncoder:
    """Remembers nothing; the vector tells how long the text and its batch are."""

    encoder_id = "shape"

    def __call__(self):
        return lambda texts: np.array([[len(t) + 1.0, len(texts)] for t in texts])


def test_encoding_runs_in_batches(spark):
    texts = spark.range(600).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")).coalesce(1)
    got = encode_dense(texts, ShapeEncoder(), batch_rows=256).collect()
    sizes = sorted({round(r["vector"][1] / r["vector"][0]) for r in got})
    assert len(got) == 600 and sizes == [88, 256]


def test_grid_has_no_nested_loop_join(asked, vectors):
    run = dense.search(asked, vectors, 3, broadcast_bytes=0, query_block=200)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("kind", ["smallint", "decimal(5,0)", "date", "string"])
def test_ids_of_any_kind(spark, kind):
    rows_of = [(k, [1.0, float(k)]) for k in range(6)] + [(None, [1.0, 99.0])]
    ids = "date_add(date'2020-01-01', id)" if kind == "date" else f"cast(id as {kind})"
    v = spark.createDataFrame(rows_of, "id int, vector array<float>").selectExpr(f"{ids} AS doc_id", "vector")
    got = dense.search(v.withColumnRenamed("doc_id", "qid"), v, 2, skip_identical=True)
    assert got.schema["doc_id"].dataType == v.schema["doc_id"].dataType
    assert got.count() == 12 and got.where("doc_id IS NULL OR qid IS NULL OR qid = doc_id").count() == 0


def _most_held(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_bounds_of_balls_stay_within_the_buffer():
    rng = np.random.default_rng(0)
    queries, vectors = rng.normal(size=(5_000, 4)), rng.normal(size=(4_000, 4))
    batch = pa.RecordBatch.from_pydict({"doc_ids": pa.array([[i] for i in range(4_000)], pa.list_(pa.int64())), "vectors": [v.tobytes() for v in vectors],
                                        "centre": [v.tobytes() for v in vectors], "radius": np.zeros(4_000)})
    schema = pa.schema([("qid", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("score", pa.list_(pa.float64()))])
    out = []
    task = balls._scan(SimpleNamespace(value=(np.arange(5_000), queries)), 1, False, schema, None, None)
    # All bounds at once are 160 MB.
    assert _most_held(lambda: out.extend(task(iter([batch])))) < 100_000_000
    found = {q: d for part in out for q, (d,) in zip(part.column("qid").to_pylist(), part.column("doc_id").to_pylist())}
    assert [found[q] for q in range(5_000)] == (np.round(queries @ vectors.T, 6)).argmax(axis=1).tolist()


def test_lookup_tables_are_of_few_queries():
    rng = np.random.default_rng(0)
    codec, queries = PqCodec(rng.normal(size=(8, 256, 8))), rng.normal(size=(5_000, 64))
    codes = pa.array(rng.integers(0, 256, (300, 8)).tolist(), pa.list_(pa.int16()))
    part, got = np.arange(600), []
    # The tables of all queries are 82 MB.
    assert _most_held(lambda: got.append(codec.product(queries)(codes)(part, slice(None)))) < 20_000_000
    assert np.allclose(got[0], queries[part] @ codec.decode(codes).T)


def test_chunks_count_all_rows_kept_for_a_query(vectors, asked):
    some, sizes = asked.where("qid < 50"), []
    k = 100

    def scan(part):
        sizes.append(part.count())
        return vectors.crossJoin(part.select("qid")).select(
            "qid", F.array("doc_id").alias("doc_id"), F.array(F.lit(1.0)).alias("score"))

    # 64 components and 100 rows of 24 bytes are 2,928 bytes a query.
    dense.in_chunks(some, k, scan, broadcast_bytes=50_000)
    assert sum(sizes) == some.count() and len(sizes) > 1 and max(sizes) < some.count()


def _scanned(queries, vectors, k, skip_identical, batch_rows=1_000):
    """What one task leaves of a scan, by position of query, and how many scores it formed in double precision."""
    schema = pa.schema([("qid", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("score", pa.list_(pa.float64()))])
    table = pa.table({"doc_id": np.arange(len(vectors)), "vector": pa.array(list(vectors), pa.list_(pa.float64()))})
    formed, offer = [0], dense.BestRows.offer

    def counted(self, rows, scores, ids):
        formed[0] += len(rows)
        offer(self, rows, scores, ids)

    dense.BestRows.offer = counted
    try:
        task = dense._screen_task(SimpleNamespace(value=(np.arange(len(queries)), queries, None)), k, "vector", dense.plain, skip_identical, schema)
        out = pa.Table.from_batches(list(task(iter(table.to_batches(max_chunksize=batch_rows)))), schema)
    finally:
        dense.BestRows.offer = offer
    return {r["qid"]: list(zip(r["doc_id"], r["score"])) for r in out.to_pylist()}, formed[0]


def _best(queries, vectors, k, skip_identical):
    scores = np.round(queries @ vectors.T, 6)
    if skip_identical:
        scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    return {i: [(int(j), s[j]) for j in np.lexsort((np.arange(len(s)), -s))[:k] if s[j] > -np.inf] for i, s in enumerate(scores)}


def test_few_scores_need_double_precision():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(9_000, 64))
    got, formed = _scanned(vectors[:500], vectors, 10, True)
    assert got == _best(vectors[:500], vectors, 10, True)
    # All 4.5 million were, and these are 4 hundredths of them.
    assert formed < 180_000


@pytest.mark.parametrize("k", [1, 10, 300])
def test_scores_that_single_precision_cannot_tell_apart(k, monkeypatch):
    """Copies, near copies a millionth apart, long and short vectors, numbers out of the range of single precision."""
    rng = np.random.default_rng(k)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 512)
    monkeypatch.setattr(dense, "DECODED_BYTES", 100_000)
    base = rng.normal(size=(40, 16))
    near = base[rng.integers(0, 40, 2_000)] * (1 + rng.integers(0, 5, (2_000, 1)) * 1e-6)
    vectors = np.concatenate([near, near[:50], -near[:50], rng.normal(size=(50, 16)) * 1e-4, rng.normal(size=(30, 16)) * 300])
    for rows in (vectors, vectors[::-1].copy(), vectors[:7], rng.integers(-3, 4, (700, 16)).astype(float)):
        queries = rows[:300]
        assert _scanned(queries, rows, k, True, 199)[0] == _best(queries, rows, k, True)
    far = np.concatenate([vectors[:600], vectors[:3] * 1e30, vectors[600:1200]])
    mixed = np.concatenate([vectors[:20], vectors[:2] * 1e30])
    got, want = _scanned(mixed, far, k, False, 199)[0], _best(mixed, far, k, False)
    assert {q: [d for d, _ in found] for q, found in got.items() if q < 20} == {q: [d for d, _ in found] for q, found in want.items() if q < 20}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-9) for q in want)


def test_a_small_run_is_merged_by_few_tasks(spark, vectors, asked, exact):
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        run = dense.search(asked, vectors, 10, skip_identical=True)
        assert run.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_chunks_overlap_and_fail_as_one(vectors, asked):
    met = threading.Barrier(2)

    def scan(part):
        # Waits for another chunk.
        met.wait(60)
        return part.select("qid", F.array(F.col("qid")).alias("doc_id"), F.array(F.lit(1.0)).alias("score"))

    some = asked.where("qid < 40")
    run = rows(dense.in_chunks(some.withColumn("cells", F.array((F.col("qid") % 4).cast("int"))), 5, scan, broadcast_bytes=0, query_block=10))
    assert run == [(q, q, 1.0, 1) for q in range(40)]

    def broken(part):
        raise ValueError("no scan")

    with pytest.raises(ValueError, match="no scan"):
        dense.in_chunks(some, 5, broken, broadcast_bytes=0, query_block=10)
