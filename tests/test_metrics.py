"""Metric cases worked out by hand."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.operators import metrics
from rankloom.operators.ranking import ranked

from .conftest import rows

RUN = "qid string, doc_id string, score double"
QRELS = "qid string, doc_id string, rel int"


def make(spark, run, qrels):
    return ranked(spark.createDataFrame(run, RUN)), spark.createDataFrame(qrels, QRELS)


def scores(spark, run, qrels, ks=(1, 2, 3), **options):
    run, qrels = make(spark, run, qrels)
    return {(r["qid"], r["k"]): r for r in metrics.per_query(run, qrels, ks, **options).collect()}


def test_graded_relevance_and_unjudged_hits(spark):
    got = scores(spark, [("q", "a", 3.0), ("q", "x", 2.0), ("q", "b", 1.0)],
                 [("q", "a", 1), ("q", "b", 2), ("q", "c", 1)])
    ideal3 = 2 + 1 / math.log2(3) + 1 / 2
    assert got["q", 1]["ndcg"] == pytest.approx(1 / 2)
    assert got["q", 3]["ndcg"] == pytest.approx((1 + 2 / 2) / ideal3)
    assert got["q", 3]["ap"] == pytest.approx((1 + 2 / 3) / 3)
    assert got["q", 2]["recall"] == pytest.approx(1 / 3)
    assert got["q", 3]["recall"] == pytest.approx(2 / 3)
    assert got["q", 3]["prec"] == pytest.approx(2 / 3)


def test_cutoff_longer_than_the_list(spark):
    got = scores(spark, [("q", "a", 1.0)], [("q", "a", 1), ("q", "b", 1)], (10,))
    assert got["q", 10]["prec"] == pytest.approx(0.1)
    assert got["q", 10]["recall"] == pytest.approx(0.5)
    assert got["q", 10]["ndcg"] == pytest.approx(1 / (1 + 1 / math.log2(3)))


def test_queries_without_hits_or_without_judgements(spark):
    run = [("q1", "a", 1.0), ("q3", "a", 1.0)]
    qrels = [("q1", "a", 1), ("q2", "a", 1)]
    assert {q for q, _ in scores(spark, run, qrels)} == {"q1"}
    zero = scores(spark, run, qrels, missing="zero")
    assert {q for q, _ in zero} == {"q1", "q2"}
    assert zero["q2", 3]["ndcg"] == zero["q2", 3]["ap"] == zero["q2", 3]["prec"] == 0.0
    run, qrels = make(spark, run, qrels)
    assert [r["ndcg"] for r in metrics.evaluate(run, qrels, (1,), missing="zero").collect()] == [0.5]
    with pytest.raises(ValueError):
        metrics.per_query(run, qrels, missing="drop")


def test_query_without_relevant_documents_scores_zero(spark):
    got = scores(spark, [("q", "a", 1.0)], [("q", "a", 0), ("q", "b", 0)])
    assert got["q", 1]["ndcg"] == got["q", 1]["recall"] == got["q", 1]["ap"] == 0.0


def test_ties_rank_by_document_id(spark):
    run, qrels = make(spark, [("q", "b", 1.0), ("q", "a", 1.0)], [("q", "a", 1)])
    assert rows(run, "doc_id", "rank") == [("a", 1), ("b", 2)]
    assert metrics.evaluate(run, qrels, (1,)).first()["ndcg"] == 1.0


def test_own_id_is_ignored_and_ranks_close_up(spark):
    run, qrels = make(spark, [("a", "a", 9.0), ("a", "b", 1.0)], [("a", "b", 1)])
    assert metrics.evaluate(run, qrels, (1,)).first()["ndcg"] == 1.0
    assert metrics.evaluate(run, qrels, (1,), ignore_identical=False).first()["ndcg"] == 0.0


def test_query_and_document_ids_of_unlike_types(spark):
    run = ranked(spark.createDataFrame([("7", 7, 9.0), ("7", 8, 1.0), ("x", 7, 1.0)], "qid string, doc_id long, score double"))
    qrels = spark.createDataFrame([("7", 8, 1), ("x", 7, 1)], "qid string, doc_id long, rel int")
    assert metrics.evaluate(run, qrels, (1,)).first()["ndcg"] == 1.0


def test_runs_of_a_grid_are_scored_apart(spark):
    run, qrels = make(spark, [("q", "a", 1.0), ("q", "b", 0.5)], [("q", "a", 1), ("p", "a", 1)])
    other, _ = make(spark, [("q", "b", 1.0)], [("q", "a", 1)])
    both = run.withColumn("method", F.lit("m1")).unionByName(other.withColumn("method", F.lit("m2")))
    assert rows(metrics.evaluate(both, qrels, (1,), ["method"]), "method", "num_queries", "ndcg") == [("m1", 1, 1.0), ("m2", 1, 0.0)]
    zero = metrics.evaluate(both, qrels, (1,), ["method"], missing="zero")
    assert rows(zero, "method", "num_queries", "ndcg") == [("m1", 2, 0.5), ("m2", 2, 0.0)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 3), min_size=1),
       st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 5), min_size=1))
def test_bounds_and_the_ideal_run(spark, relevant, found):
    run = [("q", d, float(s)) for d, s in found.items()]
    qrels = [("q", d, r) for d, r in relevant.items()]
    for r in scores(spark, run, qrels, (1, 10)).values():
        assert all(-1e-9 <= r[c] <= 1 + 1e-9 for c in ("ndcg", "ap", "recall", "prec"))
    ideal = scores(spark, [("q", d, float(r)) for d, r in relevant.items()], qrels, (1, 10))
    assert ideal["q", 1]["ndcg"] == pytest.approx(1.0)
    assert ideal["q", 10]["ndcg"] == pytest.approx(1.0)


def test_a_grade_below_zero_gains_nothing(spark):
    got = scores(spark, [("q", "a", 3.0), ("q", "b", 2.0)], [("q", "a", -1), ("q", "b", 1)], (10,))
    assert got["q", 10]["ndcg"] == pytest.approx(1 / math.log2(3))
    only = scores(spark, [("q", "a", 3.0)], [("q", "a", -1)], (10,))
    assert only["q", 10]["ndcg"] == 0


def test_ranks_beyond_the_last_cutoff_are_cut_early(spark):
    run = spark.createDataFrame([("q", f"d{k:03d}", float(-k)) for k in range(50)], RUN)
    qrels = spark.createDataFrame([("q", "d001", 1), ("q", "d040", 1)], QRELS)
    scored = metrics.evaluate(run, qrels, (1, 5))
    assert "WindowGroupLimit" in scored._jdf.queryExecution().executedPlan().toString()
    assert [(r["k"], r["recall"]) for r in scored.orderBy("k").collect()] == [(1, 0.0), (5, 0.5)]
