"""Ranking quality: NDCG, MAP, recall and precision at several cut-offs.

Gain is linear with a log2 discount, relevant means rel >= 1, MAP and recall
divide by all relevant documents of the query. Averages run over the queries
present in both the run and the judgements, or over every judged query with
``missing="zero"``. ``by`` names extra key columns (dataset, method, trial), so
the runs of a whole experiment grid are scored in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import top_k
from .runs import differs_from_query

CUTOFFS = (1, 10, 100)
PLACES = 5


def _relevant() -> Column:
    return F.col("rel") >= 1


def _gain(place: str) -> Column:
    """Discounted gain; a grade below zero gains nothing."""
    return F.greatest("rel", F.lit(0)).cast("double") / F.log2(F.col(place).cast("double") + F.lit(1.0))


def _shared(run: DataFrame, qrels: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c in by if c in qrels.columns]


def judged_run(run: DataFrame, qrels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The run with ``rel``; a document nobody judged has rel 0."""
    keys = [*_shared(run, qrels, by), "qid", "doc_id"]
    judged = run.join(qrels.select(*keys, "rel"), keys, "left")
    return judged.select(*by, "qid", "doc_id", "score", "rank",
                         F.coalesce("rel", F.lit(0)).cast("int").alias("rel"))


def ideal_dcg(qrels: DataFrame, ks: Sequence[int] = CUTOFFS, by: Sequence[str] = ()) -> DataFrame:
    """``(qid, k, idcg, num_rel)``: the best reachable sum and all relevant documents.

    Only the first max(k) judgements of a query leave their partition; counting
    is a partial aggregation, so a query with very many judgements is no burden.
    """
    return _per_cutoff(_wide_ideal(qrels, ks, by), [*by, "qid"], ks, ["idcg"], ["num_rel"])


def _wide_ideal(qrels: DataFrame, ks: Sequence[int], by: Sequence[str]) -> DataFrame:
    """One row a query with ``num_rel`` and an ``idcg_`` column for each cut-off."""
    keys = [*by, "qid"]
    order = Window.partitionBy(*keys).orderBy(F.desc("rel"), F.asc("doc_id"))
    best = (qrels.where(_relevant()).withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= max(ks)))
    sums = best.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("place") <= k, _gain("place"))).alias(f"idcg_{k}") for k in ks])
    relevant = qrels.groupBy(*keys).agg(F.count_if(_relevant()).alias("num_rel"))
    return relevant.join(sums, keys, "left")


def _per_cutoff(wide: DataFrame, keys, ks, names, plain) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(k).alias("k"),
                 *[F.coalesce(f"{name}_{k}", F.lit(0.0)).alias(name) for name in names])
        for k in ks])
    return wide.select(*keys, *plain, F.explode(rows).alias("r")).select(*keys, "r.k", *[f"r.{n}" for n in names], *plain)


def per_query(run: DataFrame, qrels: DataFrame, ks: Sequence[int] = CUTOFFS, by: Sequence[str] = (),
              missing: str = "skip") -> DataFrame:
    """``(qid, k, ndcg, ap, recall, prec)`` for every query and cut-off."""
    if missing not in ("skip", "zero"):
        raise ValueError(f"missing must be 'skip' or 'zero', not {missing!r}")
    keys = [*by, "qid"]
    upto = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged_run(run, qrels, by).withColumn("found", F.sum(_relevant().cast("int")).over(upto))
    sums = []
    for k in ks:
        inside = F.col("rank") <= k
        sums += [
            F.sum(F.when(inside, _gain("rank"))).alias(f"dcg_{k}"),
            F.sum(F.when(inside & _relevant(), F.col("found") / F.col("rank"))).alias(f"psum_{k}"),
            F.sum((inside & _relevant()).cast("double")).alias(f"hits_{k}"),
        ]
    got = judged.groupBy(*keys).agg(*sums)
    shared = _shared(run, qrels, by)
    ideal = _wide_ideal(qrels, ks, shared)
    if missing == "zero" and list(by) != shared:
        ideal, shared = _for_every_run(ideal, run, by, shared), list(by)
    # One row a query on both sides; the cut-offs come last.
    wide = got.join(ideal, [*shared, "qid"], "right" if missing == "zero" else "inner")
    joined = _per_cutoff(wide, keys, ks, ["dcg", "psum", "hits", "idcg"], ["num_rel"])

    def ratio(top: Column, bottom: Column) -> Column:
        value = F.when(bottom > 0, F.coalesce(top, F.lit(0.0)) / bottom)
        return F.coalesce(value, F.lit(0.0))

    return joined.select(
        *keys, "k",
        ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"),
        ratio(F.col("psum"), F.col("num_rel")).alias("ap"),
        ratio(F.col("hits"), F.col("num_rel")).alias("recall"),
        ratio(F.col("hits"), F.col("k")).alias("prec"),
    )


def _for_every_run(ideal: DataFrame, run: DataFrame, by: Sequence[str], shared: list[str]) -> DataFrame:
    """Repeat the judged queries for each run of the experiment grid (tens of rows)."""
    groups = run.select(*by).distinct()
    if shared:
        return ideal.join(groups, shared)
    cells = [F.struct(*[F.lit(value).alias(name) for name, value in row.asDict().items()])
             for row in groups.collect()]
    return ideal.withColumn("cell", F.explode(F.array(*cells))).select("cell.*", *ideal.columns)


def evaluate(run: DataFrame, qrels: DataFrame, ks: Sequence[int] = CUTOFFS, by: Sequence[str] = (),
             missing: str = "skip", ignore_identical: bool = True) -> DataFrame:
    """``(k, num_queries, ndcg, map, recall, prec)``, means rounded to 5 places."""
    if ignore_identical:
        run = run.where(differs_from_query(run))
    # Ranks beyond the last cut-off count for nothing: each partition is cut to it before the exchange.
    run = top_k(run.select(*by, "qid", "doc_id", "score"), max(ks), [*by, "qid"])
    return means(per_query(run, qrels, ks, by, missing), by)


def means(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by, "k").agg(
        F.count(F.lit(1)).alias("num_queries"),
        *[F.bround(F.avg(c), PLACES).alias(a)
          for c, a in (("ndcg", "ndcg"), ("ap", "map"), ("recall", "recall"), ("prec", "prec"))])
