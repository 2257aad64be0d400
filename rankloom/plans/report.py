"""Tables made from experiment records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 4


def trial_summary(results: DataFrame, measures: Sequence[str], by: Sequence[str] = ("dataset", "method")) -> DataFrame:
    """Mean and sample deviation of each measure over the trials of a method."""
    aggregates = [F.count(F.lit(1)).alias("trials")]
    for m in measures:
        column = F.col(f"`{m}`")
        aggregates += [F.avg(column).alias(f"{m}_mean"), F.stddev_samp(column).alias(f"{m}_std")]
    return results.groupBy(*by).agg(*aggregates)


def method_pivot(results: DataFrame, methods: Sequence[str], value: str) -> DataFrame:
    """Datasets as rows, methods as columns."""
    return results.groupBy("dataset").pivot("method", list(methods)).agg(F.first(F.col(f"`{value}`")))


def reproduction_error(measured: DataFrame, published: DataFrame) -> DataFrame:
    """Signed difference and percent absolute error against published values.

    Both sides are ``(dataset, method, value)``.
    """
    joined = measured.join(published.withColumnRenamed("value", "published"), ["dataset", "method"])
    diff = F.col("value") - F.col("published")
    return joined.select(
        "dataset", "method", F.col("value").alias("measured"), "published",
        F.bround(diff, PLACES).alias("diff"),
        F.bround(F.abs(diff) / F.col("published") * 100, PLACES).alias("abs_error_pct"))


def summary_table(results: DataFrame, ndcg: str = "NDCG@10") -> DataFrame:
    """The printed summary with fixed decimals, in run order."""
    return results.select(
        "dataset", "method", "trial", F.round("index_time_s", 2).alias("index_time_s"),
        F.round("qps", 2).alias("qps"), F.round(F.col(f"`{ndcg}`"), 5).alias("ndcg10"),
    ).orderBy("dataset", "method", "trial")
