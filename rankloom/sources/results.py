"""Experiment records: summary CSV and a history of timestamped JSON runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

# Fixed value: the stamp of a run.
RUN_STAMP = "%Y%m%d_%H%M%S"


def write_results_csv(results: DataFrame, path: str) -> None:
    """One CSV with a header; an experiment grid has tens of rows."""
    results.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_results_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def append_results_json(results: DataFrame, path: str, run_ts: str | None = None) -> str:
    """Add one run to the history, in the folder of its stamp; returns the stamp. Written again, it takes the place of what it wrote before."""
    run_ts = run_ts or datetime.now().strftime(RUN_STAMP)
    results.coalesce(1).write.mode("overwrite").json(f"{path}/run_ts={run_ts}")
    return run_ts


def read_results_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, run_ts string").json(path)
