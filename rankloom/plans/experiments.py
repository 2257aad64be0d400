"""Experiment grids: datasets x methods x trials, runs, records."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import CUTOFFS, evaluate
from ..operators.runs import union_runs
from ..sources.benchmark_files import Dataset, read_dataset
from ..sources.results import RUN_STAMP, append_results_json, write_results_csv
from ..sources.vector_tables import EmbeddingCache
from .report import summary_table
from .retrievers import METHODS, Method, Registry, registry
from .staging import new_path, staged, write_meta

# Documents kept for a query, and trials of a method whose build
# depends on its seeds.
TOP_K = 1000
SEEDED_TRIALS = 5
TIME_PLACES = 4

CELL = ("dataset", "method", "trial")
METRICS = {"ndcg": "NDCG", "map": "MAP", "recall": "Recall", "prec": "P"}


def trials_of(method: str) -> int:
    return SEEDED_TRIALS if "hnsw" in method else 1


def trials_column(method: Column) -> Column:
    return F.when(method.contains("hnsw"), F.lit(SEEDED_TRIALS)).otherwise(F.lit(1))


def experiment_grid(datasets: DataFrame, methods: Sequence[str] = tuple(METHODS)) -> DataFrame:
    """``(dataset, method, trial)`` for a table of datasets."""
    names = F.array(*[F.lit(m) for m in methods])
    cells = datasets.select("dataset", F.explode(names).alias("method"))
    trials = F.sequence(F.lit(0), trials_column(F.col("method")) - 1)
    return cells.select("dataset", "method", F.explode(trials).alias("trial"))


def selected(grid: DataFrame, datasets: Sequence[str] | None = None,
             methods: Sequence[str] | None = None) -> DataFrame:
    if datasets is not None:
        grid = grid.where(F.col("dataset").isin(list(datasets)))
    if methods is not None:
        check_methods(methods)
        grid = grid.where(F.col("method").isin(list(methods)))
    return grid


def unknown_methods(requests: DataFrame, known: Sequence[str] = tuple(METHODS)) -> DataFrame:
    """Requested methods that do not exist."""
    return requests.where(~F.col("method").isin(list(known)) | F.col("method").isNull())


def check_methods(methods: Sequence[str], known: Sequence[str] = tuple(METHODS)) -> None:
    unknown = [m for m in methods if m not in known]
    if unknown:
        raise ValueError(f"unknown methods {unknown}; available: {sorted(known)}")


def wide_metrics(metrics: DataFrame, by: Sequence[str] = CELL, ks: Sequence[int] = CUTOFFS) -> DataFrame:
    """One row per run with columns NDCG@1, NDCG@10, ..., P@100."""
    return metrics.groupBy(*by).agg(*[
        F.max(F.when(F.col("k") == k, F.col(name))).alias(f"{label}@{k}")
        for name, label in METRICS.items() for k in ks])


def search_once(method: Method, dataset: Dataset, k: int = TOP_K, path: str | None = None):
    """Fit, search and store the run; returns (run, seconds by step)."""
    model = method.fit(dataset.corpus, dataset.name)
    start = time.perf_counter()
    found = model.search(dataset.queries, k)
    run = staged(found.withColumn("score", F.col("score").cast("double")), "run", path)
    return run, {"encode_time_s": model.encode_seconds, "index_time_s": model.index_seconds,
                 "search_time_s": time.perf_counter() - start}


def records(spark: SparkSession, runs: DataFrame, datasets: Sequence[Dataset], timings: Sequence[dict],
            ks: Sequence[int] = CUTOFFS) -> DataFrame:
    """One record per run: counts, seconds, queries per second and all metrics.

    All runs of the grid are scored in one pass, keyed by their grid cell.
    """
    qrels = union_runs(*[d.qrels.select(F.lit(d.name).alias("dataset"), "qid", "doc_id", "rel") for d in datasets])
    quality = wide_metrics(evaluate(runs, qrels, ks, CELL), CELL, ks)
    sizes = {d.name: d.counted() for d in datasets}
    rows = []
    for t in timings:
        docs, queries = sizes[t["dataset"]]
        seconds = t["search_time_s"]
        rows.append((t["dataset"], t["method"], t["trial"], docs, queries,
                     round(t["encode_time_s"], TIME_PLACES), round(t["index_time_s"], TIME_PLACES),
                     round(queries / seconds if seconds > 0 else 0.0, TIME_PLACES)))
    heads = spark.createDataFrame(
        rows, "dataset string, method string, trial int, num_docs long, num_queries long, "
              "encode_time_s double, index_time_s double, qps double")
    # A run that matched no judged query still has its record, scored zero.
    return heads.join(quality, list(CELL), "left").na.fill(0.0)


def run_single(method: Method, dataset: Dataset, name: str, trial: int = 0, k: int = TOP_K,
               ks: Sequence[int] = CUTOFFS) -> DataFrame:
    """One experiment from build to record."""
    spark = dataset.corpus.sparkSession
    run, seconds = search_once(method, dataset, k)
    runs = run.select(F.lit(dataset.name).alias("dataset"), F.lit(name).alias("method"),
                      F.lit(trial).alias("trial"), "qid", "doc_id", "score", "rank")
    return records(spark, runs, [dataset], [{"dataset": dataset.name, "method": name, "trial": trial, **seconds}], ks)


TIMINGS = ("encode_time_s", "index_time_s", "search_time_s")


def finished(spark: SparkSession, root: str) -> dict[tuple, dict]:
    """The cells of a grid that are done, with their seconds: a cell notes itself down once its run is written."""
    schema = "dataset string, method string, trial int, " + ", ".join(f"{t} double" for t in TIMINGS)
    # Without rows, and only where there is nothing yet.
    spark.createDataFrame([], schema).write.mode("ignore").json(f"{root}/finished/none")
    rows = spark.read.schema(schema).json(f"{root}/finished/*").collect()
    return {tuple(r[c] for c in CELL): r.asDict() for r in rows}


def run_all(datasets: Sequence[Dataset], methods: Sequence[str] = tuple(METHODS),
            factories: dict[str, Callable[[int], Method]] | None = None, k: int = TOP_K,
            trials: Callable[[str], int] = trials_of, root: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Every run of the grid in one table keyed by (dataset, method, trial).

    With a ``root`` of its own a grid that was interrupted goes on where it
    stopped: finished cells are not run again, the unfinished one is written anew.
    """
    spark = datasets[0].corpus.sparkSession
    factories = registry(EmbeddingCache(new_path(spark, "embeddings"))) if factories is None else factories
    check_methods(methods, tuple(factories))
    factories = factories.scoped() if isinstance(factories, Registry) else factories
    done = finished(spark, root) if root else {}
    root, timings = root or new_path(spark, "runs"), []
    for dataset in datasets:
        for name in methods:
            for trial in range(trials(name)):
                cell = (dataset.name, name, trial)
                if cell not in done:
                    path = f"{root}/runs/dataset={dataset.name}/method={name}/trial={trial}"
                    _, seconds = search_once(factories[name](trial), dataset, k, path)
                    done[cell] = dict(zip(CELL, cell)) | seconds
                    write_meta(spark, f"{root}/finished/{dataset.name}-{name}-{trial}", **done[cell])
                timings.append(done[cell])
    schema = spark.read.parquet(f"{root}/runs/dataset={datasets[0].name}/method={methods[0]}/trial=0").schema
    schema = T.StructType([*schema.fields, *T.StructType.fromDDL("dataset string, method string, trial int").fields])
    runs = spark.read.schema(schema).parquet(f"{root}/runs")
    wanted = spark.createDataFrame([tuple(t[c] for c in CELL) for t in timings], "dataset string, method string, trial int")
    # A root may hold cells of an earlier, larger grid. One row a cell.
    return runs.join(F.broadcast(wanted), list(CELL), "left_semi").select(*CELL, *schema.names[:-3]), timings


def sweep(datasets: Sequence[Dataset], methods: Sequence[str] = tuple(METHODS),
          factories: dict[str, Callable[[int], Method]] | None = None, k: int = TOP_K,
          trials: Callable[[str], int] = trials_of, ks: Sequence[int] = CUTOFFS, root: str | None = None) -> DataFrame:
    """Run the grid and return its records."""
    runs, timings = run_all(datasets, methods, factories, k, trials, root)
    return records(runs.sparkSession, runs, datasets, timings, ks)


def run_and_save(spark: SparkSession, folders: Sequence[str], out: str, methods: Sequence[str] = tuple(METHODS),
                 factories: dict[str, Callable[[int], Method]] | None = None, k: int = TOP_K, stamp: str | None = None) -> DataFrame:
    """Read benchmark folders, run the grid, write summary and history, return the summary.

    ``out/summary.csv`` holds the records of this run, ``out/raw`` those of all
    runs. Runs are kept under ``out/sweeps/<stamp>``: called again with the
    ``stamp`` of a grid that was interrupted, it goes on with that one, and its
    records come into the history once.
    """
    check_methods(methods, tuple(factories or METHODS))
    stamp = stamp or datetime.now().strftime(RUN_STAMP)
    datasets = [read_dataset(spark, f).stored() for f in folders]
    results = staged(sweep(datasets, methods, factories, k, root=f"{out}/sweeps/{stamp}"), "results")
    write_results_csv(results, f"{out}/summary.csv")
    append_results_json(results, f"{out}/raw", stamp)
    return summary_table(results)
