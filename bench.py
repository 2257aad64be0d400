"""Headline timings as one JSON line: python bench.py

Index and search are timed apart, as are all vector methods. A first pass over
a small search warms the JVM; every figure is the best of ``BENCH_REPEAT`` runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from rankloom.catalog import fixtures as fx  # noqa: E402
from rankloom.catalog.queries import QUERIES  # noqa: E402
from rankloom.functions.encoders import HashedTermEncoder  # noqa: E402
from rankloom.operators import dense, ivf, lexical, metrics  # noqa: E402
from rankloom.operators.encode import encode_dense  # noqa: E402
from rankloom.operators.impact import ImpactIndex, impact_topk  # noqa: E402
from rankloom.operators.balls import BallIndex  # noqa: E402
from rankloom.operators.quantize import FlatIndex, Int8Codec, PqCodec, coded_search  # noqa: E402
from rankloom.operators.two_level import TwoLevelCells  # noqa: E402
from rankloom.plans.staging import staged  # noqa: E402
from rankloom.catalog import queries as catalog  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "2"))
TOP_K = 1000
# Candidates by codes for each row asked for; coarse and fine cells, and those probed.
RERANK = 20
LEVELS, PROBED = (7, 7), (6, 36)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(action):
    """(fastest seconds, last result)"""
    seconds, result = [], None
    for _ in range(REPEAT):
        start = time.perf_counter()
        result = action()
        seconds.append(time.perf_counter() - start)
    return min(seconds), result


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("rankloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs, asked = fx.plain_corpus(spark, FOLDER), fx.queries(spark, FOLDER)
    vectors = staged(fx.vectors(spark, FOLDER).repartition(int(CPUS), "doc_id"), "vectors")
    points = vectors.withColumnRenamed("doc_id", "qid")
    run(QUERIES["bm25_topk"](spark, FOLDER))

    seconds: dict[str, float] = {}
    extra: dict[str, float] = {}

    def timed(name, action):
        seconds[name], result = best(action)
        return result

    # Terms.
    index = timed("bm25_index", lambda: lexical.LexicalIndex.build(docs))
    timed("bm25_search", lambda: run(lexical.bm25_topk(index, asked, TOP_K)))
    impacts = timed("impact_index", lambda: ImpactIndex.build(catalog._impacts(spark, FOLDER)))
    timed("impact_search", lambda: run(impact_topk(impacts, catalog._query_impacts(spark, FOLDER), TOP_K)))

    # Quality of the stored run.
    found = staged(lexical.bm25_topk(index, asked, TOP_K), "run")
    judged = staged(fx.qrels(spark, FOLDER), "qrels")
    quality = timed("evaluate", lambda: metrics.evaluate(found, judged).collect())
    extra.update({f"bm25_ndcg@{r['k']}": r["ndcg"] for r in quality})

    # Vectors.
    timed("encode_corpus", lambda: run(encode_dense(docs.repartition(int(CPUS), "doc_id"), HashedTermEncoder())))
    exact = timed("flat_search", lambda: dense.search(points, vectors, 10, skip_identical=True).toPandas())
    wanted = set(zip(exact.qid, exact.doc_id))

    def recall(frame) -> float:
        return round(len(wanted & set(zip(frame.qid, frame.doc_id))) / len(wanted), 5)

    for name, codec in (("int8", Int8Codec), ("pq", PqCodec)):
        fitted, rows = timed(f"{name}_index", lambda: (lambda c: (c, staged(c.encode(vectors), "codes")))(codec.fit(vectors)))
        frame = timed(f"{name}_search", lambda: coded_search(points, rows, 10, fitted, skip_identical=True).toPandas())
        extra[f"{name}_recall@10"] = recall(frame)
    reranked = FlatIndex(rows, fitted)
    frame = timed("pq_rerank_search", lambda: reranked.search(points, 10, vectors, RERANK, skip_identical=True).toPandas())
    extra["pq_rerank_recall@10"] = recall(frame)
    balls = timed("ball_index", lambda: BallIndex.build(vectors))
    frame = timed("ball_search", lambda: balls.search(points, 10, skip_identical=True).toPandas())
    extra["ball_recall@10"] = recall(frame)
    cells = timed("ivf_index", lambda: ivf.CellIndex.build(vectors))
    frame = timed("ivf_search", lambda: cells.search(points, 10, skip_identical=True).toPandas())
    extra["ivf_recall@10"] = recall(frame)
    coded = timed("ivf_pq_index", lambda: ivf.CellIndex.build(vectors, codec=PqCodec.fit(vectors)))
    frame = timed("ivf_pq_search", lambda: coded.search(points, 10, vectors=vectors, factor=RERANK, skip_identical=True).toPandas())
    extra["ivf_pq_recall@10"] = recall(frame)
    extra["ivf_effort"] = f"{ivf.suggested_probes(len(cells.centres))} of {len(cells.centres)} cells"
    nested = timed("two_level_index", lambda: TwoLevelCells.build(vectors, *LEVELS))
    frame = timed("two_level_search", lambda: nested.search(points, 10, *PROBED, skip_identical=True).toPandas())
    extra["two_level_recall@10"] = recall(frame)
    extra["two_level_effort"] = f"{PROBED[1]} fine cells in {PROBED[0]} of {LEVELS[0]} x {LEVELS[1]}"

    # Queries per second, for comparison with published figures.
    for name, n in (("bm25", asked.count()), ("impact", asked.count()), ("flat", len(wanted) // 10), ("ivf", len(wanted) // 10)):
        extra[f"{name}_qps"] = round(n / seconds[f"{name}_search"], 2)

    print(json.dumps({
        "metric": "retrieval_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {name: round(s, 3) for name, s in seconds.items()},
        "sf": FOLDER.rstrip("/").rsplit("/sf", 1)[-1], "detail": extra,
    }))


if __name__ == "__main__":
    main()
