"""One registered query per operator; all run over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoders import HashedTermEncoder, LogCountEncoder
from ..functions.text import ENGLISH_STOP_WORDS, contents
from ..functions.vectors import components, inner_product, l2_normalize
from ..functions.stems import plural_stem
from ..operators import dense, impact, ivf, lexical, metrics, runs
from ..operators.balls import BallIndex
from ..operators.encode import encode_dense, encode_sparse
from ..operators.impact import ImpactIndex, impact_scores, impact_topk, quantize_impacts
from ..operators.quantize import FlatIndex, Int8Codec, PqCodec, coded_search
from ..operators.ranking import top_k
from ..operators.two_level import TwoLevelCells
from ..plans import experiments, report
from ..plans.retrievers import METHODS, registry
from ..plans.staging import measured_bytes, new_path, spread, staged
from ..sources import benchmark_files, benchmark_format, results as result_files
from ..sources.vector_tables import EmbeddingCache, read_vectors, write_vectors
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Rows kept for a query: term searches, and vector searches.
TERM_K = 100
VECTOR_K = 10
NEAR = 10
# Candidates by codes for each row asked for.
RERANK_FACTOR = 10
# Cells and those probed, in one level and in two.
CELLS, PROBES = 16, 4
COARSE, FINE = 6, 5
IMPACT_SCALE = 100.0


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _stored_vectors(spark, sf) -> DataFrame:
    """The vectors as a table of their own: training and encoding read them several times."""
    return staged(spread(fx.vectors(spark, sf), "doc_id"), "vectors")


def _elements(df: DataFrame, key: str, column: str = "vector") -> DataFrame:
    flat = df.select(key, components(F.col(column)).alias("dim", "val"))
    return flat.select(key, "dim", F.round(F.col("val").cast("double"), 6).alias("val"))


# ---- sources and sinks ---------------------------------------------------


def _folder(spark: SparkSession, sf: str) -> str:
    """A benchmark folder written from the given tables."""
    folder = new_path(spark, "benchmark")
    benchmark_files.write_corpus(fx.corpus(spark, sf), folder)
    benchmark_files.write_queries(fx.queries(spark, sf), folder)
    benchmark_files.write_qrels(fx.qrels(spark, sf), folder)
    return folder


@registered
def corpus_source(spark, sf):
    return benchmark_files.read_dataset(spark, _folder(spark, sf)).corpus


@registered
def queries_source(spark, sf):
    return benchmark_files.read_dataset(spark, _folder(spark, sf)).queries


@registered
def qrels_source(spark, sf):
    return benchmark_files.read_dataset(spark, _folder(spark, sf)).qrels


def _by_format(spark, sf, table):
    benchmark_format.register(spark)
    return spark.read.format(benchmark_format.FORMAT).option("table", table).load(_folder(spark, sf))


@registered
def corpus_format(spark, sf):
    return _by_format(spark, sf, "corpus")


@registered
def queries_format(spark, sf):
    """The judged queries, both sides by the data source."""
    return benchmark_files.judged_queries(_by_format(spark, sf, "queries"), _by_format(spark, sf, "qrels"))


@registered
def qrels_format(spark, sf):
    return _by_format(spark, sf, "qrels")


@registered
def contents_sink(spark, sf):
    path = new_path(spark, "contents")
    benchmark_files.write_contents(fx.corpus(spark, sf), path)
    return benchmark_files.read_contents(spark, path, "long")


@registered
def vectors_sink(spark, sf):
    path = new_path(spark, "vectors")
    write_vectors(fx.vectors(spark, sf), path)
    return _elements(read_vectors(spark, path, id_type="long"), "doc_id")


@registered
def embedding_cache(spark, sf):
    """Filled by the first call, read by the second."""
    cache = EmbeddingCache(new_path(spark, "cache"))
    texts, encoder = spread(fx.plain_corpus(spark, sf), "doc_id"), HashedTermEncoder()
    cache.vectors(texts, encoder, encoder.encoder_id)
    return _elements(cache.vectors(texts, encoder, encoder.encoder_id), "doc_id")


# ---- text and terms ------------------------------------------------------


@registered
def contents_field(spark, sf):
    return fx.corpus(spark, sf).select("doc_id", contents().alias("contents"))


@registered
def tokens(spark, sf):
    return lexical.tokens(fx.plain_corpus(spark, sf))


@registered
def tokens_stopped(spark, sf):
    stops = spark.createDataFrame([(w,) for w in ENGLISH_STOP_WORDS], "term string")
    return lexical.drop_terms(lexical.tokens(fx.plain_corpus(spark, sf)), stops).select("doc_id", "term")


@registered
def postings(spark, sf):
    return lexical.postings(fx.plain_corpus(spark, sf))


@registered
def doc_freq(spark, sf):
    return lexical.doc_freq(lexical.postings(fx.plain_corpus(spark, sf)))


@registered
def corpus_stats(spark, sf):
    stats = lexical.corpus_stats(lexical.postings(fx.plain_corpus(spark, sf)))
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"), "total")


@registered
def term_matches(spark, sf):
    rows = lexical.postings(fx.plain_corpus(spark, sf))
    matched = lexical.term_matches(rows, lexical.query_terms(fx.queries(spark, sf)))
    return matched.select("qid", "doc_id", "term", "qtf", "tf")


def _lexical_index(spark, sf):
    return lexical.LexicalIndex.build(fx.plain_corpus(spark, sf))


@registered
def bm25_scores(spark, sf):
    return lexical.bm25_scores(_lexical_index(spark, sf), fx.queries(spark, sf))


@registered
def bm25_candidates(spark, sf):
    """BM25 of given pairs only, the ten best by learned weights: work and output follow the candidates."""
    found = impact_topk(ImpactIndex.build(_impacts(spark, sf)), _query_impacts(spark, sf), NEAR)
    return lexical.bm25_candidates(_lexical_index(spark, sf), fx.queries(spark, sf), found)


@registered
def bm25_topk(spark, sf):
    return lexical.bm25_topk(_lexical_index(spark, sf), fx.queries(spark, sf), TERM_K)


@registered
def stems(spark, sf):
    """Every distinct term of the documents with its singular."""
    return lexical.stem_table(lexical.tokens(fx.plain_corpus(spark, sf)), plural_stem)


def _stemmed_index(spark, sf):
    return lexical.LexicalIndex.build(fx.plain_corpus(spark, sf), stemmer=plural_stem)


@registered
def stemmed_postings(spark, sf):
    return _stemmed_index(spark, sf).postings


@registered
def bm25_stemmed_topk(spark, sf):
    """BM25 over singulars, of documents and queries alike."""
    return lexical.bm25_topk(_stemmed_index(spark, sf), fx.queries(spark, sf), TERM_K)


# ---- learned impacts -----------------------------------------------------


def _log_weight(count: str):
    return F.log(F.lit(1.0) + F.col(count).cast("double"))


def _impacts(spark, sf):
    rows = lexical.postings(fx.plain_corpus(spark, sf))
    return quantize_impacts(rows.select("doc_id", "term", _log_weight("tf").alias("weight")), IMPACT_SCALE)


def _query_impacts(spark, sf):
    rows = lexical.query_terms(fx.queries(spark, sf))
    return quantize_impacts(rows.select("qid", "term", _log_weight("qtf").alias("weight")), IMPACT_SCALE)


@registered
def impact_source(spark, sf):
    path = new_path(spark, "impacts")
    staged(_impacts(spark, sf), "impacts", path)
    return ImpactIndex.load(spark, path).impacts


@registered
def impact_scores_all(spark, sf):
    return impact_scores(ImpactIndex.build(_impacts(spark, sf)), _query_impacts(spark, sf))


@registered
def impact_candidates(spark, sf):
    """Learned weights of given pairs only, the ten best by BM25: work and output follow the candidates."""
    found = lexical.bm25_topk(_lexical_index(spark, sf), fx.queries(spark, sf), NEAR)
    return impact.impact_candidates(ImpactIndex.build(_impacts(spark, sf)), _query_impacts(spark, sf), found)


@registered
def impact_top(spark, sf):
    return impact_topk(ImpactIndex.build(_impacts(spark, sf)), _query_impacts(spark, sf), TERM_K)


def _signed(rows: DataFrame, key: str) -> DataFrame:
    """Every second weight below zero, by the length of the term and, for documents, their id."""
    odd = (F.length("term") + (F.col(key) if key == "doc_id" else F.lit(0))) % 2
    return rows.withColumn("weight", F.when(odd == 1, -F.col("weight")).otherwise(F.col("weight")))


def _signed_run(spark, sf, chunks):
    asked = staged(_signed(_query_impacts(spark, sf), "qid"), "query-impacts")
    limit = measured_bytes(asked) // chunks if chunks else None
    return impact_topk(ImpactIndex.build(_signed(_impacts(spark, sf), "doc_id")), asked, TERM_K, broadcast_bytes=limit)


@registered
def impact_topk_signed(spark, sf):
    """Weights of either sign, the query side broadcast whole."""
    return _signed_run(spark, sf, None)


@registered
def impact_topk_chunked(spark, sf):
    """The same with a query side three times the limit."""
    return _signed_run(spark, sf, 3)


@registered
def impact_topk_string_ids(spark, sf):
    """A ready-made table whose documents have string ids."""
    path = new_path(spark, "impacts")
    staged(_impacts(spark, sf).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))), "impacts", path)
    return impact_topk(ImpactIndex.load(spark, path, "string"), _query_impacts(spark, sf), TERM_K)


@registered
def encode_query_impacts(spark, sf):
    rows = encode_sparse(fx.queries(spark, sf), LogCountEncoder())
    return rows.select("qid", "term", F.round("weight", 6).alias("weight"))


@registered
def quantized_impacts(spark, sf):
    texts = spread(fx.plain_corpus(spark, sf), "doc_id")
    return quantize_impacts(encode_sparse(texts, LogCountEncoder(), "doc_id"), IMPACT_SCALE)


# ---- vectors -------------------------------------------------------------


@registered
def encode_corpus(spark, sf):
    return _elements(encode_dense(spread(fx.plain_corpus(spark, sf), "doc_id"), HashedTermEncoder()), "doc_id")


@registered
def encode_queries(spark, sf):
    return _elements(encode_dense(fx.queries(spark, sf), HashedTermEncoder()), "qid")


@registered
def normalized_vectors(spark, sf):
    """Vectors stretched by their label (0 makes zero vectors) and brought to unit length."""
    rows = fx.table(spark, sf, "embeddings")
    stretched = rows.select(F.col("vec_id").alias("doc_id"),
                            F.transform("embedding", lambda x: x.cast("double") * F.col("label")).alias("vector"))
    return _elements(stretched.select("doc_id", l2_normalize(F.col("vector")).alias("vector")), "doc_id")


def _flat_run(spark, sf, k=VECTOR_K, skip_identical=True):
    return dense.search(fx.query_vectors(spark, sf), spread(fx.vectors(spark, sf), "doc_id"), k,
                        skip_identical=skip_identical)


@registered
def flat_topk(spark, sf):
    return _flat_run(spark, sf)


@registered
def inner_products(spark, sf):
    """The scores of the exact run recomputed by array functions in the JVM."""
    pairs = _flat_run(spark, sf).select("qid", "doc_id")
    left = fx.query_vectors(spark, sf).withColumnRenamed("vector", "a")
    right = fx.vectors(spark, sf).withColumnRenamed("vector", "b")
    return pairs.join(left, "qid").join(right, "doc_id").select(
        "qid", "doc_id", F.round(inner_product(F.col("a"), F.col("b")), 6).alias("score"))


@registered
def int8_codes(spark, sf):
    rows = fx.vectors(spark, sf)
    return Int8Codec.fit(rows).encode(rows).select("doc_id", F.posexplode("codes").alias("dim", "code")).select(
        "doc_id", "dim", F.col("code").cast("int").alias("code"))


@registered
def int8_topk(spark, sf):
    rows = _stored_vectors(spark, sf)
    codec = Int8Codec.fit(rows)
    return dense.search(fx.query_vectors(spark, sf), codec.encode(rows), VECTOR_K, "codes", codec.decode,
                        skip_identical=True)


@registered
def pq_codes(spark, sf):
    rows = _stored_vectors(spark, sf)
    return PqCodec.fit(rows).encode(rows).select("doc_id", F.posexplode("codes").alias("block", "code")).select(
        "doc_id", "block", F.col("code").cast("int").alias("code"))


@registered
def pq_topk(spark, sf):
    rows = _stored_vectors(spark, sf)
    codec = PqCodec.fit(rows)
    return coded_search(fx.query_vectors(spark, sf), codec.encode(rows), VECTOR_K, codec, skip_identical=True)


@registered
def pq_rerank(spark, sf):
    """The ten best of the hundred best by codes, by their exact scores."""
    rows = _stored_vectors(spark, sf)
    index = FlatIndex.build(rows, PqCodec.fit(rows))
    return index.search(fx.query_vectors(spark, sf), VECTOR_K, rows, RERANK_FACTOR, skip_identical=True)


@registered
def ivf_assign(spark, sf):
    rows = _stored_vectors(spark, sf)
    return ivf.assign_cells(rows, ivf.train_cells(rows, CELLS)).select("doc_id", "cell")


def _cell_run(spark, sf, codec=None, trial=0):
    rows = _stored_vectors(spark, sf)
    index = ivf.CellIndex.build(rows, CELLS, trial=trial, codec=None if codec is None else codec.fit(rows))
    return index.search(fx.query_vectors(spark, sf), VECTOR_K, PROBES, skip_identical=True)


@registered
def ivf_topk(spark, sf):
    return _cell_run(spark, sf)


@registered
def ivf_int8_topk(spark, sf):
    return _cell_run(spark, sf, Int8Codec)


@registered
def ivf_pq_topk(spark, sf):
    return _cell_run(spark, sf, PqCodec)


def _trial_quality(spark, sf):
    """Recall of each trial's run against exact search."""
    parts = [_cell_run(spark, sf, trial=t).withColumn("trial", F.lit(t)) for t in range(experiments.SEEDED_TRIALS)]
    exact = staged(_flat_run(spark, sf), "exact").select("qid", "doc_id", F.lit(1).alias("rel"))
    return metrics.evaluate(runs.union_runs(*parts), exact, (NEAR,), ("trial",))


@registered
def ivf_trials(spark, sf):
    return _trial_quality(spark, sf).select("trial", "k", "num_queries", "recall", "ndcg")


@registered
def trial_summary(spark, sf):
    records = _trial_quality(spark, sf).select(F.lit("embeddings").alias("dataset"), F.lit("hnsw").alias("method"),
                                               "trial", "recall")
    summary = report.trial_summary(records, ["recall"])
    return summary.select("dataset", "method", "trials", F.round("recall_mean", 6).alias("recall_mean"),
                          F.round("recall_std", 6).alias("recall_std"))


@registered
def ball_topk(spark, sf):
    """Exact search that passes over balls of vectors out of reach."""
    return BallIndex.build(_stored_vectors(spark, sf)).search(fx.query_vectors(spark, sf), VECTOR_K, skip_identical=True)


@registered
def two_level_topk(spark, sf):
    """Cells in two levels, all of them probed: the same run as exact search."""
    index = TwoLevelCells.build(_stored_vectors(spark, sf), COARSE, FINE)
    return index.search(fx.query_vectors(spark, sf), VECTOR_K, COARSE, COARSE * FINE, skip_identical=True)


# ---- run shaping ---------------------------------------------------------


@registered
def hits_to_run(spark, sf):
    """Hit lists by row number, empty slots marked -1, to a run with document names."""
    hits = _flat_run(spark, sf).select(
        "qid", "rank", F.when(F.col("score") >= 0.3, F.col("doc_id")).otherwise(F.lit(-1)).alias("idx"), "score")
    # A list has at most VECTOR_K entries.
    ordered = F.array_sort(F.collect_list(F.struct("rank", "idx", "score")))
    lists = hits.groupBy("qid").agg(F.transform(ordered, lambda h: F.struct(h.idx.alias("idx"), h.score.alias("score"))).alias("hits"))
    names = fx.vectors(spark, sf).select(F.col("doc_id").alias("idx"), F.concat(F.lit("v"), F.col("doc_id")).alias("doc_id"))
    return runs.hits_to_run(lists, names)


@registered
def dedupe_hits(spark, sf):
    """Hits on copies of one text become hits on the first copy; the last one counts."""
    docs = fx.plain_corpus(spark, sf).select("doc_id", F.sha2("text", 256).alias("body"))
    first = docs.groupBy("body").agg(F.min("doc_id").alias("first_id"))
    run = staged(lexical.bm25_topk(_lexical_index(spark, sf), fx.queries(spark, sf), TERM_K), "run")
    # Only copies that were hit meet their first copy, at most k for each query.
    canonical = docs.join(run.select("doc_id").distinct(), "doc_id").join(first, "body").select("doc_id", "first_id")
    hits = run.join(canonical, "doc_id").select("qid", F.col("first_id").alias("doc_id"), "score", F.col("rank").alias("pos"))
    return runs.dedupe_hits(hits)


@registered
def drop_identical(spark, sf):
    return runs.drop_identical(_flat_run(spark, sf, VECTOR_K + 1, False))


@registered
def run_union(spark, sf):
    """Runs of two methods in one table."""
    index = _lexical_index(spark, sf)
    asked = fx.queries(spark, sf)
    bm25 = lexical.bm25_topk(index, asked, TERM_K)
    impacts = ImpactIndex(quantize_impacts(index.postings.select("doc_id", "term", _log_weight("tf").alias("weight")), IMPACT_SCALE))
    learned = impact_topk(impacts, _query_impacts(spark, sf), TERM_K)
    return runs.union_runs(
        bm25.select(F.lit("bm25").alias("method"), *runs.RUN_COLUMNS),
        learned.select(F.lit("splade").alias("method"), "qid", "doc_id", F.col("score").cast("double").alias("score"), "rank"))


# ---- metrics -------------------------------------------------------------


def _bm25_run(spark, sf):
    return lexical.bm25_topk(_lexical_index(spark, sf), fx.queries(spark, sf), TERM_K)


@registered
def judged_run(spark, sf):
    return metrics.judged_run(_bm25_run(spark, sf), fx.qrels(spark, sf))


@registered
def ideal_dcg(spark, sf):
    rows = metrics.ideal_dcg(fx.qrels(spark, sf))
    return rows.select("qid", "k", F.round("idcg", 6).alias("idcg"), "num_rel")


@registered
def ndcg_per_query(spark, sf):
    rows = metrics.per_query(_bm25_run(spark, sf), fx.qrels(spark, sf))
    return rows.select("qid", "k", *[F.round(c, 6).alias(c) for c in ("ndcg", "ap", "recall", "prec")])


def _bm25_quality(spark, sf, ignore_identical=False):
    return metrics.evaluate(_bm25_run(spark, sf), fx.qrels(spark, sf), ignore_identical=ignore_identical)


@registered
def ndcg(spark, sf):
    return _bm25_quality(spark, sf).select("k", "num_queries", "ndcg")


@registered
def map_at_k(spark, sf):
    return _bm25_quality(spark, sf).select("k", "num_queries", "map")


@registered
def recall_at_k(spark, sf):
    return _bm25_quality(spark, sf).select("k", "num_queries", "recall")


@registered
def precision_at_k(spark, sf):
    return _bm25_quality(spark, sf).select("k", "num_queries", "prec")


@registered
def metrics_all_judged(spark, sf):
    """Averages over every judged query, absent ones counted as zero; own id ignored."""
    return metrics.evaluate(_bm25_run(spark, sf), fx.qrels(spark, sf), missing="zero")


# ---- experiments ---------------------------------------------------------


@registered
def experiment_grid(spark, sf):
    """Every language of the documents is a dataset of its own."""
    datasets = fx.table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset")).agg(F.count(F.lit(1)).alias("num_docs"))
    grid = experiments.selected(experiments.experiment_grid(datasets), methods=["bm25", "splade", "hnsw"])
    return grid.join(datasets, "dataset").select("dataset", "method", "trial", "num_docs")


@registered
def unknown_methods(spark, sf):
    """Method names asked for by document language; only plain bm25 exists."""
    asked = fx.table(spark, sf, "documents").select(
        F.concat(F.lit("bm25"), F.when(F.col("lang") == "en", F.lit("")).otherwise(F.concat(F.lit("_"), "lang"))).alias("method"))
    return experiments.unknown_methods(asked.groupBy("method").agg(F.count(F.lit(1)).alias("requests")))


@registered
def run_record(spark, sf):
    """One experiment from build to record; the seconds are left out."""
    dataset = fx.datasets(spark, sf)["plain"].stored()
    record = experiments.run_single(METHODS["bm25"](0), dataset, "bm25", k=TERM_K)
    return record.drop("encode_time_s", "index_time_s", "qps")


def _methods(spark):
    """All methods, the approximate ones with the cells and probes of the other queries."""
    return registry(EmbeddingCache(new_path(spark, "embeddings")), nlist=CELLS, nprobe=PROBES)


@registered
def all_methods_run(spark, sf):
    """The run of every method over one dataset, first trial."""
    dataset = fx.datasets(spark, sf)["plain"]
    table, _ = experiments.run_all([dataset], factories=_methods(spark), k=VECTOR_K, trials=lambda method: 1)
    return table.select("method", "qid", "doc_id", F.col("score").cast("double").alias("score"), "rank")


@registered
def experiment_sweep(spark, sf):
    """All methods and trials, build to record; the seconds are left out."""
    records = experiments.sweep([fx.datasets(spark, sf)["plain"]], factories=_methods(spark), k=TERM_K)
    return records.drop("encode_time_s", "index_time_s", "qps")


def _term_records(spark, sf):
    """Records of the two term methods over texts without and with titles."""
    return experiments.sweep(list(fx.datasets(spark, sf).values()), ["bm25", "splade"], k=TERM_K)


RECORD_SCHEMA = ("dataset string, method string, trial int, num_docs long, num_queries long, "
                 "encode_time_s double, index_time_s double, qps double, "
                 + ", ".join(f"`{label}@{k}` double" for label in experiments.METRICS.values() for k in metrics.CUTOFFS))


@registered
def results_csv(spark, sf):
    path = new_path(spark, "summary")
    result_files.write_results_csv(_term_records(spark, sf), path)
    rows = result_files.read_results_csv(spark, path, RECORD_SCHEMA)
    return rows.drop("encode_time_s", "index_time_s", "qps")


@registered
def results_json(spark, sf):
    """Two runs appended to the history, counted and averaged by record."""
    path = new_path(spark, "history")
    records = _term_records(spark, sf)
    for stamp in ("20260101_000000", "20260102_000000"):
        result_files.append_results_json(records, path, stamp)
    history = result_files.read_results_json(spark, path, RECORD_SCHEMA)
    return history.select("run_ts", "dataset", "method", "trial", "num_docs", "num_queries", "NDCG@10")


@registered
def summary_table(spark, sf):
    return report.summary_table(_term_records(spark, sf)).drop("index_time_s", "qps")


@registered
def method_pivot(spark, sf):
    return report.method_pivot(_term_records(spark, sf), ["bm25", "splade"], "NDCG@10")


@registered
def reproduction_error(spark, sf):
    """NDCG@10 with titles as the measured value, the plain run to 3 places as published."""
    records = _term_records(spark, sf).select("dataset", "method", F.col("`NDCG@10`").alias("value"))
    measured = records.where("dataset = 'titled'").withColumn("dataset", F.lit("documents"))
    published = records.where("dataset = 'plain'").select(
        F.lit("documents").alias("dataset"), "method", F.bround("value", 3).alias("value"))
    return report.reproduction_error(measured, published)


# Names used in the operator inventory.
for name, key in (("contents_field", "contents"), ("impact_scores_all", "impact_scores"), ("impact_top", "impact_topk"),
                  ("quantized_impacts", "quantize_impacts"), ("normalized_vectors", "l2_normalize"),
                  ("inner_products", "inner_product")):
    QUERIES[key] = QUERIES.pop(name)
