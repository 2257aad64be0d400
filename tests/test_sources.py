"""Round trips through files, and the vector cache."""

import pytest
from pyspark.sql import functions as F

from rankloom.catalog import fixtures as fx
from rankloom.functions.encoders import HashedTermEncoder
from rankloom.operators.encode import encode_dense
from rankloom.plans.staging import measured_bytes, new_path, staging_root
from rankloom.sources import benchmark_files as bf
from rankloom.sources import benchmark_format
from rankloom.sources import results as result_files
from rankloom.sources.vector_tables import EmbeddingCache, read_vectors, write_vectors

from .conftest import rows


def test_benchmark_folder_round_trip(spark, folder, tmp_path):
    out = str(tmp_path / "bench")
    judged = fx.qrels(spark, folder)
    bf.write_corpus(fx.corpus(spark, folder), out)
    bf.write_queries(fx.queries(spark, folder), out)
    bf.write_qrels(judged, out)
    data = bf.read_dataset(spark, out)
    assert data.name == "bench"
    assert rows(data.corpus.na.fill("-")) == rows(fx.corpus(spark, folder).select(F.col("doc_id").cast("string"), "title", "text").na.fill("-"))
    assert rows(data.qrels, "qid", "doc_id", "rel") == [(str(q), str(d), r) for q, d, r in sorted(map(tuple, judged.collect()), key=lambda t: (str(t[0]), str(t[1])))]
    assert {r["qid"] for r in data.queries.collect()} == {r["qid"] for r in data.qrels.collect()}


def test_single_files_with_missing_titles(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "text": "alpha"}\n{"_id": "d2", "title": "T", "text": "beta"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "alpha"}\n{"_id": "q2", "text": "none"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n")
    data = bf.read_dataset(spark, str(tmp_path))
    assert rows(data.corpus.select("doc_id", F.coalesce("title", F.lit("?")))) == [("d1", "?"), ("d2", "T")]
    assert rows(data.queries) == [("q1", "alpha")]
    assert rows(data.qrels) == [("q1", "d1", 2)]


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1 << 20])
def test_benchmark_format_reads_every_line_once(spark, tmp_path, range_bytes):
    benchmark_format.register(spark)
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").mkdir()
    lines = [f'{{"_id": "d{k}", "title": "Tïtle {k}", "text": "{"wörd " * (k * 7 % 30)}", "metadata": {{"n": {k}}}}}' for k in range(23)]
    (tmp_path / "corpus.jsonl" / "part-0.json").write_text("\n".join(lines[:20]))
    (tmp_path / "corpus.jsonl" / "part-1.json").write_text("\n".join(lines[20:]) + "\n")
    (tmp_path / "corpus.jsonl" / "_SUCCESS").write_text("")
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "alpha"}\n{"_id": "q2"}\n')
    (tmp_path / "qrels" / "dev.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"q{k}\td{k}\t{k % 3}\n" for k in range(9)))

    def read(table, **options):
        return spark.read.format("benchmark_folder").options(table=table, range_bytes=range_bytes, **options)

    corpus = read("corpus").load(str(tmp_path))
    want = bf.read_corpus(spark, str(tmp_path))
    assert corpus.schema.simpleString() == want.schema.simpleString()
    assert rows(corpus) == rows(want) and corpus.count() == 23
    assert rows(read("queries").load(str(tmp_path)).na.fill("-")) == [("q1", "alpha"), ("q2", "-")]
    assert rows(read("qrels", split="dev").load(str(tmp_path))) == rows(bf.read_qrels(spark, str(tmp_path), "dev"))
    # Only the columns asked for.
    assert rows(read("corpus").schema("doc_id string").load(str(tmp_path))) == sorted((f"d{k}",) for k in range(23))
    if range_bytes == 64:
        assert corpus.rdd.getNumPartitions() > 20


def test_benchmark_format_says_what_is_wrong(spark, tmp_path):
    benchmark_format.register(spark)
    for options, error in (({"table": "vectors"}, "must be one of"), ({"table": "qrels", "split": "none"}, "has no qrels/none.tsv")):
        with pytest.raises(Exception, match=error):
            spark.read.format("benchmark_folder").options(**options).load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("benchmark_folder").schema("body string").load(str(tmp_path)).collect()


def test_stored_datasets_are_counted_while_they_are_written(spark, folder):
    data = fx.datasets(spark, folder)["plain"]
    stored = data.stored()
    assert stored.sizes == data.counted() == (data.corpus.count(), data.queries.count())
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert stored.counted() == stored.sizes
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(before)


def test_contents_and_vectors(spark, folder, tmp_path):
    bf.write_contents(fx.corpus(spark, folder), str(tmp_path / "contents"))
    back = bf.read_contents(spark, str(tmp_path / "contents"), "long")
    assert back.count() == fx.corpus(spark, folder).count()
    assert back.where(F.col("contents").startswith(" ")).count() == fx.corpus(spark, folder).where("title is null").count()
    v = fx.vectors(spark, folder)
    for fmt in ("json", "parquet"):
        write_vectors(v, str(tmp_path / fmt), fmt)
        assert rows(read_vectors(spark, str(tmp_path / fmt), fmt, "long").select("doc_id", F.col("vector").cast("string"))) == \
            rows(v.select("doc_id", F.col("vector").cast("string")))


class CountingEncoder(HashedTermEncoder):
    """Writes down how many texts it was given."""

    def __init__(self, counter):
        super().__init__(8)
        self.counter = counter

    def __call__(self):
        encode, counter = super().__call__(), self.counter

        def counted(texts):
            counter.add(len(texts))
            return encode(texts)

        return counted


def test_cache_encodes_every_distinct_text_once(spark, folder, tmp_path):
    counter = spark.sparkContext.accumulator(0)
    encoder, cache = CountingEncoder(counter), EmbeddingCache(str(tmp_path / "cache"))
    docs = fx.plain_corpus(spark, folder)
    docs = docs.union(docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 100_000)).union(
        spark.createDataFrame([(200_000, None), (200_001, "")], "doc_id long, text string"))
    n, distinct = docs.count(), docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert distinct < n - 20

    def vectors(df, name="a"):
        return rows(cache.vectors(df, encoder, name).select("doc_id", F.col("vector").cast("string")))

    first = vectors(docs)
    assert counter.value == distinct and len(first) == n
    assert vectors(docs) == first and counter.value == distinct
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.lit("new text")).otherwise(F.col("text")))
    new = vectors(changed)
    assert counter.value == distinct + 1 and len(new) == n and new != first
    assert new == rows(encode_dense(changed, HashedTermEncoder(8)).select("doc_id", F.col("vector").cast("string")))
    # Another dataset of the same texts costs nothing, another encoder all of it.
    assert len(vectors(docs.where("doc_id < 50").withColumn("doc_id", F.concat(F.lit("x"), "doc_id")))) == 50
    assert counter.value == distinct + 1
    vectors(docs, "b")
    assert counter.value == 2 * distinct + 1


def test_results_files(spark, tmp_path):
    schema = "dataset string, method string, trial int, `NDCG@10` double"
    records = spark.createDataFrame([("a", "bm25", 0, 0.5), ("a", "hnsw", 1, 0.25)], schema)
    result_files.write_results_csv(records, str(tmp_path / "csv"))
    assert rows(result_files.read_results_csv(spark, str(tmp_path / "csv"), schema)) == rows(records)
    part = next((tmp_path / "csv").glob("part-*.csv"))
    assert part.read_text().splitlines()[0] == "dataset,method,trial,NDCG@10"
    one = result_files.append_results_json(records, str(tmp_path / "json"), "20260101_000000")
    two = result_files.append_results_json(records, str(tmp_path / "json"))
    assert len(two) == len(one) == 15
    history = result_files.read_results_json(spark, str(tmp_path / "json"), schema)
    assert history.groupBy("run_ts").count().count() == 2
    assert rows(history.where(F.col("run_ts") == one).drop("run_ts")) == rows(records)
    # The same run again takes its own place.
    result_files.append_results_json(records, str(tmp_path / "json"), one)
    assert result_files.read_results_json(spark, str(tmp_path / "json"), schema).count() == 4


def test_staging_folder_is_the_sessions(spark):
    assert staging_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x") != new_path(spark, "x")


def test_measured_bytes(spark):
    df = spark.createDataFrame([("ab", [1.0, 2.0], 1), (None, None, None)], "s string, v array<double>, i int")
    assert measured_bytes(df) == (16 + 2 + 16 + 8) + (16 + 0 + 0 + 8)


@pytest.mark.parametrize("missing", ["corpus.jsonl", "queries.jsonl"])
def test_missing_folder_fails(spark, tmp_path, missing):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        (bf.read_corpus if missing.startswith("c") else bf.read_queries)(spark, str(tmp_path))
