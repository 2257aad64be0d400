"""The pipeline stage by stage against brute force on each stage's own input."""

import random
import re

import corpus_pipeline
from rankloom.llm import quality
from rankloom.llm.queries import MODEL
from rankloom.llm.pieces import Pieces
from tests.llm.helpers import DOCS, documents, rows_of, with_clashing_columns, words
from tests.llm.test_documents import SPACE, slow_components, slow_contamination, slow_dedup, slow_fingerprint


def tables(spark, folder):
    docs = documents(spark)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 != 1), 0) for k in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    shared = " ".join(docs.where("doc_id = 20").first().text.split()[:12])
    spark.createDataFrame([(1, shared), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, shared


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs, shared = tables(spark, folder)
    stages = dict(corpus_pipeline.STAGES)
    columns = list(corpus_pipeline.COLUMNS)

    good = stages["quality classifier"](spark, with_clashing_columns(docs), folder)
    model = quality.fit(docs, quality.grades(spark.read.parquet(f"{folder}/labels.parquet")))
    scored = quality.score(docs, model).where(quality.kept())
    assert good.columns == columns and rows_of(good) == rows_of(scored.select(*columns))
    assert good.where("text IS NULL OR trim(text) = ''").count() == 0

    # Every stage over all documents, whatever the one before keeps.
    rows = docs.collect()
    roots = slow_components([r.doc_id for r in rows], [slow_fingerprint(r.text) for r in rows])
    once = stages["SimHash near-dedup"](spark, with_clashing_columns(docs), folder)
    assert once.columns == columns
    want = {r.doc_id for r, root in zip(rows, roots) if r.doc_id == root and r.doc_id is not None}
    assert sorted(r.doc_id for r in once.where("doc_id IS NOT NULL").collect()) == sorted(want)
    assert once.where("doc_id IS NULL").count() == docs.where("doc_id IS NULL").count()

    cut = stages["substring dedup"](spark, with_clashing_columns(docs), folder)
    assert cut.columns == columns
    left = sorted(((r.doc_id, len(re.findall(SPACE, r.text or ""))) for r in cut.collect()), key=repr)
    assert left == sorted([(d, n - gone) for d, n, gone, _ in slow_dedup(rows)], key=repr)
    same = {(d, n) for d, n, gone, _ in slow_dedup(rows) if not gone}
    assert {r.text for r in cut.collect() if (r.doc_id, len(re.findall(SPACE, r.text or ""))) in same} <= {r.text for r in rows}

    clean = stages["benchmark decontamination"](spark, with_clashing_columns(docs), folder)
    leaks = {d for d, _, hit, _ in slow_contamination([(r.doc_id, r.text) for r in rows], [(1, shared)], 10) if any(hit)}
    assert leaks and clean.columns == columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((r.doc_id for r in rows if r.doc_id not in leaks), key=repr)


def test_run(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{stage.__name__}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    with open(MODEL, "rb") as file:
        pieces = Pieces(file.read())
    texts = sorted((r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect())
    assert 0 < len(texts) < 60
    assert [(r.doc_id, pieces.decode(r.pieces)) for r in sorted((r for r in got if r.doc_id is not None), key=lambda r: r.doc_id)] == texts


def test_decisions_by_row(spark, tmp_path):
    leak, clean, other = (" ".join(f"{name}{k}" for k in range(40)) for name in ("leak", "clean", "other"))
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, t, None, None, None) for i, t in ((None, leak), (None, clean), (None, clean), (5, leak), (5, clean + " more"), (5, other), (6, other))]
    docs = spark.createDataFrame(rows, DOCS)
    left = corpus_pipeline.keep_clean(spark, docs, str(tmp_path))
    assert rows_of(left) == sorted([r for r in rows if r[1] != leak], key=repr)
    once = corpus_pipeline.keep_first(spark, docs, str(tmp_path))
    want = [(None, leak), (None, clean), (5, leak), (5, clean + " more"), (5, other)]
    assert sorted(((r.doc_id, r.text) for r in once.collect()), key=repr) == sorted(want, key=repr)


def test_near_copies_and_empty_tables(spark, tmp_path):
    """A copy with a few changed words in a long text is within 3 bits; of each group one row stays. Nothing in, nothing out."""
    rng = random.Random(11)
    base = words(rng, 3000, "abcdefghijklmnop")
    near = list(base)
    near[1500] = "changed"
    texts = [" ".join(words(rng, 200)), " ".join(base), " ".join(near), " ".join(base), " ".join(words(rng, 200))]
    prints = [slow_fingerprint(t) for t in texts]
    roots = slow_components(list(range(10, 15)), prints)
    docs = spark.createDataFrame([(10 + k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    left = corpus_pipeline.keep_first(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(roots)) and 13 not in set(roots)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
