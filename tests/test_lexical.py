"""Term search against a plain Python computation over all texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.catalog import fixtures as fx
from rankloom.functions.stems import plural_stem, porter_stem
from rankloom.functions.text import contents, without, words
from rankloom.operators import lexical, ranking, term_blocks
from rankloom.operators.impact import ImpactIndex, impact_candidates, impact_scores, impact_topk, quantize_impacts
from rankloom.operators.ranking import best_in_tasks, ranked, top_k
from rankloom.plans.staging import measured_bytes, text_shards

from .conftest import rows


@pytest.fixture(scope="module")
def tables(spark, folder):
    return fx.plain_corpus(spark, folder), fx.queries(spark, folder)


@pytest.fixture(scope="module")
def index(spark, tables):
    return lexical.LexicalIndex.build(tables[0])


def terms_of(text):
    return re.findall(r"[^\W_]+", text.lower())


@pytest.fixture(scope="module")
def expected(tables):
    docs = {r["doc_id"]: Counter(terms_of(r["text"])) for r in tables[0].collect()}
    docs = {d: c for d, c in docs.items() if c}
    df = Counter(t for c in docs.values() for t in c)
    avgdl = sum(sum(c.values()) for c in docs.values()) / len(docs)
    out = {}
    for q in tables[1].collect():
        for t, qtf in Counter(terms_of(q["text"])).items():
            for d, c in docs.items():
                if t in c:
                    idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                    part = c[t] / (c[t] + 0.9 * (1 - 0.4 + 0.4 * sum(c.values()) / avgdl))
                    out[q["qid"], d] = out.get((q["qid"], d), 0.0) + qtf * idf * part
    return out


def test_scores_equal_the_formula(index, tables, expected):
    got = {(r["qid"], r["doc_id"]): r["score"] for r in lexical.bm25_scores(index, tables[1]).collect()}
    assert got.keys() == expected.keys()
    assert max(abs(got[key] - expected[key]) for key in got) < 1e-6


def test_large_query_side_gives_the_same_scores(index, tables, monkeypatch):
    """The salted exchange join, with most terms counted as hot."""
    plain = rows(lexical.bm25_scores(index, tables[1]), "qid", "doc_id", "score")
    monkeypatch.setattr(lexical, "HOT_PARTS", index.total // 3)
    salted = lexical.bm25_scores(index, tables[1], broadcast_bytes=0)
    assert rows(salted, "qid", "doc_id", "score") == plain


def test_queries_over_the_limit_are_searched_in_chunks(index, tables):
    whole = rows(lexical.bm25_topk(index, tables[1], 10))
    size = measured_bytes(lexical.query_terms(tables[1]))
    assert rows(lexical.bm25_topk(index, tables[1], 10, broadcast_bytes=size // 2)) == whole
    # Below the size of single queries every chunk goes through the exchange join.
    one = tables[1].where("qid < 3")
    tiny = measured_bytes(lexical.query_terms(one)) // 6
    assert rows(lexical.bm25_topk(index, one, 10, broadcast_bytes=tiny)) == [r for r in whole if r[0] < 3]


def test_rare_terms_and_empty_queries(spark, index, tables):
    """Few matches in a block, a query nobody answers, a query without terms."""
    rare = index.doc_freq.where("df <= 2").orderBy("term").limit(30).select(
        F.concat(F.lit("q"), F.col("term")).alias("qid"), F.col("term").alias("text"))
    asked = rare.unionByName(spark.createDataFrame([("none", "zzzzqqqq"), ("blank", " ")], "qid string, text string"))
    run = rows(lexical.bm25_topk(index, asked, 5))
    assert run == rows(top_k(lexical.bm25_scores(index, asked), 5))
    assert len({q for q, *_ in run}) == 30
    assert rows(lexical.bm25_topk(index, asked.where("qid = 'none'"), 5)) == []


def test_one_term_in_every_document(spark):
    """A third of the documents are copies; ties of equal copies go to the lowest id."""
    texts = [(i, "common copy" if i % 3 == 0 else f"common w{i}") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common"), (2, "copy common")], "qid long, text string")
    index = lexical.LexicalIndex.build(docs)
    run = rows(lexical.bm25_topk(index, asked, 4), "qid", "rank", "doc_id")
    assert run == [(1, r, d) for r, d in enumerate([0, 1, 2, 3], 1)] + [(2, r, d) for r, d in enumerate([0, 3, 6, 9], 1)]


def test_shard_count_does_not_matter(tables, index):
    other = lexical.LexicalIndex.build(tables[0], shards=13)
    assert (other.n, other.avgdl, other.total) == (index.n, index.avgdl, index.total)
    assert rows(lexical.bm25_topk(other, tables[1], 20)) == rows(lexical.bm25_topk(index, tables[1], 20))


def test_top_k_is_a_prefix_and_two_step_merge_agrees(index, tables):
    scores = lexical.bm25_scores(index, tables[1])
    ten = rows(top_k(scores, 10))
    assert ten == rows(top_k(scores, 11).where("rank <= 10"))
    assert ten == rows(top_k(scores, 10, parts=3))


def test_stored_index_reopens(spark, tables, tmp_path):
    path = str(tmp_path / "index")
    built = lexical.LexicalIndex.build(tables[0], path)
    opened = lexical.LexicalIndex.open(spark, path)
    assert (opened.n, opened.avgdl, opened.total) == (built.n, built.avgdl, built.total)
    assert rows(lexical.bm25_topk(opened, tables[1], 10)) == rows(lexical.bm25_topk(built, tables[1], 10))


def test_another_analyser_is_refused(spark, tables, tmp_path):
    path = str(tmp_path / "index")
    stopped = without(words, ["the", "of"])
    lexical.LexicalIndex.build(tables[0].limit(20), path, stopped)
    opened = lexical.LexicalIndex.open(spark, path, without(words, ["of", "the"]))
    for ask in (lambda: lexical.LexicalIndex.open(spark, path), lambda: lexical.bm25_topk(opened, tables[1], 3)):
        with pytest.raises(ValueError, match="analysed by"):
            ask()


def test_search_moves_only_top_rows(index, tables):
    """Scoring is a scan without joins or exchanges; one exchange of lists of top rows by query follows."""
    plan = lexical.bm25_topk(index, tables[1], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(qid" in plan
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan


def test_postings_equal_plain_ones(index, tables):
    assert rows(index.postings) == rows(lexical.postings(tables[0]).select(index.postings.columns))
    assert rows(index.doc_freq) == rows(lexical.doc_freq(lexical.postings(tables[0])))


def test_blocks_below_the_best_are_passed_over(spark):
    """A few documents hold a rare word often; blocks of the others cannot reach them."""
    texts = [(i, "rare rare rare common" if i < 20 else f"common word{i % 50} and other{i % 7} words of a longer text") for i in range(6000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "rare common"), (2, "common longer")], "qid long, text string")
    index = lexical.LexicalIndex.build(docs, shards=2)
    looked_at, skipped = (spark.sparkContext.accumulator(0) for _ in range(2))
    found = lexical.bm25_topk(index, asked, 5, looked_at=looked_at, skipped=skipped)
    got = rows(found)
    assert looked_at.value + skipped.value >= 2 * 11 and skipped.value > 0
    assert got == rows(top_k(lexical.bm25_scores(index, asked), 5))
    # Impacts of either sign have bounds as well.
    weights = spark.createDataFrame([(i, t, (9 if i < 20 else 1) * s) for i in range(6000) for t, s in (("a", 1), ("b", -1))], "doc_id long, term string, weight int")
    asked = spark.createDataFrame([(1, "a", 2), (2, "b", -2), (3, "b", 2)], "qid long, term string, weight int")
    stored = ImpactIndex.build(weights, shards=2)
    looked_at, skipped = (spark.sparkContext.accumulator(0) for _ in range(2))
    got = rows(impact_topk(stored, asked, 5, looked_at=looked_at, skipped=skipped))
    assert got == rows(top_k(impact_scores(stored, asked), 5)) and skipped.value > 0
    assert [(q, s) for q, _, s, r in got if r == 5] == [(1, 18), (2, 18), (3, -2)]


def test_top_k_beyond_the_limit_of_the_window(spark, tables, index, monkeypatch):
    scores = lexical.bm25_scores(index, tables[1])
    plan = top_k(scores, 5000)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan.split("Window", 1)[1] and "WindowGroupLimit" not in plan
    assert rows(top_k(scores, 5000)) == rows(ranked(scores).where("rank <= 5000"))
    monkeypatch.setattr(ranking, "HELD_ROWS", 100)
    assert rows(top_k(best_in_tasks(scores, 7), 7)) == rows(top_k(scores, 7))
    assert rows(lexical.bm25_topk(index, tables[1], 5000)) == rows(ranked(scores))
    # With null keys and several of them.
    odd = spark.createDataFrame([(None, "x", 1, 0.5), (None, "x", 2, 0.7), (1, None, 3, 0.1), (1, None, 4, 0.1), (1, "x", 5, 0.0)],
                                "a int, b string, doc_id int, score double")
    assert rows(best_in_tasks(odd.coalesce(1), 1, ("a", "b")), "doc_id") == [(2,), (3,), (5,)]


def test_lists_of_top_rows_are_merged(spark):
    """Many parts of a query, cut as they stream past, in one step and in two."""
    rng = np.random.default_rng(1)
    flat = [(q, int(d), float(s)) for q in range(7) for d, s in zip(rng.permutation(900), rng.integers(0, 40, 900))]
    parts = [(q, [d for _, d, _ in some], [s for *_, s in some]) for q in range(7) for part in range(9)
             for some in [[f for f in flat if f[0] == q and f[1] % 9 == part]]]
    packed = spark.createDataFrame(parts, "qid long, doc_id array<long>, score array<double>").repartition(6)
    want = rows(top_k(spark.createDataFrame(flat, "qid long, doc_id long, score double"), 30))
    assert rows(ranking.merged(packed, 30)) == rows(ranking.merged(packed, 30, parts=3)) == want


def test_candidates_are_scored_alone(index, tables):
    impacts = ImpactIndex.build(quantize_impacts(index.postings.select("doc_id", "term", F.log1p("tf").alias("weight"))))
    asked = quantize_impacts(lexical.query_terms(tables[1]).select("qid", "term", F.log1p("qtf").alias("weight")))
    pairs = tables[1].select("qid").crossJoin(tables[0].where("doc_id < 5").select("doc_id"))
    every = impact_scores(impacts, asked).where("doc_id < 5")
    assert rows(impact_candidates(impacts, asked, pairs)) == rows(every)


def test_candidates_move_no_postings(spark, index, tables):
    """A small set of candidates goes to the postings, which are exchanged for a large one only."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    impacts = ImpactIndex.build(quantize_impacts(index.postings.select("doc_id", "term", F.log1p("tf").alias("weight"))))
    asked = quantize_impacts(lexical.query_terms(tables[1]).select("qid", "term", F.log1p("qtf").alias("weight")))
    pairs = tables[1].select("qid").crossJoin(tables[0].where("doc_id < 5").select("doc_id"))
    # Spark shall not broadcast the tiny tables here by itself.
    spark.conf.set(limit, "-1")
    try:
        for search in (lambda held: impact_candidates(impacts, asked, pairs, broadcast_bytes=held),
                       lambda held: lexical.bm25_candidates(index, tables[1], pairs, broadcast_bytes=held)):
            small, large = search(None), search(0)
            assert rows(small) == rows(large)
            assert ["SortMergeJoin" in x._jdf.queryExecution().toString() for x in (small, large)] == [False, True]
    finally:
        spark.conf.set(limit, before)


def test_impacts_are_an_integer_dot_product(spark, tables, index):
    weights = quantize_impacts(index.postings.select("doc_id", "term", F.log1p("tf").alias("weight")))
    asked = quantize_impacts(lexical.query_terms(tables[1]).select("qid", "term", F.log1p("qtf").alias("weight")))
    docs, got = {}, {}
    for r in weights.collect():
        docs.setdefault(r["term"], []).append((r["doc_id"], r["weight"]))
    for r in asked.collect():
        for d, w in docs.get(r["term"], []):
            got[r["qid"], d] = got.get((r["qid"], d), 0) + w * r["weight"]
    stored = ImpactIndex.build(weights)
    assert {(r["qid"], r["doc_id"]): r["score"] for r in impact_scores(stored, asked).collect()} == got
    large = impact_topk(stored, asked, 10, broadcast_bytes=0)
    assert rows(large) == rows(impact_topk(stored, asked, 10))


def test_weights_of_either_sign_give_one_answer_on_every_plan(spark):
    docs = [(d, f"t{t}", (d * t) % 5 - 2 or 1) for d in range(40) for t in range(d % 7 + 1)] + [(99, "t0", 1), (99, "t1", -1)]
    weights = spark.createDataFrame(docs, "doc_id long, term string, weight int")
    asked = spark.createDataFrame([(0, f"t{t}", 3 - t) for t in range(7)] + [(q, f"t{q % 7}", -2) for q in range(1, 12)] + [(20, "t0", 1), (20, "t1", 1)],
                                  "qid long, term string, weight int")
    index = ImpactIndex.build(weights)
    pairs = {}
    for r in impact_scores(index, asked).collect():
        pairs.setdefault(r["qid"], []).append((-r["score"], r["doc_id"]))
    want = sorted((q, d, -s, n) for q, found in pairs.items() for n, (s, d) in enumerate(sorted(found)[:8], 1))
    assert any(s < 0 for _, _, s, _ in want) and any(s == 0 for _, _, s, _ in want)
    size = lexical._held_bytes(asked, 8)
    for limit in (None, size // 2, size // 3, 50, 0):
        run = impact_topk(index, asked, 8, broadcast_bytes=limit)
        assert run.schema["score"].dataType.simpleString() == "bigint" and rows(run) == want, limit


def test_impact_scores_are_made_where_the_blocks_lie(spark, monkeypatch):
    rng = np.random.default_rng(7)
    docs = [(f"d{d}", f"t{t}", int(rng.integers(-9, 9)) or 1) for d in range(300) for t in rng.integers(0, 40, 6)] + [(None, "t1", 3), ("d1", "t1", 5)]
    weights = spark.createDataFrame(docs, "doc_id string, term string, weight int")
    # Products beyond what a double holds, repeated rows, and rows without an id or a term.
    asked = spark.createDataFrame([(q, f"t{(q * t) % 40}", t - 3 or 2**30) for q in range(30) for t in range(7)] + [(None, "t1", 2), (4, None, 2), (5, "none", 1)],
                                  "qid int, term string, weight int")
    heavy = weights.withColumn("weight", F.when(F.col("doc_id") == "d1", F.lit(2**30 + 1)).otherwise(F.col("weight")))
    for table in (weights, heavy):
        index = ImpactIndex.build(table)
        parts = table.where("doc_id IS NOT NULL").withColumnRenamed("weight", "part").join(asked, "term")
        want = parts.groupBy("qid", "doc_id").agg(F.sum(F.col("weight").cast("long") * F.col("part")).alias("score"))
        for buffer in (1_000_000, 700):
            monkeypatch.setattr(term_blocks, "SCORE_BUFFER", buffer)
            found = impact_scores(index, asked)
            assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.schema["qid"] == asked.schema["qid"]
        assert "Exchange" not in found._jdf.queryExecution().toString()
        # By the exchange, and with a null weight.
        assert sorted(map(str, impact_scores(index, asked, broadcast_bytes=0).collect())) == sorted(map(str, want.collect()))
    odd = spark.createDataFrame([(1, "t1", None), (1, "t2", 3)], "qid int, term string, weight int")
    assert sum(r["score"] is None for r in impact_scores(index, odd).collect()) > 0


def test_matched_entries_of_a_batch_are_bounded(spark, index, tables, monkeypatch):
    from rankloom.operators import term_blocks

    want = rows(lexical.bm25_topk(index, tables[1], 5))
    monkeypatch.setattr(term_blocks, "SCORE_BUFFER", 500)
    assert rows(lexical.bm25_topk(index, tables[1], 5)) == want


def test_stored_impacts_reopen(spark, index, tables, tmp_path):
    path = str(tmp_path / "impacts")
    weights = index.postings.select("doc_id", "term", F.col("tf").cast("int").alias("weight"))
    ImpactIndex.build(weights, path)
    assert rows(ImpactIndex.open(spark, path).impacts, "doc_id", "term", "weight") == rows(weights, "doc_id", "term", "weight")


def test_published_stems():
    # Examples of the published algorithm, word and stem.
    pairs = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
        conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file
        happy happi sky sky relational relat conditional condit rational ration digitizer digit radicalli radic vietnamization vietnam
        operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic
        formative form electriciti electr hopeful hope goodness good revival reviv allowance allow airliner airlin adjustable adjust
        irritant irrit replacement replac dependent depend adoption adopt communism commun activate activ effective effect probate probat
        rate rate cease ceas controll control roll roll""".split()
    assert [porter_stem(w) for w in pairs[::2]] == pairs[1::2]
    assert [porter_stem(w) for w in ("is", "größen", "b2b", "")] == ["is", "größen", "b2b", ""]
    assert [plural_stem(w) for w in ("cities", "zombaies", "boxes", "shoes", "cats", "bus", "glass", "s", "")] == \
        ["city", "zombaie", "boxe", "shoe", "cat", "bus", "glass", "s", ""]


def test_stemmed_index(spark, tables, tmp_path):
    """Both ways to join the stems; queries meet documents by stem; the stemmer sees each term once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(term):
        seen.add(1)
        return porter_stem(term)

    counted.label = "porter"
    path = str(tmp_path / "index")
    small = lexical.LexicalIndex.build(tables[0], path, stemmer=counted)
    assert seen.value == lexical.tokens(tables[0]).select("term").distinct().count()
    large = lexical.LexicalIndex.build(tables[0], stemmer=porter_stem, broadcast_bytes=0)
    assert rows(small.postings) == rows(large.postings) and rows(small.doc_freq) == rows(large.doc_freq)
    want = lexical.stemmed(lexical.postings(tables[0]), lexical.stem_table(lexical.tokens(tables[0]), porter_stem), "tf")
    assert rows(small.postings) == rows(want.select(small.postings.columns))
    opened = lexical.LexicalIndex.open(spark, path, stemmer=porter_stem)
    assert rows(lexical.bm25_topk(opened, tables[1], 10)) == rows(top_k(lexical.bm25_scores(large, tables[1]), 10))
    with pytest.raises(ValueError, match="stems by porter"):
        lexical.LexicalIndex.open(spark, path)
    docs = spark.createDataFrame([(1, "running runs"), (2, "walks")], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "Run walked")], "qid string, text string")
    run = lexical.bm25_topk(lexical.LexicalIndex.build(docs, stemmer=porter_stem), asked, 5)
    assert [d for _, d in rows(run, "rank", "doc_id")] == [1, 2]


def test_stems_of_many_terms_meet_blocks_not_postings(spark, monkeypatch):
    """Names over the broadcast limit are exchanged by block and term; blocks come out as with a broadcast, in as many parts as shards."""
    docs = spark.createDataFrame([(i, " ".join(f"{w}{'s' * (i % 2)}" for w in ("cat", "dog", f"word{i % 700}"))) for i in range(3000)], "doc_id long, text string")
    small = lexical.LexicalIndex.build(docs, stemmer=plural_stem, shards=3)

    def refused(blocks):
        raise AssertionError("postings one by one")

    monkeypatch.setattr(lexical, "rows_of", refused)
    large = lexical.LexicalIndex.build(docs, stemmer=plural_stem, shards=3, broadcast_bytes=0)
    assert large.blocks.columns == small.blocks.columns
    kept = ("doc_ids", "terms", "sizes", "places", "values", "lengths", "most", "least", "shortest")
    key = lambda r: [list(r[c]) for c in kept]
    assert sorted(map(key, large.blocks.collect())) == sorted(map(key, small.blocks.collect()))
    plain = term_blocks.blocks_of_terms(docs.select("doc_id", words(F.col("text")).alias("terms"))).withColumn("block", F.monotonically_increasing_id())
    names = lexical.stem_table(lexical.tokens(docs), plural_stem)
    assert term_blocks.renamed_by_exchange(plain, names, 13).rdd.getNumPartitions() == 13


def test_analysers_and_contents(spark):
    df = spark.createDataFrame([("T", "The fox, the Größe_x 42!"), (None, None), ("", " ")], "title string, text string")
    got = [r[0] for r in df.select(words(F.col("text"))).collect()]
    assert got == [["the", "fox", "the", "größe", "x", "42"], [], []]
    assert df.select(without(words, ["the"])(F.col("text"))).first()[0] == ["fox", "größe", "x", "42"]
    assert [r[0] for r in df.select(contents()).collect()] == ["T The fox, the Größe_x 42!", " ", "  "]


def test_zero_impacts_are_left_out(spark):
    df = spark.createDataFrame([(1, "a", 0.001), (1, "b", 1.5)], "doc_id int, term string, weight double")
    assert rows(quantize_impacts(df)) == [(1, "b", 150)]


def test_shards_of_texts_grow_with_the_table(spark):
    # The leaf states 8 bytes a row, 320 MB, without being run.
    corpus = spark.range(40_000_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = lexical.postings(corpus)
    weighed = rows.select("doc_id", "term", F.col("tf").cast("int").alias("weight"))
    dealt = [re.search(r"RepartitionByExpression \[doc_id\S*\], (\d+)", part._jdf.queryExecution().optimizedPlan().toString())
             for part in (rows, weighed.repartition(text_shards(weighed), "doc_id"))]
    assert [int(found[1]) for found in dealt] == [39, 39]


def test_blocks_hold_the_same_rows_however_many_shards(spark):
    rows = [(i if i % 9 else None, "a b b " + f"t{i % 7}" if i % 5 else None) for i in range(2_000)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, lexical.LexicalIndex.build(corpus, shards=n).postings.collect())) for n in (1, 13)]
    assert found[0] == found[1]
    assert len(found[0]) == 3 * sum(1 for i, text in rows if i is not None and text)
