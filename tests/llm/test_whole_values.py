"""Whole values, full shards, random conversations and rows without ratings."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import hilbert, hnsw, url_cascade
from rankloom.llm.queries import QUERIES
from rankloom.llm.quotes import conversations
from tests.llm.helpers import DOCS, documents, rows_of, with_clashing_columns


def test_long_common_beginnings_are_told_apart(spark):
    """Sources that share far more than a few bytes, one of them with a third of the rows."""
    names = [f"https://crawl.example.org/2024/part-{k:03d}" for k in range(40)]
    rows = [(k, "t", "en", names[17] if k % 3 == 0 else names[k % 40] if k % 41 else None, k) for k in range(1200)]
    docs = spark.createDataFrame(rows, DOCS)
    cuts = hilbert.text_cuts(docs, "source", 8)
    assert 5 <= len(cuts) < 8 and cuts == sorted(set(cuts)) and set(cuts) <= set(names)
    values = sorted(r[3] for r in rows if r[3] is not None)
    bounds = [sum(v <= c for v in values) for c in cuts]
    # Every step has about an eighth of the rows, but for the value that holds more by itself.
    sizes = np.diff([0, *bounds, len(values)])
    assert sorted(sizes)[:-1] <= [2 * len(values) / 8] * (len(sizes) - 1) and max(sizes) >= 400
    assert hilbert.text_cuts(docs.where("false"), "source", 8) == []
    placed = docs.select("source", hilbert.curve_column(docs, ("source", "n_chars"), 3).alias("curve")).collect()
    assert len({r.curve for r in placed if r.source == names[3]} & {r.curve for r in placed if r.source == names[36]}) == 0
    assert sorted(r.shard for r in hilbert.shards(docs, 5).collect()) == sorted(k * 5 // 1200 for k in range(1200))


def test_shards_against_brute_force(spark):
    docs = documents(spark)
    got = hilbert.shards(with_clashing_columns(docs), 7).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 8, None if r.text is None else zlib.crc32(r.text.encode())) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    counts = np.bincount([r.shard for r in got], minlength=7)
    assert counts.max() - counts.min() <= 1
    for s in range(7):
        mine = sorted((r.slot, r.curve) for r in got if r.shard == s)
        assert [slot for slot, _ in mine] == list(range(len(mine))) and [c for _, c in mine] == sorted(c for _, c in mine)


def test_cascades_are_cut_by_the_longer_level(spark, monkeypatch):
    """Few listed keys among many: the second level is the longer one."""
    made = []
    plain = url_cascade.cascade
    monkeypatch.setattr(url_cascade, "cascade", lambda universe: made.append([len(b.bits) for b in plain(universe)]) or plain(universe))
    rows = spark.range(40_000).select(F.concat(F.lit("h"), "id").alias("host"), "id")
    got = url_cascade.listed_rows(rows, "host", F.substring("key", 2, 9).cast("int") % 4000 == 0, 500)
    assert got.where("listed <> (id % 4000 = 0)").count() == 0 and got.count() == 40_000
    assert len(made) == 4


MARKS = re.compile(r"^(?:[ \t]*>)+[ \t]?")


def slow_replies(messages):
    """{turn: reply_to} of one conversation, by comparing every quote with every earlier message."""
    def passages(text):
        out = []
        for line in (text or "").split("\n"):
            marks = MARKS.match(line)
            level, line = (marks[0].count(">"), line[marks.end():]) if marks else (0, line)
            if not line.strip(" "):
                out.append(None)
            elif out and out[-1] and out[-1][0] == level:
                out[-1][1].append(line)
            else:
                out.append((level, [line]))
        return [p for p in out if p]

    def normal(text):
        return re.sub(r"\s+", " ", text.lower()).strip(" ")

    replies = {}
    for turn, text in messages:
        found = []
        for level, lines in passages(text):
            if not level:
                continue
            earlier = sorted((t, [x for at, x in passages(body) if at == 0]) for t, body in messages if t < turn)
            asked = normal("\n".join(lines))
            whole = [t for t, own in earlier if any(asked in [normal("\n".join(x)), *map(normal, x)] for x in own)]
            some = [t for t, own in earlier if any([normal(y) for y in x[k:k + len(lines)]] == [normal(y) for y in lines]
                                                   for x in own for k in range(len(x) - len(lines) + 1))] if len(lines) > 1 else []
            found += [(level, -(whole or some)[0])] if whole or some else []
        if found:
            replies[turn] = -min(found)[1]
    return replies


@pytest.mark.parametrize("seed", [1, 2])
def test_random_nested_quotes(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("red green blue one two".split()) for _ in range(rng.randrange(1, 4))) for _ in range(12)]
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(10):
            parts = []
            for _ in range(rng.randrange(1, 4)):
                if texts and rng.random() < 0.6:
                    lines = rng.choice(texts).split("\n")
                    a = rng.randrange(len(lines))
                    parts += ["> " + line for line in lines[a:a + rng.randrange(1, 5)]]
                else:
                    parts += [rng.choice(pool) for _ in range(rng.randrange(1, 5))]
                parts += [""] * rng.randrange(2)
            texts.append("\n".join(parts))
        rows += [(conv, turn, "user", text) for turn, text in enumerate(texts)]
    got = conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    want = {(conv, t): r for conv in range(12) for t, r in slow_replies([(t, x) for c, t, _, x in rows if c == conv]).items()}
    assert {(r.conv_id, r.turn): r.reply_to for r in got if r.reply_to is not None} == want and len(want) > 40


def test_announced_quotes_and_long_messages(spark):
    first = "\n".join(f"line {k} of a long message" for k in range(4000))
    quotes = "\n\n".join("\n".join(f"> line {k + j} of a long message" for j in range(10)) for k in range(0, 3900, 50))
    rows = [(1, 0, "u", first), (1, 1, "u", "On Monday, A wrote:\n" + quotes + "\nOn Tuesday we meet"), (1, 2, "u", "Am Montag schrieb B:\nkein Zitat")]
    got = {r.turn: r for r in conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1].reply_to == 0 and got[1].content == "On Tuesday we meet"
    assert got[2].reply_to is None and got[2].content == "Am Montag schrieb B:\nkein Zitat"


def test_recall_in_a_full_shard():
    """A shard of its whole size: clusters, near copies and equal vectors."""
    rng = np.random.default_rng(6)
    n = hnsw.SHARD_ROWS
    centres = rng.normal(size=(60, 16))
    points = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, 16)) * 0.15
    points[:1500] = points[rng.integers(0, 300, 1500)] + rng.normal(size=(1500, 16)) * 1e-3
    points[1500:1600] = points[7]
    graph = hnsw.Graph({"dim": 16, **hnsw.build_graph(np.arange(n), points)})
    found = wanted = 0
    for q in range(0, n, 128):
        apart = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        apart[q] = np.inf
        limit = np.sort(apart)[9]
        _, distance = graph.search(q, points[q], 10, hnsw.EF_SEARCH)
        found += (distance <= limit + 1e-12).sum()
        wanted += 10
    assert found / wanted >= 0.95


def test_without_ratings_only_texts_without_words_go(spark, tmp_path):
    docs = documents(spark)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.keep_good(spark, with_clashing_columns(docs), str(tmp_path))
    assert rows_of(left) == sorted((tuple(r) for r in docs.collect() if (r.text or "").strip()), key=repr)
