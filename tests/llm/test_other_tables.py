"""Conversations, pages, vectors and pieces."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from rankloom.llm import hnsw, url_cascade
from rankloom.llm.pieces import Pieces, encode_decode
from rankloom.llm.queries import MODEL, QUERIES
from rankloom.llm.quotes import conversations
from tests.llm.helpers import documents, rows_of, with_clashing_columns

MESSAGES = "conv_id bigint, turn bigint, role string, text string"


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?\n\nSecond passage here"),
        (1, 1, "assistant", "> How are   You?\nFine."),
        (1, 2, "user", ">> how are you?\n> Fine.\n\nGood to hear"),
        (1, 3, "assistant", "> Second passage here\r\nyes"),
        (1, 4, "user", None),
        (1, 5, "user", "> Not yet said\nback to the start"),
        (1, 6, "user", "Not yet said"),
        (2, 0, "user", "> Fine.\nnot linked"),
        (2, 1, None, "a\n\n> b"), (2, 1, None, "a\n\n> b"),
        (None, 5, "user", "> Fine."), (2, None, "x", ""),
    ]
    got = conversations(with_clashing_columns(spark.createDataFrame(rows, MESSAGES)))
    assert rows_of(got.select("conv_id", "turn", "level", "reply_to", "thread", "position", "content")) == sorted([
        (1, 0, 0, None, 0, 0, "Hello there\nHow are you?\n\nSecond passage here"),
        (1, 1, 1, 0, 0, 1, "Fine."), (1, 2, 2, 1, 0, 2, "Good to hear"), (1, 3, 1, 0, 0, 3, "yes"),
        (1, 4, 0, None, 4, 4, ""), (1, 5, 1, None, 5, 5, "back to the start"), (1, 6, 0, None, 6, 6, "Not yet said"),
        (2, None, 0, None, None, 0, ""), (2, 0, 1, None, 0, 1, "not linked"), (2, 1, 1, None, 1, 2, "a"), (2, 1, 1, None, 1, 3, "a"),
        (None, 5, 1, None, 5, 0, ""),
    ], key=repr)


def test_conversations_without_quotes_stay_as_they_are(spark, folder):
    messages = spark.read.parquet(f"{folder}/conversations.parquet")
    got = QUERIES["op6_quotes"](spark, folder)
    assert rows_of(got.select("conv_id", "turn", "content")) == rows_of(messages.select("conv_id", "turn", "text"))
    assert got.where("position <> turn OR reply_to IS NOT NULL").count() == 0


def test_long_message(spark):
    text = "\n".join(("> " if k % 3 else "") + f"line {k}" for k in range(20_000))
    got = conversations(spark.createDataFrame([(1, 0, "u", text), (1, 1, "u", "> line 0\nok")], MESSAGES)).collect()
    assert {(r.turn, r.reply_to) for r in got} == {(0, None), (1, 0)}


def slow_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_cascade.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    words = host.replace("-", ".").split(".")
    return host, path, None, "block" if set(words) & set(url_cascade.BLOCK_WORDS) else "allow"


def test_urls(spark, folder):
    odd = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "http://example.org/en/17", "http://org/", "http://xorg/", "http://a.org",
           "http://a.org?x=/es/", "https://a.com/fr/#x", "https://a.com/de/?q", "x://y://z/fr/", "http://big-POKER.net/", "ftp://Ä.com/fr/",
           "http://h\nn.org/a\nb", "http://example.org/es/", "http://example.org/es/"]
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").union(
        spark.createDataFrame([(1000 + k, u) for k, u in enumerate(odd)] + [(None, None)], "page_id bigint, url string"))
    got = url_cascade.filter_urls(with_clashing_columns(pages.withColumn("html", F.lit(None).cast("string"))))
    assert rows_of(got) == sorted([(r.page_id, *slow_url(r.url)) for r in pages.collect()], key=repr)
    assert url_cascade.filter_urls(pages.where("false")).count() == 0


@pytest.mark.parametrize("bits, size", [(1, 10**9), (8, 10**9), (4, 8000)])
def test_cascade_is_exact(spark, bits, size, monkeypatch):
    monkeypatch.setattr(url_cascade, "BITS_A_KEY", bits)
    rows = spark.range(60_000).select(F.concat(F.lit("h"), F.col("id") % 58_000).alias("host"), "id")
    listed = F.substring("key", 2, 9).cast("int") % 3 == 0
    got = url_cascade.listed_rows(rows, "host", listed, size)
    assert got.count() == 60_000 and got.where("listed <> (id % 58000 % 3 = 0)").count() == 0
    universe = rows.select(F.col("host").alias("key"), (F.col("id") % 3 == 0).alias("listed")).where("id < 58000")
    assert len(url_cascade.cascade(universe, bits)) >= 2


def slow_nearest(rows, every, k):
    points = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            points[i] = min(points.get(i, v), v)
    out = []
    for q in points:
        if q % every == 0:
            ranked = sorted((float(np.sqrt(((np.array(v, float) - np.array(points[q], float)) ** 2).sum())), i)
                            for i, v in points.items() if i != q and len(v) == len(points[q]))[:k]
            out += [(q, rank, i, d) for rank, (d, i) in enumerate(ranked, 1)]
    return out


def test_nearest_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(300)]
    rows += [(300 + k, rows[7][1]) for k in range(40)] + [(None, [1.0] * 4), (400, None), (500, [0.0] * 4), (600, [1.0, None, 1.0, 1.0]),
                                                         (700, [float("nan")] * 4), (800, [float("inf")] * 4), (900, []), (1000, [1.0, 2.0]),
                                                         (1001, [1.0, 2.5]), rows[100], (200, [9.0] * 4)]
    df = with_clashing_columns(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in hnsw.search_every(df).collect()}
    want = {(q, rank): (i, d) for q, rank, i, d in slow_nearest(rows, 100, 10)}
    assert set(got) == set(want) and (1000, 1) in got
    same = [abs(got[key][1] - want[key][1]) < 1e-12 for key in want]
    assert np.mean(same) > 0.95
    # Ties go to the smaller id wherever the distances were all found.
    assert all(got[key][0] == want[key][0] for key in want if all(got[k][1] == want[k][1] for k in want if k[0] == key[0]))
    assert hnsw.search_every(df.where("false")).count() == 0


def test_nearest_recall_over_several_shards(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
    want = {(q, i) for q, _, i, _ in slow_nearest(rows, 20, 10)}
    index, parts = hnsw.build_index(hnsw.usable(vectors), shard_rows=150)
    got = hnsw.nearest(index, parts, hnsw.usable(vectors).where("vec_id % 20 = 0"), block=7).collect()
    assert parts == 4 and len(got) == len(want)
    assert len(want & {(r.query_id, r.vec_id) for r in got}) / len(want) >= 0.9


@pytest.fixture(scope="module")
def pieces():
    with open(MODEL, "rb") as file:
        return Pieces(file.read())


def slow_encode(pieces, word):
    """Best segmentation of one word by trying every piece at every place."""
    by_text = {"".join(map(chr, c[:n])): (float(s), int(i)) for c, n, s, i in zip(pieces.chars, pieces.sizes, pieces.scores, pieces.ids)}
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        choices = [(best[start][0] + by_text[word[start:end]][0], best[start][1] + [by_text[word[start:end]][1]])
                   for start in range(max(0, end - pieces.longest), end) if word[start:end] in by_text]
        if word[end - 1] not in by_text:
            choices.append((best[end - 1][0] + pieces.unknown_score, best[end - 1][1] + [int(pieces.byte_ids[b]) for b in word[end - 1].encode()]))
        best.append(max(choices, key=lambda c: c[0]))
    return best[-1][1]


def test_pieces_are_the_best_path(pieces, spark, folder):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(20).collect()]
    words = sorted({w for t in texts for w in t.split(" ")})[:400] + ["漢字é", "a\nb\t", "😀x", "", "$$$", "\x00"]
    ids, counts = pieces.encode(words)
    ends = np.cumsum(counts)
    for word, end, n in zip(words, ends, counts):
        assert ids[end - n:end].tolist() == (slow_encode(pieces, " " + word) if word else [])


def test_pieces_score_no_less_than_the_library(pieces):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    # The library reading the same pieces and scores as a unigram model.
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = dict(zip(pieces.ids.tolist(), pieces.scores.tolist()))
    same = 0
    words = [f"{a}{b}" for a in ("th", "qu", "re", "ver", "z", "Schl") for b in ("ing", "ation", "est", "x", "eur", "heit", "oo")]
    for word in words:
        mine, theirs = pieces.encode([word])[0].tolist(), library.encode(word)
        same += mine == theirs
        assert sum(map(score.get, mine)) >= sum(map(score.get, theirs))
    assert same >= 0.9 * len(words)


def test_pieces_round_trip(spark, pieces):
    docs = documents(spark)
    got = encode_decode(with_clashing_columns(docs), MODEL)
    assert got.count() == docs.count() and got.where("NOT restored").count() == 0
    assert {(r.pieces, r.n_pieces, r.restored) for r in got.where("doc_id = 12").select(F.col("pieces").cast("string"), "n_pieces", "restored").collect()} \
        == {(None, None, None)}
    assert [tuple(r) for r in got.where("doc_id = 13").select(F.size("pieces"), "n_pieces", "restored").collect()] == [(0, 0, True)]
    for text in ("a  b", " lead", "trail  ", "漢字 \n\t é", "x" * 3000, "   "):
        assert pieces.decode(pieces.encode([text])[0].tolist()) == text
    assert pieces.decode(pieces.encode(["a▁b"])[0].tolist()) == "a b"


@pytest.mark.parametrize("name", ["op6_quotes", "op8_url_cascade", "op9_hnsw"])
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], MESSAGES).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_quote_of_some_lines_of_a_passage(spark):
    passage = "one\nTwo  words\nthree\nfour"
    rows = [(1, 0, "user", passage), (1, 1, "bot", "> two words\n> three\nyes"), (1, 2, "user", "x\none\ntwo words"),
            # Lines that are not one after the other, and in another order.
            (1, 3, "bot", "> one\n> three"), (1, 4, "bot", "> three\n> two words"),
            # A whole passage comes before part of an earlier one.
            (1, 5, "user", "three\nfour"), (1, 6, "bot", "> three\n> four"), (1, 7, "bot", ">> one\n>> two words\n>> three\n> yes"),
            # Not from another conversation, nor from a later turn.
            (2, 0, "bot", "> two words\n> three"), (2, 1, "user", passage)]
    got = {(r.conv_id, r.turn): r.reply_to for r in conversations(
        spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {(1, 1): 0, (1, 6): 5, (1, 7): 1}
