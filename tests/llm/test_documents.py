"""Operators on documents against brute force, over tables with every awkward case."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import decontamination, hilbert, language_id, quality, simhash, substrings
from rankloom.llm.components import components
from rankloom.llm.queries import QUERIES
from tests.llm.helpers import DOCS, documents, lower, rows_of, with_clashing_columns

SPACE = r"[^\x20\x09-\x0D]+"


def slow_fingerprint(text):
    words = re.findall(SPACE, lower(text or ""))
    shingles = [" ".join(words[k:k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k in range(len(ids)):
        if ids[k] is not None:
            least[find(k)] = min(ids[k], least.get(find(k), ids[k]))
    return [least.get(find(k)) for k in range(len(ids))]


def test_simhash(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    roots = slow_components([r.doc_id for r in rows], prints)
    want = sorted([(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, roots)], key=repr)
    for df in (docs, with_clashing_columns(docs)):
        assert rows_of(simhash.near_duplicates(df)) == want


@pytest.mark.parametrize("hot", [4096, 1])
def test_links_connect_all_within_distance(spark, hot):
    rng = np.random.default_rng(5)
    prints = [0, -1]
    for centre in rng.integers(-2**63, 2**63 - 1, 12):
        point = int(centre)
        for _ in range(25):
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                point ^= -(1 << 63) if bit == 63 else 1 << int(bit)
            prints.append(point)
    prints = sorted(set(prints))
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), hot_bucket=hot)
    roots = {r.node: r.root for r in components(edges).collect()}
    got = [roots.get(p, p) for p in prints]
    want = slow_components(prints, [p & 2**64 - 1 for p in prints])
    assert got == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(50)] + [(7, 7), (None, 3), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([100, *range(200, 250)], 100), 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def slow_dedup(rows):
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        words = re.findall(SPACE, r.text or "")
        for k in range(len(words) - 19):
            place = (r.doc_id is not None, r.doc_id or 0, k)
            window = tuple(words[k:k + 20])
            seen[window] = min(seen.get(window, place), place)
    for r in rows:
        words = re.findall(SPACE, r.text or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            if seen[tuple(words[k:k + 20])] < (r.doc_id is not None, r.doc_id or 0, k):
                gone[k:k + 20] = [True] * 20
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((r.doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [4096, 2])
def test_substring_dedup(spark, shard):
    docs = documents(spark)
    want = slow_dedup(docs.collect())
    assert sum(r[2] for r in want) > 300
    assert rows_of(substrings.dedup(with_clashing_columns(docs), keep_text=False, shard_contexts=shard)) == want


def test_substring_dedup_carries_columns(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(25))), "a"), (2, "x  y " + " ".join(map(str, range(22))), "b"), (3, "p  q", None)],
                                 "doc_id bigint, text string, kept string")
    got = rows_of(substrings.dedup(docs, carry=("kept",)).select("doc_id", F.lit(0)))
    assert [r[0] for r in got] == [1, 2, 3]
    left = substrings.dedup(docs.withColumnRenamed("kept", "source"), carry=("source",))
    assert rows_of(left.select("doc_id", "source", "kept"))[1:] == [(2, "b", "x y"), (3, None, "p  q")]


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def slow_contamination(docs, items, window, slop=0):
    tests = {}
    for item, text in items:
        w = re.findall(WORD, lower(text or ""))
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            tests.setdefault(tuple(w[k:k + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w = re.findall(WORD, lower(text or ""))
        hit, found = [False] * len(w), set()
        for phrase, names in tests.items():
            for s in range(-slop, len(w)):
                if all(any(0 <= s + k + j < len(w) and w[s + k + j] == t for j in range(-slop, slop + 1)) for k, t in enumerate(phrase)):
                    found |= names
                    a, b = max(s, 0), max(s, 0) + len(phrase)
                    hit[a:b] = [True] * len(hit[a:b])
        out.append((doc, len(w), hit, sorted(str(f) for f in found - {None})))
    return out


def test_decontamination(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = {d: t for d, t in rows if t}
    items = [(1, " ".join(texts[3].split()[:14])), (2, None), (3, ""), (10, "É àb"), (None, " ".join(texts[6].split()[2:14]).upper()),
             (4, texts[16][1000:1200]), (4, "nowhere at all"), (5, "--- ...")]
    bench = with_clashing_columns(spark.createDataFrame(items, "item_id bigint, text string"))
    want = sorted([(d, n, sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), sum(hit) > 0)
                   for d, n, hit, names in slow_contamination(rows, items, 10)], key=repr)
    index = decontamination.build_index(with_clashing_columns(docs))
    assert rows_of(decontamination.contamination_digest(decontamination.contamination(with_clashing_columns(docs), bench))) == want
    # The benchmark in many broadcasts.
    assert rows_of(decontamination.contamination_digest(decontamination.match(index, bench, item_bytes=1))) == want
    empty = bench.where("false")
    assert decontamination.contamination(docs, empty).where("n_hit > 0 OR size(items) > 0").count() == 0


def test_proximity(spark):
    docs = [(1, "a b c d e f"), (2, "x a b y c z"), (3, "c b a"), (4, "a"), (5, None)]
    items = [(7, "a b c")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for slop in (0, 1, 2):
        got = {r.doc_id: r["items"] for r in decontamination.contamination(df, bench, slop=slop).collect()}
        assert got == {d: names for d, _, _, names in slow_contamination(docs, items, 10, slop)}, slop


def test_shards(spark):
    docs = documents(spark)
    got = hilbert.shards(with_clashing_columns(docs), 7, bits=3).collect()
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    want = [(r.doc_id, len((r.text or "").encode()) + 8) for r in docs.collect()]
    assert sorted(((r.doc_id, r["size"]) for r in got), key=repr) == sorted(want, key=repr)
    # More shards than rows.
    assert hilbert.shards(docs.limit(3), 24).select("shard").distinct().count() == 3


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_goes_through_every_cell_by_single_steps(spark, dims, bits):
    side = 1 << bits
    cells = [F.expr(f"CAST(id DIV {side ** k} % {side} AS INT)").alias(f"c{k}") for k in range(dims)]
    grid = spark.range(side ** dims).select(*cells)
    got = grid.select(hilbert.curve_index([F.col(f"c{k}") for k in range(dims)], bits).alias("at"), "*").orderBy("at").toPandas()
    assert list(got.pop("at")) == list(range(side ** dims))
    assert (np.abs(np.diff(got.to_numpy(), axis=0)).sum(1) == 1).all()


def test_curve_files_can_be_skipped(spark, tmp_path):
    rows = [(k, "t", f"l{k % 8}", f"s{k // 8 % 8}", k // 64) for k in range(4096)]
    hilbert.write_runs(spark.createDataFrame(rows, DOCS), str(tmp_path / "runs"), 16)
    spans = spark.read.parquet(str(tmp_path / "runs")).groupBy(F.input_file_name()).agg(
        *[F.count_distinct(c).alias(c) for c in ("lang", "source")], (F.max("n_chars") - F.min("n_chars")).alias("n_chars")).toPandas()
    box = spans["lang"] / 8 * spans["source"] / 8 * (spans["n_chars"] + 1) / 64
    assert len(spans) == 16 and box.mean() < 0.15 and spans[["lang", "source", "n_chars"]].mean().lt([8, 8, 63]).all()


def test_language_id_held_out(spark, folder):
    got = QUERIES["op1_language_id"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id").toPandas()
    assert got.count() == docs.count() and len(held) > 20
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_id_awkward_rows(spark):
    docs = with_clashing_columns(documents(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").when(F.col("doc_id") > 20, "de")))
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in language_id.identify(docs).collect()}
    assert {p for d, p, _ in got if d in (12, 13, 14)} == {"und"} and (None, "und", False) in got
    assert {p for _, p, _ in got} <= {"und", "xx", "de"}
    assert language_id.has_letter("½ 12".encode()) is False and language_id.has_letter("½ é".encode())
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    grades = quality.grades(spark.read.parquet(f"{folder}/labels.parquet"))
    model = quality.fit(docs, grades.where("doc_id % 4 <> 0"))
    assert list(np.diff(model.cuts) > 0) == [True]
    got = quality.score(docs, model).join(grades.where("doc_id % 4 = 0"), "doc_id").withColumn("kept", quality.kept()).toPandas()
    kept = got.groupby("grade")["kept"].mean()
    assert kept[0] < 0.05 and kept[2] > 0.98 and kept[1] < 0.4
    means = got.groupby("grade")["expected_grade"].mean()
    assert means[0] < means[1] < means[2]


def test_quality_cut_removes_toxic(spark):
    """Single telling words, each in about ten of 3,000 rated documents."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(6000):
        low, toxic = rng.random() < 0.15, rng.random() < 0.1
        text = [f"{'low' if low and rng.random() < 0.3 else 'w'}{n}" for n in rng.integers(0, 100, 30)] + [f"bad{rng.integers(0, 30)}"] * toxic
        rows.append((k, " ".join(rng.permutation(text)), int(not low), int(toxic)))
    every = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int")
    model = quality.fit(every, quality.grades(every.where("doc_id % 2 = 0")))
    got = quality.score(every.where("doc_id % 2 = 1"), model).withColumn("kept", quality.kept()).where("quality = 1").toPandas()
    kept = got.groupby("toxic")["kept"].mean()
    print(f"cut {model.keep:.3f}, kept {kept.to_dict()}, at one half {got.assign(h=got['tail_probability'] >= 0.5).groupby('toxic')['h'].mean().to_dict()}")
    assert kept[1] < 0.2 and kept[0] > 0.98
    assert quality.keep_from(np.arange(1000) / 1000) == quality.KEEP
    assert quality.keep_from(0.7 + np.arange(1000) / 10000) == 0.701


def test_quality_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(k, k % 3 // 2 if k % 5 else None, k % 2) for k in range(50)] + [(None, 1, 0), (999, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    model = quality.fit(with_clashing_columns(docs), quality.grades(labels), least=1)
    got = quality.score(with_clashing_columns(docs), model)
    assert got.count() == docs.count()
    low = {(r.expected_grade, r.tail_probability) for r in got.where("doc_id IN (12, 13, 14)").collect()}
    assert low == {(0.0, 0.0)}
    none = quality.score(docs, quality.fit(docs, quality.grades(labels.where("false"))))
    assert none.where(quality.kept()).count() == docs.count()
    one = quality.fit(docs, quality.grades(labels.where("quality = 0")))
    assert {r.expected_grade for r in quality.score(docs, one).collect()} == {0.0}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ("op6_quotes", "op8_url_cascade", "op9_hnsw", "op11_hard_negatives")))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
