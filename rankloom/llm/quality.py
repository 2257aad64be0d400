"""Quality of documents by ordinal regression on graded ratings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import as_bytes, chunks

# Rated documents learnt from.
ROWS = 6_000
WORDS = 1 << 17
# Bytes of a longer word that are a feature of their own.
START = 5
# A word enters if so many rated documents have it and its score test against some grade is this many
# deviations off; thousands of words that tell nothing would drown the few that do.
LEAST, TELLING = 3, 4.0
# Besides hashed words: shapes of words, and figures on the whole text.
SHAPES, FIGURES = 64, 3
SIZE = WORDS + SHAPES + FIGURES
# Documents are kept if the chance of the best grade is at least this, or a higher cut that costs at most
# ``LOSS`` of the documents of the best grade in a held-out ``HELD_OUT``-th of the rated ones.
KEEP = 0.5
LOSS, HELD_OUT = 0.01, 6

_SIGNS = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def grades(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)`` of ``labels(doc_id, quality, toxic)``: 0 for low quality, 1 for toxic, 2 for neither.

    A null toxic counts as 0; a null quality gives no grade.
    """
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality").isNotNull(), 2)
    return labels.select("doc_id", grade.alias("grade")).where("grade IS NOT NULL")


class _Codes(dict):
    """Word to hashed start (``WORDS`` for none), hashed bucket and shape, in one number; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        bare = word.strip(_SIGNS)
        signs = len(word) - len(bare)
        shape = (bool(bare) and bare == bare.upper() != bare.lower()) | (any(48 <= b < 58 for b in bare[:3])) << 1 \
            | min(signs, 3) << 2 | min(len(bare) // 8, 3) << 4
        bare = bare.lower()
        start = xxhash.xxh32_intdigest(bare[:START], seed=1) % WORDS if len(bare) > START else WORDS
        code = self[word] = start << 25 | xxhash.xxh32_intdigest(bare) % WORDS << 8 | int(shape)
        return code


def features(text: bytes, codes: dict) -> tuple[np.ndarray, np.ndarray] | None:
    """Numbers and values of a text's features; None for a text without words.

    Words and starts of longer ones enter by being there, so that a single
    telling one in a long text counts; the figures are the share of words equal
    to the one before, the share of distinct ones and the length.
    """
    words = text.split()
    n = len(words)
    if not n:
        return None
    both = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    word = np.unique(both >> 8 & WORDS - 1)
    start = np.unique(both >> 25)
    bucket = np.union1d(word, start[start < WORDS])
    shape = np.bincount(both & 255, minlength=SHAPES) / n
    seen = np.flatnonzero(shape)
    figures = [(both[1:] == both[:-1]).mean() if n > 1 else 0.0, len(word) / n, np.log1p(n) / 10]
    return (np.r_[bucket, WORDS + seen, WORDS + SHAPES + np.arange(FIGURES)],
            np.r_[np.full(len(bucket), 0.5), 2 * shape[seen], figures])


class OrdinalModel:
    """P(grade > levels[j]) = sigmoid(weights . x - cuts[j]): one set of weights, ordered cuts."""

    def __init__(self, levels: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.levels, self.weights, self.cuts = levels, weights, cuts
        self.keep = KEEP

    def above(self, score: np.ndarray) -> np.ndarray:
        """Chance, for every score, of a grade above each level but the last."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts, -500, 500)))

    def expected(self, above: np.ndarray) -> np.ndarray:
        return self.levels[0] + above @ np.diff(self.levels)

    def tail(self, above: np.ndarray, grade: float) -> np.ndarray:
        """Chance of ``grade`` or better."""
        at = int(np.searchsorted(self.levels, grade))
        if at == 0:
            return np.ones(len(above))
        return above[:, at - 1] if at < len(self.levels) else np.zeros(len(above))


def fit_ordinal(rows: np.ndarray, numbers: np.ndarray, values: np.ndarray, grade: np.ndarray,
                steps: int = 300, rate: float = 0.05, decay: float = 3e-4) -> OrdinalModel:
    """Maximum likelihood with ridge, by full gradient steps with adaptive rates.

    The cuts are a first one and positive distances, so they stay in order.
    """
    levels, level = np.unique(grade, return_inverse=True)
    n, inner = len(grade), len(levels) - 1
    used, column = np.unique(numbers, return_inverse=True)
    if not inner:
        return OrdinalModel(levels.astype(float), np.zeros(SIZE), np.zeros(0))
    share = np.array([(level > j).mean() for j in range(inner)])
    start = -np.log(share / (1 - share))
    weight, first, steps_up = np.zeros(len(used)), start[0], np.log(np.maximum(np.diff(start), 1e-3))
    mean, square = np.zeros(len(used) + inner), np.zeros(len(used) + inner)
    every = np.arange(n)
    for step in range(1, steps + 1):
        cuts = first + np.r_[0, np.cumsum(np.exp(steps_up))]
        score = np.bincount(rows, weight[column] * values, n)
        over = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30)))
        edge = np.c_[np.ones(n), over, np.zeros(n)]
        slope = edge * (1 - edge)
        chance = np.maximum(edge[every, level] - edge[every, level + 1], 1e-12)
        pull = -(slope[every, level] - slope[every, level + 1]) / chance / n
        # By cut: a cut is the lower edge of one level and the upper edge of the one below.
        by_cut = np.array([((level == j + 1) * slope[:, j + 1] / chance - (level == j) * slope[:, j + 1] / chance).sum() / n
                           for j in range(inner)])
        toward = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.r_[np.bincount(column, pull[rows] * values, len(used)) + decay * weight, toward[0], toward[1:] * np.exp(steps_up)]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        move = rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)
        weight, first, steps_up = weight - move[:len(used)], first - move[len(used)], steps_up - move[len(used) + 1:]
    full = np.zeros(SIZE)
    full[used] = weight
    return OrdinalModel(levels.astype(float), full, first + np.r_[0, np.cumsum(np.exp(steps_up))])


def keep_from(tails: np.ndarray, loss: float = LOSS) -> float:
    """The highest cut, ``KEEP`` at least, under which at most ``loss`` of the good documents' chances ``tails`` lie.

    Too few documents to tell such a loss leave it at ``KEEP``.
    """
    lost = int(loss * len(tails))
    return max(KEEP, float(np.sort(tails)[lost])) if lost else KEEP


def telling(rows: np.ndarray, numbers: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """For every hashed word the greatest deviation, over the cuts between grades, of how many documents above the cut have it."""
    have = np.bincount(numbers, minlength=SIZE).astype(float)
    out = np.zeros(SIZE)
    for cut in np.unique(grade)[:-1]:
        above = grade > cut
        share = above.mean()
        off = np.bincount(numbers, above[rows], SIZE) - have * share
        out = np.maximum(out, np.abs(off) / np.sqrt(np.maximum(have * share * (1 - share), 1e-9)))
    return out


def fit(docs: DataFrame, ratings: DataFrame, most: int = ROWS, least: int = LEAST, good: float = 2) -> OrdinalModel | None:
    """A model from at most ``most`` ratings, chosen by the hash of the id; None without any.

    A hashed word gets a weight if ``least`` of the documents have it and it is
    ``telling``. Where there are enough, the ``HELD_OUT``-th part is left out of
    the fit and gives the cut ``keep``, for documents of grade ``good`` or better. A document that is
    rated several times, or an id that several documents share, enters with
    every pair of document and rating. Ratings without a document are ignored.

    Only these few ids are broadcast; executors turn the whole texts into
    features and the driver gets those.
    """
    at = F.xxhash64(F.lit("rated"), "doc_id")
    chosen = ratings.where("grade IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("grade").cast("double").alias("grade")) \
        .orderBy(at, "doc_id", "grade").limit(most)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in chunks(batches):
            out = {"grade": [], "numbers": [], "values": []}
            for text, grade in zip(as_bytes(batch.column("text")), batch.column("grade").to_pylist()):
                found = features(text or b"", codes)
                if found:
                    out["grade"].append(grade)
                    out["numbers"].append(found[0].astype("<i4").tobytes())
                    out["values"].append(found[1].astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("grade", pa.float64()), ("numbers", pa.binary()), ("values", pa.binary())]))

    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "grade")
    found = rated.mapInArrow(rows, "grade double, numbers binary, values binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["grade", "numbers", "values"]).reset_index(drop=True)
    numbers = [np.frombuffer(x, "<i4") for x in found["numbers"]]
    rows_of = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
    number = np.concatenate(numbers).astype(np.int64)
    value = np.concatenate([np.frombuffer(x, "<f4") for x in found["values"]]).astype(float)
    grade = found["grade"].to_numpy()

    def learn(which: np.ndarray) -> OrdinalModel:
        mine = which[rows_of]
        own = (np.cumsum(which) - 1)[rows_of[mine]]
        enters = (telling(own, number[mine], grade[which]) >= TELLING) & (np.bincount(number[mine], minlength=SIZE) >= least)
        enters[WORDS:] = True
        used = enters[number[mine]]
        return fit_ordinal(own[used], number[mine][used], value[mine][used], grade[which])

    # Rows are in order of grade and features, so every HELD_OUT-th one is a fair share of each grade.
    held = np.arange(len(grade)) % HELD_OUT == HELD_OUT - 1
    if LOSS * ((grade >= good) & held).sum() < 1:
        return learn(np.ones(len(grade), bool))
    # The cut holds for the model it was chosen with, so that one is kept and not fitted anew.
    model = learn(~held)
    sums = np.bincount(rows_of, model.weights[number] * value, len(grade))
    model.keep = keep_from(model.tail(model.above(sums[(grade >= good) & held]), good))
    return model


def score(docs: DataFrame, model: OrdinalModel | None, good: float = 2) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability``, the chance of grade ``good`` or better, and the model's ``keep_cut``.

    A text that is null or has no words gets the lowest grade and chance 0.
    Without a model all are null. Existing columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("expected_grade", "tail_probability", "keep_cut")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, model = _Codes(), shared.value
        for batch in chunks(batches):
            found = [features(t or b"", codes) if model else None for t in as_bytes(batch.column("text"))]
            known = np.array([f is not None for f in found], bool)
            sums = np.array([model.weights[f[0]] @ f[1] if f else 0.0 for f in found]) if model else np.zeros(len(found))
            if model:
                above = model.above(sums)
                expected = np.where(known, model.expected(above), model.levels[0])
                tail = np.where(known, model.tail(above, good), 0.0)
                more = [pa.array(expected), pa.array(tail)]
            else:
                more = [pa.nulls(len(found), pa.float64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "expected_grade", "tail_probability"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return (docs.mapInArrow(rows, schema + "expected_grade double, tail_probability double")
            .withColumn("keep_cut", F.lit(model.keep if model else None).cast("double")))


def kept() -> Column:
    """Whether a scored row stays: the chance reaches the model's cut, or nothing is known."""
    return F.coalesce(F.col("tail_probability") >= F.col("keep_cut"), F.lit(True))
