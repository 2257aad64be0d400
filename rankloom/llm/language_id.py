"""Language of a text: the family first, then one-versus-one linear SVMs between its languages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rankloom.llm.common import as_bytes, chunks

# Language families by ISO 639-1 code. A language of no family here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("ar", "he", "mt"),
    "austronesian": ("id", "jv", "ms", "tl"),
}
# Labelled rows learnt from, for each language.
ROWS_PER_LANGUAGE = 400
# Two-byte features have a weight each, three-byte ones share as many by a hash.
HALF = 1 << 16
SCALE = 30.0
UNKNOWN = "und"

_ASCII_LETTER = re.compile(rb"[A-Za-z]")
# ASCII other than letters becomes a space.
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang.lower().split("-")[0] in members), f"={lang}")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode())))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all places of texts, two columns, and where each text starts.

    Texts are lower-cased in ASCII; two spaces before and after keep them apart.
    """
    plain = [b"  " + t.lower().translate(_PLAIN) + b"  " for t in texts]
    at = np.frombuffer(b"".join(plain), np.uint8).astype(np.uint32)
    # The two last places belong to no feature of their own.
    at = np.r_[at, np.uint32(32), np.uint32(32)]
    two = at[:-2] << 8 | at[1:-1]
    three = (two << 8 | at[2:]) * np.uint32(2654435761) >> 16
    starts = np.r_[0, np.cumsum([len(p) for p in plain])[:-1]]
    return np.stack([two, three + HALF], 1).astype(np.int64), starts


def linear_svm(rows: np.ndarray, features: np.ndarray, values: np.ndarray, sign: np.ndarray,
               steps: int = 120, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge), by full gradient steps with adaptive rates.

    Entry e says that row ``rows[e]`` has ``features[e]`` with ``values[e]``; both classes weigh the same.
    """
    used, column = np.unique(features, return_inverse=True)
    n = len(sign)
    share = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1))
    weight, bias = np.zeros(len(used)), 0.0
    mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        margin = sign * (np.bincount(rows, weight[column] * values, n) + bias)
        pull = -2 * share * sign * np.maximum(1 - margin, 0)
        gradient = np.r_[np.bincount(column, pull[rows] * values, len(used)) + decay * weight, pull.sum()]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        move = rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
    full = np.zeros(2 * HALF)
    full[used] = weight
    return full, bias


class LanguageModel:
    """Weights of all deciders side by side: one column a family, then one a pair of languages of one family."""

    def __init__(self, langs: list[str], entries: tuple[np.ndarray, np.ndarray, np.ndarray], of: np.ndarray):
        rows, features, values = entries
        self.families: dict[str, list[str]] = {}
        for lang in langs:
            self.families.setdefault(family_of(lang), []).append(lang)
        columns = []
        family = np.array([family_of(langs[k]) for k in of], object)
        for name in self.families:
            columns.append(linear_svm(rows, features, values, np.where(family == name, 1, -1)) if len(self.families) > 1
                           else (np.zeros(2 * HALF), 0.0))
        self.pairs = [pair for members in self.families.values() for pair in combinations(members, 2)]
        for a, b in self.pairs:
            mine = np.isin(of, [langs.index(a), langs.index(b)])
            number = np.cumsum(mine) - 1
            kept = mine[rows]
            columns.append(linear_svm(number[rows[kept]], features[kept], values[kept], np.where(of[mine] == langs.index(a), 1, -1)))
        self.weights = np.ascontiguousarray(np.stack([w for w, _ in columns], 1) * SCALE, dtype=np.float32)
        self.bias = np.array([b for _, b in columns])

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        at, starts = grams(texts)
        sums = np.zeros((len(texts), len(self.bias)))
        # A long text goes through in pieces, to bound what is held.
        sizes = np.diff(np.r_[starts, len(at)])
        owner = np.repeat(np.arange(len(texts)), sizes)
        for cut in range(0, len(at), 1 << 18):
            part = at[cut:cut + (1 << 18)]
            first, where = np.unique(owner[cut:cut + len(part)], return_index=True)
            sums[first] += np.add.reduceat(self.weights[part[:, 0]] + self.weights[part[:, 1]], where, axis=0, dtype=np.float64)
        margins = sums / sizes[:, None] + self.bias
        n = len(self.families)
        family = margins[:, :n]
        sure = np.exp(4 * (family - family.max(1, keepdims=True)))
        sure = sure.max(1) / sure.sum(1)
        duel = 1 / (1 + np.exp(-4 * np.clip(margins[:, n:], -50, 50)))
        out = []
        for k, best in enumerate(family.argmax(1)):
            members = list(self.families.values())[best]
            wins = {m: [] for m in members}
            for p, (a, b) in enumerate(self.pairs):
                if a in wins:
                    wins[a].append(duel[k, p])
                    wins[b].append(1 - duel[k, p])
            # Most duels won, then the larger sum, then the first by name.
            lang = max(members, key=lambda m: (sum(w > 0.5 for w in wins[m]), sum(wins[m])))
            out.append((lang, float(sure[k] * (np.mean(wins[lang]) if wins[lang] else 1.0))))
        return out


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of every language, chosen by the hash of the id; thinned out before anything is sorted."""
    range_of = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    counts = labelled.groupBy("lang").count().collect()
    share = F.lit(0)
    for lang, rows in counts:
        share = F.when(F.col("lang") == lang, min(int(2 * most / rows * (1 << 30)) + 1, 1 << 30)).otherwise(share)
    order = Window.partitionBy("lang").orderBy("at", "doc_id")
    return (labelled.withColumn("at", range_of).where(F.col("at") < share)
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= most))


def fit(docs: DataFrame, most: int = ROWS_PER_LANGUAGE) -> LanguageModel | None:
    """A model from rows ``(doc_id, text, lang)``, at most ``most`` a language; None without any.

    Executors turn the whole texts into counts; the driver gets these only.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = {"lang": [], "features": [], "values": []}
            for text, lang in zip(as_bytes(batch.column("text")), batch.column("lang").to_pylist()):
                if has_letter(text):
                    at, _ = grams([text])
                    features, n = np.unique(at, return_counts=True)
                    out["lang"].append(lang)
                    out["features"].append(features.astype("<i4").tobytes())
                    out["values"].append((n / len(at) * SCALE).astype("<f4").tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("lang", pa.string()), ("features", pa.binary()), ("values", pa.binary())]))

    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    found = _sample(usable, most).select("text", "lang").mapInArrow(rows, "lang string, features binary, values binary").toPandas()
    if found.empty:
        return None
    # The order of rows has no part in the result but for rounding; fix it all the same.
    found = found.sort_values(["lang", "features"]).reset_index(drop=True)
    langs = sorted(found["lang"].unique())
    features = [np.frombuffer(f, "<i4") for f in found["features"]]
    entries = (np.repeat(np.arange(len(features)), [len(f) for f in features]), np.concatenate(features).astype(np.int64),
               np.concatenate([np.frombuffer(v, "<f4") for v in found["values"]]).astype(float))
    return LanguageModel(langs, entries, found["lang"].map(langs.index).to_numpy())


def predict(docs: DataFrame, model: LanguageModel | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, lang_pred, score)`` for every row of ``docs(doc_id, text)``.

    A null text or one without a letter, and any text without a model, is
    ``und`` with score 0. Repeated rows stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = as_bytes(batch.column("text"))
            known = [k for k, t in enumerate(texts) if shared.value is not None and has_letter(t)]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for k, (name, sure) in zip(known, shared.value.predict([texts[k] for k in known]) if known else []):
                lang[k], score[k] = name, sure
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *keep)], pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], ["doc_id", *keep, "lang_pred", "score"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in ("doc_id", *keep))
    return docs.select("doc_id", *keep, "text").mapInArrow(rows, kept + "lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, most: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learns where crc32 of the id as text is not 0 modulo ``folds``, predicts everywhere.

    ``lang`` is read for learning only. A null doc_id is neither learnt from nor held out.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    model = fit(docs.where(fold != 0), most)
    return predict(docs.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out")), model, ("held_out",))
