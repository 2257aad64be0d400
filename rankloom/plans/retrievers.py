"""Retrieval methods behind one contract.

``method.fit(corpus)`` returns a fitted model; ``model.search(queries, k)``
returns the run as a lazy DataFrame. A method that is not fitted has no
``search``. ``corpus(doc_id, [title], text)``, ``queries(qid, text)``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoders import HashedTermEncoder, LogCountEncoder
from ..functions.text import Analyzer, contents, words
from ..operators import ivf, lexical
from ..operators.encode import encode_dense, encode_sparse
from ..operators.impact import ImpactIndex, impact_topk, quantize_impacts
from ..operators.quantize import Int8Codec, PqCodec, coded_search
from ..sources.vector_tables import EmbeddingCache
from .staging import spread, staged


class Model(Protocol):
    encode_seconds: float
    index_seconds: float

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class Method(Protocol):
    def fit(self, corpus: DataFrame, dataset: str = "corpus") -> Model: ...


def indexed_text(corpus: DataFrame) -> DataFrame:
    """``(doc_id, text)``: title and text joined where there is a title column."""
    body = contents() if "title" in corpus.columns else F.coalesce("text", F.lit(""))
    return corpus.select("doc_id", body.alias("text"))


@dataclass(frozen=True)
class Fitted:
    run: Callable[[DataFrame, int], DataFrame] = field(repr=False)
    index_seconds: float
    encode_seconds: float = 0.0

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.run(queries, k)


@dataclass(frozen=True)
class Bm25:
    k1: float = lexical.K1
    b: float = lexical.B
    analyzer: Analyzer = words
    shards: int | None = None
    path: str | None = None
    stemmer: Callable[[str], str] | None = None

    def fit(self, corpus: DataFrame, dataset: str = "corpus") -> Fitted:
        start = time.perf_counter()
        index = lexical.LexicalIndex.build(indexed_text(corpus), self.path, self.analyzer, self.shards, self.stemmer)
        return Fitted(
            lambda queries, k: lexical.bm25_topk(index, queries, k, k1=self.k1, b=self.b, analyzer=self.analyzer),
            time.perf_counter() - start)


@dataclass(frozen=True)
class LearnedImpact:
    """Sparse learned weights. With ``impacts_path`` a ready-made table is opened,
    otherwise the corpus is encoded by ``encoder``, which also serves queries.

    ``impacts_path`` is one path, or a mapping or function from the name of a
    dataset to its path; ids in the table are of the type they have in the corpus.
    """

    encoder: Callable = field(default_factory=LogCountEncoder)
    scale: float = 100.0
    impacts_path: str | Mapping[str, str] | Callable[[str], str] | None = None
    shards: int | None = None

    def _path(self, dataset: str) -> str:
        if isinstance(self.impacts_path, Mapping):
            return self.impacts_path[dataset]
        return self.impacts_path(dataset) if callable(self.impacts_path) else self.impacts_path

    def _impacts(self, texts: DataFrame, key: str) -> DataFrame:
        return quantize_impacts(encode_sparse(texts, self.encoder, key), self.scale)

    def fit(self, corpus: DataFrame, dataset: str = "corpus") -> Fitted:
        start = time.perf_counter()
        encode_seconds = 0.0
        if self.impacts_path:
            index = ImpactIndex.load(corpus.sparkSession, self._path(dataset), corpus.schema["doc_id"].dataType.simpleString())
        else:
            texts = spread(indexed_text(corpus), "doc_id", self.shards)
            impacts = staged(self._impacts(texts, "doc_id"), "impacts")
            encode_seconds = time.perf_counter() - start
            start = time.perf_counter()
            index = ImpactIndex.build(impacts, shards=self.shards)
        return Fitted(lambda queries, k: impact_topk(index, staged(self._impacts(queries, "qid"), "query-impacts"), k),
                      time.perf_counter() - start, encode_seconds)


@dataclass(frozen=True)
class _Dense:
    encoder: Callable = field(default_factory=HashedTermEncoder)
    compression: str | None = None
    cache: EmbeddingCache | None = None
    shards: int | None = None
    # Tables of vectors already stored, shared by the methods of one experiment; None for none.
    tables: dict | None = field(default=None, repr=False, compare=False)

    def _once(self, kind: str, name: str, table: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
        """A stored table, made once for one DataFrame object by all methods that share ``tables``.

        Not for equal plans: files may have changed between two reads of a path.
        """
        if self.tables is None:
            return staged(make(), kind)
        key = (kind, name, self.encoder.encoder_id, id(table))
        if key not in self.tables:
            # The object is held as well, so that no other one gets its id.
            self.tables[key] = table, staged(make(), kind)
        return self.tables[key][1]

    def _encoded(self, corpus: DataFrame, dataset: str) -> DataFrame:
        """Vectors as a stored table in enough parts for every core."""
        texts = spread(indexed_text(corpus), "doc_id", self.shards)
        if self.cache is not None:
            return self._once("vectors", dataset, corpus, lambda: self.cache.vectors(texts, self.encoder, self.encoder.encoder_id))
        return self._once("vectors", dataset, corpus, lambda: encode_dense(texts, self.encoder))

    def _queries(self, queries: DataFrame) -> DataFrame:
        """Stored, so that measuring them does not run the model again."""
        return self._once("query-vectors", "", queries, lambda: encode_dense(queries.select("qid", "text"), self.encoder))

    def _codec(self, vectors: DataFrame):
        if self.compression not in (None, "int8", "pq"):
            raise ValueError(f"compression must be None, 'int8' or 'pq', not {self.compression!r}")
        return {None: lambda: None, "int8": lambda: Int8Codec.fit(vectors),
                "pq": lambda: PqCodec.fit(vectors)}[self.compression]()


@dataclass(frozen=True)
class Flat(_Dense):
    """Exact search; with ``compression`` exact over int8 or PQ codes."""

    def fit(self, corpus: DataFrame, dataset: str = "corpus") -> Fitted:
        start = time.perf_counter()
        vectors = self._encoded(corpus, dataset)
        encoded = time.perf_counter()
        codec = self._codec(vectors)
        rows = vectors if codec is None else staged(codec.encode(vectors), "codes")
        return Fitted(lambda queries, k: coded_search(self._queries(queries), rows, k, codec),
                      time.perf_counter() - encoded, encoded - start)


@dataclass(frozen=True)
class Cells(_Dense):
    """Approximate search by cell probing; ``trial`` picks another set of seeds.

    Build effort and search effort are by the size of the corpus unless given.
    """

    nlist: int | None = None
    nprobe: int | None = None
    rounds: int = ivf.ROUNDS
    trial: int = 0

    def fit(self, corpus: DataFrame, dataset: str = "corpus") -> Fitted:
        start = time.perf_counter()
        vectors = self._encoded(corpus, dataset)
        encoded = time.perf_counter()
        index = ivf.CellIndex.build(vectors, self.nlist, self.rounds, self.trial, self._codec(vectors))
        return Fitted(lambda queries, k: index.search(self._queries(queries), k, self.nprobe),
                      time.perf_counter() - encoded, encoded - start)


class Registry(dict):
    """Factories of methods by name, as users of the experiments know them.

    A factory makes a fresh object for every trial. Those of ``scoped()`` belong
    to one experiment and encode each of its tables once between them; nothing
    outlives it.
    """

    def __init__(self, make: Callable[[dict | None], dict[str, Callable[[int], Method]]]):
        super().__init__(make(None))
        self._make = make

    def scoped(self) -> dict[str, Callable[[int], Method]]:
        return self._make({})


def registry(cache: EmbeddingCache | None = None, compression: str = "int8", encoder: Callable | None = None,
             impact_encoder: Callable | None = None, impacts_path: str | Mapping[str, str] | Callable[[str], str] | None = None, nlist: int | None = None,
             nprobe: int | None = None, rounds: int = ivf.ROUNDS) -> Registry:
    """All methods. With a ``cache`` texts are encoded once for all time.

    ``compression`` ("int8" or "pq") is that of the quantised methods;
    ``nprobe`` is the search effort and ``nlist`` and ``rounds`` the build
    effort of the approximate ones.
    """
    def make(tables: dict | None) -> dict[str, Callable[[int], Method]]:
        vectors = {"encoder": encoder or HashedTermEncoder(), "cache": cache, "tables": tables}
        cells = {**vectors, "nlist": nlist, "nprobe": nprobe, "rounds": rounds}
        return {
            "bm25": lambda trial: Bm25(),
            "splade": lambda trial: LearnedImpact(impact_encoder or LogCountEncoder(), impacts_path=impacts_path),
            "flat": lambda trial: Flat(**vectors),
            "flat_quantized": lambda trial: Flat(**vectors, compression=compression),
            "hnsw": lambda trial: Cells(**cells, trial=trial),
            "hnsw_quantized": lambda trial: Cells(**cells, trial=trial, compression=compression),
        }

    return Registry(make)


METHODS = registry()
