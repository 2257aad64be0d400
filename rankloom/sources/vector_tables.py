"""Vector files and the cache of encoded corpora."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import encode_dense
from ..plans.staging import is_small, staged


def write_vectors(vectors: DataFrame, path: str, fmt: str = "json") -> None:
    """``{id, vector}`` records as JSON lines, or parquet for anything large."""
    vectors.select(F.col("doc_id").alias("id"), "vector").write.format(fmt).save(path)


def read_vectors(spark: SparkSession, path: str, fmt: str = "json", id_type: str = "string") -> DataFrame:
    rows = spark.read.format(fmt).schema(f"id {id_type}, vector array<float>").load(path)
    return rows.select(F.col("id").alias("doc_id"), "vector")


@dataclass(frozen=True)
class EmbeddingCache:
    """A parquet table of vectors by encoder and content: every distinct text is encoded once, whatever dataset it is in.

    A text is known by two 64-bit hashes of it. Only distinct texts that are
    not stored yet are encoded; their vectors are appended and joined back with
    all documents that have the text. A changed text or another encoder never
    reads an old vector. One writer per encoder at a time.
    """

    path: str

    def _stored(self, spark: SparkSession, encoder_id: str) -> DataFrame:
        schema, folder = "h1 long, h2 long, vector array<float>", f"{self.path}/encoder_id={encoder_id}"
        # Without rows, and only where there is nothing yet.
        spark.createDataFrame([], schema).write.mode("ignore").parquet(folder)
        return spark.read.schema(schema).parquet(folder)

    def vectors(self, texts: DataFrame, encoder, encoder_id: str) -> DataFrame:
        """``texts(doc_id, text)`` to ``(doc_id, vector)``, encoding only what is new."""
        spark, keys = texts.sparkSession, ["h1", "h2"]
        body = F.coalesce("text", F.lit(""))
        hashed = texts.select("doc_id", F.xxhash64(body).alias("h1"), F.xxhash64(F.lit("second"), body).alias("h2"), body.alias("text"))
        stored = self._stored(spark, encoder_id)
        new = hashed.select(*keys, "text")
        if not stored.isEmpty():
            # Only keys are compared; texts move only if most of them are new.
            unknown = staged(hashed.select(keys).distinct().join(stored.select(keys), keys, "left_anti"), "unknown")
            new = None if unknown.isEmpty() else new.join(F.broadcast(unknown) if is_small(unknown) else unknown, keys, "left_semi")
        if new is not None:
            encode_dense(new.dropDuplicates(keys), encoder).write.mode("append").parquet(f"{self.path}/encoder_id={encoder_id}")
        return hashed.select("doc_id", *keys).join(self._stored(spark, encoder_id), keys).select("doc_id", "vector")
