"""Embeddings of sections and symbols with a pluggable encoder, their storage and statistics.

chunks(kind, section_id, chunk_id, chunk) become embeddings(kind, section_id, chunk_id, embedding, content_md5): ids travel with their vectors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillmark.functions import constants as K
from quillmark.operators import context
from quillmark.operators.global_search import symbol_text

#: Makes an encoder in a worker: texts to a matrix of unit rows.
EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]
DIMENSION = 64


def hashed_encoder(dimension: int = DIMENSION) -> Callable[[list[str]], np.ndarray]:
    """Deterministic bags of hashed words, for use without a model."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dimension] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def _sentence_transformer(name: str):
    """A sentence-transformers model, if that package is there."""
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name)


class ModelEncoder:
    """A model's encoder: unit rows in batches, and the dimension, which one text tells. `load` makes a model with encode(texts, batch_size=...) from its name."""

    def __init__(self, name: str = "all-MiniLM-L6-v2", batch: int = 32, load=_sentence_transformer):
        self.model, self.batch = load(name), batch
        self.dimension = len(self(["dimension"])[0])

    def __call__(self, texts: list[str], normalize: bool = True) -> np.ndarray:
        made = np.asarray(self.model.encode(texts, batch_size=self.batch), np.float32)
        return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12) if normalize and len(made) else made

    def one(self, text: str) -> np.ndarray:
        return self([text])[0]


def model_encoder(name: str = "all-MiniLM-L6-v2", batch: int = 32) -> ModelEncoder:
    return ModelEncoder(name, batch)


def encoded(chunks: DataFrame, factory: EncoderFactory = hashed_encoder) -> DataFrame:
    """Adds embedding and content_md5; the encoder is made once for each task and sees Arrow batches."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for texts in batches:
            yield pd.Series(list(np.asarray(encode(texts.fillna("").tolist()), np.float32)) if len(texts) else [])

    return chunks.withColumn("embedding", embed("chunk")).withColumn("content_md5", F.md5("chunk")).drop("chunk")


def section_chunks(sections: DataFrame, most: int = K.SENTENCE_CHARS, overlap: int = K.OVERLAP_CHARS) -> DataFrame:
    texts = sections.select("section_id", F.concat_ws("\n\n", "title", "content").alias("text"))
    return context.sentence_chunks(texts, most, overlap).withColumn("kind", F.lit("document"))


def symbol_chunks(symbols: DataFrame) -> DataFrame:
    """One chunk for each symbol, named by path and name."""
    key = F.concat_ws(":", "file_path", "name")
    return symbols.select(key.alias("section_id"), key.alias("chunk_id"), symbol_text().alias("chunk"), F.lit("code").alias("kind"))


def generate(sections: DataFrame, symbols: DataFrame, factory: EncoderFactory = hashed_encoder, most: int = K.SENTENCE_CHARS, overlap: int = K.OVERLAP_CHARS) -> DataFrame:
    return encoded(section_chunks(sections, most, overlap).unionByName(symbol_chunks(symbols)), factory)


def write(embeddings: DataFrame, path: str) -> None:
    embeddings.write.mode("overwrite").partitionBy("kind").parquet(path)


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if kind is None else rows.filter(F.col("kind") == kind)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def stats(embeddings: DataFrame) -> DataFrame:
    """kind, number of vectors and their dimension."""
    return embeddings.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.max(F.size("embedding")).cast("bigint").alias("dimension"))


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the kept versions below a folder, oldest first."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(target) if s.getPath().getName().startswith("v")) if fs.exists(target) else []


def write_version(embeddings: DataFrame, folder: str, keep: int = K.EMBEDDINGS_KEPT) -> str:
    """Writes a new version and drops all but the newest `keep`; returns its path."""
    spark, old = embeddings.sparkSession, versions(embeddings.sparkSession, folder)
    path = f"{folder}/v{int(old[-1].rpartition('/v')[2]) + 1 if old else 0:09d}"
    write(embeddings, path)
    for gone in versions(spark, folder)[:-keep]:
        target = spark._jvm.org.apache.hadoop.fs.Path(gone)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return path
