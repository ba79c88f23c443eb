"""Token counts from a digest cache (operator 5).

A text's key is the SHA-256 of its normalised content beside the SHA-256 of the tokenizer's file. Stored counts are joined
on that key; only distinct contents without one are encoded, and their counts are appended to the cache, a Parquet table. Digests alone are compared with the cache: where it has
them all, no text is shuffled. The query fills a cache of its own and joins its rows to the stored counts. Where a session has more shuffle partitions than
the texts are worth, partitions are put together, not cut, before files are written.

Misses keep one row for each digest in each scan task before they are shuffled by digest, compressed, so a text that a third of all
rows share crosses once from each task. The tokenizers library counts every text. Where the vocabulary file drops white space
before it splits, a text is the sum of its space-separated pieces, and a worker remembers the counts of pieces it has met
(the last PIECES or more of them); texts with special strings are encoded whole.

Normalised content: white-space runs as one space where the tokenizer does so itself, else the text as it is.

Defined cases: a null text counts as empty, with 0 bytes and the tokens of the empty text; repeated rows and texts each get the count
encoded once; texts of any length are counted whole; where two runs have appended counts of one digest, which are equal, one is taken; null ids and further columns do not
matter (a column of the result's name gives way to it); an empty table encodes nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._tables import bounded, documents, new_path, tasks_for, unused, written

LIMIT = 2048
PIECES = 200_000
TEXTS_AT_ONCE = 64
CACHE = "digest binary, version string, n_tokens bigint"
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts tokens with the library of a vocabulary file; made once in a worker."""

    def __init__(self, path: str):
        self.pieces: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.by_piece = False
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.by_piece = drops_space(path)
            self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        else:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def whole(self, texts: list[str]) -> list[int]:
        if hasattr(self, "model"):
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self.whole(texts)
        if len(self.pieces) > PIECES:
            self.pieces, self.older = {}, self.pieces
        known, older, parts = self.pieces, self.older, []
        for t in texts:
            parts.append([t] if any(s in t for s in self.special) else t.replace("\n", " ").split(" "))
        unmet = set().union(*parts).difference(known)
        known.update((p, older[p]) for p in unmet if p in older)
        new = list(unmet.difference(known))
        known.update(zip(new, self.whole(new), strict=True))
        sums = [sum(map(known.__getitem__, ps)) for ps in parts]
        for p in new:
            if len(p) > 64:
                del known[p]
        return sums


def drops_space(path: str) -> bool:
    """Whether a .json vocabulary makes white space one space and then splits it away, so that no token spans it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = lambda x, many: x.get(many, [x])
    one_space = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps(normal, "normalizers"))
    first = steps(split, "pretokenizers")[0]
    apart = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and "[^\\s" in (first.get("pattern") or {}).get("Regex", "")
    return one_space and apart


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def version_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of the task, its text compressed."""
    import zstandard

    seen, squeeze = set(), zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        digests = batch.column(0).to_pylist()
        new = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
        texts = batch.column(1).take(pa.array(new, pa.int64())).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in new], pa.binary()), pa.array([squeeze(t) for t in texts], pa.binary())], ["digest", "packed"])


def _encoder(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        seen, unpack, count = set(), zstandard.ZstdDecompressor().decompress, counter(path).count
        for batch in batches:
            digests, packed = batch.column(0).to_pylist(), batch.column(1)
            new = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
            counts: list[int] = []
            for i in range(0, len(new), TEXTS_AT_ONCE):
                counts += count([unpack(packed[k].as_py()).decode() for k in new[i : i + TEXTS_AT_ONCE]])
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in new], pa.binary()), pa.array([version] * len(new), pa.string()), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    return run


def digest(text, path: str):
    """The content key of a text column."""
    filled = F.coalesce(text, F.lit(""))
    normal = F.regexp_replace(filled, "[ \\n]+", " ") if path.endswith(".json") and drops_space(path) else filled
    return F.unhex(F.sha2(normal.cast("binary"), 256))


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Counts of the cache for a tokenizer's version; None before the cache's first use."""
    try:
        return spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def fill(docs: DataFrame, path: str, cache: str, text: str = "text") -> None:
    """Encodes the distinct contents whose digests the cache lacks and appends their counts. Texts are shuffled only if there are some to encode."""
    spark, version = docs.sparkSession, version_of(path)
    keyed = docs.select(digest(F.col(f"`{text}`"), path).alias("digest"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    known, firsts = _stored(spark, cache, version), keyed.mapInArrow(_first_of_each, "digest binary, packed binary")
    if known is None:
        each = firsts.repartition("digest")
    else:
        both = keyed.select("digest", F.lit(0).alias("stored")).union(known.select("digest", F.lit(1)))
        misses = written(both.groupBy("digest").agg(F.max("stored").alias("stored")).filter("stored = 0").select("digest"), "token-misses")
        if misses.isEmpty():
            return
        each = firsts.join(misses.withColumnRenamed("digest", "_digest").hint("merge"), F.col("digest") == F.col("_digest")).select("digest", "packed")
    bounded(spark)
    each.mapInArrow(_encoder(path, version), CACHE).coalesce(tasks_for(docs)).write.mode("append").parquet(cache)


def counted(docs: DataFrame, keep: list[str], path: str, cache: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Columns `keep` of every row and its token count; counts that the cache at `cache` lacks are appended to it first."""
    spark, version, key = docs.sparkSession, version_of(path), unused(docs, "_digest")
    fill(docs, path, cache, text)
    counts = _stored(spark, cache, version).groupBy(F.col("digest").alias(key)).agg(F.max("n_tokens").alias(into))
    counts = written(counts.coalesce(tasks_for(docs)), "token-counts")  # a plain shuffle on both sides of the join, which adaptive execution can split
    rows = docs.select(*(F.col(f"`{c}`") for c in keep if c != into), digest(F.col(f"`{text}`"), path).alias(key))
    return rows.join(counts, key, "left").drop(key).coalesce(tasks_for(docs))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    cache = new_path(spark, "token-cache")
    rows = counted(sized, ["doc_id", "n_bytes"], vocabulary_path(), cache)
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
