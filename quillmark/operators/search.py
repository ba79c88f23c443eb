"""Ranked retrieval: BM25, dense similarity, their merge, boosts, modes, and the basic substring search.

A query is one lazy plan. Scores are ranked as rounded to six places, ties by section id.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import text as T
from quillmark.operators.index import Index, bm25_share, section_part

#: Queries of a batch that go to a task at once.
QUERY_BLOCK = 1024


def terms_of(query: str) -> list[str]:
    """Terms of one query, on the driver."""
    return [w for w in re.split(r"[^\w]+", query.lower()) if len(w) > 2 and w not in K.QUERY_STOP_WORDS]


def expand(terms: list[str]) -> list[str]:
    return list(dict.fromkeys([*terms, *(s for t in terms for s in K.SYNONYMS.get(t, []))]))


def basic_terms_of(query: str) -> list[str]:
    return [w for w in re.findall(r"\w+", query.lower()) if len(w) > 2 and w not in K.BASIC_STOP_WORDS]


def _scored(index: Index, terms: DataFrame | None, keys: list[str], only: list[str] | None = None, times: Column | None = None) -> DataFrame:
    """Sums of shares by keys and section, above zero only: of terms(keys..., term, times), or of the terms `only`, whose filter reaches the scan."""
    if index.impacts is not None:
        shares = index.impacts
    else:
        one = index.corpus_stats.select(F.col("n").alias("_n"), F.col("avg_dl").alias("_avg"))
        # The queries' terms come first: statistics and lengths meet only the postings that a query asks for.
        asked = (lambda df: df.filter(F.col("term").isin(only))) if only is not None else (lambda df: df.join(terms.select("term").distinct(), "term", "left_semi"))
        hits = asked(index.postings)
        joined = hits.join(asked(index.term_stats), "term").join(index.section_stats.select("section_id", "dl"), "section_id").join(F.broadcast(one))  # one row
        shares = joined.select("term", "section_id", bm25_share(F.col("tf"), F.col("df"), F.col("dl"), F.col("_n"), F.col("_avg")).alias("impact"))
    rows = shares.filter(F.col("term").isin(only)).withColumn("times", times) if terms is None else shares.join(terms, "term")
    return rows.groupBy(*keys, "section_id").agg(F.sum(F.col("times") * F.col("impact")).alias("score")).filter("score > 0")


def bm25(index: Index, terms: list[str]) -> DataFrame:
    """section_id and score for the terms of one query; a repeated term counts as often."""
    times = {t: terms.count(t) for t in dict.fromkeys(terms)}
    weight = F.create_map(*(F.lit(x) for pair in times.items() for x in pair))[F.col("term")] if times else F.lit(0)
    return _scored(index, None, [], list(times), weight)


def bm25_batch(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, section_id and score of queries(query_id, terms); the size of either side decides the join."""
    terms = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    return _scored(index, terms, ["query_id"])


def best(scored: DataFrame, most: int) -> DataFrame:
    return scored.orderBy(F.desc(F.round("score", 6)), "section_id").limit(most)


HEAD = ["title", "chars", "file_path"]
RESULT = ["section_id", "title", "content", "file_path", "score", "match_type"]


def _with_heads(index: Index, scored: DataFrame, match_type: str) -> DataFrame:
    return scored.join(index.section_stats.select("section_id", *HEAD), "section_id").withColumn("match_type", F.lit(match_type))


def keyword_search(index: Index, terms: list[str]) -> DataFrame:
    """Sections that score: section_id, score, title, chars, file_path, match_type. Contents are fetched for the results alone."""
    return _with_heads(index, bm25(index, terms), "keyword")


def with_content(index: Index, top: DataFrame) -> DataFrame:
    """A limited number of results as RESULT rows: the results are what is broadcast, and where sections are partitioned by hashed id, theirs alone are read."""
    text = ["title", "content", F.coalesce("file_path", F.lit("unknown")).alias("file_path")]
    own = top.select("section_id", "score", "match_type")
    if index.parts is None:
        return F.broadcast(own).join(index.sections.select("section_id", *text), "section_id").select(*RESULT)
    own = own.withColumn("part", section_part(index.parts))
    return F.broadcast(own).join(index.sections.select("part", "section_id", *text), ["part", "section_id"]).select(*RESULT)


def _products(batch: pa.RecordBatch, queries: np.ndarray, floor: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
    """Query, score and section of the pairs above the floor. Vectors of another length, and null ones, match nothing."""
    column = batch.column(1)
    sizes = np.diff(column.offsets.to_numpy()) if batch.num_rows else np.zeros(0)
    ok = np.flatnonzero((sizes == queries.shape[1]) & ~np.asarray(column.is_null()))
    if not len(ok):
        return None
    rows = column.take(pa.array(ok))
    matrix = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), queries.shape[1])
    scores = matrix @ queries.T
    row, query = np.nonzero(scores > floor)
    return query, scores[row, query], batch.column(0).take(pa.array(ok[row]))


PAIRS = "query_id string, section_id string, score double"


def _similarities(queries: np.ndarray, ids: list, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := _products(batch, queries, threshold):
                yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in found[0]], pa.string()), found[2], pa.array(found[1])], ["query_id", "section_id", "score"])

    return run


def _nearest(queries: np.ndarray, ids: list, threshold: float, most: int):
    """The best `most` of a task for each query, a few more where rounded scores tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)]
        floor = np.full(len(ids), threshold)

        def pruned() -> None:
            order = np.lexsort((-held[1], held[0]))
            query, score = held[0][order], held[1][order]
            first = np.searchsorted(query, np.arange(len(ids)))
            nth = np.arange(len(query)) - first[query]
            last = order[nth == most - 1]
            floor[held[0][last]] = np.maximum(floor[held[0][last]], held[1][last] - 2e-6)
            keep = held[1] > floor[held[0]]
            held[:] = [x[keep] for x in held]

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                if found := _products(batch.slice(at, 1024), queries, floor):
                    more = (found[0], found[1], np.array(found[2].to_pylist(), object))
                    held[:] = [np.concatenate([x, y]) for x, y in zip(held, more, strict=True)]
                if len(held[0]) > 4 * most * len(ids):
                    pruned()
        pruned()
        yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in held[0]], pa.string()), pa.array(held[2], pa.string()), pa.array(held[1], pa.float64())], ["query_id", "section_id", "score"])

    return run


def similar(vectors: DataFrame, queries: list[tuple[str, list[float]]], threshold: float = K.SEMANTIC_THRESHOLD) -> DataFrame:
    """query_id, section_id and dot product above the threshold, of every vector with every query. vectors: section_id, embedding.

    One scan of the vectors for each block of queries, which are few; a task multiplies Arrow batches with the block's matrix. Vectors of another length, and null ones, match nothing.
    """
    out = None
    for at in range(0, len(queries), QUERY_BLOCK):
        block = queries[at : at + QUERY_BLOCK]
        matrix = np.array([v for _, v in block], np.float64)
        part = vectors.select(F.col("section_id").cast("string"), "embedding").mapInArrow(_similarities(matrix, [q for q, _ in block], threshold), PAIRS)
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], PAIRS) if out is None else out


def nearest(vectors: DataFrame, queries: DataFrame, folder: str, most: int = K.MAX_RESULTS, threshold: float = K.SEMANTIC_THRESHOLD) -> DataFrame:
    """The best `most` vectors above the threshold of each query: query_id, section_id, score and rank; ties by section id. queries: query_id, embedding.

    Queries go in blocks of about QUERY_BLOCK, so that the driver and a task hold one block whatever their number: a task keeps the best of its vectors for each query of
    the block, and the ranks of what the tasks kept are one small shuffle. With several blocks each one's result is written below `folder`, which the executors share.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    each, out = vectors.select(F.col("section_id").cast("string"), "embedding"), None
    best_first = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "section_id")
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select(F.col("query_id").cast("string"), "embedding").filter("embedding IS NOT NULL").collect()
        if not own:
            continue
        matrix, ids = np.array([r.embedding for r in own], np.float64), [r.query_id for r in own]
        found = each.mapInArrow(_nearest(matrix, ids, threshold, most), PAIRS)
        part = found.withColumn("rank", F.row_number().over(best_first).cast("bigint")).filter(F.col("rank") <= most)
        if blocks > 1:
            path = f"{folder}/nearest-{uuid.uuid4().hex}"
            part.write.parquet(path)
            part = spark.read.parquet(path)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], PAIRS + ", rank bigint") if out is None else out


def semantic_search(index: Index, vectors: DataFrame, vector: list[float], threshold: float = K.SEMANTIC_THRESHOLD) -> DataFrame:
    """As keyword_search, by the best vector of each section."""
    return _with_heads(index, similar(vectors, [("", vector)], threshold).groupBy("section_id").agg(F.max("score").alias("score")), "semantic")


def merged(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Full outer merge: keyword scores doubled, averaged with the semantic score where both have the section."""
    side = lambda df, name: df.select("section_id", *(F.col(c).alias(f"{name}_{c}") for c in [*HEAD, "score"]))
    k, s = side(keyword, "k").withColumn("k_score", F.col("k_score") * K.KEYWORD_BOOST), side(semantic, "s")
    both = F.col("k_score").isNotNull() & F.col("s_score").isNotNull()
    return k.join(s, "section_id", "full_outer").select(
        "section_id", *(F.coalesce(f"k_{c}", f"s_{c}").alias(c) for c in HEAD),
        F.when(both, (F.col("k_score") + F.col("s_score")) / 2).otherwise(F.coalesce("k_score", "s_score")).alias("score"),
        F.when(both, "hybrid").when(F.col("k_score").isNotNull(), "keyword").otherwise("semantic").alias("match_type"),
    )


def boosted(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Scores raised for titles that hold a query term, and for short contents."""
    title = F.lower("title")
    named = F.lit(False)
    for t in dict.fromkeys(terms):
        named = named | title.contains(t)
    factor = F.when(named, K.TITLE_BOOST).otherwise(1.0) * F.when(F.col("chars") < K.SHORT_CHARS, K.SHORT_BOOST).otherwise(1.0)
    return rows.withColumn("score", F.col("score") * factor)


def hybrid_search(index: Index, query: str, vectors: DataFrame | None = None, vector: list[float] | None = None, most: int = K.MAX_RESULTS, threshold: float = K.SEMANTIC_THRESHOLD) -> DataFrame:
    """The whole query: terms, synonyms, both legs, merge, boosts, top results, their contents. A query without terms finds nothing."""
    terms = terms_of(query)
    keyword = keyword_search(index, expand(terms))
    if vectors is None or vector is None:
        rows = keyword.withColumn("score", F.col("score") * K.KEYWORD_BOOST)
    else:
        rows = merged(keyword, semantic_search(index, vectors, vector, threshold))
    if not terms:
        rows = rows.filter(F.lit(False))
    return with_content(index, best(boosted(rows, terms), most))


def search(index: Index, query: str, mode: str = "hybrid", vectors: DataFrame | None = None, vector: list[float] | None = None, most: int = K.MAX_RESULTS) -> DataFrame:
    """keyword: no synonyms and no boosts; semantic: the dense leg alone; hybrid: all."""
    if mode == "keyword":
        # Nothing but the score ranks here, so no other column is needed before the results are known.
        return with_content(index, best(bm25(index, terms_of(query)), most).withColumn("match_type", F.lit("keyword")))
    if mode == "semantic":
        rows = keyword_search(index, []) if vectors is None or vector is None else semantic_search(index, vectors, vector)
        return with_content(index, best(rows, most))
    return hybrid_search(index, query, vectors, vector, most)


def basic_search(sections: DataFrame, query: str, most: int = 10) -> DataFrame:
    """A tenth for each occurrence of a term in title and content, 1 at most."""
    low, terms = F.lower(F.concat_ws(" ", "title", "content")), basic_terms_of(query)
    total = F.lit(0)
    for t in terms:
        total = total + T.occurrences(low, F.lit(t))
    scored = sections.withColumn("score", F.least(F.lit(1.0), total * 0.1)).filter("score > 0")
    return best(scored, most).select("section_id", T.dotted_preview("content").alias("content"), "file_path", F.lit(1).alias("line_number"), "score", F.lit("basic").alias("match_type"))
