"""Inverted index and its statistics as plain tables.

postings(term, section_id, tf) with terms of any length, term_stats(term, df) with terms of three characters or more,
section_stats(section_id, dl, title, chars, file_path) and corpus_stats(n, avg_dl). Term counts combine map-side before they are shuffled by (term, section).

A written index also holds impacts(term, section_id, impact), each posting's whole BM25 share, so that a query over it joins no statistics; and its
sections are partitioned by hashed id, so that fetching the contents of a few results reads their partitions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import text as T
from quillmark.shared import planned_bytes

#: Bytes of a stored file, about; partitions of the sections at most; sections of a term in one file.
PART_BYTES = 128 << 20
MOST_PARTS = 1 << 14
HOT_SECTIONS = 1 << 22
TABLES = ("postings", "term_stats", "section_stats", "corpus_stats", "impacts")


@dataclass
class Index:
    postings: DataFrame
    term_stats: DataFrame
    section_stats: DataFrame
    corpus_stats: DataFrame
    sections: DataFrame
    impacts: DataFrame | None = None
    #: Of the written sections, by hashed id.
    parts: int | None = None


def tokenized(sections: DataFrame) -> DataFrame:
    """section_id and tokens of each section."""
    return sections.select("section_id", T.index_tokens("title", "content").alias("tokens"))


def build(sections: DataFrame) -> Index:
    """The index of sections(section_id, title, content, file_path, ...), not written yet."""
    # The outer form, since a plain explode makes the optimizer add a filter that tokenises every text once more.
    words = tokenized(sections).select("section_id", F.explode_outer("tokens").alias("term")).filter("term IS NOT NULL")
    postings = words.groupBy("term", "section_id").agg(F.count(F.lit(1)).alias("tf"))
    term_stats = postings.filter(F.length("term") > 2).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = F.size(T.index_tokens("title", "content")).cast("bigint")
    section_stats = sections.select("section_id", size.alias("dl"), "title", F.length("content").alias("chars"), F.coalesce("file_path", F.lit("unknown")).alias("file_path"))
    corpus_stats = section_stats.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"))
    return Index(postings, term_stats, section_stats, corpus_stats, sections)


def bm25_share(tf: Column, df: Column, dl: Column, n: Column, avg_dl: Column) -> Column:
    """What one term adds to a section's score; negative for terms of over half the sections."""
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    return idf * (tf * (K.BM25_K1 + 1)) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl / avg_dl))


def impacts(index: Index, *more: str) -> DataFrame:
    one = index.corpus_stats.select(F.col("n").alias("_n"), F.col("avg_dl").alias("_avg"))
    joined = index.postings.join(index.term_stats, "term").join(index.section_stats.select("section_id", "dl"), "section_id").join(F.broadcast(one))  # one row
    return joined.select("term", "section_id", bm25_share(F.col("tf"), F.col("df"), F.col("dl"), F.col("_n"), F.col("_avg")).alias("impact"), *more)


def section_part(parts: int) -> Column:
    return F.pmod(F.hash("section_id"), F.lit(parts))


def write(index: Index, path: str, buckets: int | None = None, parts: int | None = None) -> None:
    """Writes the tables below `path`; impacts are dealt by hashed term, sorted, so that a query's terms prune row groups. Statistics come from the written postings.

    The numbers of files follow the sizes unless they are given. A term of over HOT_SECTIONS sections is dealt to as many files as it fills, by hashed section.
    """
    spark, stored = index.postings.sparkSession, lambda name: spark.read.parquet(f"{path}/{name}")

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return stored(name)

    # Dealt by term and section already: sorted where they are, without another shuffle.
    postings = put("postings", index.postings.sortWithinPartitions("term"))
    terms = put("term_stats", postings.filter(F.length("term") > 2).groupBy("term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("term"))
    lengths = put("section_stats", index.section_stats)
    parts = parts or min(MOST_PARTS, max(16, planned_bytes(index.sections) // PART_BYTES))
    totals = put("corpus_stats", lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl"), F.lit(parts).alias("parts")))
    shares = impacts(Index(postings, terms, lengths, totals, index.sections), "df")
    buckets = buckets or max(16, planned_bytes(postings) // PART_BYTES)
    spread = shares.withColumn("_salt", F.pmod(F.hash("section_id"), F.ceil(F.col("df") / HOT_SECTIONS).cast("int"))).repartition(buckets, "term", "_salt")
    put("impacts", spread.sortWithinPartitions("term").select("term", "section_id", "impact"))
    index.sections.withColumn("part", section_part(parts)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/sections")


def load(spark: SparkSession, path: str) -> Index:
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in (*TABLES, "sections")}
    return Index(**tables, parts=tables["corpus_stats"].first()["parts"])


def section_metadata(sections: DataFrame) -> DataFrame:
    """One row of metadata for each parsed section."""
    return sections.select(
        "section_id", "title", "level", "file_path", F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end")).alias("line_range"), "parent_id", "children",
        F.length("content").cast("bigint").alias("content_length"), T.word_count("content").alias("word_count"),
    )


def summaries(sections: DataFrame) -> DataFrame:
    return sections.select("section_id", "title", "file_path", T.preview("content").alias("content_preview"), T.word_count("content").alias("word_count"))


def top_keywords(texts: DataFrame, key: str = "section_id", text: str = "content", most: int = 10) -> DataFrame:
    """key and the array of its most frequent keywords, ties by first occurrence; every key has a row."""
    from pyspark.sql import Window

    tokens = texts.select(key, F.posexplode_outer(T.words(text)).alias("at", "word")).filter(F.col("word").rlike("^[a-z]{3,}$") & ~F.col("word").isin(K.KEYWORD_STOP_WORDS))
    counts = tokens.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "at"))).filter(F.col("rank") <= most)
    lists = ranked.groupBy(F.col(key).alias("_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    return texts.select(key).join(lists, F.col(key) == F.col("_key"), "left").select(key, F.coalesce("keywords", T.strings([])).alias("keywords"))
