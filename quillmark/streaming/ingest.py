"""Structured Streaming: continuous indexing of arriving sections, and windowed statistics of the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import index


def read_sections(spark: SparkSession, folder: str, schema, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def index_stream(sections: DataFrame, out: str, checkpoint: str):
    """Starts a query that appends each micro-batch's postings and lengths below `out`, once each: a batch has its own partition, which a retry overwrites.

    Document frequencies and totals are sums over the batches' partitions, so nothing that grows is kept as state. Sections must arrive once; later versions need a build.
    """

    def add(batch: DataFrame, number: int) -> None:
        built = index.build(batch)
        for name in ("postings", "section_stats"):
            getattr(built, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.write.mode("overwrite").parquet(f"{out}/sections/batch={number}")

    return sections.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_index(spark: SparkSession, out: str) -> index.Index:
    """The index of all batches so far, its statistics summed from them."""
    postings, lengths = (spark.read.parquet(f"{out}/{name}").drop("batch") for name in ("postings", "section_stats"))
    terms = postings.filter(F.length("term") > 2).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return index.Index(postings, terms, lengths, lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_dl")), spark.read.parquet(f"{out}/sections").drop("batch"))


def query_log_windows(log: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests and mean latency by outcome and tumbling window of log(ts, outcome, seconds); rows later than the watermark are dropped."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "outcome").agg(F.count(F.lit(1)).alias("queries"), F.avg("seconds").alias("mean_seconds")).select(F.col("w.start").alias("window_start"), "outcome", "queries", "mean_seconds")
