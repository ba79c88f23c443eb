"""Directory scans, change detection and the tables of an indexed workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import text as T
from quillmark.operators import classify


# The characters that Windows-1252 has where ISO-8859-1 has control characters.
WINDOWS_1252 = {
    0x80: "\u20ac", 0x82: "\u201a", 0x83: "\u0192", 0x84: "\u201e", 0x85: "\u2026", 0x86: "\u2020", 0x87: "\u2021", 0x88: "\u02c6", 0x89: "\u2030", 0x8A: "\u0160", 0x8B: "\u2039", 0x8C: "\u0152",
    0x8E: "\u017d", 0x91: "\u2018", 0x92: "\u2019", 0x93: "\u201c", 0x94: "\u201d", 0x95: "\u2022", 0x96: "\u2013", 0x97: "\u2014", 0x98: "\u02dc", 0x99: "\u2122", 0x9A: "\u0161", 0x9B: "\u203a",
    0x9C: "\u0153", 0x9E: "\u017e", 0x9F: "\u0178",
}


def decoded(content: Column | str) -> tuple[Column, Column]:
    """(text, encoding): UTF-8 if the bytes are, Windows-1252 if they hold its characters and none that it lacks, else ISO-8859-1; line ends as newlines."""
    raw = T._col(content)
    latin = F.decode(raw, "ISO-8859-1")
    only_windows = latin.rlike("[\x80-\x9f]") & ~latin.rlike("[\x81\x8d\x8f\x90\x9d]")
    encoding = F.when(F.is_valid_utf8(raw.cast("string")), "utf-8").when(only_windows, "cp1252").otherwise("latin-1")
    windows = F.translate(latin, "".join(map(chr, WINDOWS_1252)), "".join(WINDOWS_1252.values()))
    text = F.when(encoding == "utf-8", F.decode(raw, "UTF-8")).when(encoding == "cp1252", windows).otherwise(latin)
    return F.regexp_replace(text, "\r\n?", "\n"), encoding


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, most_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """path (relative), size, modified, file_type, hash, language, encoding and content of every file that is not ignored.

    Size and name are tested before content is read into an expression; the size limit is pushed into the scan. Files that cannot be read, or that go while the scan runs, count as ignored.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root).filter(F.col("length") <= most_bytes)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^file:/*", "/")
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    relative = F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(F.col("path"))
    rows = raw.withColumn("_path", relative).filter(~classify.ignored("_path", "length", patterns, most_bytes))
    text, encoding = decoded("content")
    return rows.select(
        F.col("_path").alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("modified"), classify.file_type("_path").alias("file_type"),
        F.sha2("content", 256).alias("hash"), F.lit(None).cast("string").alias("language"), encoding.alias("encoding"), text.alias("content"),
    )


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or have another hash."""
    return now.join(before.select("path", "hash"), ["path", "hash"], "left_anti")


def deleted(now: DataFrame, before: DataFrame) -> DataFrame:
    return before.join(now.select("path"), "path", "left_anti")


def type_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count(F.lit(1)).alias("files"))
