"""Building and opening a workspace's index: scan, parse, index, embed, pack, register.

Scanned files are written first, with their text, and parsed from there, so that the directory is read once; every further product is an independent write over
the parsed sections and symbols. Reads of the files table for metadata alone leave the text column out.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.operators import classify, context, embedding, global_search, index, parsing
from quillmark.operators.registry import Registry
from quillmark.settings import Settings
from quillmark.sources import files as sources

FOLDER = ".quillmark"


@dataclass
class Workspace:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def index(self) -> index.Index:
        return index.load(self.spark, f"{self.path}/index")

    def vectors(self, kind: str = "document") -> DataFrame | None:
        path = f"{self.path}/vectors"
        return embedding.load(self.spark, path, kind) if embedding.exists(self.spark, path) else None

    def create_views(self, prefix: str = "") -> list[str]:
        """Registers the index's tables as temporary views, for SQL."""
        names = {t: f"index/{t}" for t in index.TABLES} | {t: t for t in ("files", "sections", "symbols", "chunks", "summaries")}
        for view, path in names.items():
            self.table(path).createOrReplaceTempView(prefix + view)
        return [prefix + view for view in names]

    def exists(self) -> bool:
        return embedding.exists(self.spark, f"{self.path}/index/corpus_stats/_SUCCESS")


def _products(found: DataFrame, out: str, settings: Settings, factory) -> None:
    """Writes every table of an index from the scanned files."""
    spark = found.sparkSession
    found.write.mode("overwrite").parquet(f"{out}/files")
    eligible = spark.read.parquet(f"{out}/files").filter(F.col("file_type").isin("documents", "code")).select("path", "content")
    parsing.parsed_sections(eligible).write.mode("overwrite").parquet(f"{out}/sections")
    parsing.parsed_symbols(eligible).write.mode("overwrite").parquet(f"{out}/symbols")
    sections, symbols = spark.read.parquet(f"{out}/sections"), spark.read.parquet(f"{out}/symbols")
    index.write(index.build(sections), f"{out}/index")
    if settings.indexing.enable_embeddings:
        embedding.write(embedding.generate(sections, symbols, factory, settings.indexing.chunk_size, settings.indexing.chunk_overlap), f"{out}/vectors")
    # Groups are files, in order of lines, so that no group is larger than a file.
    grouped = sections.select(F.col("file_path").alias("grp"), F.col("start_line").alias("ord"), "section_id", "title", "content")
    for budget in K.CHUNK_BUDGETS:
        context.packed_chunks(grouped, budget).write.mode("overwrite").parquet(f"{out}/chunks/budget={budget}")
    index.summaries(sections).write.mode("overwrite").parquet(f"{out}/summaries")


def counts(workspace: Workspace) -> dict:
    """Totals of an index, from its tables."""
    files = workspace.table("files").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    vectors = embedding.load(workspace.spark, f"{workspace.path}/vectors").count() if embedding.exists(workspace.spark, f"{workspace.path}/vectors") else 0
    return {"file_count": files.n, "document_count": workspace.table("sections").count(), "code_symbol_count": workspace.table("symbols").count(), "embedding_count": vectors, "index_size_mb": files.b / 1048576}


def facts(workspace: Workspace, name: str) -> DataFrame:
    sections = workspace.table("sections")
    symbols = workspace.table("symbols").withColumn("section_id", F.concat_ws(":", "file_path", "line_number"))
    docs = index.top_keywords(symbols.filter("docstring IS NOT NULL").select("section_id", F.col("docstring").alias("content")).dropDuplicates(["section_id"]))
    return global_search.section_facts(sections, "", name, index.top_keywords(sections)).unionByName(global_search.symbol_facts(symbols.drop("section_id"), "", name, docs))


def build(spark: SparkSession, root: str, out: str | None = None, settings: Settings | None = None, registry: Registry | None = None, name: str | None = None, description: str = "", force: bool = False, factory=embedding.hashed_encoder) -> dict:
    """Indexes a directory; returns totals and the elapsed seconds. Nothing is written but the files table if no file is found."""
    began, settings = time.time(), settings or Settings()
    out = out or f"{root.rstrip('/')}/{FOLDER}"
    patterns = [*settings.indexing.ignored_patterns, f"{FOLDER}/"]
    found = sources.scan(spark, root, patterns, settings.indexing.max_file_size)
    key = None
    if registry is not None:
        listed = found.select(F.lit("").alias("root"), "path")
        kind = (classify.project_types(listed).first() or ["", "mixed"])[1]
        folders = spark.createDataFrame([(kind, [r[0] for r in listed.select(F.concat(F.element_at(F.split("path", "/"), 1), F.lit("/"))).filter(F.col("path").contains("/")).distinct().collect()])], "kind string, paths array<string>")
        tags = folders.select(classify.tags(F.col("kind"), F.col("paths"))).first()[0]
        key = registry.register(root, name or root.rstrip("/").rpartition("/")[2], description, kind, tags, force)
    if found.isEmpty():
        return {"file_count": 0, "workspace_id": key, "seconds": time.time() - began}
    _products(found, out, settings, factory)
    made = Workspace(spark, out)
    return _listed(made, registry, key, name or root.rstrip("/").rpartition("/")[2]) | {"workspace_id": key, "seconds": time.time() - began}


def _listed(made: Workspace, registry: Registry | None, key: str | None, name: str) -> dict:
    """The index's totals, which with the facts go to the registry."""
    totals = counts(made)
    if registry is not None and key is not None:
        registry.update_stats(key, **totals)
        registry.update_facts(key, facts(made, name))
    return totals


def update(spark: SparkSession, root: str, out: str | None = None, settings: Settings | None = None, registry: Registry | None = None, factory=embedding.hashed_encoder) -> dict:
    """Brings an index up to date: the numbers of changed and deleted files; tables are written anew, and the registry's row and facts with them, only if there are any.

    The settings and the encoder should be those of the build.
    """
    settings, out = settings or Settings(), out or f"{root.rstrip('/')}/{FOLDER}"
    found = sources.scan(spark, root, [*settings.indexing.ignored_patterns, f"{FOLDER}/"], settings.indexing.max_file_size)
    before = spark.read.parquet(f"{out}/files")
    seen = {"changed": sources.changed(found.select("path", "hash"), before).count(), "deleted": sources.deleted(found.select("path"), before).count()}
    if any(seen.values()):
        _products(found, out, settings, factory)
        row = registry.find(root) if registry is not None else None
        if row is not None:
            _listed(Workspace(spark, out), registry, row.id, row.name)
    return seen
