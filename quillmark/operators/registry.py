"""Registry of workspaces as tables: workspaces, relationship edges and the flattened search facts.

A mutation writes a new snapshot folder and then moves the name of the current one, after keeping the older snapshots that retention allows.
Facts are partitioned by workspace, and replacing a workspace's rows overwrites its partition alone. One writer at a time is assumed.
"""

from __future__ import annotations

import hashlib
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import text as T

WORKSPACES = (
    "id string, name string, description string, path string, created_at string, updated_at string, version string, project_type string, file_count bigint, document_count bigint, "
    "code_symbol_count bigint, embedding_count bigint, tags array<string>, status string, last_indexed string, index_size_mb double, health_score double"
)
EDGES = "src string, dst string, rel_type string"
FACTS = "workspace_name string, section_id string, title string, content_preview string, file_path string, section_type string, keywords array<string>, workspace_id string"


def stats(workspaces: DataFrame) -> DataFrame:
    """One row of totals; the mean health is of active workspaces, 1 if there is none."""
    active = F.col("status") == "active"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    sums = workspaces.agg(
        F.count(F.lit(1)).alias("total_workspaces"), F.count_if(active).alias("active_workspaces"), total("document_count"), total("code_symbol_count"), total("embedding_count"),
        F.coalesce(F.sum("index_size_mb"), F.lit(0.0)).alias("total_size_mb"), F.coalesce(F.avg(F.when(active, F.col("health_score"))), F.lit(1.0)).alias("mean_health"),
    )
    return sums.withColumn("health_status", T.health_label("mean_health"))


def stale(workspaces: DataFrame, now: datetime, days: int = K.CLEANUP_DAYS) -> DataFrame:
    """Inactive workspaces not updated for so many days; times that cannot be read are passed over."""
    cutoff = F.lit((now - timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    return workspaces.filter((F.col("status") == "inactive") & (F.try_to_timestamp("updated_at") < cutoff))


def replaced(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows without those whose key is in `new`, and the new ones."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def newest(rows: DataFrame, by: str, keep: int, per: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """The newest rows (of each `per` group), ties by another column."""
    order = Window.partitionBy(*(per or [F.lit(0)])).orderBy(F.desc(by), *([tie] if tie else []))
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


def related(edges: DataFrame, workspaces: DataFrame) -> DataFrame:
    """src, dst, its name and the types of the links between them."""
    names = workspaces.select(F.col("id").alias("dst"), "name")
    links = edges.groupBy("src", "dst").agg(F.sort_array(F.collect_set("rel_type")).alias("types"))
    return links.join(names, "dst", "left").select("src", "dst", F.coalesce("name", F.lit("Unknown")).alias("name"), "types")


def workspace_id_of(path: str, seconds: float) -> str:
    return f"ws_{hashlib.md5(path.encode()).hexdigest()[:8]}_{str(int(seconds))[-6:]}"


class Registry:
    """Named snapshots below a folder that Spark can reach; the driver holds no rows but those of a mutation."""

    def __init__(self, spark: SparkSession, folder: str, max_workspaces: int = K.MAX_WORKSPACES, backups: int = K.BACKUPS):
        self.spark, self.folder, self.max_workspaces, self.backups = spark, folder.rstrip("/"), max_workspaces, backups

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _snapshots(self, table: str) -> list[str]:
        fs, folder = self._fs(f"{self.folder}/{table}")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v")) if fs.exists(folder) else []

    def _read(self, table: str, kind: str) -> DataFrame:
        """The newest complete snapshot; an absent registry is empty."""
        for name in reversed(self._snapshots(table)):
            fs, done = self._fs(f"{self.folder}/{table}/{name}/_SUCCESS")
            if fs.exists(done):
                return self.spark.read.schema(kind).parquet(f"{self.folder}/{table}/{name}")
        return self.spark.createDataFrame([], kind)

    def _write(self, table: str, rows: DataFrame) -> None:
        last = self._snapshots(table)
        number = int(last[-1][1:]) + 1 if last else 0
        rows.coalesce(1).write.parquet(f"{self.folder}/{table}/v{number:09d}")
        for name in self._snapshots(table)[: -(self.backups + 1)]:
            fs, old = self._fs(f"{self.folder}/{table}/{name}")
            fs.delete(old, True)

    def workspaces(self, include_inactive: bool = False) -> DataFrame:
        rows = self._read("workspaces", WORKSPACES)
        return rows if include_inactive else rows.filter("status = 'active'")

    def edges(self) -> DataFrame:
        return self._read("edges", EDGES)

    def facts(self) -> DataFrame:
        fs, folder = self._fs(f"{self.folder}/facts")
        return self.spark.read.schema(FACTS).parquet(f"{self.folder}/facts") if fs.exists(folder) else self.spark.createDataFrame([], FACTS)

    def get(self, workspace_id: str):
        return self.workspaces(True).filter(F.col("id") == workspace_id).first()

    def find(self, path: str):
        return self.workspaces(True).filter(F.col("path") == path).first()

    def _known(self, workspace_id: str):
        if (row := self.get(workspace_id)) is None:
            raise ValueError(f"Workspace not found: {workspace_id}")
        return row

    def register(self, path: str, name: str, description: str, project_type: str = "auto", tags: list[str] | None = None, force: bool = False) -> str:
        """A new workspace's id. A registered path needs force, which keeps id and creation time but clears counts and links."""
        old, now = self.find(path), datetime.now(timezone.utc).replace(tzinfo=None).isoformat()
        if old and not force:
            raise ValueError(f"Workspace already registered: {old.name}")
        if not old and self.workspaces(True).count() >= self.max_workspaces:
            raise ValueError(f"Maximum workspace limit reached: {self.max_workspaces}")
        key = old.id if old else workspace_id_of(path, time.time())
        row = (key, name, description, path, old.created_at if old else now, now, "1.0.0", project_type, 0, 0, 0, 0, tags or [], "active", None, 0.0, 1.0)
        self._write("workspaces", replaced(self.workspaces(True), self.spark.createDataFrame([row], WORKSPACES), "id"))
        if old:
            self._write("edges", self.edges().filter(F.col("src") != key))
        return key

    def update_stats(self, workspace_id: str, **counts) -> None:
        """Counts that are given replace the old ones; the workspace becomes active."""
        self._known(workspace_id)
        now, here = datetime.now(timezone.utc).replace(tzinfo=None).isoformat(), F.col("id") == workspace_id
        new = {"updated_at": now, "last_indexed": now, "status": "active", "health_score": 1.0} | {k: v for k, v in counts.items() if v is not None}
        rows = self.workspaces(True)
        self._write("workspaces", rows.select(*(F.when(here, F.lit(new[c])).otherwise(F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in new else F.col(c) for c in rows.columns)))

    def update_facts(self, workspace_id: str, facts: DataFrame) -> None:
        """Replaces the workspace's rows by overwriting its partition."""
        self._known(workspace_id)
        columns = [c.split()[0] for c in FACTS.split(", ")]
        own = facts.withColumn("workspace_id", F.lit(workspace_id)).select(*columns)
        if own.isEmpty():
            self._drop_facts(workspace_id)
        else:
            own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id").parquet(f"{self.folder}/facts")

    def _drop_facts(self, workspace_id: str) -> None:
        fs, part = self._fs(f"{self.folder}/facts/workspace_id={workspace_id}")
        fs.delete(part, True)

    def remove(self, workspace_id: str) -> None:
        self._known(workspace_id)
        self._write("workspaces", self.workspaces(True).filter(F.col("id") != workspace_id))
        self._write("edges", self.edges().filter(F.col("src") != workspace_id))
        self._drop_facts(workspace_id)

    def relate(self, workspace_id: str, other: str, rel_type: str) -> None:
        """Adds a link once."""
        self._known(workspace_id)
        self._known(other)
        if rel_type not in K.RELATIONSHIPS:
            raise ValueError(f"Invalid relationship type: {rel_type}")
        self._write("edges", self.edges().unionByName(self.spark.createDataFrame([(workspace_id, other, rel_type)], EDGES)).distinct())

    def related(self, workspace_id: str) -> DataFrame:
        self._known(workspace_id)
        return related(self.edges().filter(F.col("src") == workspace_id), self.workspaces(True)).drop("src")

    def clean_up(self, now: datetime | None = None) -> list[str]:
        """Removes stale workspaces; returns their ids."""
        gone = [r.id for r in stale(self.workspaces(True), now or datetime.now(timezone.utc).replace(tzinfo=None)).collect()]
        for key in gone:
            self.remove(key)
        return gone

    def stats(self) -> DataFrame:
        return stats(self.workspaces(True))

    def search(self, query: str, most: int = 20) -> DataFrame:
        from quillmark.operators import global_search

        return global_search.search(self.facts(), query, most)


_shared: dict[str, Registry] = {}


def shared_registry(spark: SparkSession, folder: str) -> Registry:
    return _shared.setdefault(folder, Registry(spark, folder))


def reset_shared_registry() -> None:
    _shared.clear()


def relationship_allowed(rel_type: Column | str) -> Column:
    return T._col(rel_type).isin(K.RELATIONSHIPS)
