"""Shared places, row keys and size checks of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Only for sessions in one process.
LOCAL_FOLDER = "/tmp/checkpoints"
#: Bytes of an Arrow batch, and of a row group that a task of an intermediate table holds before it is written.
BATCH_BYTES = 4 << 20
GROUP_BYTES = 16 << 20
BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Estimated bytes of a table for a task that writes what comes of it, where there are more tasks than TASKS_A_CORE.
TASK_BYTES, TASKS_A_CORE = 4 << 20, 3


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A session in one process may go without; on a cluster there is no folder to fall back to."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = LOCAL_FOLDER
    return folder.rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, unless the session has a bound of its own: Spark's 64 MB are held several times over, in the JVM and in the worker."""
    if BOUND not in spark.conf.getAll:
        spark.conf.set(BOUND, str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder once and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    bounded(spark)
    df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame) -> int:
    """How many tasks what comes of the table is worth, by Spark's estimate of its size. A task of a few rows still makes a file, for which the JVM starts processes of its own size."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), (1 << 31) - 1)  # rows of unknown size count as boundless


def removed(df: DataFrame) -> None:
    """Deletes a table that written() made, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(*columns: str):
    """Two hashes of the columns' values, nulls told apart: equal for equal rows only, but for chance."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(F.lit(17), *parts).alias("_k1"), F.xxhash64(F.lit(29), *reversed(parts)).alias("_k2")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def boxed(df: DataFrame, keep: list[str], **more: str) -> DataFrame:
    """The kept columns as one struct column _box, away from an operator's own names, and further columns under given names. `_box.*` opens it."""
    box = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(None).cast("int").alias("_none"))
    return df.select(box.alias("_box"), *(F.col(f"`{c}`").alias(name) for name, c in more.items()))


def opened(df: DataFrame, keep: list[str], *more) -> DataFrame:
    return df.select(*(F.col(f"_box.`{c}`").alias(c) for c in keep), *more)


def add_struct(df: DataFrame, keep: list[str], name: str, kind: str, make, text: str = "text", limit: int | None = None) -> DataFrame:
    """Columns `keep` and a struct column `name` of type `kind`, which `make(rows, buf, offs)` fills block by block.

    make returns the struct's arrays in order. Only `keep` and the text leave the JVM, in one Arrow pass without a shuffle; a text that is kept too is sent once.
    """
    import pyarrow as pa

    from quillmark.llm import _blocks

    bounded(df.sparkSession)
    inner = StructType.fromDDL(kind)
    fields = [df.schema[c] for c in keep]
    source, most = text if text in keep else unused(df, "_text"), limit or _blocks.BLOCK_BYTES

    def run(batches):
        for rows, buf, offs in _blocks.blocks(batches, source, most):
            made = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in make(rows, buf, offs)], inner.names)
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), made], [*keep, name])

    body = [] if text in keep else [F.col(f"`{text}`").alias(source)]
    return df.select(*(F.col(f"`{c}`") for c in keep), *body).mapInArrow(run, StructType([*fields, StructField(name, inner)]))
