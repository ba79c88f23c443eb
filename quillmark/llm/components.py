"""Connected components of a table of links, as joins and aggregates over tables in the shared folder.

The least neighbour of each node is written before it is joined: both sides of the join are then plain shuffles, and adaptive execution splits a node that a third of all
links share. Tables of a pass are deleted when the next one stands. Up to FEW links are joined by one task instead: a round's joins and files cost the same for a few rows.

Defined cases: a null end of a link counts as no link; links of a node to itself and repeated links change nothing; no links give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillmark.llm._tables import removed, written

#: Links that one task joins at once, in about 50 MB of a worker if their ends are digests; more go through rounds of stars.
FEW = 1 << 17


def _least_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component of all links (a, b) of a task, for every node but the least of its component."""
    parent, kind = {}, None

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 50_000):
        some = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([root(x) for x in some], kind)], ["node", "component"])


def _large_star(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Each node links its larger neighbours to its least one (or itself); then the table that this reads."""
    both = edges.union(edges.select("b", "a"))
    least = written(both.groupBy(F.col("a").alias("_a")).agg(F.least(F.min("b"), F.first("a")).alias("_m")), name)
    linked = both.filter("b > a").join(least, F.col("a") == F.col("_a"))
    return linked.select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct(), least


def _small_star(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Each node links its smaller neighbours and itself to the least of them; then the table that this reads. edges: b < a, each link once."""
    least = written(edges.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m")), name)
    others = edges.join(least, F.col("a") == F.col("_a")).filter("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return others.union(least.select(F.col("_a"), F.col("_m"))).distinct(), least


def _tangled(edges: DataFrame) -> bool:
    """Whether some node links to several others, or links to one that links on. edges: b < a, each link once."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    counts = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not counts.filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """node and its component's least node, for every node of a link but the least. edges: columns a and b of one orderable type.

    Alternates large-star and small-star until every node links to its least one alone, or until FEW links are left; each pass is written to the shared folder, and only
    the number of links and whether there is one more pass to do come to the driver.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    kind = now.schema["a"].dataType
    while (few := now.count() <= FEW) or _tangled(now):
        if few:
            found = written(now.coalesce(1).mapInArrow(_least_of, StructType([StructField("node", kind), StructField("component", kind)])), name)
            removed(now)
            return found
        large, read = _large_star(now, f"{name}-least")
        middle = written(large, name)
        small, too = _small_star(middle, f"{name}-least")
        before, now = now, written(small, name)
        for table in (read, too, middle, before):
            removed(table)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
