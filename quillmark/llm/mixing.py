"""Mixing sources to target weights (operator 1).

Each source's words, document after document in a hashed order, are packed into blocks of `block` words. Output shards of
`shard` slots draw how many slots each source gets: multinomial draws over what the sources' targets still lack, so that
the totals meet the targets within one and a half blocks. The draws go down a tree over the shards: a node's counts are drawn for its left half, the rest goes
right, each node with a seed of its own, so that a task draws the shards of its range alone and the driver none. A source's j-th slot goes through a pseudorandom
permutation of its block indexes (a Feistel network with cycle walking, another one for each pass over the source) and blocks join the slots by that index.

Word offsets come from two levels of prefix sums: documents fall into ranges of their hash, sums run inside a source's range, and the
ranges' totals run inside the source. There are about as many ranges as a range has documents, the square root of the table's rows; their number changes no result.
No source, however hot, is sorted in one task. The driver holds a row for each source, not documents or shards.

Defined cases: a null text has no words and is in the result with nothing taken, as is every document without words; a null source is a
source of its own, ranked last; repeated rows are documents of their own, equal in order and so interchangeable; null ids are kept; texts of any length are cut into as many blocks as
they fill; a source without words gets target 0; further columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm._blocks import mix as mix64
from quillmark.llm._tables import documents, removed, row_key, written

WORD = r"[^\x20\x09-\x0D]+"
#: Shards of a task.
TASK_SHARDS = 16
PIECE = 1 << 16


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (1, 2, 3)
    #: Passes over a source at most.
    most_passes: int = 3
    #: Words of the output as a share of all words.
    share: float = 1.0
    block: int = 64
    #: Slots of an output shard.
    shard: int = 8192
    seed: int = 20240229


def targets(sizes: list[int], mix: Mix) -> list[float]:
    """Words for each source: shares of the total by weight, none above most_passes times its size, the excess reshared by weight."""
    total, weights = mix.share * sum(sizes), [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    while free:
        rest = total - sum(out)
        scale = rest / sum(weights[i] for i in free)
        full = [i for i in free if scale * weights[i] >= mix.most_passes * sizes[i]]
        if not full:
            for i in free:
                out[i] = scale * weights[i]
            break
        for i in full:
            out[i] = float(mix.most_passes * sizes[i])
        free = [i for i in free if i not in set(full)]
    return out


def _left_half(counts: np.ndarray, want: int, mix: Mix, first: int, last: int) -> np.ndarray:
    """A multinomial draw of `want` slots out of counts, what exceeds a source drawn again from the others."""
    rng, left, got = np.random.default_rng((mix.seed, first, last)), counts.copy(), np.zeros_like(counts)
    while want:
        drawn = np.minimum(rng.multinomial(want, left / left.sum()), left)
        got, left, want = got + drawn, left - drawn, want - int(drawn.sum())
    return got


def draw_shards(slots: np.ndarray, mix: Mix, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, each source's slots before it, its slots of each source) for the shards from start up to stop."""
    total = int(slots.sum())
    n = -(-total // mix.shard)
    stop = n if stop is None else min(stop, n)
    todo = [(0, n, np.zeros(len(slots), np.int64), slots.astype(np.int64))]
    while todo:
        first, last, before, counts = todo.pop()
        if first >= stop or last <= start or first >= last:
            continue
        if last - first == 1:
            yield first, before, counts
            continue
        middle = (first + last) // 2
        left = _left_half(counts, (middle - first) * mix.shard, mix, first, last)
        todo += [(middle, last, before + left, counts - left), (first, middle, before, left)]


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source").alias("_source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *row_key("doc_id", "text"))


def _placed(own: DataFrame) -> DataFrame:
    """Documents with their source and size and their first word's place in the source."""
    bits = max(1, (own.count().bit_length() + 1) // 2)
    own = own.withColumn("_bucket", F.shiftright("_k1", 64 - bits))  # ranges of the hash in its order
    totals = own.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"))
    by_bucket = Window.partitionBy("_source").orderBy("_bucket")
    starts = totals.select("_source", "_bucket", (F.sum("_words").over(by_bucket) - F.col("_words")).alias("_start"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_k1", "_k2", "doc_id")
    placed = own.withColumn("_at", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return placed.join(starts.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_start"), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).select(
        "doc_id", "_source", "size", "_k1", "_k2", (F.col("_start") + F.col("_at")).alias("_from")
    )


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The places of indexes in a pseudorandom permutation of 0..n-1: four Feistel rounds over the least even number of bits that
    holds n, repeated for what falls outside until all are inside."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix64(np.arange(4, dtype=np.uint64) + np.uint64((key * 4) % (1 << 64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        return (left << half) | right

    x = once(index.astype(np.uint64))
    while len(out := np.flatnonzero(x >= n)):
        x[out] = once(x[out])
    return x.astype(np.int64)


def slots(spark: SparkSession, sizes: list[int], aims: list[float], mix: Mix) -> DataFrame:
    """One row for each slot of the output: shard, source's rank, the slot's number in the source, pass and block index."""
    blocks = np.array([-(-s // mix.block) for s in sizes], np.int64)
    passes = np.array([int(a // s) if s else 0 for a, s in zip(aims, sizes, strict=True)], np.int64)
    extra = np.array([round((a - p * s) / mix.block) for a, p, s in zip(aims, passes, sizes, strict=True)], np.int64)
    wanted = passes * blocks + np.minimum(extra, blocks)
    n = -(-int(wanted.sum()) // mix.shard)

    def run(batches):
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for shard, before, counts in draw_shards(wanted, mix, task * TASK_SHARDS, (task + 1) * TASK_SHARDS):
                    for rank in np.flatnonzero(counts).tolist():
                        of, stop = int(blocks[rank]), int(before[rank] + counts[rank])
                        for first in range(int(before[rank]), stop, PIECE):
                            j = np.arange(first, min(first + PIECE, stop))
                            turn, place = j // of, np.empty(len(j), np.int64)
                            for t in np.unique(turn).tolist():
                                here = turn == t
                                place[here] = permuted(j[here] % of, of, (mix.seed * 1_000_003 + rank) * 1_009 + t)
                            full = lambda v, kind: np.full(len(j), v, kind)  # noqa: E731, B023
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full(shard, np.int64), full(rank, np.int32), j, turn.astype(np.int32), place)], ["shard", "rank", "j", "pass", "block"])

    tasks = -(-n // TASK_SHARDS)
    return spark.range(0, tasks, 1, max(1, min(tasks, 1 << 16))).mapInArrow(run, "shard bigint, rank int, j bigint, pass int, block bigint")


@dataclass
class Mixed:
    #: rank, doc_id, size, source_size, target, _k1, _k2 and _from (the first word's place in the source) of every document.
    documents: DataFrame
    #: A document's share of a block: rank, block, doc_id, _from, first_word, words and times, how often the block is taken.
    pieces: DataFrame
    #: The slots of the output.
    plan: DataFrame


def mixed(docs: DataFrame, mix: Mix = Mix()) -> Mixed:
    spark = docs.sparkSession
    own = written(_sized(docs), "mix-documents")
    placed = written(_placed(own), "mix-placed")
    removed(own)
    found = sorted(((r["_source"], r["n"]) for r in placed.groupBy("_source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in found]
    aims = targets(sizes, mix)
    ranks = spark.createDataFrame([(i, s, n, float(a)) for i, ((s, n), a) in enumerate(zip(found, aims, strict=True))], "rank int, _s string, source_size bigint, target double")
    ranked = placed.join(ranks, F.col("_source").cast("string").eqNullSafe(F.col("_s")))
    plan = slots(spark, sizes, aims, mix)
    taken = plan.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    last = F.col("_from") + F.col("size") - 1
    spread = ranked.filter("size > 0").select("rank", "doc_id", "_from", "size", F.explode(F.sequence(F.floor(F.col("_from") / mix.block), F.floor(last / mix.block))).alias("block"))
    start = F.greatest(F.col("_from"), F.col("block") * mix.block)
    # Sizes of tables that Python makes are guessed from what it reads, here a row for each task: by merge, never broadcast.
    pieces = spread.join(taken.hint("merge"), ["rank", "block"]).select(
        "rank", "block", "doc_id", "_from", "times", (start - F.col("_from")).alias("first_word"), (F.least(F.col("_from") + F.col("size"), (F.col("block") + 1) * mix.block) - start).alias("words")
    )
    return Mixed(ranked, pieces, plan)


def takes_of(made: Mixed) -> DataFrame:
    sums = made.pieces.groupBy(F.col("rank").alias("_r"), F.col("_from").alias("_f")).agg(F.sum(F.col("times") * F.col("words")).alias("_taken"))
    here = (F.col("rank") == F.col("_r")) & (F.col("_from") == F.col("_f")) & (F.col("size") > 0)
    return made.documents.join(sums.hint("merge"), here, "left").select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def takes(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target and words taken of every document."""
    return takes_of(mixed(docs, mix))


def blocks_of(docs: DataFrame, made: Mixed, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: shard, slot, source's rank and text of every block, its words joined by spaces."""
    texts = docs.select(F.col("text").alias("_text"), *row_key("doc_id", "text")).dropDuplicates(["_k1", "_k2"])
    # Documents without words share their place with the next one.
    keyed = made.documents.filter("size > 0").select("rank", "_from", "size", "_k1", "_k2").join(texts, ["_k1", "_k2"])
    upto = F.col("_from") + F.col("size")
    begin = lambda b: F.greatest(F.col("_from"), b * mix.block) - F.col("_from")
    length = lambda b: F.least(upto, (b + 1) * mix.block) - F.greatest(F.col("_from"), b * mix.block)
    blocks = F.sequence(F.floor(F.col("_from") / mix.block), F.floor((upto - 1) / mix.block))
    cut = lambda ws: F.transform(blocks, lambda b: F.struct(b.alias("block"), F.array_join(F.slice(ws, (begin(b) + 1).cast("int"), length(b).cast("int")), " ").alias("piece")))
    # The outer lambda's variable holds the words: the optimizer would otherwise copy the extraction into each block.
    cuts = F.element_at(F.transform(F.array(F.regexp_extract_all("_text", F.lit(f"({WORD})"))), cut), 1)
    each = keyed.select("rank", "_from", F.explode(cuts).alias("c")).select("rank", "_from", "c.block", "c.piece")
    whole = each.groupBy("rank", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_from", "piece"))), lambda x: x["piece"]), " ").alias("text"))
    return made.plan.join(whole.hint("merge"), ["rank", "block"]).select("shard", "rank", "pass", F.col("j").alias("slot"), "block", "text")


def output_blocks(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    return blocks_of(docs, mixed(docs, mix), mix)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return takes(documents(spark, sf_dir))
