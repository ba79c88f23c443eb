"""Results and sections within token budgets: ranked contexts, packed chunks, overlapping sentence chunks, and response formats."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import text as T
from quillmark.shared import planned_bytes, shared_checkpoints

#: Planned bytes of sections up to which one task packs a group.
BLOCK_BYTES = 256 << 20
NOTHING = "No relevant content found."
NOTHING_FOR_QUERY = "No relevant content found for your query."


def within_budget(results: DataFrame, budget: int = K.TOKEN_LIMIT, by: list[str] | None = None) -> DataFrame:
    """Ranked results up to the budget, the first beyond it cut to what is left if that is over 100 tokens.

    results: section_id, title, content, rank (and the columns `by`, one context each). Adds tokens, body and truncated. The running sum never falls, so a
    prefix filter is the same as stopping; a window over one query's few ranked rows.
    """
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = results.withColumn("tokens", T.token_estimate("content")).withColumn("_sum", F.sum("tokens").over(order))
    left = F.lit(budget) - (F.col("_sum") - F.col("tokens"))
    over = F.col("_sum") > budget
    first_over = over & (F.sum(over.cast("int")).over(order) == 1)
    kept = sized.withColumn("_left", left).withColumn("truncated", over).withColumn("_first", first_over).filter(~F.col("truncated") | (F.col("_first") & (F.col("_left") > K.LEAST_TRUNCATED_TOKENS)))
    cut = F.concat(F.substring(F.col("content"), F.lit(1), (F.col("_left") * 4).cast("int")), F.lit("..."))
    return kept.withColumn("body", F.when(F.col("truncated"), cut).otherwise(F.col("content"))).drop("_sum", "_left", "_first")


def _joined(pieces: Column, by: str, empty: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("rank", pieces.alias("piece"))))
    text = F.array_join(F.transform(ordered, lambda x: x["piece"]), by)
    return F.when(F.count(F.lit(1)) > 0, text).otherwise(empty)


def engine_context(budgeted: DataFrame) -> DataFrame:
    """One row: the budgeted results as headed sections."""
    return budgeted.agg(_joined(F.concat(F.lit("## "), F.col("title"), F.lit("\n"), F.col("body")), "\n\n", NOTHING).alias("context"))


def text_response(budgeted: DataFrame) -> DataFrame:
    source = F.when(F.col("file_path") != "unknown", F.concat(F.lit("\n\n*Source: "), F.col("file_path"), F.lit("*"))).otherwise("")
    return budgeted.agg(_joined(F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("body"), source), "\n\n---\n\n", NOTHING_FOR_QUERY).alias("content"))


def json_response(ranked: DataFrame) -> DataFrame:
    fields = F.struct("section_id", "title", "content", "score", "match_type", "file_path", F.array(F.lit(0), F.lit(0)).alias("line_range"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", fields.alias("row"))))
    return ranked.agg(F.to_json(F.transform(ordered, lambda x: x["row"])).alias("content"))


def structured_blocks(ranked: DataFrame) -> DataFrame:
    """rank and the block of each result."""
    lines = [F.concat(F.lit("### Result "), F.col("rank").cast("string"), F.lit(": "), F.col("title")), F.concat(F.lit("**Relevance Score:** "), F.format_string("%.3f", "score")), F.concat(F.lit("**Match Type:** "), F.col("match_type")), F.concat(F.lit("**Source:** "), F.col("file_path")), F.lit(""), F.col("content"), F.lit("")]
    return ranked.select("rank", F.concat_ws("\n", *lines).alias("block"))


def structured_response(ranked: DataFrame) -> DataFrame:
    blocks = structured_blocks(ranked)
    return blocks.agg(_joined(F.col("block"), "\n---\n\n", "No results found.").alias("content"))


def ranked(results: DataFrame) -> DataFrame:
    """A few results with their rank from 1 on by score and id."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("score", 6)), "section_id")).cast("bigint"))


CHUNK = "grp string, chunk_no bigint, section_ids array<string>, content string, token_count bigint, section_count bigint"


def _packing(budget: int, entries: dict[int, tuple[int, int]] | None = None, edges: bool = False):
    """Chunks of rows in order. With entries, a task is a block whose first chunk may go on from there, with those tokens and that number: `edges` asks for
    the parts of chunks that may cross a border alone, otherwise they are left out."""
    names = ["grp", "chunk_no", "section_ids", "content", "token_count", "section_count", "block"]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.int32()]
    if entries is None:
        names, kinds = names[:-1], kinds[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        crosses, (before, number) = block in (entries or {}), (entries or {}).get(block, (0, 0))
        group, ids, parts, used, out = object(), [], [], 0, []
        first = crosses

        def close(edge: bool) -> None:
            if ids and (entries is None or edge == edges):
                out.append((group, number, ids, "\n\n".join(parts), used, len(ids), block)[: len(names)])

        for batch in batches:
            for grp, _, section, title, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = len(content or "") // 4
                if first:
                    group, first = grp, False
                if grp != group or before + used + tokens > budget:
                    close(crosses)
                    group, number = grp, number + 1 if grp == group else 0
                    ids, parts, used, before, crosses = [], [], 0, 0, False
                ids.append(section)
                parts.append(f"# {title}\n{content}")
                used += tokens
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)
                out.clear()
        close(entries is not None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return run


def packing_steps(tokens: np.ndarray, budget: int) -> tuple[list[int], list[int], list[int], int]:
    """What a run of sections does to the chunk that is open before it: the token sums at which the chunk may close, the tokens of the chunk that is open
    after the run if it closes there, the chunks begun until then, and the sum of all. At most budget + 2 steps; the first is a run that begins a chunk."""
    n, sums = len(tokens), np.concatenate([[0], np.cumsum(tokens)])
    following = np.maximum(np.searchsorted(sums, sums[:-1] + budget, "right") - 1, np.arange(1, n + 1)).tolist()
    left, begun = (sums[n] - sums[:-1]).tolist(), [0] * n
    for i in range(n - 1, -1, -1):
        if (j := following[i]) < n:
            left[i], begun[i] = left[j], begun[j] + 1
    reach = min(n, int(np.searchsorted(sums, budget, "right")))
    kept = [j for j in range(reach) if j == 0 or tokens[j] > 0]
    return [int(sums[j + 1]) for j in kept], [left[j] for j in kept], [begun[j] for j in kept], int(sums[n])


def _summaries(budget: int):
    """The steps of the first and the last group of each task's rows (grp, tokens); the groups between begin and end there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, runs, group, held = TaskContext.get().partitionId(), [], object(), []
        for batch in batches:
            groups, tokens = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            cuts = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and groups[a] != group:
                    if held:
                        runs = [*runs[:1], (group, held)]
                    group, held = groups[a], []
                if a < b:
                    held.append(tokens[a:b])
        if held:
            runs = [*runs[:1], (group, held)]
        rows = [(block, i, g, *packing_steps(np.concatenate(h), budget)) for i, (g, h) in enumerate(runs)]
        kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.list_(pa.int64())] * 3, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["block", "seq", "grp", "ends", "left", "begun", "total"])

    return run


def _chain(budget: int):
    """The open chunk's tokens and number at the start of each block that goes on with a group, from the steps in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used, number = object(), 0, 0
        for batch in batches:
            out = []
            for block, seq, grp, ends, left, begun, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seq == 0 and grp == group:
                    out.append((block, used, number))
                    at = bisect_right(ends, budget - used)
                    used, number = (left[at], number + begun[at] + 1) if at < len(ends) else (used + total, number)
                else:
                    group, used, number = grp, left[0], begun[0]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["block", "used", "number"])

    return run


def packed_chunks(sections: DataFrame, budget: int, blocks: bool | None = None) -> DataFrame:
    """Greedy chunks of each group's sections in order: grp, chunk_no, section_ids, content, token_count, section_count.

    sections: grp, ord, section_id, title, content. The sum restarts at each chunk, so that a chunk's start depends on all before it. Up to BLOCK_BYTES of
    sections, a group streams through one task, which holds no more than the open chunk. Beyond that (or as `blocks` says) the rows are dealt out as ranges
    of (grp, ord, section_id), however large one group is, and kept by checkpoint(): a first pass over the token counts finds what each block does to any open
    chunk, one task chains these steps, and a second pass packs all blocks at once. Parts of chunks that cross a border meet by their number. The driver gets
    two numbers for each block.
    """
    rows = sections.select("grp", "ord", F.col("section_id").cast("string"), "title", "content")
    if not (planned_bytes(sections) > BLOCK_BYTES if blocks is None else blocks):
        return rows.repartition("grp").sortWithinPartitions("grp", "ord", "section_id").mapInArrow(_packing(budget), CHUNK)
    shared_checkpoints(sections.sparkSession)
    ranged = rows.repartitionByRange("grp", "ord", "section_id").sortWithinPartitions("grp", "ord", "section_id").checkpoint()
    tokens = F.floor(F.coalesce(F.length("content"), F.lit(0)) / 4)
    steps = ranged.select("grp", tokens.alias("tokens")).mapInArrow(_summaries(budget), "block int, seq int, grp string, ends array<bigint>, left array<bigint>, begun array<bigint>, total bigint")
    chained = steps.repartition(1).sortWithinPartitions("block", "seq").mapInArrow(_chain(budget), "block int, used bigint, number bigint")
    entries = {r["block"]: (r["used"], r["number"]) for r in chained.collect()}
    whole, parts = (ranged.mapInArrow(_packing(budget, entries, edges), f"{CHUNK}, block int") for edges in (False, True))
    ordered = F.sort_array(F.collect_list(F.struct("block", "section_ids", "content")))
    met = parts.groupBy("grp", "chunk_no").agg(ordered.alias("p"), F.sum("token_count").alias("token_count"), F.sum("section_count").alias("section_count"))
    met = met.select("grp", "chunk_no", F.flatten("p.section_ids").alias("section_ids"), F.array_join("p.content", "\n\n").alias("content"), "token_count", "section_count")
    return whole.drop("block").unionByName(met)


def sentence_chunks_of(sentences: list[str], most: int = K.SENTENCE_CHARS, overlap: int = K.OVERLAP_CHARS) -> list[str]:
    """Chunks of whole sentences of at most `most` characters (a longer sentence is its own), each starting with the end of the one before."""
    chunks, held, size = [], [], 0
    for s in sentences:
        if held and size + len(s) > most:
            chunks.append(" ".join(held))
            tail, room = len(held), overlap
            while tail and len(held[tail - 1]) <= room:
                tail -= 1
                room -= len(held[tail])
            held = held[tail:]
            size = sum(map(len, held))
        held.append(s)
        size += len(s)
    return [*chunks, " ".join(held)] if held else chunks


def sentence_chunks(texts: DataFrame, most: int = K.SENTENCE_CHARS, overlap: int = K.OVERLAP_CHARS) -> DataFrame:
    """section_id, chunk_id and chunk of texts(section_id, text); one Arrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sections, names, chunks = [], [], []
            for section, sentences in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, chunk in enumerate(sentence_chunks_of(sentences or [], most, overlap)):
                    sections.append(section)
                    names.append(f"{section}_chunk_{i}")
                    chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (sections, names, chunks)], ["section_id", "chunk_id", "chunk"])

    return texts.select(F.col("section_id").cast("string"), T.sentences("text").alias("s")).mapInArrow(run, "section_id string, chunk_id string, chunk string")
