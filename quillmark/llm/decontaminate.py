"""Benchmark decontamination (operator 4).

All windows of 10 consecutive words of the benchmark's items (a shorter item is one window) become a hash set. Its size
is measured first: up to MAX_SET_BYTES of item text are broadcast at once, a larger benchmark goes in blocks of that size,
one after the other: each is scanned against all documents and its hits written, and the hits of a document are united. Documents are scanned in one Arrow pass: rolling
word-window hashes of a whole block are looked up, and every hit is compared word by word before it counts. No shuffle
with one block; with more, only hits are shuffled.

Defined cases: a null or empty text has no words and no hits; null or empty items have no windows; a null item id reads as
the empty string and items that share an id count once; a window that several items share counts for each of them; repeated document rows each get their own result; an empty
benchmark hits nothing; an empty table of documents gives an empty result; further columns, whatever their names, are kept as they are. Words of any length and texts of any
length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import _blocks as B
from quillmark.llm._tables import add_struct, boxed, documents, opened, row_key, unused, written

WINDOW = 10
MAX_SET_BYTES = 16 << 20
KIND = "n_words bigint, hit_words array<int>, items array<string>, spans array<struct<start:int,end:int>>"


class WindowSet:
    """The windows of some items: by length in words, hashes in order with each window's item and first word. Texts are kept once, as the items' words."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        data = [t.encode() for t in texts]
        offs = np.cumsum([0, *map(len, data)])
        low, self.starts, self.ends, rows = B.plain_words(np.frombuffer(b"".join(data), np.uint8), offs)
        self.raw, self.ids, hashes = low.tobytes(), ids, B.slice_hashes(low, self.starts, self.ends) if len(rows) else np.zeros(0, np.uint64)
        count = B.per_row(rows, len(ids)) if len(ids) else np.zeros(0, np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in {min(int(c), window) for c in count if c}:
            at = B.window_hashes(hashes, length)
            places = np.flatnonzero(B.whole_windows(rows, length) & (np.minimum(count, window) == length)[rows[: len(at)]])
            places = places[np.argsort(at[places], kind="stable")]
            likely = np.zeros(1 << 16, bool)
            likely[(at[places] >> np.uint64(48)).astype(np.int64)] = True
            self.by_length[length] = at[places], likely, places, rows[places]
        self.known: dict[tuple, frozenset] = {}

    def items(self, length: int, key: np.uint64, text: bytes) -> frozenset:
        """Ids of the items that hold the window, compared word by word; remembered for windows that occur."""
        if (found := self.known.get((length, text))) is None:
            ordered, _, places, rows = self.by_length[length]
            first, last = np.searchsorted(ordered, key), np.searchsorted(ordered, key, "right")
            same = [i for i in range(first, last) if b" ".join(self.raw[self.starts[k] : self.ends[k]] for k in range(places[i], places[i] + length)) == text]
            found = frozenset(self.ids[rows[i]] for i in same)
            if found:
                self.known[length, text] = found
        return found


def _scan(buf: np.ndarray, offs: np.ndarray, windows: WindowSet) -> list:
    n = len(offs) - 1
    low, starts, ends, rows = B.plain_words(buf, offs)
    hashes = B.slice_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    hits, items = np.zeros(len(starts) + 1, np.int32), [set() for _ in range(n)]
    for length, (ordered, likely, *_) in windows.by_length.items():
        at = B.window_hashes(hashes, length)
        maybe = np.flatnonzero(likely[(at >> np.uint64(48)).astype(np.int64)] & B.whole_windows(rows, length))
        place = np.minimum(np.searchsorted(ordered, at[maybe]), len(ordered) - 1)
        for w in maybe[ordered[place] == at[maybe]].tolist():
            text = b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(w, w + length))
            if ids := windows.items(length, at[w], text):
                hits[w] += 1
                hits[w + length] -= 1
                items[rows[w]] |= ids
    hit = np.flatnonzero(np.cumsum(hits[:-1]) > 0) if len(starts) else np.zeros(0, np.int64)
    return _described(buf, offs, starts, ends, rows, hit, [sorted(x) for x in items])


def _described(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hit: np.ndarray, items: list[list[str]]) -> list:
    """The struct's arrays of a block whose words `hit` are hit."""
    import pyarrow as pa

    n = len(offs) - 1
    n_words = B.per_row(rows, n)
    first = np.concatenate([[0], np.cumsum(n_words)])
    in_row = (hit - first[rows[hit]]).astype(np.int32)
    spans: list[list[dict]] = [[] for _ in range(n)]
    if len(hit):
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (rows[hit[1:]] != rows[hit[:-1]])
        begin = np.flatnonzero(new)
        for a, b in zip(hit[begin], hit[np.append(begin[1:], len(hit)) - 1], strict=True):
            base = points[offs[rows[a]]]
            spans[rows[a]].append({"start": int(points[starts[a]] - base), "end": int(points[ends[b]] - base)})
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[hit], np.arange(n + 1)).astype(np.int32)), pa.array(in_row))
    kind = pa.list_(pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32())]))
    return [n_words, lists, pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)]


def _united(block, buf: np.ndarray, offs: np.ndarray) -> list:
    """As _scan, from the hit words (second column) and items (third) that the blocks of a benchmark have found."""
    _, starts, ends, rows = B.plain_words(buf, offs)
    first = np.concatenate([[0], np.cumsum(B.per_row(rows, len(offs) - 1))])
    words = block.column(1).to_pylist()
    hit = np.concatenate([np.zeros(0, np.int64), *(first[i] + np.array(w, np.int64) for i, w in enumerate(words) if w)])
    return _described(buf, offs, starts, ends, rows, hit, [x or [] for x in block.column(2).to_pylist()])


def window_sets(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, max_bytes: int = MAX_SET_BYTES) -> tuple[int, Callable[[int], WindowSet]]:
    """How many blocks of at most about max_bytes of text the items make, and how to build the windows of one: the driver holds one block."""
    sized = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = sized.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-total // max_bytes))

    def block(b: int) -> WindowSet:
        rows = (sized if n == 1 else sized.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)).collect()
        return WindowSet([r["i"] for r in rows], [r["t"] for r in rows], window)

    return n, block


def scan(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", into: str = "found", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_SET_BYTES) -> DataFrame:
    """Columns `keep` of every document and a struct `into`: its words, the indexes of its hit words, the items, and the hit spans in code points."""
    spark = docs.sparkSession
    n, block = window_sets(items, item_id, item_text, window, max_bytes)

    def against(rows: DataFrame, columns: list[str], shared, name: str, body: str) -> DataFrame:
        return add_struct(rows, columns, name, KIND, lambda _, buf, offs: _scan(buf, offs, shared.value), body)

    if n == 1:
        return against(docs, keep, spark.sparkContext.broadcast(block(0)), into, text)
    keyed = boxed(docs, keep, text=text).select("_box", "text", *row_key("text"))
    some = []
    for b in range(n):
        shared = spark.sparkContext.broadcast(block(b))
        hits = against(keyed, ["_k1", "_k2"], shared, "_own", "text").filter(F.size("_own.hit_words") > 0).dropDuplicates(["_k1", "_k2"])
        some.append(written(hits, "decontaminate-hits"))
        shared.unpersist()
    united = some[0]
    for more in some[1:]:
        united = united.unionByName(more)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"_own.{c}"))))
    united = united.groupBy("_k1", "_k2").agg(flat("hit_words").alias("_h"), flat("items").alias("_i"))
    united = written(united, "decontaminate-united")  # a plain shuffle on both sides of the join, which adaptive execution can split
    marked = keyed.join(united, ["_k1", "_k2"], "left").select("_box", "_h", "_i", "text")
    return opened(add_struct(marked, ["_box", "_h", "_i"], "_own", KIND, _united), keep, F.col("_own").alias(into))


def without_documents(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no window of an item occurs, with their columns."""
    into = unused(docs, "_found")
    return scan(docs, items, docs.columns, text, into).filter(F.size(f"{into}.hit_words") == 0).drop(into)


def without_spans(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """All documents, their hit spans cut from the text."""
    into = unused(docs, "_found")
    spans, whole = f"{into}.spans", F.col(f"`{text}`")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            whole,
            F.when(i == 0, 0).otherwise(F.try_element_at(F.col(spans), i)["end"]) + 1,
            F.coalesce(F.try_element_at(F.col(spans), i + 1)["start"], F.length(whole)) - F.when(i == 0, 0).otherwise(F.try_element_at(F.col(spans), i)["end"]),
        ),
    )
    cut = F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(whole)
    return scan(docs, items, docs.columns, text, into).withColumn(text, cut).drop(into)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.size("found.hit_words").cast("long").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.hit_words") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, ws[i:i + n - 1] AS w FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT k, i, n, ws[i:i + n - 1] AS w FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT k, i, n, item FROM dw JOIN bw USING (n, w)),
p AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, i + unnest(range(n)) AS p FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (k) LEFT JOIN t USING (k)
"""
