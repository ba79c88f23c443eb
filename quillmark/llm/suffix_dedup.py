"""Suffix-array dedup of long repeated byte strings (operator 3).

A byte goes if a string of LENGTH bytes covers it that also starts anywhere else in the table. Suffixes of the whole table are never sorted in one
place; strings that could be equal are brought together first:

1. Every window of LENGTH bytes has an anchor, the K bytes of least hash inside it, leftmost on a tie. Equal windows have equal anchors at equal places, so a window can
   only repeat if its anchor's hash does. Consecutive windows with one anchor are a segment, LENGTH + SPAN bytes at most; one text has about two for each SPAN bytes.
2. Segments whose anchor occurs twice or more anywhere are kept; equal ones become one row with a count, by partial aggregation, so copies of texts, however many, collapse.
3. The bytes of one copy of each are fetched, grouped by anchor, and each group's suffixes are sorted in two stages: those smaller than their successors directly,
   the others induced by scans of the first-byte buckets. Common prefixes of neighbours give the runs of equal windows; a run repeats if its counts sum to two or more.
   An anchor with over SPLIT bytes of different segments is dealt out by sub-ranges of its windows and the bytes that all windows of a sub-range share. Before sorting, equal
   strings of a group become one with a count again: a passage in many different surroundings leaves a few.
4. Repeated windows go back to the texts that hold the segments, their ranges are united, and the remaining bytes hashed.

Texts are shuffled twice, compressed; besides them, a row for each segment.

Defined cases: a null text is empty, keeps nothing and loses nothing; texts under LENGTH bytes are kept whole; longer ones, of any length, are anchored in chunks that overlap by a window; equal texts of LENGTH bytes or more lose every byte, each row of them; null ids are kept;
an empty table gives an empty result; further columns do not matter; bytes are judged on the input, also inside a code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import _blocks as B
from quillmark.llm._tables import documents, removed, written

LENGTH = 400
K = 64
SPAN = LENGTH - K
CHUNK = 4 << 20
SPLIT = 512 << 10
SUBRANGES = (1, 16, 64)
BATCH = 64 << 10
#: Suffixes whose whole keys may be held at once; more are compared STEP bytes at a time.
AT_ONCE, STEP = 150_000, 64
U64 = np.uint64
PLACE = U64((1 << 24) - 1)
ANCHORS = "key binary, v bigint, seg bigint, lo int, len int"


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor's hash, and first and last window start of every segment; places are in the buffer, which is under 16 MB."""
    n = len(buf)
    long = np.flatnonzero(np.diff(offs) >= LENGTH)
    if not len(long):
        return (np.zeros(0, np.int64),) * 4
    h = buf.astype(U64) + U64(1)
    step, base = 1, int(B.BASE)
    while step < K:
        h = h[:-step] * U64(pow(base, step, 1 << 64)) + h[step:]
        step *= 2
    h = B.mix(h)
    width, m = SPAN + 1, len(h)
    ranked = np.full(-(-m // width) * width, U64(0xFFFFFFFFFFFFFFFF))
    ranked[:m] = (h & ~PLACE) | np.arange(m, dtype=U64)
    table = ranked.reshape(-1, width)
    ahead = np.minimum.accumulate(table, 1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    at = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & PLACE).astype(np.int64)
    inside = B.covered(offs[long], offs[long + 1] - LENGTH + 1, windows)
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    return np.searchsorted(offs, lo, "right") - 1, h[at[lo]], lo, hi


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ANCHORS rows of (key, text) rows."""
    from xxhash import xxh3_64_intdigest

    for rows, whole, bounds in B.blocks(batches, "text"):
        for begin in range(0, max(1, len(whole)), CHUNK):
            # Only a block of one long text has several chunks; they overlap by a window less a byte.
            buf = whole[begin : begin + CHUNK + LENGTH - 1]
            offs = bounds if len(whole) <= CHUNK else np.array([0, len(buf)])
            row, v, lo, hi = anchors(buf, offs)
            raw = memoryview(buf.tobytes())
            seg = np.array([xxh3_64_intdigest(raw[a:b]) for a, b in zip(lo.tolist(), (hi + LENGTH).tolist(), strict=True)], U64)
            columns = [rows.column(0).take(pa.array(row)), v.view(np.int64), seg.view(np.int64), (lo - offs[row] + begin).astype(np.int32), (hi - lo + LENGTH).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["key", "v", "seg", "lo", "len"])


def _sorted_direct(data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The starts in the order of data[start:stop]; memory is bounded by AT_ONCE whole keys or STEP bytes of each."""
    todo, out = [(0, len(starts), 0)], np.stack([starts, stops], 1)
    while todo:
        lo, hi, at = todo.pop()
        part = out[lo:hi]
        few = hi - lo <= AT_ONCE
        ends = part[:, 1] if few else np.minimum(part[:, 0] + at + STEP, part[:, 1])
        keys = [data[a:b] for a, b in zip((part[:, 0] + at).tolist(), ends.tolist(), strict=True)]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        out[lo:hi] = part[order]
        if not few:
            first = 0
            for i in range(1, len(order) + 1):
                if i == len(order) or keys[order[i]] != keys[order[first]]:
                    if i - first > 1 and len(keys[order[first]]) == STEP:
                        todo.append((lo + first, lo + i, at + STEP))
                    first = i
    return out[:, 0]


def suffix_order(data: bytes, ends: np.ndarray, depth: int = LENGTH, windows: bool = False) -> np.ndarray:
    """The suffixes of strings laid end to end, ordered by their first `depth` bytes; ends: of the strings, none empty.

    With windows, only suffixes of at least `depth` bytes matter, and those behind the last of them that induce it: up to the next one that is sorted directly.

    Stage one sorts the suffixes that are smaller than their successors; stage two induces the others: when the bucket of a first byte is complete, its
    members' predecessors with a larger byte go to the ends of their own buckets, and those with the same byte to the end of this one.
    """
    t = np.frombuffer(data, np.uint8).astype(np.int16)
    n, last = len(t), np.zeros(len(t), bool)
    last[ends - 1] = True
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(t[1:] - t[:-1])
    rise[last] = -1  # the end of a string is smaller than any byte
    known = np.where(rise != 0, np.arange(n), n)
    smaller = rise[np.minimum.accumulate(known[::-1])[::-1]] > 0
    direct, sizes = np.flatnonzero(smaller), np.diff(np.concatenate([[0], ends]))
    owner, seeds = np.repeat(np.arange(len(ends)), sizes), ends - 1
    if windows:
        next_direct = np.append(direct, n)[np.searchsorted(direct, np.maximum(ends - depth, 0))]
        inside = next_direct < ends
        stop_at = np.where(sizes < depth, -1, np.where(inside, next_direct, ends - 1))
        direct, seeds = direct[direct <= stop_at[owner[direct]]], seeds[~inside & (sizes >= depth)]
    stop = np.minimum(direct + depth, ends[owner[direct]])
    direct = _sorted_direct(data, direct, stop)
    cut = np.searchsorted(t[direct], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(members: np.ndarray) -> None:
        by = t[members]
        order = np.argsort(by, kind="stable")
        members, by = members[order], by[order]
        if len(by):
            edge = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1], [True]])).tolist()
            for a, b in zip(edge, edge[1:], strict=False):
                queues[by[a]].append(members[a:b])

    deal(seeds)
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    out = []
    for c in range(256):
        if not queues[c] and cut[c] == cut[c + 1]:
            continue
        induced, i = queues[c], 0
        while i < len(induced):
            before = induced[i][~first[induced[i]]] - 1
            if len(same := before[t[before] == c]):
                induced.append(same)
            i += 1
        bucket = np.concatenate([*induced, direct[cut[c] : cut[c + 1]]])
        out.append(bucket)
        before = bucket[~first[bucket]] - 1
        deal(before[t[before] > c])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(data: bytes, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix of at least `depth` bytes shares with the one before it, `depth` at most; the first has 0."""
    padded = data + bytes(8)
    words = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, depth, 8):
        differ = words[order[live] + at] ^ words[order[live - 1] + at]
        if depth - at < 8:
            differ &= U64((1 << (8 * (depth - at))) - 1)
        apart = differ != 0
        low = differ[apart] & (~differ[apart] + U64(1))
        shared[live[apart]] = at + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        live = live[~apart]
        if not len(live):
            break
    shared[live] = depth
    return shared


def repeated_windows(strings: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """The starts in each string of the windows of `length` bytes that occur twice or more, a string counting so many times."""
    data, ends = b"".join(strings), np.cumsum([len(s) for s in strings])
    order = suffix_order(data, ends, length, True)
    owner = np.repeat(np.arange(len(strings)), [len(s) for s in strings])[order]
    whole = ends[owner] - order >= length
    order, owner = order[whole], owner[whole]
    if not len(order):
        return [np.zeros(0, np.int64) for _ in strings]
    runs = np.flatnonzero(common_prefixes(data, order, length) < length)
    sums = np.add.reduceat(counts[owner], runs)
    hit = np.repeat(sums >= 2, np.diff(np.append(runs, len(order))))
    places = np.sort(order[hit])
    cut = np.searchsorted(places, np.concatenate([[0], ends]))
    return [places[cut[i] : cut[i + 1]] - (ends[i] - len(s)) for i, s in enumerate(strings)]


def ranges_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last of each run of consecutive places."""
    if not len(places):
        return places, places
    new = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1] + 1]))
    return places[new], places[np.append(new[1:], len(places)) - 1] + 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = B.text_column(batch, "text").cast(pa.binary())
        made = pa.array([squeeze(x.as_buffer()) for x in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), made], [*batch.schema.names[:-1], "packed"])


def _packed_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _packed, one row for each key of a task."""
    seen: set[bytes] = set()
    for batch in _packed(b.filter(pa.array([not (k in seen or seen.add(k)) for k in b.column(0).to_pylist()], pa.bool_())) for b in batches):
        yield batch


SEGMENT = "grp bigint, mark bigint, v bigint, seg bigint, n bigint, at int, body binary"


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SEGMENT rows of (key, packed, refs) rows; equal keys in a row are read once. mark: of the body, which is there once for each group and mark of a task."""
    import zstandard
    from xxhash import xxh3_64_intdigest

    unpack, before, seen = zstandard.ZstdDecompressor().decompress, None, set()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    names, kinds = ["grp", "mark", "v", "seg", "n", "at", "body"], [*[pa.int64()] * 5, pa.int32(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        out, held = [], 0
        for i in range(batch.num_rows):
            if (key := batch.column(0)[i].as_py()) == before:
                continue
            before, text = key, unpack(batch.column(1)[i].as_py())
            for r in batch.column(2)[i].as_py():
                body = text[r["lo"] : r["lo"] + r["len"]]
                if r["parts"] == 1:
                    out.append((r["v"], r["seg"], r["v"], r["seg"], r["n"], 0, body))
                    held += len(body)
                else:
                    for name, at, part in _subranges(body, r["parts"], r["v"]):
                        grp, mark = signed(xxh3_64_intdigest(name)), signed(xxh3_64_intdigest(part))
                        new = (grp, mark) not in seen
                        seen.add((grp, mark))
                        out.append((grp, mark, r["v"], r["seg"], r["n"], at, part if new else None))
                        held += len(part) if new else 50
                if held > 4 << 20:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)


def _subranges(body: bytes, parts: int, v: int) -> Iterator[tuple[bytes, int, bytes]]:
    """(group, place in the body, bytes) for the sub-ranges of the places that the anchor has in a window; a group's name holds what all its windows share."""
    windows = len(body) - LENGTH + 1
    first = _anchor_place(np.frombuffer(body, np.uint8))
    for p in range(parts):
        near, far = p * (SPAN + 1) // parts, (p + 1) * (SPAN + 1) // parts - 1  # the anchor's place in the window, both included
        a, b = max(0, first - far), min(windows - 1, first - near)
        if a <= b:
            core = body[first - near : first - far + LENGTH]
            yield v.to_bytes(8, "big", signed=True) + p.to_bytes(4, "big") + core, a, body[a : b + LENGTH]


def _anchor_place(buf: np.ndarray) -> int:
    """Where the anchor of a segment's windows lies in it."""
    h = buf.astype(U64) + U64(1)
    step, base = 1, int(B.BASE)
    while step < K:
        h = h[:-step] * U64(pow(base, step, 1 << 64)) + h[step:]
        step *= 2
    return int(np.argmin(B.mix(h)[: SPAN + 1] & ~PLACE))


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grp, mark and ranges of repeated window starts of rows (grp, mark, n, body) that come by group."""
    held: list[tuple] = []

    def judged() -> pa.RecordBatch:
        found = repeated_windows([h[3] for h in held], np.array([h[2] for h in held]))
        rows = [(h[0], h[1], [{"s": int(a), "e": int(b)} for a, b in zip(*ranges_of(x), strict=True)]) for h, x in zip(held, found, strict=True) if len(x)]
        kind = pa.list_(pa.struct([pa.field("s", pa.int32()), pa.field("e", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), kind))], ["grp", "mark", "ranges"])

    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and size >= BATCH and row[0] != held[-1][0]:
                yield judged()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield judged()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(columns, packed, starts) to (columns, n_bytes, n_removed, n_spans, removed, kept_sha256)."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    kind = pa.list_(pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32())]))
    for batch in batches:
        n = batch.num_columns - 2
        made: list[list] = [[], [], [], [], []]
        for packed, windows in zip(batch.column(n), batch.column(n + 1), strict=True):
            text, spans = unpack(packed.as_py()), []
            for w in windows.as_py() or []:
                if spans and w["s"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], w["e"] - 1 + LENGTH)
                else:
                    spans.append({"start": w["s"], "end": w["e"] - 1 + LENGTH})
            kept, at = hashlib.sha256(), 0
            for s in spans:
                kept.update(text[at : s["start"]])
                at = s["end"]
            kept.update(text[at:])
            for column, x in zip(made, (len(text), sum(s["end"] - s["start"] for s in spans), len(spans), spans, kept.hexdigest()), strict=True):
                column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), kind, pa.string()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))], [*batch.schema.names[:n], "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256"])


def window_starts(texts: DataFrame) -> DataFrame:
    """key and sorted ranges of the starts of repeated windows, for texts that have any. texts: key, text; equal keys are equal texts."""
    anchored = found = written(texts.mapInArrow(_segments, ANCHORS), "suffix-anchors")
    twice = found.groupBy(F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_v")
    twice = written(twice, "suffix-twice")  # a plain shuffle on both sides of the join, which adaptive execution can split
    some = found.join(twice, F.col("v") == F.col("_v")).groupBy("v", "seg", "key", "lo", "len").agg(F.count(F.lit(1)).alias("n"))
    some = written(some, "suffix-repeated")
    each = some.groupBy("v", "seg").agg(F.sum("n").alias("n"), F.min(F.struct("key", "lo", "len")).alias("one"))
    # Only anchors to be dealt out; written, so that both sides of the join are plain shuffles, which adaptive execution can split.
    sizes = written(each.groupBy(F.col("v").alias("_v")).agg(F.sum("one.len").alias("_bytes")).filter(F.col("_bytes") > SPLIT), "suffix-large")
    parts = F.when(F.col("_bytes").isNull(), SUBRANGES[0]).when(F.col("_bytes") <= SPLIT * 256, SUBRANGES[1]).otherwise(SUBRANGES[2])
    refs = each.join(sizes, F.col("v") == F.col("_v"), "left").groupBy(F.col("one.key").alias("_key")).agg(F.collect_list(F.struct("v", "seg", "n", F.col("one.lo").alias("lo"), F.col("one.len").alias("len"), parts.alias("parts"))).alias("refs"))
    packed = texts.mapInArrow(_packed_once, "key binary, packed binary")
    bodies = written(packed.join(refs, F.col("key") == F.col("_key")).select("key", "packed", "refs").mapInArrow(_bodies, SEGMENT), "suffix-bodies")
    once = bodies.groupBy("grp", "mark").agg(F.sum("n").alias("n"), F.max("body").alias("body"))
    judged = once.repartition("grp").sortWithinPartitions("grp").mapInArrow(_sorted_groups, "grp bigint, mark bigint, ranges array<struct<s:int,e:int>>")
    windows = written(judged, "suffix-windows")
    judged = windows.select(F.col("grp").alias("_g"), F.col("mark").alias("_m"), "ranges")
    found = bodies.select("grp", "mark", F.col("v").alias("_v"), F.col("seg").alias("_s"), "at").join(judged, (F.col("grp") == F.col("_g")) & (F.col("mark") == F.col("_m"))).select("_v", "_s", "at", "ranges")
    held = written(found, "suffix-found")
    starts = some.select("v", "seg", "key", "lo").join(held, (F.col("v") == F.col("_v")) & (F.col("seg") == F.col("_s"))).select("key", (F.col("lo") + F.col("at")).alias("lo"), F.explode("ranges").alias("r"))
    starts = starts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((F.col("lo") + F.col("r.s")).alias("s"), (F.col("lo") + F.col("r.e")).alias("e")))).alias("starts"))
    starts = written(starts, "suffix-starts")  # a plain shuffle on both sides of the join that follows, which adaptive execution can split
    for table in (anchored, twice, some, sizes, bodies, windows, held):
        removed(table)
    return starts


def repeats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, n_bytes, n_removed, n_spans, the removed byte ranges and kept_sha256 of every row."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.unhex(F.md5(body.cast("binary")))
    starts = window_starts(docs.select(key.alias("key"), body.alias("text")))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)), key.alias("_key"), body.alias("text"))
    own = [f"_{i}" for i in range(len(keep))]
    columns = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*own, "_key"])
    packed = rows.mapInArrow(_packed, f"{columns}, packed binary")
    joined = packed.join(starts, F.col("_key") == F.col("key"), "left").select(*own, "packed", "starts")
    columns = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in own)
    made = joined.mapInArrow(_cut, f"{columns}n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<start:int,end:int>>, kept_sha256 string")
    return made.select(*(F.col(c).alias(name) for c, name in zip(own, keep, strict=True)), "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir), ["doc_id"]).drop("removed")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT k, p, md5(substr(x, 2 * p + 1, 800)) AS m FROM (SELECT k, x, unnest(range(0, n - 399)) AS p FROM d WHERE n >= 400)),
r AS (SELECT k, p FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
i AS (SELECT k, p, sum(new) OVER (PARTITION BY k ORDER BY p) AS island FROM (SELECT k, p, CASE WHEN p <= lag(p) OVER (PARTITION BY k ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT k, min(p) AS a, max(p) + 400 AS b FROM i GROUP BY k, island),
g AS (SELECT k, a, b, lag(b, 1, 0) OVER (PARTITION BY k ORDER BY a) AS before FROM s),
t AS (SELECT k, count(*) AS spans, sum(b - a) AS removed, max(b) AS last FROM g GROUP BY k),
h AS (SELECT k, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS pieces FROM g JOIN d USING (k) GROUP BY k)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(pieces, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (k) LEFT JOIN h USING (k)
"""
